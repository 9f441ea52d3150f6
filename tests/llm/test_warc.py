from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest

from svlake.llm import warc as W
from svlake.llm.common import scratch

SCHEMA = "page_id long, url string, html string, refers_to string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    rng = random.Random(1)
    bodies = ["<p>é</p>", "", None, "same", "x" * 300_000, "\r\n\r\nhead"]
    rows = [(i, rng.choice(["http://www.b.org/x?y", "https://a.com:8443/", None, "not a url\r\n", "http://a.com/"]), bodies[i % 6] if i % 3 else f"own {i}") for i in range(60)]
    rng.shuffle(rows)
    got = W.capture_histories(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), archive_bytes=2_000).collect()
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    assert len(got) == 60
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), digest(html))
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == r.page_id else ("revisit", first[html]))
    ordered = sorted(got, key=lambda r: (r.range, r.place))
    keys = [(r.url_key, r.timestamp) for r in ordered]
    assert keys == sorted(keys)


def test_edges(spark):
    rows = [(None, "u", "same", None), (5, "u", "same", None), (5, "u", "same", None), (None, None, "alone", None)]
    got = W.capture_histories(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("5", "response", None), ("5", "response", None), ("None", "response", None), ("None", "revisit", 5)]
    assert W.capture_histories(spark.createDataFrame([], SCHEMA)).count() == 0
    few = W.capture_histories(spark.createDataFrame([(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abc", None), (4, "u", "abc", None)], SCHEMA), least_bytes=3).collect()
    assert {r.page_id: r.record_type for r in few} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    entry = lambda: (rng.choice("abc"), str(rng.randrange(5)), rng.randrange(9), 0, "", "", None, "f", rng.randrange(1000), 0)
    runs = [sorted((entry() for _ in range(rng.randrange(0, 30))), key=W._key) for _ in range(k)]
    assert list(W.merge([iter(r) for r in runs])) == sorted((e for r in runs for e in r), key=W._key)


def test_many_runs_are_merged_in_passes(spark):
    rows = [(i, f"http://h{i % 7}.org/{i % 3}", f"b{i}", None) for i in range(80)]
    base = scratch(spark, "w")
    runs = W.index_archives(W.write_archives(spark.createDataFrame(rows, SCHEMA), f"{base}/a", archive_bytes=600), f"{base}/r")
    assert runs.select("run").distinct().count() > 12
    got = W.merge_runs(runs, f"{base}/r", fan_in=4, ranges=3).collect()
    assert sorted(r.page_id for r in got) == list(range(80))
    ordered = [(r.url_key, r.timestamp) for r in sorted(got, key=lambda r: (r.range, r.place))]
    assert ordered == sorted(ordered)
    assert len({r.range for r in got}) > 1


def test_damage_is_noticed(tmp_path):
    data = W.record(1, "http://a/", b"payload", digest("other"), None, "2024-01-01T00:00:00Z", "")
    (tmp_path / "a.warc.gz").write_bytes(data)
    (r,) = W.records(str(tmp_path / "a.warc.gz"))
    with pytest.raises(ValueError, match="digest"):
        W.parse("a", *r)
    (tmp_path / "b.warc.gz").write_bytes(data[:-9])
    with pytest.raises(ValueError, match="cut short"):
        list(W.records(str(tmp_path / "b.warc.gz")))
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_url_keys():
    assert W.url_key("http://www.Example.com:80/A?b#c") == "com,example)/A?b"
    assert W.url_key("https://u@a.b:8443") == "b,a:8443)/"
    assert W.url_key(None) == W.url_key("") == ""


def test_frequent_and_rare_payloads(spark):
    """One payload that many pages share, and so many pairs that each is below a thousandth of the repeats."""
    rows = [(i, f"http://a/{i}", "hot" if i < 400 else f"pair {i // 2}", None) for i in range(2_600)]
    got = W.capture_histories(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert {r.page_id: r.refers_to for r in got} == {i: None if i == 0 or (i >= 400 and i % 2 == 0) else 0 if i < 400 else i - 1 for i in range(2_600)}
    assert len(got) == 2_600
