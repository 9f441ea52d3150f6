from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from svlake.llm import token_files as T
from svlake.llm.common import by_bytes, scratch
from svlake.llm.queries import tokenizer_path

TEXTS = ["Hello world", "", "  two  spaces ", "tab\there\nline \n end", " lead", "don't it's 'quoted' I'll", "é ü ñ — “x”", "a b 　c", "<|endoftext|> in text", "see <|endoftext|> here", "end<|endoftext|>", "a\nb\nc d\n\ne", "line one.\nLine \nthree", "so\u00a0\nit", "well*** said!? it's; 9,5 don't.'", "x" * 3000, "\n", " ", "1 2  3\n\n4", "\x1c odd", "word " * 40_000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(reference):
    e = T.Encoder(tokenizer_path(), 2, most=5)
    assert e.by_words
    for texts in (TEXTS, TEXTS[:4], TEXTS[::-1], [], TEXTS):
        ids, counts = e.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*reference(t), 2] for t in texts] or not texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé9.,'!_ \n\t\r\x0b\x1c\x85\u00a0\u2028\u3000\u0301文😀<|>")), min_size=1, max_size=4))
def test_any_text_equals_the_library(reference, texts):
    e = _ENCODER.setdefault(0, None) or _ENCODER.update({0: T.Encoder(tokenizer_path(), 2)}) or _ENCODER[0]
    ids, counts = e.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*reference(t), 2] for t in texts]


_ENCODER: dict = {}


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    assert [b.column("text").to_pylist() for b in by_bytes(batch, "text", 20)] == [["a" * 10, None], ["b" * 50], ["", "c"]]


def test_round_trip(spark, reference):
    rows = [(i * 3 % 17, t) for i, t in enumerate(TEXTS)] + [(100, None), (100, "twice"), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(T.token_digests(docs, tokenizer_path()).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = [*reference(text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert T.token_digests(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_random_access_and_checksums(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"number {i} " * 50) for i in range(200)], "doc_id long, text string")
    base = scratch(spark, "t")
    manifest = T.write_token_files(docs, tokenizer_path(), base, frame_ids=500, shards=2)
    assert [r.doc_id for r in T.read_documents(spark, manifest, [7, 150, 999]).orderBy("doc_id").collect()] == [7, 150]
    uri = manifest.first().uri
    path = uri.removeprefix("file://")
    data = open(path, "rb").read()
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(-1) for _ in [0])
    reader = T.Reader(uri)
    assert whole == b"".join(ids.tobytes() for _, ids in reader.documents())
    wanted, held = int(reader.doc_id[-1]), []
    content = reader._content
    reader._content = lambda k, at: held.append(k) or content(k, at)
    assert len(list(reader.documents([wanted]))) == 1
    assert held == [int(reader.frame[-1])]
    at = int(reader.starts[0]) + int(reader.table[0][0]) // 2
    (tmp_path / "bad.zst").write_bytes(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(T.Reader(str(tmp_path / "bad.zst")).documents())
    (tmp_path / "cut.zst").write_bytes(data[:-5])
    with pytest.raises(ValueError, match="cut short"):
        T.Reader(str(tmp_path / "cut.zst"))


def test_clashing_columns(spark):
    from svlake.llm.queries import tokenizer_path
    from svlake.llm.token_files import token_digests

    rows = [(i, f"some text {i}", 5, "x", 9, 1, "s") for i in range(20)] + [(None, None, 5, "x", 9, 1, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, start int, n_tokens string, ids_crc32 int, shard int, uri string")
    plain = token_digests(d.select("doc_id", "text"), tokenizer_path()).collect()
    assert sorted(map(str, token_digests(d, tokenizer_path()).collect())) == sorted(map(str, plain))
