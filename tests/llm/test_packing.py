"""Packing against best-fit decreasing piece by piece, and pieces against the tokenizers library."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from svlake.llm import packing
from svlake.llm.queries import op12_packing, tokenizer_path


def plain_best_fit(lengths: list[int], capacity: int) -> list[int]:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fitting = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting)[1]] -= n
        else:
            rooms.append(capacity - n)
    return rooms


@pytest.mark.parametrize("capacity", [1, 7, 64, 100, 1024])
def test_plan_is_best_fit_decreasing(capacity):
    rng = np.random.default_rng(capacity)
    for k in range(40):
        top = max(1, capacity // (1 + k % 4))
        lengths = rng.integers(1, top + 1, rng.integers(0, 400)).tolist() + [int(rng.integers(1, top + 1))] * int(rng.integers(0, 60))
        table = packing.plan(Counter(lengths), capacity)
        ranks, filled = Counter(), defaultdict(list)
        for length, rank, n, first, each, offset in table.tolist():
            assert rank == ranks[length]
            ranks[length] += n
            for i in range(n):
                filled[first + i // each].append((offset + i % each * length, length))
        assert ranks == Counter(lengths)
        for held in filled.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in h) for h in filled.values()) == sorted(plain_best_fit(lengths, capacity))


def test_tightest_room():
    rng, rooms, held = np.random.default_rng(3), packing.Rooms(20), Counter()
    for _ in range(500):
        room = int(rng.integers(0, 21))
        if held[room] and rng.random() < 0.6:
            held[room] -= 1
            rooms.add(room, -1)
        else:
            held[room] += 1
            rooms.add(room, 1)
        for need in range(21):
            assert rooms.tightest(need) == min((r for r, n in held.items() if n and r >= need), default=None)


def test_plan_stays_small():
    """A plan has a few rows for each length, however many pieces there are."""
    rng = np.random.default_rng(5)
    for counts in ({n: int(rng.integers(1, 10**9)) for n in range(1, 1025)}, {n: 10**11 // n**2 + 1 for n in range(1, 1025)}, {n: 1 for n in range(1, 1025)}):
        assert len(packing.plan(counts)) < 11 * 3 * 1024


def check(pieces: list, texts: dict, capacity: int = 1024) -> None:
    library = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        found = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in found:
            assert r.start == at
            assert r.length == capacity or r.piece == 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in h) for h in by_sequence.values()) == sorted(plain_best_fit([r.length for r in pieces], capacity))


def test_query(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    check(op12_packing(spark, sf_dir).collect(), texts)


def test_sequences_hold_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    made = packing.pieces(docs, tokenizer_path()).repartition(3)
    placed = packing.place(made)
    ids = defaultdict(dict)
    for r in packing.sequences(placed).collect():
        assert len(r.ids) == 4 * r.n_tokens <= 4096
        for d in r.documents:
            ids[d.doc_id][d.piece] = bytes(r.ids[4 * d.offset : 4 * (d.offset + d.length)])
    library = Tokenizer.from_file(tokenizer_path())
    for doc_id, text in docs.select("doc_id", "text").collect():
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(ids[doc_id][k] for k in sorted(ids[doc_id])) == want


def test_odd_rows(spark):
    long = "word " * 3000
    rows = [(1, "same", 1, "p"), (1, "same", 1, "p"), (None, "same", None, None), (2, None, 0, ""), (3, "", 0, ""), (4, long, 0, ""), (5, " \n ", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, ids string")
    got = packing.place(packing.pieces(df, tokenizer_path())).collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 2, None: 1, 2: 1, 3: 1, 4: 3, 5: 1})
    assert {r.length for r in got if r.doc_id in (2, 3)} == {1}
    assert sorted(r.length for r in got if r.doc_id == 4)[1:] == [1024, 1024]
    assert packing.place(packing.pieces(df.where("doc_id > 9"), tokenizer_path())).count() == 0


def test_lengths_beyond_the_capacity_are_refused(spark):
    with pytest.raises(ValueError, match="between 1 and 10"):
        packing.place(spark.createDataFrame([(11, 0, 0)], "length long, task int, nth long"), 10)
