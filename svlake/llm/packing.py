"""Best-fit packing: documents' tokens in as few sequences of at most ``CAPACITY`` tokens as best-fit decreasing finds.

Best-fit decreasing places the pieces from the longest to the shortest, each in the open sequence with the least room that
still holds it. Pieces of one length are interchangeable, and so are sequences with the same room, so the outcome depends
on the histogram of lengths alone, which has ``CAPACITY`` entries however many documents there are. A segment tree over
remaining capacities finds the tightest room in logarithmic time; runs of equal sequences are placed together. The plan, a
few segments for each length, says for the r-th piece of a length which sequence and offset it gets; pieces
find their places in parallel by their rank. It is the packing that placing all documents of the table one after another gives.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes, materialise, small
from .token_files import CALL_BYTES, END_ID, Encoder

CAPACITY = 1024
_ENCODERS: dict[tuple[str, int], Encoder] = {}


class Rooms:
    """A segment tree over the capacities 0 to ``capacity``: a leaf counts what is open with that much room, a node its leaves."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that anything open has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first node with something open to the right
            at >>= 1
        if at == 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for ``counts`` pieces of each length (1 to ``capacity``): rows (length, first rank, pieces, first
    sequence, pieces a sequence, offset), by length and rank. A run of sequences with equal room is refilled at most
    log2(capacity) times, since filling leaves less than half of the room, so there are a few rows for each length."""
    rooms, held, opened, out = Rooms(capacity), defaultdict(list), 0, []

    def put(first: int, n: int, room: int) -> None:
        if n and room:
            held[room].append((first, n))
            rooms.add(room, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = held[room].pop()
                rooms.add(room, -1)
            each = room // length  # the next of equal pieces goes to the same sequence as long as it fits
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for at, some, per in ((first, full, each), (first + full, int(rest > 0), rest)):
                if some:
                    out.append((length, rank, some * per, at, per, capacity - room))
                    rank, left = rank + some * per, left - some * per
                    put(at, some, room - per * length)
            put(first + full + (rest > 0), n - full - (rest > 0), room)
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def _cut(doc_id: pa.Array, ids: np.ndarray, counts: np.ndarray, capacity: int, seen: np.ndarray, task: int) -> pa.RecordBatch:
    """Documents' pieces, numbered within their length by ``seen``, which goes on counting."""
    n = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = (counts - (n - 1) * capacity)[doc]
    length = np.where(piece == 0, first, capacity)
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    nth = np.empty(len(length), np.int64)
    nth[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
    seen += np.bincount(length, minlength=len(seen))
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
    packed = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4", copy=False).tobytes())])
    columns = {"doc_id": doc_id.take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length.astype(np.int64)), "ids": packed}
    columns |= {"task": pa.array(np.full(len(length), task, np.int32)), "nth": pa.array(nth)}
    return pa.RecordBatch.from_pydict(columns)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth), written: the tokens of every whole text followed by ``end_id``, uncut up
    to ``capacity`` tokens; longer ones in pieces of ``capacity``, of which the first may be shorter.

    ``ids`` are 32-bit little-endian; ``nth`` numbers the pieces of a length within the task that made them. Null texts are
    empty and hold the end id alone; rows without doc_id and repeated rows are documents of their own; other columns are
    ignored; an empty table has no pieces."""
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        if (tokenizer, end_id) not in _ENCODERS:
            _ENCODERS[tokenizer, end_id] = Encoder(tokenizer, end_id)
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for some in by_bytes(batch, "text", CALL_BYTES):
                ids, counts = _ENCODERS[tokenizer, end_id].encode(pc.fill_null(some.column("text"), ""))
                yield _cut(some.column("doc_id"), ids, counts, capacity, seen, task)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary, task int, nth long"), "pieces")


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (length, task, nth and any others) with sequence_id and offset in place of task and nth.

    (task, length, nth) must be distinct, nth counting from 0 without gaps. Only the histogram of lengths, ``capacity`` rows, and the
    plan made from it pass through the driver; how many pieces of its length come before a task's is a prefix sum over tasks."""
    spark = made.sparkSession
    by_task = materialise(made.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # a row for each length, ``capacity`` at most
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    table = plan(counts, capacity)
    shared = spark.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = shared.value
        length, rank = length.to_numpy(), rank.to_numpy()
        row = rows[np.searchsorted(keys, length << 40 | rank, "right") - 1]
        within = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + within // row[:, 4], "offset": row[:, 5] + within % row[:, 4] * length})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(small(bases), ["task", "length"]).withColumn("place", find("length", F.col("nth") + F.col("base")))
    return ranked.select(*[F.col(f"`{c}`") for c in made.columns if c not in ("task", "nth")], "place.*")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, documents): the packed sequences of ``placed`` pieces, ``documents`` saying by offset which
    piece of which document begins there. A sequence has at most ``CAPACITY`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    rows = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda got, p: F.concat(got, p["ids"]))
    listed = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p["doc_id"].alias("doc_id"), p["piece"].alias("piece")))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"), listed.alias("documents"))
