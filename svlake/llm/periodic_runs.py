"""Periodic runs of words, found by the power-of-two naming of Karp, Miller and Rosenberg.

Level k names the 2**k words from each place so that equal names mean equal words; level k + 1 names pairs of names of level
k. Naming ends at the first level without a repeated name. The longest common extension of two places goes down the levels,
a step of 2**k wherever the names agree. A stretch of period p and at least 2 p words holds a place i divisible
by p with words i and i + p alike within it, so the grid of multiples of p, for every p up to the longest repeat, has a
candidate of every run; extending it both ways gives the run whole. All of it is exact, without fingerprints or suffix sorting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes

LEAST = 12
#: About so many bytes of text are split at once, and so many grid places looked at.
CALL_BYTES, CALL_PLACES = 4_000_000, 1 << 20


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words from each place, up to the last level on which a name repeats (level 0 always)."""
    levels = [words.astype(np.int64, copy=False)]
    while (span := 1 << (len(levels) - 1)) < len(levels[-1]):
        below = levels[-1]
        names = np.unique(below[:-span] * (int(below.max()) + 1) + below[span:], return_inverse=True)[1]
        if int(names.max()) + 1 == len(names):
            break
        levels.append(names)
    return levels


def extensions(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from places ``a`` and ``b`` on are the same, and how many before them; a < b."""
    n, ahead, back = len(levels[0]), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        span, names = 1 << k, levels[k]
        can = np.flatnonzero(b + ahead + span <= n)
        ahead[can[names[a[can] + ahead[can]] == names[b[can] + ahead[can]]]] += span
        can = np.flatnonzero(a - back >= span)
        back[can[names[a[can] - back[can] - span] == names[b[can] - back[can] - span]]] += span
    return ahead, back


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) by start, then period: every maximal stretch of ``words`` (numbers that say which are
    the same) of at least max(least, twice its smallest period) words."""
    n, levels = len(words), name_levels(words)
    longest = min((1 << len(levels)) - 1, n)  # no two places have more words in common
    periods = np.arange(1, min(longest, n // 2) + 1, dtype=np.int64)
    periods = periods[np.maximum(least - periods, periods) <= longest]
    if not len(periods):
        return np.empty((0, 3), np.int64)
    places = -(-(n - periods) // periods)
    ends, found = np.cumsum(places), [np.empty((0, 3), np.int64)]
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + CALL_PLACES, "right")))
        p = np.repeat(periods[at:to], places[at:to])
        i = (np.arange(len(p)) - np.repeat(ends[at:to] - places[at:to] - ends[at] + places[at], places[at:to])) * p
        alike = np.flatnonzero(levels[0][i] == levels[0][i + p])
        i, p = i[alike], p[alike]
        ahead, back = extensions(levels, i, i + p)
        whole = ahead + back + p
        good = whole >= np.maximum(least, 2 * p)
        found.append(np.stack([i - back, whole, p], axis=1)[good])
        at = to
    every = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    smallest = np.ones(len(every), bool)
    smallest[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)  # the same stretch also has the multiples of its period
    every = every[smallest]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when each run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts without nulls, one text's after the other, and where each text's words begin, the end last."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    words = np.asarray(pc.binary_length(flat)) > 0  # white space at an end leaves an empty piece there
    at = np.concatenate([[0], np.cumsum(words)])[offsets - offsets[0]]
    return flat.filter(pa.array(words)), at


def _runs(least: int):
    def run(batches):
        for batch in batches:
            for some in by_bytes(batch, "text", CALL_BYTES):
                words, at = split_words(pc.fill_null(some.column("text"), ""))
                names = np.asarray(words.dictionary_encode().indices, dtype=np.int64)
                found, stay = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    found.append(find_runs(names[a:b], least))
                    stay.append(kept_words(b - a, found[-1]))
                stay = np.concatenate([np.zeros(0, bool), *stay])
                ends = np.concatenate([[0], np.cumsum(stay)])[at].astype(np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.filter(pa.array(stay))), " ")
                flat = np.concatenate([np.empty((0, 3), np.int64), *found])
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
                counts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                made = [some.column("doc_id"), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(counts), spans), text]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (array of start, length, period, in words, by start,
    then period) and collapsed (the words left when each run keeps only its first period, joined by single spaces).

    Words are runs of anything but ASCII white space of the whole text. Null texts and texts without words have no runs
    and collapse to the empty string; rows without doc_id and repeated rows are judged as any other; other columns are ignored;
    an empty table gives no rows. A row is judged by itself, nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runs(least), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one of ten documents, chosen by the crc32 of its decimal doc_id, repeats a stretch of its words up to its
    end: with h the crc32 and g = h div 10, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    Rows without doc_id and texts without words stay as they are."""
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("if(n > 0, cast(g % n as int), null)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: doc_id, n_runs, the longest run (the first of equals, then that of the smaller period) as start,
    length, period and exponent_milli, nulls without runs, and sha256 of the listed runs and of the collapsed text."""
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
