"""Filter interaction audit: what every filter removes at every place of every order of the filters.

A document is only a part and a mask, whose bit f says that it fails filter f. The histogram of masks, one row for all
documents of a part, one for the labelled good ones and one for the toxic ones, is all that the orders need: outcomes of
each (order, step) are a 0/1 column over the masks, so the audit is histogram x matrix, with integer matrices of
2**filters rows and a column per order and step (32 by 600 for five filters) for kept, removed, redundant and unique outcomes.
The work on documents is one pass; the orders cost nothing more however many documents there are.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@lru_cache(maxsize=4)
def outcomes(filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which filter stands at each (order, step), then the matrices masks x (order, step): kept, removed, redundant, unique."""
    orders = np.array(list(permutations(range(filters))), np.int64).reshape(-1, filters)
    own = 1 << orders
    upto = np.cumsum(own, axis=1)
    own, before, upto = own.ravel(), (upto - own).ravel(), upto.ravel()
    mask = np.arange(1 << filters)[:, None]
    fails, earlier = (mask & own) > 0, (mask & before) > 0
    return orders.ravel(), *(m.astype(np.int64) for m in ((mask & upto) == 0, fails & ~earlier, fails & earlier, mask == own))


def text_failures(text: Column) -> list[Column]:
    """Failures that a text shows by itself, a null text being empty: under 100 words; under 80 % of the words distinct; over
    10 % of the code points in A-Z; any of ``#$%&*|``. Words are runs of anything but ASCII white space, told apart by case."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, points = F.size(words), F.length(text)
    capitals = points - F.length(F.translate(text, UPPER, ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * points, text.rlike(r"[#$%&*|]")]


def repeats(rows: DataFrame, key: str, number: str) -> tuple[DataFrame, Column]:
    """``rows`` with what it takes to tell whether a smaller ``number`` (never null) has the same ``key``, and that condition.

    The smallest numbers are aggregated before they are shuffled; the join is on key and number, so a key with a third
    of all rows is spread by its numbers."""
    first, same = free_name(rows, "first_number"), free_name(rows, "first_key")
    least = rows.groupBy(F.col(key).alias(same)).agg(F.min(number).alias(first))
    return rows.join(least, (F.col(key) == F.col(same)) & (F.col(number) == F.col(first)), "left"), F.col(first).isNull()


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of ``mask``, bits 0 to 3 for
    ``text_failures``, bit 4 for texts that are identical to that of any smaller doc_id.

    Null texts are empty texts, a null part is the empty string. Rows without doc_id count as documents without labels; every
    doc_id is smaller than none, and rows that share a doc_id are no repeats of each other. A document is good or toxic if
    any label row of its id says 1. Other columns are ignored; an empty table gives no rows."""
    failures = text_failures(F.col("text"))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failures)), F.lit(0))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(number.alias("number"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("alone"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest"))
    rows, repeated = repeats(rows, "digest", "number")
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("number"))
    marks = marks.agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    rows = rows.select("number", "part", (F.col("alone") + F.when(repeated, F.lit(16)).otherwise(F.lit(0))).alias("mask")).join(marks, "number", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def audit(histogram: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, filter, and ``COUNTS``) for each part of ``histogram`` (part, mask, n, good, toxic), every
    order of the filters ``names`` (a letter each, bit by bit of the mask) and every step, zeros included.

    kept: passed all filters so far; removed: by this step; redundant: fail this step's filter but were removed before;
    unique_fails: fail no other filter; good_lost and toxic_lost: labelled ones among the removed; shapley: what the filter
    removes, summed over all orders. Masks with bits beyond ``names`` are an error."""
    bits, steps = 1 << len(names), len(names)
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")  # a part has 2**filters cells at most

    def multiply(batches):
        at, kept, removed, redundant, unique = outcomes(steps)
        orders = ["".join(names[i] for i in at[k : k + steps]) for k in range(0, len(at), steps)]
        for batch in batches:
            parts, lists = batch.column("part"), batch.column("cells")
            h = np.zeros((3, len(parts), bits), np.int64)
            flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
            row, cell = np.repeat(np.arange(len(parts)), sizes), flat.field("mask").to_numpy(zero_copy_only=False)
            for k, name in enumerate(("n", "good", "toxic")):
                np.add.at(h[k], (row, cell), flat.field(name).to_numpy(zero_copy_only=False))
            gone = h @ removed
            by_filter = np.stack([gone[0][:, at == f].sum(axis=1) for f in range(steps)], axis=1)
            values = [h[0] @ kept, gone[0], h[0] @ redundant, h[0] @ unique, gone[1], gone[2], by_filter[:, at]]
            made = [parts.take(pa.array(np.repeat(np.arange(len(parts)), len(at)))), pa.array([o for o in orders for _ in range(steps)] * len(parts), pa.string())]
            made += [pa.array(np.tile(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders)), len(parts))), pa.array([names[i] for i in at] * len(parts), pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *(pa.array(v.ravel()) for v in values)], ["part", "filter_order", "step", "filter", *COUNTS])

    schema = "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in COUNTS)
    return histogram.groupBy("part").agg(cells).mapInArrow(multiply, schema)


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of ``masks``, called A to E, by language."""
    return audit(masks(docs, labels), "ABCDE")
