"""Helpers shared by the text operators: tables, shared storage, word hashing, exact top-k, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, by contract: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one side of a join may have at most to be broadcast; beyond it Spark chooses the join.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local folder only for local masters."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="svlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/svlake/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps don't repeat the work, nor depend on executors' disks."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Arrow batches hold at most so many rows and about ``size`` bytes, so that a worker's memory doesn't grow with the texts. A
    plan reads these settings when it runs, so they stay set in the session; smaller ones are left alone."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if not 0 < int(str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).rstrip("bB")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table whose size has been checked; a larger one is left to Spark's choice of join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def among(rows: DataFrame, key: str, ids: DataFrame, most: int = 4_000_000, bits: int = 16, exact: bool = True) -> DataFrame:
    """Rows whose ``key``, a long, is in the one column of ``ids``. A bitmap of hashed ids, ``bits`` to 2 * ``bits`` for each, is broadcast first and drops nearly
    all other rows where they are read, so that texts aren't shuffled to be dropped; the join on the ids decides, which
    ``exact=False`` leaves to the caller. Beyond ``most`` ids there is no bitmap."""
    ids = ids.toDF(key).distinct()
    n = ids.count()
    if n <= most:
        slot = f"(xxhash64({key}) & {(1 << (bits * max(n, 64)).bit_length()) - 1}L)"
        word, bit = F.expr(f"shiftright({slot}, 6)"), F.expr(f"shiftleft(1L, cast({slot} & 63L as int))")
        maps = ids.select(word.alias("among_word"), bit.alias("among_bit")).groupBy("among_word").agg(F.bit_or("among_bit").alias("among_bits"))
        rows = rows.join(F.broadcast(maps), (word == F.col("among_word")) & (F.col("among_bits").bitwiseAND(bit) != 0), "left_semi")
    return rows.join(ids, key, "left_semi") if exact else rows


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible uniform draw in (0, 1) from the values of columns."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with a number behind it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"{name}{i or ''}") not in taken)


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a distinct number for each row, in the order of doc_id (nulls last), and the column's name. Where doc_id is
    distinct and never null it is the number itself; otherwise rows are sorted, numbered and written, so that
    the numbers stay the same whenever they are read."""
    key = free_name(docs, "row_key")
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    parts, order = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_last()
    return materialise(docs.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn(key, F.monotonically_increasing_id()), "keyed"), key


class WordHashes(dict):
    """64-bit hashes of words; keeps those of the first ``most`` distinct words, which bounds its memory."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value


WORDS = WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words: bytes.lower and bytes.split treat exactly the ASCII letters and white space."""
    words = (text or b"").lower().split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered pair of hashes as one."""
    h = a * _MUL + b + _MIX
    h ^= h >> np.uint64(32)
    h *= _MUL
    h ^= h >> np.uint64(29)
    return h


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of fewer words, the whole sequence as one; of none, empty."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    h = fold(np.full(n - width + 1, width, np.uint64), words[: n - width + 1])
    for j in range(1, width):
        h = fold(h, words[j : n - width + 1 + j])
    return np.unique(h)


def kth_largest(df: DataFrame, value: str, k: int, bins: int = 1024, few: int = 20_000) -> float:
    """The k-th largest value of a column, exactly: counts by equal bins narrow the range until few rows are left in it."""
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if n == 0 or k > n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while low < high:
        inside = df.where(F.col(value).between(low, high))
        width = (high - low) / bins
        if inside.limit(few + 1).count() <= few or width <= 0 or low + width == low:
            break
        slot = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("int"))
        rows = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(slot).agg(F.count("*"), F.min(value), F.max(value)).collect()}
        for b in sorted(rows, reverse=True):
            if k <= rows[b][0]:
                low, high = rows[b][1:]
                break
            k -= rows[b][0]
    if low == high:
        return low
    return df.where(F.col(value).between(low, high)).orderBy(F.desc(value)).limit(k).agg(F.min(value)).first()[0]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Labels fall to the least of the neighbours and jump
    along labels until none changes; every round is written to the shared folder, nothing is collected."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), label)
    now = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), label)
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = now.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lower = materialise(lower, label)
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        now = materialise(lower.join(up, "component", "left").select("node", "was", F.least("component", "top").alias("component")), label)
        if now.where("component <> was").limit(1).count() == 0:
            return now.select("node", "component")
        now = now.select("node", "component")


def arrow_texts(column: Iterable) -> list:
    """An Arrow string column as a list of bytes or None."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def by_bytes(batch, name: str, most: int) -> Iterable:
    """Slices of an Arrow batch whose texts have about ``most`` bytes together; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, most + (int(ends[at - 1]) if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to
