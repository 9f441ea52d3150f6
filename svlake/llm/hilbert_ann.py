"""Approximate nearest neighbours by largest inner product, over shifted Hilbert orderings of projected vectors.

Vectors get one more coordinate, sqrt(M**2 - |x|**2) with M the largest norm, which turns the largest inner product into the
smallest distance. A random rotation, fitted to the spread of a bounded sample, gives one 8-dimensional projection for each
ordering; each is shifted, quantised and laid along a Hilbert curve. Spark range-partitions the (ordering, key) pairs and
ranks them; a query meets the candidates within ``window`` ranks on either side in each ordering, and what the orderings
find is merged and ranked anew in double precision.

Equal vectors are one entry of the index with its smallest ids, so copies, however many, neither crowd a window nor get lost.
How wide a window must be depends on the data, so it is measured: a bounded number of queries is compared with every
vector, and the window is the smallest one in which the wanted share of their true neighbours lies. Clustered vectors need
few ranks, vectors without structure a part of the index; nothing else depends on the size. Candidates travel as one byte a
component; the best 2 k of each query are reranked on the vectors themselves. Both meet in cells of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

DIMS, BITS = 8, 4
QUERY_CELL = 65_536  # ranks of queries that may meet in one task step; of candidates it is the window, 512 to 4096
SAMPLE, PROBES = 10_000, 128  # rows that fit the projections, queries that measure the window


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, d), bit by bit from the most significant, after Skilling
    (2004): undo the excess rotations and reflections of each level, then Gray-decode and interleave."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            set_ = (x[i] >> level) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level) & 1
    return key


def _projections(sample: np.ndarray, orderings: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(width, orderings * DIMS) directions, their offsets and scales, so that projections of the sample fill the grid."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    made = []
    while sum(m.shape[1] for m in made) < orderings * DIMS:
        made.append(np.linalg.qr(rng.normal(size=(width, width)))[0])
    directions = np.concatenate(made, axis=1)[:, : orderings * DIMS]
    at = sample @ directions
    spread = np.maximum(at.std(axis=0), 1e-12)
    shift = rng.uniform(-0.5, 0.5, directions.shape[1])  # of a grid step, which is half of a standard deviation
    return directions, at.mean(axis=0) - (4 + shift / 2) * spread, 2 / spread


def _keyer(shared, orderings: int):
    def run(batches):
        directions, offset, scale, largest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_pylist()])
            extra = np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0))
            at = np.concatenate([x, extra[:, None]], axis=1) @ directions
            grid = np.clip((at - offset) * scale, 0, (1 << BITS) - 1).astype(np.int64).reshape(len(x), orderings, DIMS)
            keys = np.stack([hilbert_keys(grid[:, c], BITS) for c in range(orderings)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["rep", "keys"])

    return run


def _packer(batches):
    """Vectors as bytes -127 to 127 and what one is worth."""
    for batch in batches:
        if batch.num_rows:
            x = np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_pylist()])
            scale = np.abs(x).max(axis=1) / 127
            packed = np.rint(x / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(scale.astype(np.float32))], ["rep", "vector", "scale"])


def _unpacked(t: pa.Table) -> np.ndarray:
    x = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.int8).reshape(t.num_rows, -1)
    return x * t.column("scale").to_numpy()[:, None]


def _meet(k: int, window: int):
    """The k best candidates of each query within a pair of cells."""

    def run(key, candidates: pa.Table, queries: pa.Table):
        kinds = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float32())])
        if not candidates.num_rows or not queries.num_rows:
            return kinds.empty_table()
        x, ids, ranks = _unpacked(candidates), candidates.column("rep").to_numpy(), candidates.column("rank").to_numpy()
        q, qids, qranks = _unpacked(queries), queries.column("rep").to_numpy(), queries.column("rank").to_numpy()
        out = []
        for lo in range(0, len(q), 1024):
            s = q[lo : lo + 1024] @ x.T
            s[np.abs(qranks[lo : lo + 1024, None] - ranks[None, :]) > window] = -np.inf
            n = min(k, s.shape[1])
            best = np.argpartition(-s, n - 1, axis=1)[:, :n]
            found = np.take_along_axis(s, best, axis=1)
            row, col = np.nonzero(np.isfinite(found))
            out.append((qids[lo + row], ids[best[row, col]], found[row, col]))
        return pa.table([pa.array(np.concatenate([o[i] for o in out]), t) for i, t in enumerate(kinds.types)], schema=kinds)

    return run


def _scan(shared, k: int):
    """The k nearest of each probe within a partition, the probe itself left out."""

    def run(batches):
        ids, q = shared.value
        best_s, best_i = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = batch.column(0).to_numpy()
            s = q @ np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_pylist()]).T
            s[ids[:, None] == rep[None, :]] = -np.inf
            s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(rep, s.shape)], axis=1)
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(s, top, axis=1), np.take_along_axis(i, top, axis=1)
        row, col = np.nonzero(np.isfinite(best_s))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(best_i[row, col], pa.int64()), pa.array(best_s[row, col])], ["query", "rep", "score"])

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def ranked(reps: DataFrame, orderings: int, seed: int = 9) -> DataFrame:
    """(rep, c, rank): the place of each vector (rep, v), from 0, along each ordering c. Written before it is returned."""
    spark = reps.sparkSession
    largest = reps.agg(F.max(F.sqrt(_dot(F.col("v"), F.col("v"))))).first()[0]
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).collect()  # SAMPLE rows at most
    x = np.array([r.v for r in sample])
    x = np.concatenate([x, np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)
    shared = spark.sparkContext.broadcast((*_projections(x, orderings, seed), largest))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of (ordering, key) are counted, then rows are numbered within their range.
    keyed = reps.mapInArrow(_keyer(shared, orderings), "rep long, keys array<long>").select("rep", F.posexplode("keys").alias("c", "key"))
    ranged = materialise(keyed.repartitionByRange(parts, "c", "key", "rep").withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("c", "part").count()
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = sums.select("c", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("c", "part").orderBy("key", "rep"))
    return materialise(ranged.withColumn("r", local).join(small(sums), ["c", "part"]).select("rep", "c", (F.col("offset") + F.col("r") - 1).alias("rank")), "ranks")


def fitted_window(reps: DataFrame, asked: DataFrame, ranks: DataFrame, k: int, recall: float, probes: int = PROBES) -> int:
    """Ranks within which the share ``recall`` of the k nearest of ``probes`` queries lies in some ordering. The probes are
    the first in the order of a hash; each is compared with every vector."""
    spark = reps.sparkSession
    rows = asked.join(reps, "rep").orderBy(F.xxhash64("rep")).limit(probes).collect()  # probes rows at most
    if not rows:
        return k
    shared = spark.sparkContext.broadcast((np.array([r.rep for r in rows]), np.array([r.v for r in rows])))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    true = reps.mapInArrow(_scan(shared, k), "query long, rep long, score double").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query", "rep")
    true = F.broadcast(materialise(true, "probes"))  # probes * k rows at most
    mine = F.broadcast(ranks.join(true.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("query"), "c", F.col("rank").alias("mine")))  # probes * orderings rows
    apart = ranks.join(true, "rep").join(mine, ["query", "c"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("rank") - F.col("mine"))).alias("apart"))
    found = sorted(r.apart for r in apart.select("apart").collect())  # probes * k rows at most
    return max(k, found[min(len(found) - 1, int(recall * len(found)))] if found else k)


def nearest(vectors: DataFrame, query: Column, k: int = 20, orderings: int = 32, recall: float = 0.94, window: float | None = None, seed: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) that satisfies ``query``, its k
    nearest found among all other rows, nearest first, ties to the smaller vec_id; all of them if there are fewer.

    The window is fitted to ``recall``, or given as a share of the index; 1.0 compares all, which is exact. Rows without
    vec_id, with null, zero or other than the commonest number of components, with null or non-finite ones, and
    zero vectors take no part; of rows that share a vec_id, the smallest vector does. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), v.alias("v"), query.alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("size(v) > 0").where(finite).where(F.exists("v", lambda x: x != 0))
    rows = materialise(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    rows = rows.where(F.size("v") == lengths.n)
    # Classes of equal vectors: the first k + 1 ids of each are enough for every answer.
    first = Window.partitionBy("v").orderBy("vec_id")
    members = materialise(rows.select("v", "vec_id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))), "members")
    reps = members.where("r = 1").select("rep", "v")
    asking = materialise(rows.where("asks").join(reps, "v").select(F.col("vec_id").alias("query_id"), "rep"), "asking")
    asked = asking.select("rep").distinct()
    total = reps.count()
    ranks = ranked(reps, orderings, seed)
    half = fitted_window(reps, asked, ranks, k, recall) if window is None else max(1, int(window * total))
    cells = min(4096, max(512, 1 << (half - 1).bit_length()))

    packed = reps.mapInArrow(_packer, "rep long, vector binary, scale float")
    cell = lambda col, size: F.floor(col / size)
    reach = F.sequence(cell(F.greatest(F.col("rank") - half, F.lit(0)), cells), cell(F.least(F.col("rank") + half, F.lit(total - 1)), cells))
    queries = ranks.join(asked, "rep").withColumn("qc", cell(F.col("rank"), QUERY_CELL)).withColumn("cc", F.explode(reach)).join(packed, "rep")
    span = F.sequence(cell(F.greatest(F.col("cc") * cells - half, F.lit(0)), QUERY_CELL), cell(F.least(F.col("cc") * cells + cells + half, F.lit(total - 1)), QUERY_CELL))
    candidates = ranks.withColumn("cc", cell(F.col("rank"), cells)).withColumn("qc", F.explode(span)).join(packed, "rep")
    keys = ["c", "cc", "qc"]
    columns = [*keys, "rep", "rank", "vector", "scale"]
    apart = queries.select(*[F.col(c).alias(f"q_{c}") for c in columns]).toDF(*columns)  # the same columns under identities of their own
    found = candidates.select(*columns).groupBy(*keys).cogroup(apart.groupBy(*keys))
    found = found.applyInArrow(_meet(2 * k, half), "query long, rep long, score float")
    found = found.groupBy("query", "rep").agg(F.max("score").alias("near"))
    best = Window.partitionBy("query").orderBy(F.desc("near"), "rep")
    found = materialise(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * k).select("query", "rep"), "found")
    # Exact scores on the vectors themselves, then the members of the classes.
    a, b = reps.select(F.col("rep").alias("query"), F.col("v").alias("qv")), reps
    exact = found.join(a, "query").join(b, "rep").select("query", "rep", _dot(F.col("qv"), F.col("v")).alias("score"))
    spread = exact.join(members.select("rep", "vec_id"), "rep").select(F.col("query").alias("rep"), "vec_id", "score")
    answers = asking.join(spread, "rep").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
