"""Exact order statistics without a group in one task: ranks found by counting value ranges, and statistics of counted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svlake.operators.match import _kept
from svlake.operators.overlap import _small

#: Ranges that a range is cut into by a pass, and distinct values that a range may have for its ranks to be read off.
BINS, FEW = 1024, 10_000


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, n, q: for each group the quantiles of ``value`` at ``probs``, linearly interpolated between its neighbours in rank.

    A pass counts a group's values by equal ranges between its least and largest; those that hold a wanted rank are cut
    again by the next pass, until they have few distinct values (two or three passes, since each cuts by ``bins``). Counts are summed before
    they are shuffled, so neither a large group nor one value with most rows weighs on a task. Nulls, NaN and infinities take no part;
    groups without values have no row; null keys are a group. No rows give no rows."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    by = list(names.values())
    data = rows.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(value).cast("double").alias("v")).where("abs(v) < double('infinity')")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by] or [F.lit(True)]
    groups = _kept(data.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0"))
    # A wanted rank of a group: the range of values [lo, hi] that holds it, and how many values lie below that range.
    at = [F.col("n").cast("double") - 1 if p == 1 else (F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(a), F.ceil(a)) for a in at]))
    wanted = _kept(groups.select(*by, "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.explode(ranks).alias("rank")))
    while True:
        ranges = wanted.where((F.col("lo") < F.col("hi")) & (F.col("inside") > few)).select(*by, "lo", "hi", "below").distinct()
        if not ranges.limit(1).count():
            break
        ranges = _kept(ranges)
        met = data.alias("d").join(_small(ranges).alias("r"), same("d", "r")).where("v between lo and hi")
        slot = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins).cast("int"))
        counted = met.groupBy(*[F.col(f"r.{k}").alias(k) for k in by], "lo", "hi", "below", slot.alias("slot")).agg(F.count("*").alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
        upto = Window.partitionBy(*by, "lo", "below").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # ``bins`` rows
        parts = _kept(counted.withColumn("end", F.col("below") + F.sum("c").over(upto)))
        hit = wanted.alias("w").join(parts.alias("p"), [*same("w", "p"), F.col("w.lo") == F.col("p.lo"), F.col("w.below") == F.col("p.below"), F.col("rank") < F.col("end"), F.col("rank") >= F.col("end") - F.col("c")])
        cut = hit.select(*[F.col(f"w.{k}").alias(k) for k in by], F.col("from").alias("lo"), F.col("to").alias("hi"), (F.col("end") - F.col("c")).alias("below"), F.col("c").alias("inside"), "rank")
        wanted = _kept(wanted.where((F.col("lo") == F.col("hi")) | (F.col("inside") <= few)).unionByName(cut))
    one = wanted.where("lo = hi").select(*by, "rank", F.col("lo").alias("v"))
    open_ = wanted.where("lo < hi")
    ranges = open_.select(*by, "lo", "hi", "below").distinct()
    met = data.alias("d").join(_small(ranges).alias("r"), same("d", "r")).where("v between lo and hi")
    counted = met.groupBy(*[F.col(f"r.{k}").alias(k) for k in by], "lo", "below", "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*by, "lo", "below").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # ``few`` rows
    ended = counted.withColumn("end", F.col("below") + F.sum("c").over(upto))
    read = open_.alias("w").join(ended.alias("p"), [*same("w", "p"), F.col("w.lo") == F.col("p.lo"), F.col("w.below") == F.col("p.below"), F.col("rank") < F.col("end"), F.col("rank") >= F.col("end") - F.col("c")])
    found = one.unionByName(read.select(*[F.col(f"w.{k}").alias(k) for k in by], "rank", "v")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))  # two ranks for each of ``probs``
    out = groups.alias("g").join(found.alias("f"), same("g", "f"))
    low, high = lambda a: F.col("of")[F.floor(a)], lambda a: F.col("of")[F.ceil(a)]
    q = F.array(*[F.when(F.floor(a) == F.ceil(a), low(a)).otherwise((F.ceil(a) - a) * low(a) + (a - F.floor(a)) * high(a)) for a in at])
    return out.select(*[F.col(f"g.{n}").alias(k) for k, n in names.items()], "n", q.alias("q"))


def counted_stats11(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """keys and size, v_min, v_q1, v_q2, v_q3, v_max, rms, hm, mean, std, cv of groups of positive values given as rows (keys, value, n: how often), as
    ``arrays.stats11`` has them of the sorted values behind a 0, which counts in ``size`` only. Quartiles are read off running
    counts, so a group is as large as it has different values, however often each occurs."""
    of = Window.partitionBy(*keys)
    x, c = F.col(value).cast("double"), F.col(n)
    rows = counts.withColumns({"_n": F.sum(c).over(of), "_mean": F.sum(c * x).over(of) / F.sum(c).over(of), "_end": F.sum(c).over(of.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    total, mean = F.first("_n"), F.first("_mean")
    at = lambda k: F.max(F.when((F.col("_end") > F.floor(k * F.col("_n") / 4)) & (F.col("_end") - c <= F.floor(k * F.col("_n") / 4)), x))
    std = F.sqrt(F.sum(c * (x - F.col("_mean")) * (x - F.col("_mean"))) / total)
    made = rows.groupBy(*keys).agg(
        (total + 1).alias("size"), F.min(x).alias("v_min"), at(1).alias("v_q1"), at(2).alias("v_q2"), at(3).alias("v_q3"), F.max(x).alias("v_max"),
        F.sqrt(F.sum(c * x * x) / total).alias("rms"), (total / F.sum(c / x)).alias("hm"), mean.alias("mean"), std.alias("std"),
    )
    return made.withColumn("cv", F.col("std") / F.col("mean"))
