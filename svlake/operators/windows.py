"""Genomic windows around calls: insertions, deletions, exclusion zones and sampled negatives. Half-open, 0-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svlake.operators.overlap import with_bins

HUMAN = [*map(str, range(1, 23)), "X", "Y"]


def allowed(df: DataFrame, names: list[str] = HUMAN) -> DataFrame:
    return df.where(F.col("chrom").isin(names))


def _clamp(begin: Column, end: Column, length: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0).cast("bigint"), begin), F.when(end >= length, length - 1).otherwise(end)


def insertion_windows(calls: DataFrame, sizes: DataFrame, gap: int = 1024) -> DataFrame:
    """Windows of ``gap`` bases on either side of each call's pos. ``sizes`` (chrom, len) is small."""
    begin, end = _clamp(F.col("pos") - 1 - gap, F.col("pos") - 1 + gap, F.col("len"))
    return calls.join(F.broadcast(sizes), "chrom").withColumns({"begin": begin, "end": end}).drop("len")


def deletion_windows(calls: DataFrame, sizes: DataFrame) -> DataFrame:
    """Windows from a quarter of a deletion's length before it to a quarter after it (at least 1), from pos and stop."""
    gap = F.expr("(stop - pos) div 4")
    gap = F.when(gap == 0, 1).otherwise(gap)
    begin, end = _clamp(F.col("pos") - 1 - gap, F.col("stop") - 1 + gap, F.col("len"))
    return calls.join(F.broadcast(sizes), "chrom").withColumns({"begin": begin, "end": end}).drop("len")


def valid(windows: DataFrame) -> DataFrame:
    """Windows that aren't inverted, as those of deletions whose end is unknown are."""
    return windows.where("end > begin")


def near_calls(points: DataFrame, calls: DataFrame, gap: int = 1024) -> DataFrame:
    """Points (chrom, at, ...) that lie within pos - gap ... pos + gap - 1 of a call (chrom, pos): the exclusion zone, as an
    equi-join on bins as wide as the zone."""
    width = 2 * gap
    zone = calls.select("chrom", "pos").distinct().withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos") - gap) / width), F.floor((F.col("pos") + gap - 1) / width))))
    p = points.withColumn("bin", F.floor(F.col("at") / width))
    hit = (p.chrom == zone.chrom) & (p.bin == zone.bin) & p["at"].between(zone.pos - gap, zone.pos + gap - 1)
    return p.join(zone, hit, "left_semi").drop("bin")


SPAN = 65_536  # bases whose free stretches are one row


def free_spans(calls: DataFrame, sizes: DataFrame, gap: int = 1024, span: int = SPAN) -> DataFrame:
    """(chrom, bin, free, n, before): for each ``span`` bases of a chromosome the stretches (s, e), from 1, inclusive, that lie outside
    the exclusion zones pos - gap ... pos + gap - 1 of all calls, how many bases they have and how many are free before
    them. A row holds the positions of one span, so its size doesn't grow with the calls."""
    every = sizes.select("chrom", "len", F.explode(F.expr(f"sequence(0L, len div {span})")).alias("bin"))
    at = calls.where("pos is not null").select("chrom", F.col("pos").cast("long").alias("pos"))
    at = at.withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos") - gap) / span), F.floor((F.col("pos") + gap - 1) / span))))
    at = at.groupBy("chrom", "bin").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    bounds = F.struct(F.greatest(F.lit(1), F.col("bin") * span).alias("s"), F.least("len", F.col("bin") * span + span - 1).alias("e"))
    rows = every.join(at, ["chrom", "bin"], "left").select("chrom", "bin", bounds.alias("b"), F.coalesce("at", F.expr("cast(array() as array<bigint>)")).alias("at"))
    step = f"if(p - {gap} > a.s, named_struct('s', greatest(a.s, p + {gap}), 'f', concat(a.f, array(named_struct('s', a.s, 'e', p - {gap} - 1)))), named_struct('s', greatest(a.s, p + {gap}), 'f', a.f))"
    start = "named_struct('s', b.s, 'f', cast(array() as array<struct<s: bigint, e: bigint>>))"
    free = f"filter(aggregate(array_append(at, b.e + {gap} + 1), {start}, (a, p) -> {step}, a -> transform(a.f, x -> named_struct('s', x.s, 'e', least(x.e, b.e)))), x -> x.e >= x.s)"
    rows = rows.withColumn("free", F.expr(free)).withColumn("n", F.expr("aggregate(free, 0L, (t, x) -> t + x.e - x.s + 1)"))
    before = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row per span
    return rows.select("chrom", "bin", "free", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def negative_windows(deletions: DataFrame, calls: DataFrame, sizes: DataFrame, copies: int = 2, gap: int = 1024) -> DataFrame:
    """For each deletion window (id, chrom, begin, end) ``copies`` windows of its length that start outside the exclusion zone and
    keep more than half of the length within the chromosome. The starts that fit are counted, and md5(id, copy) draws one
    of them by its place; so every copy has a window unless nothing fits. The draw depends on nothing but the row and the zones."""
    spans = free_spans(calls, sizes, gap)
    d = deletions.join(F.broadcast(sizes), "chrom").withColumn("length", F.col("end") - F.col("begin"))  # sizes: a row per chromosome
    half = F.expr("length div 2")
    d = d.withColumns({"lo": F.greatest(F.lit(1), half + 2 + gap - F.col("length")), "hi": F.least("len", F.col("len") + gap - half - 1)}).where("lo <= hi")
    # Free places up to lo - 1 and up to hi, from the spans that hold these.
    ends = d.select("id", "chrom", "len", "length", F.explode(F.array(F.col("lo") - 1, F.col("hi"))).alias("x"), "lo").withColumn("bin", F.expr(f"x div {SPAN}"))
    upto = F.col("before") + F.expr("aggregate(free, 0L, (t, y) -> t + greatest(0L, least(x, y.e) - y.s + 1))")
    counted = ends.join(spans, ["chrom", "bin"]).groupBy("id", "chrom", "len", "length").agg(F.max(F.when(F.col("x") < F.col("lo"), upto)).alias("below"), F.max(upto).alias("upto"))
    draws = counted.where("upto > below").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "id", "copy").cast("binary")), 1, 15), 16, 10).cast("bigint")
    draws = draws.withColumn("nth", F.col("below") + draw % (F.col("upto") - F.col("below"))).withColumn("slot", F.expr(f"nth div {SPAN}"))
    # The place of that rank: a span has at most SPAN free bases, so it meets two slots of ranks at most.
    ranks = spans.where("n > 0").withColumn("slot", F.explode(F.expr(f"sequence(before div {SPAN}, (before + n - 1) div {SPAN})")))
    found = draws.join(ranks, ["chrom", "slot"]).where("nth >= before and nth < before + n")
    walk = "if(a.at is not null, a, if(a.left <= y.e - y.s, named_struct('left', a.left, 'at', y.s + a.left), named_struct('left', a.left - (y.e - y.s + 1), 'at', a.at)))"
    found = found.withColumn("start", F.expr(f"aggregate(free, named_struct('left', nth - before, 'at', cast(null as bigint)), (a, y) -> {walk}, a -> a.at)"))
    begin, end = _clamp(F.col("start") - 1 - gap, F.col("start") - 1 - gap + F.col("length"), F.col("len"))
    return found.select("id", "copy", "chrom", "start", begin.alias("begin"), end.alias("end"))


def first_seen(calls: DataFrame) -> DataFrame:
    """(chrom, rank): chromosomes in the order in which they first occur."""
    return calls.groupBy("chrom").agg(F.min("ord").alias("ord")).select("chrom", F.dense_rank().over(Window.orderBy("ord")).alias("rank"))


__all__ = ["HUMAN", "allowed", "deletion_windows", "first_seen", "free_spans", "insertion_windows", "near_calls", "negative_windows", "valid", "with_bins"]
