"""Differences and ordered unions of call sets, and rewriting of identifiers. Calls as in svlake.operators.match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svlake.functions import vcf_info as V
from svlake.operators import match as M


def difference(b: DataFrame, matches: DataFrame) -> DataFrame:
    """Calls of the second set that no match has taken."""
    return b.join(matches.select(F.col("j").alias("ord")), "ord", "left_anti")


def union_first(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """All of the first set, then what it lacks of the second: ``section`` 0 and 1, ordered by (section, chrom, pos, ord)."""
    return a.withColumn("section", F.lit(0)).unionByName(difference(b, matches).withColumn("section", F.lit(1)))


def union_interleaved(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """Calls of the first set in order, matched ones with the fused id, each followed by the calls of the second set that its
    match skipped; those behind a chromosome's last match come at its end. Ordered by (chrom, anchor, anchor_ord, kind, pos, ord)."""
    ids = matches.join(b.select(F.col("ord").alias("j"), F.col("id").alias("id2")), "j")
    first = a.join(ids.withColumnRenamed("i", "ord"), "ord", "left")
    first = first.withColumn("id", F.when(F.col("id2").isNotNull(), V.fused_id(F.col("id"), F.col("id2"))).otherwise(F.col("id")))
    first = first.select(*a.columns, F.col("pos").alias("anchor"), F.col("ord").alias("anchor_ord"), F.lit(0).alias("kind"))
    # The next match of the second set, in its order, anchors the calls before it.
    met = matches.join(a.select(F.col("ord").alias("i"), F.col("pos").alias("ai")), "i").withColumnRenamed("j", "ord")
    second = b.join(met, "ord", "left")
    # Tile by tile from the right: a running last value, and behind a tile's last match the next tile's first.
    second = second.withColumn("tile", F.floor(F.col("pos") / (M.TILE_CELLS * M.POS)))
    back = Window.partitionBy("chrom", "tile").orderBy(F.desc("pos"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("i").isNotNull(), F.struct("ai", "i")), ignorenulls=True).over(back)
    heads = second.groupBy("chrom", "tile").agg(F.min(F.when(F.col("i").isNotNull(), F.struct("pos", "ord", F.struct("ai", "i").alias("m")))).alias("head"))
    right = Window.partitionBy("chrom").orderBy(F.desc("tile")).rowsBetween(Window.unboundedPreceding, -1)  # a row per tile
    heads = heads.select("chrom", "tile", F.last("head.m", ignorenulls=True).over(right).alias("then"))
    second = second.withColumn("next", anchor).where("i is null").join(heads, ["chrom", "tile"]).withColumn("next", F.coalesce("next", "then"))
    second = second.select(*b.columns, F.coalesce("next.ai", F.lit((1 << 62))).alias("anchor"), F.coalesce("next.i", F.lit(1 << 62)).alias("anchor_ord"), F.lit(1).alias("kind"))
    return first.unionByName(second)


def union_merged(a: DataFrame, b: DataFrame, pos: int = M.POS, length: int = M.LEN) -> DataFrame:
    """Both sets in the order of the two-pointer merge; of a matched pair the first set's call. Ordered by (chrom, tile, step)."""
    steps = M.two_pointer_steps(a, b, pos, length)
    first = steps.where("i is not null").withColumnRenamed("i", "ord").join(a.drop("chrom"), "ord")
    second = steps.where("i is null").withColumnRenamed("j", "ord").join(b.drop("chrom"), "ord")
    columns = [*a.columns, "tile", "step"]
    return first.select(*columns).unionByName(second.select(*columns))


def fuse(sets: list[DataFrame], pos: int = M.POS, length: int = M.LEN) -> DataFrame:
    """What merging several call sets one after another by two pointers leaves, in one sweep over all of them: of each matched pair the call of the
    earlier sets. ord is made unique by the set's number in its highest bits. Calls without chrom or pos are left out; one set stays as it is."""
    tagged = [s.withColumn("ord", F.col("ord") + (k << 56)).withColumn("set", F.lit(k)) for k, s in enumerate(sets)]
    calls = reduce(DataFrame.unionByName, tagged).where("chrom is not null and pos is not null")
    left = calls if len(sets) == 1 else calls.join(M.chain_taken(calls, len(sets), pos, length), "ord", "left_anti")
    return left.select(*sets[0].columns)


def placed(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in the order of ``order``, within each group of ``by``. Rows are dealt by ranges of (by, order), written,
    numbered within their range and start where the ranges before it end."""
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = M._kept(rows.repartitionByRange(parts, *by, *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "range").count()
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = counts.select(*by, "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy(*by, "range").orderBy(*order))
    return ranged.withColumn(name, n.cast("bigint")).join(counts, [*by, "range"]).withColumn(name, F.col(name) + F.col("before")).drop("range", "before")


def renumbered(calls: DataFrame, tool: str) -> DataFrame:
    """``new_id``: tool.TYPE.n with a counter from 0 for INS, DEL and OTHER each, in file order. Counters run over ranges of
    ``ord``: a range's rows are numbered by themselves and start where the ranges before it end, so no type meets in one task."""
    kind = V.type_class(F.coalesce(F.col("svtype"), F.lit("OTHER")))
    c = calls.withColumn("type", kind).withColumn("slab", F.floor(F.col("ord") / 65_536))
    counts = c.groupBy("type", "slab").count()
    before = Window.partitionBy("type").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)  # a row per 65536 calls
    counts = counts.select("type", "slab", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("type", "slab").orderBy("ord")) - 1
    c = c.withColumn("n", n).join(counts, ["type", "slab"])
    return c.withColumn("new_id", F.concat_ws(".", F.lit(tool), "type", (F.col("n") + F.col("before")).cast("string"))).drop("slab", "n", "before", "type")


def with_id(line, old, new, everywhere: bool = False):
    """The line with another identifier: in its third column, or, as some tools do, wherever the old text occurs."""
    if everywhere:
        return F.replace(line, old, new)
    parts = F.split(line, "\t")
    return F.array_join(F.concat(F.slice(parts, 1, 2), F.array(new), F.slice(parts, 4, 1 << 20)), "\t")
