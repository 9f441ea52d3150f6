"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Each source has a target: its share of all words by weight, at most ``most`` times its size, what is above
going to the others by weight. A source's documents are cut into blocks; whole passes over the source and a part of one more
pass, taken in a random order of its blocks, make the target. These exact block quotas are split among the output shards by
a binary tree: a node with quotas (q1 ... qm) sends half of its blocks to the left, of which the sources get a
multivariate-hypergeometric draw, and the rest to the right. A shard then owns a disjoint range of each source's permuted
blocks, which it puts into a random order of its own. Everything is DataFrame and SQL work; the tree has one row per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialise, small, uniform, with_key

WEIGHTS = (5, 2, 1)
MOST = 3
_BUCKET = 4096  # blocks that are ranked together


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, ix, source_size, target) of rows (source, size). Sources by code point, null last, weigh ``weights`` in turn.
    The common level is (all - capped) / (weights of the others): sources fill up in the order of size / weight."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("ix", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("int"))  # one row a source
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("ix", F.lit(len(weights))) + 1).cast("long"))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "ix")
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("before", F.coalesce(F.sum(F.col("source_size") * most).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    above = F.when(F.col("source_size") * most > F.col("level") * F.col("weight"), F.col("level"))
    s = s.withColumn("level", F.first(above, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cap = (F.col("source_size") * most).cast("double")
    return s.select("source", "ix", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def _hypergeometric(n: str, k: str, draws: str, u: str) -> str:
    """SQL for a draw: how many of ``draws`` taken from ``n`` are among ``k`` marked ones, by inversion of the distribution
    over its mean and 9 standard deviations (beyond them lie 1e-18), each probability from the one before it."""
    sd = f"sqrt(greatest(0D, (1D * {draws} * {k} / {n}) * (1 - 1D * {k} / {n}) * (1D * ({n} - {draws}) / greatest(1, {n} - 1))))"
    mean = f"(1D * {draws} * {k} / {n})"
    lo = f"greatest(0L, {draws} - ({n} - {k}), cast(floor({mean} - 9 * {sd} - 2) as bigint))"
    hi = f"least({draws}, {k}, cast(ceil({mean} + 9 * {sd} + 2) as bigint))"
    step = f"s.p * ((1D * ({k} - x)) * ({draws} - x)) / ((x + 1D) * ({n} - {k} - {draws} + x + 1D))"
    total = f"aggregate(sequence(b.lo, b.hi - 1), named_struct('p', 1D, 'c', 1D), (s, x) -> named_struct('p', {step}, 'c', s.c + {step}), s -> s.c)"
    pick = (
        f"aggregate(sequence(b.lo, b.hi - 1), named_struct('p', 1D, 'c', 1D, 'at', b.lo), (s, x) -> "
        f"named_struct('p', {step}, 'c', s.c + {step}, 'at', if(s.c < t * {u}, x + 1, s.at)), s -> s.at)"
    )
    drawn = f"transform(array({total}), t -> {pick})[0]"
    return f"if({n} = 0, 0L, transform(array(named_struct('lo', {lo}, 'hi', {hi})), b -> if(b.hi <= b.lo, b.lo, {drawn}))[0])"


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, ix, quota) for 2**levels shards, from (ix, quota): blocks of each source, split exactly."""
    tree = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "quota"))), lambda q: q.quota).alias("q")).withColumn("shard", F.lit(0).cast("long"))
    for level in range(levels):
        u = f"((shiftrightunsigned(xxhash64({seed}, {level}, shard, size(a.got)), 11) + 0.5D) / {float(1 << 53):.1f}D)"
        draw = _hypergeometric("a.n", "k", "a.d", u)
        left = (
            "aggregate(q, named_struct('n', aggregate(q, 0L, (t, x) -> t + x), 'd', aggregate(q, 0L, (t, x) -> t + x) div 2, 'got', cast(array() as array<bigint>)), "
            f"(a, k) -> transform(array({draw}), g -> named_struct('n', a.n - k, 'd', a.d - g, 'got', concat(a.got, array(g))))[0], a -> a.got)"
        )
        tree = tree.repartition("shard") if level else tree
        tree = tree.select("shard", F.posexplode(F.expr(f"transform(array({left}), l -> array(l, zip_with(q, l, (x, y) -> x - y)))[0]")).alias("side", "q"))
        tree = tree.select((F.col("shard") * 2 + F.col("side")).alias("shard"), "q")
    return tree.select("shard", F.posexplode("q").alias("ix", "quota"))


def _shard_of(position: Column, ends: str, shards: int) -> Column:
    """The number of ends at or below a position, by halving."""
    at, step = F.lit(0), shards // 2
    while step:
        at = F.when(F.col(ends)[at + (step - 1)] <= position, at + step).otherwise(at)
        step //= 2
    return at


def mix(docs: DataFrame, block_words: int | None = 128, shards: int = 16, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks). ``shards`` is a power of two; blocks are whole documents if ``block_words`` is None.

    documents: doc_id, size, source_size, target and row, one row per row of ``docs`` (doc_id, text, source). Null and empty
    texts have size 0. Rows that share a doc_id are documents of their own; a null source is a source.
    blocks: row, doc_id, epoch, block, words, shard, place - the mix itself: ``place`` orders a shard. Pass ``epoch`` takes
    block ``block`` of a document; of the last pass, blocks that aren't longer than twice what is missing are taken in random order until
    one more would lead away from the target, which a source so misses by at most half of one of these blocks. An empty table gives empty results.
    """
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    per = materialise(targets(sized, weights, most), "targets")
    rows = sized.join(small(per), sized.source.eqNullSafe(per.source)).drop(per.source)
    width = F.lit(block_words).cast("long") if block_words else F.greatest("size", F.lit(1))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target")).cast("long") - full * F.col("source_size")
    cut = rows.where("size > 0").withColumns({"full": full, "rest": rest}).where("full > 0 or rest > 0").select("row", "doc_id", "ix", "size", width.alias("width"), "full", "rest")
    counts = cut.groupBy("ix").agg(F.sum(F.ceil(F.col("size") / F.col("width"))).alias("n"))
    cut = cut.join(small(counts), "ix")
    passes = cut.withColumn("epoch", F.explode(F.expr("sequence(0L, if(rest > 0, full, full - 1))")))
    cells = passes.withColumn("block", F.explode(F.expr("sequence(0L, cast(ceil(size / width) as bigint) - 1)")))
    cells = cells.withColumn("words", F.least("width", F.col("size") - F.col("block") * F.col("width"))).withColumn("u", uniform("doc_id", "block", "epoch", seed=seed))
    cells = cells.withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n") / _BUCKET)))
    cells = materialise(cells.select("row", "doc_id", "ix", "epoch", "block", "words", "u", "bucket", "n", "full", "rest"), "cells")
    cells = cells.where("epoch < full or words <= 2 * rest")  # what can't fit must not stand in the way of what can
    sums = cells.groupBy("ix", "epoch", "bucket").agg(F.count("*").alias("c"), F.sum("words").alias("w"))
    before = Window.partitionBy("ix", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket of blocks
    sums = sums.select("ix", "epoch", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("ix", "epoch", "bucket").orderBy("u", "row", "block")
    ranked = cells.withColumn("r", F.row_number().over(inside)).withColumn("w1", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.join(sums, ["ix", "epoch", "bucket"])
    come = F.col("w0") + F.coalesce("w1", F.lit(0))
    ranked = ranked.where((F.col("epoch") < F.col("full")) | (2 * come + F.col("words") <= 2 * F.col("rest")))
    ranked = ranked.select("row", "doc_id", "ix", "epoch", "block", "words", (F.col("epoch") * F.col("n") + F.col("c0") + F.col("r") - 1).alias("position"))
    ranked = materialise(ranked, "ranked")
    quotas = ranked.groupBy("ix").agg(F.count("*").alias("quota"))
    tree = splitting_tree(quotas.select((F.dense_rank().over(Window.orderBy("ix")) - 1).alias("k"), "ix", "quota").select(F.col("k").alias("ix"), "quota"), shards.bit_length() - 1, seed)
    real = quotas.select("ix", (F.dense_rank().over(Window.orderBy("ix")) - 1).alias("k"))
    ends = tree.withColumn("end", F.sum("quota").over(Window.partitionBy("ix").orderBy("shard")))
    ends = ends.groupBy(F.col("ix").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda e: e.end).alias("ends")).join(real, "k").drop("k")
    ends = materialise(ends, "ends")
    placed = ranked.join(small(ends), "ix").withColumn("shard", _shard_of(F.col("position"), "ends", shards))
    blocks = placed.select("row", "doc_id", "epoch", "block", "words", "shard", uniform("doc_id", "epoch", "block", "shard", seed=seed + 1).alias("place"))
    return rows.select("doc_id", "size", "source_size", "target", "row"), blocks


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes of the document, repeats counted), n_shards
    (that hold some of it). Null and empty texts have size 0 and are never taken; rows without doc_id or with a repeated one count
    by themselves; a null source is a source; other columns are ignored; an empty table gives an empty result."""
    documents, blocks = mix(docs, **options)
    taken = blocks.groupBy("row").agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("n_shards"))
    out = documents.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) as often as a mix of whole documents takes them, in any order: rows of a
    document that isn't taken go, repeats are rows of their own. Rows without words take no part and are kept as they
    are. The columns are those of ``docs``; each row counts by itself, whether its doc_id is null or that of others too."""
    rows, key = with_key(docs)
    documents, blocks = mix(rows.select(F.col(key).alias("doc_id"), "text", "source"), block_words=None, **options)
    times = free_name(rows, "times")
    often = documents.join(blocks.groupBy("row").count(), "row", "left").select(F.col("doc_id").alias(key), F.when(F.col("size") == 0, 1).otherwise(F.coalesce("count", F.lit(0))).cast("int").alias(times))
    taken = rows.join(often.where(F.col(times) > 0), key)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def block_texts(docs: DataFrame, block_words: int = 128, **options) -> DataFrame:
    """The mix as text: shard, place, doc_id, epoch, block, text (the block's words, joined by a space), ordered within each shard.
    Requires distinct, non-null doc_ids."""
    blocks = mix(docs, block_words=block_words, **options)[1]
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    held = docs.select("doc_id", words.alias("w"))
    piece = F.array_join(F.slice("w", (F.col("block") * block_words + 1).cast("int"), F.col("words").cast("int")), " ")
    return blocks.join(held, "doc_id").select("shard", "place", "doc_id", "epoch", "block", piece.alias("text")).repartition("shard").sortWithinPartitions("shard", "place")
