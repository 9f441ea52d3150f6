"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are maximal runs of letters, marks and digits, lower-cased, so punctuation stuck to a passage doesn't hide it. A window of
a document is as long as the benchmark item it may repeat. A window that shares no shingle with an item has similarity 0,
so only windows that are aligned with some item by a shared shingle are built: an exact restriction. Equal windows are
fingerprinted once. The 64-bit SimHash is cut into four blocks of 16 bits; of two fingerprints within the radius one block at
least differs in a quarter of the radius or less, so items are filed under the bits of each block and all that differ from them
by so few, and an equi-join of windows on (length, block, bits) finds every item of the window's own length within the radius. With a radius
of 11 less than 1 % of unrelated fingerprints meet. These pairs, and every window with the item it is aligned with whose fingerprint
lies farther away, are verified exactly: the weight of the item's shingles that the window holds, against the weight of all
the item's shingles. So nothing at ``similarity`` or above is lost to the fingerprints.

Everything is DataFrame and SQL work. A document's words stay arrays within its row; a bitmap of the items' shingles, sized
by their count, drops positions that can't match before rows are made of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

SHINGLE = 5
RADIUS = 11
BLOCKS, BLOCK_BITS = 4, 16
SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def _hashes(text: Column) -> Column:
    """Hashes of a text's words."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(words: str, at: str, size: int) -> str:
    """SQL for the hash of ``size`` words of an array of hashes, from an index that counts from 0."""
    return f"xxhash64({', '.join(f'{words}[{at} + {j}]' for j in range(size))})"


def _grams(words: str, size: int) -> str:
    """SQL for the shingles of an array of hashes, in order."""
    return f"if(size({words}) < {size}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {size}), i -> {_gram(words, 'i', size)}))"


def _bitmap(shingles: DataFrame, count: int) -> tuple[Column, int]:
    """An array of longs as a scalar, in which the bit of each shingle is set; about 1 of 64 bits, at most 8 MB."""
    words = 1 << max(8, min(20, (count - 1).bit_length()))
    set_ = shingles.select(F.col("sh").bitwiseAND(words - 1).alias("at"), F.expr("shiftleft(1L, cast(shiftrightunsigned(sh, 58) as int))").alias("bit"))
    set_ = set_.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = set_.sparkSession.range(words).join(set_, F.col("id") == F.col("at"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda b: b.bits).alias("b"))
    return one.scalar(), words


def _simhash(words: str) -> str:
    """SQL for the SimHash of an array of word hashes: bit b is set where more than half of the words have it."""
    half = f"2 * aggregate({words}, 0, (n, h) -> n + getbit(h, b)) > size({words})"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> if({half}, f | shiftleft(1L, b), f))"


def _blocks(differing: int) -> Column:
    """(block, bits) of a fingerprint ``sim``: four runs of 16 bits; with ``differing`` also all runs that differ in so many bits."""
    masks = [sum(1 << b for b in bits) for k in range(differing + 1) for bits in combinations(range(BLOCK_BITS), k)]
    runs = F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"cast(shiftrightunsigned(sim, {BLOCK_BITS * i}) & {(1 << BLOCK_BITS) - 1}L as int)").alias("bits")) for i in range(BLOCKS)])
    near = F.transform(runs, lambda r: F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(r["block"].alias("block"), r["bits"].bitwiseXOR(m).alias("bits"))))
    return F.explode(F.flatten(near))


def met(texts: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Pairs of fingerprints ``sim`` of texts (key, n) and items (item, n) that meet in a block, with their Hamming distance."""
    a = texts.select("key", "n", F.col("sim").alias("ws"), _blocks(0).alias("x")).select("key", "n", "ws", "x.*")
    b = materialise(items.select("item", "n", F.col("sim").alias("is"), _blocks(radius // BLOCKS).alias("x")).select("item", "n", "is", "x.*"), "blocks")
    return a.join(small(b), ["n", "block", "bits"]).withColumn("hamming", F.expr("bit_count(ws ^ is)"))


def within(texts: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(key, item, hamming): all texts and items of equal length ``n`` whose fingerprints differ in ``radius`` bits at most."""
    return met(texts, items, radius).where(F.col("hamming") <= radius).select("key", "item", "hamming").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, window_words, hamming, similarity): for each document and item that it repeats, the most
    similar window (the first of equals), ``start`` counting words from 0. A window has as many words as its item, fewer only where
    the text begins or ends within it.

    Shingles have ``shingle`` words; an item of fewer words is one shingle. A shingle's weight is
    ln(1 + items / items that have it). Items without words and rows without id, on either side, take no part, of repeated
    item ids all texts count; documents with null or empty texts hold nothing; repeated rows count once. Empty tables give an empty result.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), _hashes(F.col("text")).alias("w")).distinct()
    items = items.where("size(w) > 0").withColumn("item", F.xxhash64("item_id", "w")).withColumn("n", F.size("w"))
    items = materialise(items, "items")
    found = [_scan(docs, items.where(f"n >= {shingle}"), shingle, radius, similarity)]
    short = [r[0] for r in items.where(f"n < {shingle}").select("n").distinct().collect()]  # shingle - 1 values at most
    found += [_scan(docs, items.where(f"n = {n}"), n, radius, similarity) for n in sorted(short)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    best = F.max_by(F.struct("start", "window_words", "hamming", "similarity"), F.struct("similarity", -F.col("start"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def _scan(docs: DataFrame, items: DataFrame, size: int, radius: int, similarity: float) -> DataFrame:
    grams = items.select("item", "item_id", "n", F.posexplode(F.expr(_grams("w", size))).alias("p", "sh"))
    grams = grams.withColumn("before", F.lag("sh").over(Window.partitionBy("item").orderBy("p")))
    grams = materialise(grams, "grams")
    total, count = grams.agg(F.countDistinct("item"), F.count("*")).first()
    weights = grams.groupBy("sh").agg(F.countDistinct("item").alias("df")).select("sh", F.log(1 + F.lit(float(total)) / F.col("df")).alias("weight"))
    counted = materialise(grams.groupBy("item", "item_id", "sh").agg(F.count("*").alias("c")).join(weights, "sh"), "counted")
    bits, words = _bitmap(grams.select("sh"), count)
    # Positions whose shingle an item may have; their words are fetched when it is known which windows are wanted.
    hit = f"getbit(m[cast({_gram('h', 'i', size)} & {words - 1}L as int)], cast(shiftrightunsigned({_gram('h', 'i', size)}, 58) as int)) = 1"
    place = f"named_struct('i', i, 'sh', {_gram('h', 'i', size)}, 'last', if(i > 0, {_gram('h', 'greatest(i - 1, 0)', size)}, null))"
    anchors = f"transform(filter(sequence(0, size(h) - {size}), i -> {hit}), i -> {place})"
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("copy"), "text")
    rows = named.select("doc_id", "copy", _hashes(F.col("text")).alias("h"), bits.alias("m")).where(f"size(h) >= {size}")
    rows = rows.select("doc_id", "copy", F.explode(F.expr(anchors)).alias("a")).select("doc_id", "copy", "a.*")
    # A position continues the one before it if that has the item's shingle before: one row for each run is enough.
    known = small(grams.select(F.col("sh").alias("gsh"), "item", "p", "n", "before"))
    met = rows.join(known, (F.col("sh") == F.col("gsh")) & ~F.coalesce(F.col("last") == F.col("before"), F.lit(False)))
    starts = materialise(met.select("doc_id", "copy", "item", (F.col("i") - F.col("p")).alias("start"), "n").distinct(), "starts")
    held = named.join(starts.select("doc_id", "copy").distinct(), ["doc_id", "copy"], "left_semi").select("doc_id", "copy", _hashes(F.col("text")).alias("h"))
    first = F.greatest("start", F.lit(0))
    windows = starts.join(held, ["doc_id", "copy"]).select("doc_id", first.alias("start"), "item", "n", F.slice("h", first + 1, F.col("start") + F.col("n") - first).alias("w"))
    windows = materialise(windows.withColumn("key", F.xxhash64("n", "w")), "windows")
    texts = windows.groupBy("key").agg(F.first("w").alias("w"), F.first("n").alias("n"))
    texts = materialise(texts.withColumn("sim", F.expr(_simhash("w"))), "texts")
    marked = items.withColumn("sim", F.expr(_simhash("w")))
    near = within(texts, marked, radius)
    aligned = windows.select("key", "item").distinct().join(texts.select("key", F.col("sim").alias("ws")), "key")
    aligned = aligned.join(small(marked.select("item", F.col("sim").alias("is"))), "item").withColumn("hamming", F.expr("bit_count(ws ^ is)"))
    near = near.select("key", "item", "hamming").union(aligned.select("key", "item", "hamming")).distinct()
    full = counted.groupBy("item").agg(F.sum(F.col("weight") * F.col("c")).alias("whole"))
    held = texts.select("key", F.explode(F.expr(_grams("w", size))).alias("sh")).groupBy("key", "sh").agg(F.count("*").alias("k"))
    common = near.join(small(counted), "item").join(held, ["key", "sh"])
    common = common.groupBy("key", "item", "item_id", "hamming").agg(F.sum(F.col("weight") * F.least("c", "k")).alias("part"))
    sure = common.join(full, "item").withColumn("similarity", F.col("part") / F.col("whole")).where(F.col("similarity") >= similarity - 1e-12)
    placed = windows.select("doc_id", "start", "key", F.size("w").alias("window_words")).distinct()
    return placed.join(sure.select("key", "item_id", "hamming", "similarity"), "key").select("doc_id", "item_id", "start", "window_words", "hamming", "similarity")
