"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts become sets of word shingles; equal sets form one class. Signatures of class representatives are banded, so that
similar sets meet in a bucket. Candidates compare their signatures batch by batch and drop out as soon as the posterior
probability of reaching the threshold falls below ``miss``. A sketch with one byte of each hash travels with the bucket's rows, so a
pair is judged where it is made and only survivors are shuffled. Survivors are verified on their full sets, first on 16 bits
of each shingle, which can only overstate what they share, then, if that reaches the threshold, on the shingles themselves.

A bucket may hold a third of all rows, so no bucket is gathered. First each member is compared with the least of its buckets'
leaders (minima, found by pre-aggregation), then, in buckets where more than one component is left, with those buckets'
leaders until that finds nothing new, and last, where several components still meet, pairs of different components are
compared with each other. Pairs within one component could add no information, and pairs whose sizes differ too much can't be similar.
Sets and sketches are read for ids that met others only; a broadcast bitmap of those ids keeps other texts from being shuffled.
The texts of members still open after the first comparison are written once, with 16 bits of each shingle; later ones don't read the documents again.

A large family of near copies has many members just below the threshold to most others. Members with a common pivot are therefore compared by their differences from it: with D(x) the symmetric difference of x and the pivot,
|a ^ b| = |D(a)| + |D(b)| - 2 |D(a) & D(b)|, so a linked pair must share more of its differences than sizes allow to be missing
from the rarest-first prefixes of D(a) and D(b). Joining prefixes finds every such pair; bitmaps of the differences, whose
differing bits bound |a ^ b| from below, keep nearly all others from being made. Members with different pivots are compared pair by
pair where a bucket has few of them for each of its members; a crowded bucket's members differ from a pivot of the bucket instead, so no
bucket is squared.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, arrow_texts, bounded_batches, components, materialise, shingle_set, word_hashes

WORDS = 8  # 64-bit words of a bitmap of differences
PAIRS = 64  # pairs with different pivots that a bucket may have for each of its members before they share a pivot
FAMILY = 1000  # members of one pivot that a copy of the pivot's set serves
BANDS, ROWS, BATCH = 48, 7, 32  # a pair at 0.8 is missed by the bands with probability (1 - 0.8**7)**48 = 1e-5


def least_matches(threshold: float, miss: float, hashes: int, batch: int) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): with a uniform prior the posterior of the similarity is
    Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m); below ``miss`` a pair is dropped."""
    out = []
    for n in range(batch, hashes + 1, batch):
        total, least = 0.0, 0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                least = m
                break
        out.append((n, least))
    return out


def _signer(words: int, bands: int, rows: int, seed: int):
    hashes = bands * rows
    rng = np.random.default_rng(seed)
    flips = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)[:, None]
    odd = (rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1))[:, None]

    def sign(shingles: np.ndarray) -> np.ndarray:
        h = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
        best = np.full(hashes, 0xFFFFFFFF, np.uint32)
        for at in range(0, h.shape[1], 1024):
            np.minimum(best, ((h[:, at : at + 1024] ^ flips) * odd).min(axis=1), out=best)
        return best * np.uint32(0x9E3779B1)

    def run(batches):
        for batch in batches:
            ids, sizes, keys, buckets, sketches = batch.column(0).to_pylist(), [], [], [], []
            for text in arrow_texts(batch.column(1)):
                s = shingle_set(word_hashes(text), words)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found = sign(s) if len(s) else None
                sketches.append(None if found is None else (found[: hashes // BATCH * BATCH] >> np.uint32(24)).astype(np.uint8).tobytes())
                buckets.append(None if found is None else [xxhash.xxh3_64_intdigest(found[b * rows : (b + 1) * rows].tobytes(), seed=b) - (1 << 63) for b in range(bands)])
            made = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_shingles", "set_key", "buckets", "sketch"])

    return run


def _pruner(steps: list[tuple[int, int]]):
    """(a, sa, b, sb) -> (a, b) of the pairs of sketches that pass every step."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (1, 3))
            live, matches, before = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                matches[live] += (a[live, before:n] == b[live, before:n]).sum(axis=1)
                live, before = live[matches[live] >= least], n
            at = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at)], ["a", "b"])

    return run


def _shingler(words: int, short: bool):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(word_hashes(t), words) for t in arrow_texts(batch.column(1))]
            if short:
                sets = [np.sort((s >> np.uint64(48)).astype(np.uint16)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    return run


def _shared(s: np.ndarray, t: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    if s.dtype != np.uint16:
        return int((both[1:] == both[:-1]).sum())
    return int(np.minimum(np.bincount(s, minlength=1 << 16), np.bincount(t, minlength=1 << 16)).sum()) if len(s) > 20_000 else _shared_runs(s, t)


def _shared_runs(s: np.ndarray, t: np.ndarray) -> int:
    x, n = np.unique(s, return_counts=True)
    y, m = np.unique(t, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _verifier(percent: int, kind: type):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(1), batch.column(3), strict=True)):
                s, t = (np.frombuffer(v.as_buffer(), kind) for v in (x, y))
                common = _shared(s, t)
                if 100 * common >= percent * (len(s) + len(t) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at)], ["a", "b"])

    return run


def _differences(batches):
    """(rep, component, copy, set, pivot, pivot's set) -> the rep's difference from its pivot, with both sizes."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column(3), batch.column(5), strict=True):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            out.append((np.setxor1d(s, t, assume_unique=True), len(s), len(t)))
        made = [pa.array([o[0].view(np.int64) for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(0), batch.column(1), *made], ["pivot", "rep", "component", "d", "n", "np"])


def _deltas(members: DataFrame, sets: DataFrame, family: int) -> DataFrame:
    """Differences of members (rep, component, pivot) from their pivots, by sets (doc_id, shingles). A pivot's set is copied for every ``family``
    members, or a large family would be one join key."""
    copies = materialise(members.groupBy("pivot").agg(F.ceil(F.count("*") / family).alias("copies")), "pivots")
    own = sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("s"))
    dealt = members.join(copies, "pivot").select("rep", "component", "pivot", F.expr("pmod(xxhash64(rep), copies)").alias("copy"))
    served = copies.select(F.col("pivot").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")).join(sets, "doc_id")
    served = served.select(F.col("doc_id").alias("pivot"), "copy", F.col("shingles").alias("p"))
    both = dealt.join(own, "rep").join(served, ["pivot", "copy"]).select("rep", "component", "copy", "s", "pivot", "p")
    return materialise(both.mapInArrow(_differences, "pivot long, rep long, component long, d array<long>, n long, np long"), "differences")


def _difference_links(percent: int, delta: DataFrame) -> DataFrame:
    """Links between members (pivot, rep, component, d, n, np) of one pivot and different components.

    With c = (100 - percent) / (100 + percent), a pair is linked iff |a ^ b| <= c (n(a) + n(b)), and x is near its pivot iff
    |D(x)| <= c (n(x) + np). Two near ones are of one component. If b is not near, the pair shares more than
    (|D(a)| + c (np - n(a))) / 2 differences, which bounds a's prefix, and b's too if a isn't near either; otherwise b's is bounded by
    |D(b)| - c (n(a) + n(b)) with n(a) <= n(b) * 100 / percent."""
    c = (100 - percent) / (100 + percent)
    size, slack = F.size("d"), 1e-6
    far = size > c * (F.col("n") + F.col("np"))
    half = size - F.greatest(F.floor((size + c * (F.col("np") - F.col("n"))) / 2 - slack), F.lit(0))
    most = size - F.greatest(F.ceil(size - c * F.col("n") * (1 + 100 / percent) - slack), F.lit(1)) + 1
    rows = delta.select("pivot", "rep", "component", far.alias("far"), half.alias("half"), most.alias("most"), F.explode("d").alias("e"))
    common = rows.groupBy("pivot", "e").agg(F.count("*").alias("f")).where("f > 1")  # differences of one member only link nothing, but keep their place
    rows = rows.join(common, ["pivot", "e"], "left").withColumn("at", F.row_number().over(Window.partitionBy("pivot", "rep").orderBy(F.coalesce("f", F.lit(1)), "e")))
    rows = materialise(rows.where("f > 1").where(F.col("at") <= F.when(F.col("far"), F.greatest("half", "most")).otherwise(F.col("half"))), "prefixes")
    # A pair's sets differ in at least as many shingles as bitmaps of their differences differ in bits: where that is too many already, no row is made.
    bits = [f"aggregate(d, 0L, (s, e) -> if((e & {WORDS - 1}L) = {w}L, s | shiftleft(1L, cast(shiftrightunsigned(e, 3) & 63L as int)), s)) as m{w}" for w in range(WORDS)]
    maps = materialise(delta.selectExpr("pivot", "rep", "n", *bits), "bitmaps")
    wide = rows.join(maps, ["pivot", "rep"])
    mine = lambda k: [F.col("n").alias(f"n{k}"), *[F.col(f"m{w}").alias(f"{k}{w}") for w in range(WORDS)]]
    names = ["pivot", "e", "b", "cb", "hb", "mb", "nb", *[f"b{w}" for w in range(WORDS)]]
    b = wide.where("far").select("pivot", "e", F.col("rep").alias("b"), F.col("component").alias("cb"), (F.col("at") <= F.col("half")).alias("hb"), (F.col("at") <= F.col("most")).alias("mb"), *mine("b")).toDF(*names)
    a = wide.where(F.col("at") <= F.col("half")).select("pivot", "e", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("far").alias("fa"), *mine("a"))
    differ = " + ".join(f"bit_count(a{w} ^ b{w})" for w in range(WORDS))
    possible = f"{100 + percent} * ({differ}) <= {100 - percent} * (na + nb) and ca <> cb and ((fa and a < b and hb) or (not fa and mb))"
    pairs = a.join(b, ["pivot", "e"]).where(possible).select("pivot", "a", "b").distinct()
    full = lambda k: delta.select("pivot", F.col("rep").alias(k), F.col("d").alias(f"d{k}"), F.col("n").alias(f"n{k}"))
    both = materialise(pairs, "differing").join(full("b"), ["pivot", "b"]).join(full("a"), ["pivot", "a"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    links = both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6, seed: int = 7,
    pairs_per_member: int = PAIRS, family: int = FAMILY,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets. component_id is the smallest
    doc_id reachable over links. Null and empty texts have no shingles and no links. Rows that share a doc_id are one node with the links of all their texts.
    Rows without doc_id take no part; their component_id is null and they are kept. An empty table gives an empty result.
    ``pairs_per_member`` and ``family`` only choose how work is dealt out; results don't depend on them.
    """
    spark, hashes = docs.sparkSession, bands * rows // BATCH * BATCH
    bounded_batches(spark)
    steps = least_matches(percent / 100, miss, hashes, BATCH)
    signed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows_ = materialise(signed.mapInArrow(_signer(words, bands, rows, seed), "doc_id long, n_shingles long, set_key binary, buckets array<long>, sketch binary"), "signed")
    named = rows_.where("doc_id is not null and n_shingles > 0")
    classes = materialise(named.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = lambda found, *columns: found.join(classes, (F.col("doc_id") == F.col("rep")) & (found.set_key == classes.set_key)).select("rep", *columns)
    buckets = materialise(reps(named, "buckets").select(F.explode("buckets").alias("bucket"), "rep"), "buckets")
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last").select("bucket", "leader")
    met = materialise(buckets.join(shared, "bucket").select("bucket", "leader", "rep").distinct(), "met")
    sketch = materialise(reps(among(named, "doc_id", met.select("rep")), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(), "sketches")
    near = lambda x, y: (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))

    def sets_of(pairs: DataFrame, short: bool) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        if short and shorts is not None:
            return shorts.join(wanted, "doc_id", "left_semi")
        return materialise(among(open_texts, "doc_id", wanted).mapInArrow(_shingler(words, short), "doc_id long, shingles binary"), "sets")

    def verified(pairs: DataFrame, short: bool) -> DataFrame:
        sets = sets_of(pairs, short)
        left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
        full = pairs.join(right, "b").join(left, "a").select("a", "sa", "b", "sb")
        return materialise(full.mapInArrow(_verifier(percent, np.uint16 if short else np.uint64), "a long, b long").distinct(), "links")

    def links(judged: DataFrame) -> DataFrame:
        """Those of the pairs (a, na, sa, b, nb, sb) that hold. Nothing is read for them when none is left."""
        first = judged.where(near("na", "nb")).select("a", "sa", "b", "sb")
        found = materialise(first.mapInArrow(_pruner(steps), "a long, b long").distinct(), "likely")
        for short in (True, False):
            found = verified(found, short) if found.limit(1).count() else found
        return found

    def sketched(pairs: DataFrame) -> DataFrame:
        left, right = (sketch.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
        return pairs.join(right, "b").join(left, "a")

    def open_rows() -> DataFrame:
        """Rows of the buckets in which more than one component is left, with their component and the leader's."""
        mine = reached.withColumnRenamed("node", "rep")
        seen = met.join(mine, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        seen = materialise(seen, "seen")
        several = seen.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "rep").alias("led")).where("lo <> hi")
        return materialise(seen.join(several.select("bucket", "led"), "bucket"), "open")

    several = materialise(named.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id"), "several")
    texts = named.join(several, "doc_id").select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep").distinct()
    bridges = texts.groupBy("doc_id").agg(F.min("rep").alias("a")).join(texts, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    open_texts, shorts = signed, None
    found = links(sketched(met.where("rep <> leader").groupBy(F.col("rep").alias("b")).agg(F.min("leader").alias("a")))).union(bridges)
    reached = components(found)
    tried = None
    while True:
        left_over = open_rows()
        if shorts is None:  # components only grow, so no later round has members that aren't open now
            open_texts = materialise(among(signed, "doc_id", left_over.select("rep")), "texts")
            shorts = materialise(open_texts.mapInArrow(_shingler(words, True), "doc_id long, shingles binary"), "shorts")
        pairs = left_over.where("rep <> leader and component <> led").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "starred")
        more = links(sketched(pairs))
        if not more.limit(1).count():
            break
        tried = pairs if tried is None else tried.union(pairs)
        found = found.union(more)
        reached = components(found)
    # Every member has been compared with its buckets' leaders; what is left are pairs of members of different components.
    # Those with a common pivot are compared by their differences from it, the others by their sketches. A member's pivot is the
    # leader it meets that most others meet too, or that leader's own pivot; any choice is exact, a related one is quick.
    meets = materialise(left_over.select("rep", "leader").distinct(), "meets")
    often = meets.groupBy("leader").agg(F.count("*").alias("f"))
    own = meets.join(often, "leader").groupBy("rep").agg(F.max_by("leader", F.struct("f", -F.col("leader"))).alias("pivot"))
    own = materialise(own, "pivots")
    jumped = own.join(own.select(F.col("rep").alias("pivot"), F.col("pivot").alias("next")), "pivot", "left").select("rep", F.coalesce("next", "pivot").alias("pivot"))
    # Ids with several texts are compared by their sketches: they have no single set to differ from another.
    for k in ("rep", "pivot"):
        jumped = jumped.join(several.withColumnRenamed("doc_id", k), k, "left_anti")
    placed = materialise(left_over.where("rep <> leader").select("bucket", "rep", "component").join(jumped, "rep", "left"), "placed")
    kinds = placed.where("pivot is not null").groupBy("bucket", "pivot").agg(F.count("*").cast("double").alias("f"))
    kinds = kinds.groupBy("bucket").agg(F.sum("f").alias("n"), F.sum(F.col("f") * F.col("f")).alias("same"), F.max_by("pivot", F.struct("f", -F.col("pivot"))).alias("common"))
    crowded = materialise(kinds.where(f"n * n - same > 2 * {pairs_per_member} * n").select("bucket", "common"), "crowded")
    placed = materialise(placed.join(crowded, "bucket", "left"), "placed")
    gathered = placed.where("pivot is not null and common is not null").select("rep", "component", F.col("common").alias("pivot"))
    members = left_over.select("rep", "component").distinct().join(jumped, "rep").select("rep", "component", "pivot")
    members = materialise(members.union(gathered).distinct(), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).union(members.select("pivot")).distinct()
    sets = materialise(open_texts.join(wanted, "doc_id", "left_semi").mapInArrow(_shingler(words, False), "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "sets")
    more = materialise(_difference_links(percent, _deltas(members, sets, family)), "links")
    cross = placed.join(sketch, "rep")
    x = cross.select("bucket", "common", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("pivot").alias("pa"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = cross.select(F.col("bucket").alias("other"), F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("pivot").alias("pb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    apart = F.expr("pa is null or pb is null or (pa <> pb and common is null)")
    more = more.union(links(x.join(y, (F.col("bucket") == F.col("other")) & F.expr("a < b and ca <> cb") & apart & near("na", "nb")).select("a", "na", "sa", "b", "nb", "sb")))
    if more.limit(1).count():
        reached = components(found.union(more))
    owners = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("found"))
    out = rows_.select("doc_id", "n_shingles", "set_key").join(owners, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
