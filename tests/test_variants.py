"""Hand-made rows for the variant operators, and properties against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from svlake.functions import arrays as A
from svlake.functions import vcf_info as V
from svlake.operators import match, merge, metrics, overlap, pileup, quantiles, raster, score, windows
from svlake.sources import vcf


def line(info: str, pos: int = 100, chrom: str = "1", id_: str = "x.1") -> str:
    return f"{chrom}\t{pos}\t{id_}\tN\t<S>\t.\tPASS\t{info}\tGT\t0/1"


@pytest.mark.parametrize(
    ("info", "compat", "end"),
    [
        ("SVTYPE=DEL;CIEND=-10,10;END=500", False, 500), ("SVTYPE=DEL;CIEND=-10,10;END=500", True, 0), ("SVTYPE=DEL;SVLEN=-40", False, 140),
        ("SVTYPE=DEL;SVLEN=-40", True, 140), ("SVTYPE=DEL", False, 0), ("SVTYPE=DEL", True, 0),
    ],
)
def test_deletion_end(spark, info, compat, end):
    lines = spark.createDataFrame([(1, line(info))], "ord long, line string")
    assert vcf.deletions(lines, compat).first()["end"] == end


def test_insertion_without_length_and_route(spark):
    lines = spark.createDataFrame([(1, line("SVTYPE=INS;END=130")), (2, line("SVTYPE=DEL;X=SVTYPE=INS"))], "ord long, line string")
    assert [r.svlen for r in vcf.insertions(lines).collect()] == [30]
    assert vcf.deletions(lines).count() == 1


def test_header_variants(spark):
    lines = spark.createDataFrame([(0, "##contig=<ID=7,length=9>"), (1, "#CHROM\tPOS"), (2, line("SVTYPE=INS", id_="a#1"))], "ord long, line string")
    assert vcf.header(lines, anywhere=True).count() == 3
    assert vcf.header(lines).count() == 2
    assert [r.chrom for r in vcf.contigs(lines).collect()] == ["7"]


def test_info_map(spark):
    m = spark.range(1).select(V.info_map(F.lit("PRECISE;A=1;B=x=y;A=2")).alias("m")).first().m
    assert m == {"PRECISE": None, "A": "2", "B": "x=y"}


def test_read_lines_keep_order(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("".join(f"l{i}\n" for i in range(500)))
    rows = sorted(vcf.read_lines(spark, str(tmp_path / "a.vcf")).collect())
    assert [r.line for r in rows] == [f"l{i}" for i in range(500)]
    assert [r.ord for r in rows] == list(range(500))


def test_write_and_read(spark, tmp_path):
    lines = spark.createDataFrame([(0, "##a"), (1, "#CHROM"), (5, line("SVTYPE=INS", 9)), (4, line("SVTYPE=INS", 7))], "ord long, line string")
    other = spark.createDataFrame([(0, "##b"), (1, "#CHROM")], "ord long, line string")
    vcf.write_vcf(vcf.header_union(lines, other), vcf.body(lines), str(tmp_path / "o"))
    text = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert text[:3] == ["##a", "##b", "#CHROM"]
    assert [t.split("\t")[1] for t in text[3:]] == ["7", "9"]


def test_window_edges(spark):
    sizes = spark.createDataFrame([("1", 5000)], "chrom string, len long")
    ins = windows.insertion_windows(spark.createDataFrame([("a", "1", 5), ("b", "1", 5000)], "id string, chrom string, pos long"), sizes)
    assert {(r.id, r.begin, r.end) for r in ins.collect()} == {("a", 0, 1028), ("b", 3975, 4999)}
    dels = windows.deletion_windows(spark.createDataFrame([("a", "1", 100, 102), ("b", "1", 100, 0)], "id string, chrom string, pos long, stop long"), sizes)
    got = {r.id: (r.begin, r.end) for r in dels.collect()}
    assert got["a"] == (98, 102)
    assert got["b"] == (124, -26)
    assert [r.id for r in windows.valid(dels).collect()] == ["a"]


def call_rows(rng: random.Random, n: int) -> list[tuple]:
    return [(i, rng.choice("12"), rng.randrange(1, 30_000), f"t.{i}", rng.choice(["INS", "DEL", None]), rng.choice([None, *range(50, 400, 30)])) for i in range(n)]


SCHEMA = "ord long, chrom string, pos long, id string, svtype string, svlen int"


def same(x, y) -> bool:
    return x[1] == y[1] and x[4] == y[4] and abs(x[2] - y[2]) <= 500 and (x[5] is None or y[5] is None or abs(x[5] - y[5]) <= 100)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[2], r[0]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_equals_sequential_loops(spark, seed):
    rng = random.Random(seed)
    a, b = call_rows(rng, 80), call_rows(rng, 90)
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    forward, two = set(), set()
    for c in "12":
        x, y = [r for r in in_order(a) if r[1] == c], [r for r in in_order(b) if r[1] == c]
        last = -1
        for r in x:
            hit = next((j for j in range(last + 1, len(y)) if same(r, y[j])), None)
            if hit is not None:
                forward.add((r[0], y[hit][0]))
                last = hit
        i = j = 0
        while i < len(x) and j < len(y):
            if same(x[i], y[j]):
                two.add((x[i][0], y[j][0]))
                i, j = i + 1, j + 1
            elif x[i][2] < y[j][2]:
                i += 1
            else:
                j += 1
    assert {tuple(r) for r in match.forward_match(da, db).collect()} == forward
    assert {tuple(r) for r in match.two_pointer_match(da, db).collect()} == two
    pairs = {(x[0], y[0]) for x in a for y in b if same(x, y)}
    assert {(r.a.ord, r.b.ord) for r in match.band_pairs(da, db).collect()} == pairs
    m = match.forward_match(da, db)
    s = match.summary(da, db, m).first()
    assert (s.same + s.dif1, s.same + s.dif2) == (80, 90)
    assert merge.union_first(da, db, m).count() == s.same + s.dif1 + s.dif2
    assert merge.union_interleaved(da, db, m).count() == s.same + s.dif1 + s.dif2


@pytest.mark.parametrize("kinds", [1, 3])
def test_matching_dense_calls(spark, monkeypatch, kinds):
    """No empty cell anywhere: work is cut all the same, and results are those of one pass."""
    rng = random.Random(kinds)
    sets = [[(n, "1", rng.randrange(120_000), f"x.{n}", ["INS", "DEL", None][rng.randrange(kinds)], rng.choice([None, 50, 120, 300, 900])) for n in range(2000 + 300 * k)] for k in range(2)]
    x, y = map(in_order, sets)
    forward, last = set(), -1
    for r in x:
        hit = next((j for j in range(last + 1, len(y)) if same(r, y[j])), None)
        if hit is not None:
            forward.add((r[0], y[hit][0]))
            last = hit
    steps, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and same(x[i], y[j]):
            steps.append((x[i][0], y[j][0]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and x[i][2] < y[j][2]):
            steps.append((x[i][0], None))
            i += 1
        else:
            steps.append((None, y[j][0]))
            j += 1
    da, db = (spark.createDataFrame(d, SCHEMA) for d in sets)
    for cells in (match.TILE_CELLS, 8):
        monkeypatch.setattr(match, "TILE_CELLS", cells)
        assert {tuple(r) for r in match.forward_match(da, db).collect()} == forward
        got = sorted(match.two_pointer_steps(da, db).collect(), key=lambda r: (r.tile, r.step))
        assert [(r.i, r.j) for r in got] == steps
        assert len({r.tile for r in got}) >= 240 // cells


def chained(sets: list[list[tuple]], pos: int = 500) -> list[tuple]:
    """Calls (set, ord) that merging one set after another leaves, by one loop for each merge."""
    near = lambda x, y: x[1] == y[1] and x[4] == y[4] and abs(x[2] - y[2]) <= pos and (x[5] is None or y[5] is None or abs(x[5] - y[5]) <= 100)
    left = []
    for k, s in enumerate(sets):
        new, i, j, taken = sorted(((k, c, p, o, t, n) for o, c, p, _, t, n in s), key=lambda r: (r[2], r[0], r[3])), 0, 0, set()
        while i < len(left) and j < len(new):
            if near(left[i], new[j]):
                taken.add(j)
                i, j = i + 1, j + 1
            elif left[i][2] < new[j][2]:
                i += 1
            else:
                j += 1
        left = sorted(left + [r for j, r in enumerate(new) if j not in taken], key=lambda r: (r[2], r[0], r[3]))
    return sorted((r[0], r[3]) for r in left)


@pytest.mark.parametrize(("n", "dense", "cells"), [(2, 30_000, 64), (3, 120_000, 8), (5, 120_000, 3), (4, 400_000, 1)])
def test_fusing_many_sets_in_one_sweep(spark, monkeypatch, n, dense, cells):
    """Chains of merges over small tiles, down to tiles that a merge reaches beyond, are those of one pass over everything."""
    rng = random.Random(n)
    sets = [[(o, "1", rng.randrange(dense), f"x.{o}", rng.choice(["INS", "DEL", None]), rng.choice([None, 50, 120, 300])) for o in range(400 + 50 * k)] for k in range(n)]
    monkeypatch.setattr(match, "TILE_CELLS", cells)
    got = merge.fuse([spark.createDataFrame(s, SCHEMA).withColumn("extra", F.lit(k)) for k, s in enumerate(sets)]).collect()
    assert sorted((r.extra, r.ord - (r.extra << 56)) for r in got) == chained(sets)
    assert len(got) < sum(map(len, sets))


def test_fusing_odd_sets(spark):
    one = spark.createDataFrame([(1, "1", 5, "a.1", "INS", 3), (2, None, 5, "a.2", "INS", 3), (3, "1", None, "a.3", "INS", 3), (4, "1", 5, "a.4", None, None)], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    assert sorted(r.id for r in merge.fuse([one]).collect()) == ["a.1", "a.4"]
    assert sorted(r.id for r in merge.fuse([empty, one, empty, one]).collect()) == ["a.1", "a.4"]
    assert merge.fuse([empty, empty]).count() == 0


def test_empty_sets(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "1", 5, "a.1", "INS", 3)], SCHEMA)
    assert match.forward_match(empty, one).count() == 0
    assert match.two_pointer_match(one, empty).count() == 0
    assert merge.union_merged(one, empty).count() == 1


def test_tolerances(spark):
    a = spark.createDataFrame([(1, "1", 1000, "a", "INS", 100)], SCHEMA)
    b = spark.createDataFrame([(1, "1", 1500, "b", "INS", 200), (2, "1", 1501, "b", "INS", 100), (3, "1", 1000, "b", "INS", 201), (4, "1", 1000, "b", "INS", None), (5, "1", 1000, "b", None, 100)], SCHEMA)
    assert {r.b.ord for r in match.band_pairs(a, b).collect()} == {1, 4}


def test_renumber_and_ids(spark):
    rows = spark.createDataFrame([(70_000, "INS"), (3, "INS"), (5, None), (4, "DEL"), (1, "BND")], "ord long, svtype string")
    assert {r.ord: r.new_id for r in merge.renumbered(rows, "t").collect()} == {3: "t.INS.0", 70_000: "t.INS.1", 4: "t.DEL.0", 1: "t.OTHER.0", 5: "t.OTHER.1"}
    got = spark.createDataFrame([("1\t2\t.\tN.N",)], "l string").select(merge.with_id(F.col("l"), F.lit("."), F.lit("q")), merge.with_id(F.col("l"), F.lit("."), F.lit("q"), everywhere=True)).first()
    assert tuple(got) == ("1\t2\tq\tN.N", "1\t2\tq\tNqN")
    assert spark.range(1).select(V.fused_id(F.lit("a.1"), F.lit("b.7"))).first()[0] == "b.a.1"


def test_overlap_counts_each_pair_once(spark):
    rng = random.Random(5)
    w = [(i, "1", s, s + rng.randrange(1, 60_000)) for i in range(30) for s in [rng.randrange(100_000)]]
    r = [("1", s, s + rng.randrange(1, 40_000)) for _ in range(100) for s in [rng.randrange(150_000)]]
    got = overlap.read_counts(spark.createDataFrame(w, "id long, chrom string, begin long, end long"), spark.createDataFrame(r, "chrom string, start0 long, end0 long"), ["id"])
    want = {i: sum(s < e1 and e > b1 for _, s, e in r) for i, _, b1, e1 in w}
    assert {x.id: x.n for x in got.collect()} == want


@pytest.mark.parametrize("split", [None, 40])
def test_overlaps_of_all_sizes(spark, split):
    """Bases to chromosomes on either side, a bin with most of the reads, copies, empty and inverted intervals: the pairs of a plain loop."""
    rng = random.Random(8)
    sizes = [1, 2, 90, 5000, 130_000, 3_000_000]
    w = [(i, rng.choice("12"), s, s + rng.choice(sizes) + rng.randrange(3)) for i in range(60) for s in [rng.randrange(2_000_000)]] + [(100, "1", 0, 3_000_000), (101, "1", 50, 50), (102, "2", 60, 10), (103, "9", 0, 100)]
    r = [(rng.choice("12"), s, s + rng.choice(sizes), f"r{k}") for k in range(300) for s in [rng.randrange(2_000_000)]] + [("1", 70_000 + k % 50, 70_200, f"hot{k}") for k in range(400)] + [("1", 7, 7, "empty"), ("1", 70_010, 70_200, "same")] * 3
    windows_, reads_ = spark.createDataFrame(w, "id long, chrom string, begin long, end long"), spark.createDataFrame(r, "chrom string, start0 long, end0 long, name string")
    want = Counter((i, n) for i, c, b, e in w for d, s, t, n in r if c == d and b < e and s < t and s < e and t > b)
    pairs = overlap.overlaps(windows_, reads_, width=1000, split_above=split)
    assert Counter((x.id, x.name) for x in pairs.collect()) == want
    assert pairs.columns == ["id", "chrom", "begin", "end", "start0", "end0", "name"]
    left = overlap.overlaps(windows_, reads_, width=1000, how="left", split_above=split).collect()
    assert Counter((x.id, x.name) for x in left) == want + Counter((i, None) for i, *_ in w if not any(k[0] == i for k in want))
    counts = Counter(i for i, n in want.elements())
    assert {x.id: x.n for x in overlap.read_counts(windows_, reads_, ["id"]).collect()} == {i: counts[i] for i, *_ in w}


def test_long_windows_make_few_rows(spark):
    w = spark.createDataFrame([(0, 250_000_000), (5, 6), (16_000, 16_500)], "begin long, end long")
    rows = overlap._at_levels(w.withColumn("w_level", overlap.level_of(F.col("begin"), F.col("end"))), F.sequence("w_level", F.lit(overlap.LEVELS - 1)), F.col("begin"), F.col("end"), overlap.BIN, "first")
    assert max(x["count"] for x in rows.groupBy("begin").count().collect()) <= 2 * overlap.LEVELS


def test_depth_and_tracks(spark):
    cigar = "array<struct<op:int,len:int>>"
    r = spark.createDataFrame([("1", 10, [(4, 4), (0, 5), (2, 3), (1, 7), (0, 2)]), ("1", 12, [(0, 4)])], f"chrom string, start0 long, cigar {cigar}")
    depth = np.zeros(40, int)
    depth[10:15] += 1
    depth[18:20] += 1
    depth[12:16] += 1
    got = {x.pos: x.value for x in pileup.depth(r).collect()}
    value = 0
    for p in range(40):
        value = got.get(p, value)
        assert value == depth[p], p
    t = {(x.metric, x.pos): x.value for x in pileup.tracks(r).collect()}
    assert t["insert", 18] == 7
    assert (t["delete", 15], t["delete", 18]) == (1, 0)
    assert (t["clip", 8], t["clip", 12]) == (1, 0)
    assert pileup.insertion_lists(r).first()["values"] == [0, 7]


def test_array_statistics(spark):
    rows = spark.createDataFrame([([0],), ([0, 4],), ([0, 1, 2, 3, 4],)], "v array<int>").select(A.stats11(F.col("v")).alias("s")).select("s.*").collect()
    assert tuple(rows[0]) == (1, *[0.0] * 10)
    assert tuple(rows[1])[:6] == (2, 4.0, 4.0, 4.0, 4.0, 4.0)
    assert tuple(rows[2])[:6] == (5, 1.0, 2.0, 3.0, 4.0, 4.0)


def naive_row(ops, lens, width, to):
    full, at = np.zeros(width, np.float32), 0
    for op, n in zip(ops, lens, strict=True):
        if op in (1, 2):
            full[max(0, at - 2 * n) : max(0, min(width, at + 2 * n))] = 127 if op == 1 else 255
        elif op in (0, 4):
            full[max(0, at) : min(width, at + n)] = 0
        if op in (0, 1, 2, 3, 7, 8):
            at += n
    ratio = np.float32(np.float32(width - 1) / np.float32(to))
    out = []
    for i in range(to):
        x = np.float32(i) * ratio
        lo = int(np.floor(x))
        part = np.float32(x - np.float32(lo))
        v = full[lo] * (1 - part) + full[min(lo + 1, width - 1)] * part
        out.append(int(np.floor(v + np.float32(0.5))))
    return out


def test_raster_row_equals_full_painting():
    rng = random.Random(7)
    for _ in range(50):
        n = rng.randrange(1, 8)
        ops, lens = [rng.choice([0, 1, 2, 3, 4, 5, 7, 8]) for _ in range(n)], [rng.randrange(1, 60) for _ in range(n)]
        width = rng.randrange(1, 400)
        assert raster.row(np.array(ops), np.array(lens), 0, width, to=50).tolist() == naive_row(ops, lens, width, 50)


def test_raster_overwrites_and_empty_window(spark):
    assert raster.spans(np.array([0, 2, 1]), np.array([10, 2, 3]), 0, 30, raster.WIDE) == [(0, 10, 0), (6, 14, 255), (6, 18, 127)]
    w = spark.createDataFrame([(1, "1", 0, 100), (2, "2", 0, 100)], "id long, chrom string, begin long, end long")
    r = spark.createDataFrame([("1", 10, 60, [(0, 20), (2, 10), (0, 20)])], "chrom string, start0 long, end0 long, cigar array<struct<op:int,len:int>>")
    got = {x.id: x for x in raster.images(w, r, ["id"], ["start0"]).collect()}
    assert (got[1].n_reads, got[2].n_reads) == (1, 0)
    assert max(got[1].pixels) == 255
    assert len(got[2].pixels) == 224 * 224
    assert max(got[2].pixels) == 0


def plain_rows(reads, n, to):
    """Every read of a window painted whole and all rows resized."""
    lo, width = min(s for s, _, _ in reads), max(e for _, e, _ in reads) - min(s for s, _, _ in reads)
    made = np.array([naive_row(*zip(*[(4, 0), (3, s - lo), *c], strict=True), width, to) for s, e, c in reads])
    low, high, part = raster._places(n, to)
    part = part[:, None]
    return np.floor(made[low].astype(np.float32) * (1 - part) + made[high].astype(np.float32) * part + np.float32(0.5)).astype(np.uint8)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 40, 333])
def test_images_sample_deep_windows(spark, n):
    """Images of deep windows, of which only the sampled reads are fetched, equal those made of all reads."""
    rng, cigar = random.Random(n), "array<struct<op:int,len:int>>"
    reads = []
    for _ in range(n):
        c = [(rng.choice([0, 1, 2, 4, 8]), rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))] + [(0, 10)]
        s = rng.randrange(0, 90)
        reads.append((s, s + sum(k for op, k in c if op in (0, 2, 8)), c))
    rows = [("1", s, e, c, i) for i, (s, e, c) in enumerate(reads)]
    df = spark.createDataFrame(rows, f"chrom string, start0 long, end0 long, cigar {cigar}, ord long")
    w = spark.createDataFrame([("w", "1", 0, 100), ("none", "2", 0, 9)], "id string, chrom string, begin long, end long")
    inside = [r for r in sorted(enumerate(reads), key=lambda x: (x[1][0], x[0])) if r[1][0] < 100 and r[1][1] > 0]
    for number, most in ((None, 10_000), ("ord", 20)):
        got = {r.id: r for r in raster.images(w, df, ["id"], ["start0", "ord"], side=16, most=most, number=number).collect()}
        kept = [r for _, r in inside][:most]
        assert got["w"].n_reads == len(kept)
        assert (np.frombuffer(got["w"].pixels, np.uint8).reshape(16, 16) == plain_rows(kept, len(kept), 16)).all()
        assert max(got["none"].pixels) == 0


def test_sampled_ranks_are_those_that_the_stack_reads(spark):
    for n in (1, 5, 224, 225, 226, 300, 449, 1000, 9999, 10_000):
        got = {r[0] for r in spark.range(n).where(raster.sampled(F.col("id"), F.lit(n))).collect()}
        low, high, _ = raster._places(n, 224)
        want = set(range(n)) if n <= 224 else set(low.tolist()) | set(high.tolist())
        assert got >= set(low.tolist()) | set(high.tolist())
        assert len(got) <= len(want) + 1


def test_clip_width_and_gap(spark):
    """The reads' lengths count M, I, D, S, H and X; H isn't painted; a first read before the window moves the rows' begin to it."""
    cigar = "array<struct<op:int,len:int>>"
    c = [(5, 3), (4, 2), (0, 10), (3, 7), (1, 4), (2, 5), (8, 1), (7, 50)]  # 25 in all
    rows = [("a", 100, 90, c), ("a", 100, 120, c), ("b", 100, 130, c), ("b", 100, 110, c)]
    df = spark.createDataFrame(rows, f"id string, begin long, start0 long, cigar {cigar}")
    got = {r.id: (r.shift, r.width) for r in raster.clip_width(df, ["id"], ["start0"]).collect()}
    ends = {"a": (25, 55), "b": (35, 55)}  # from the first read's start, and from the window's begin
    assert got == {k: (-10 if k == "a" else 0, int(np.mean(v) + 3 * np.std(v))) for k, v in ends.items()}
    made = raster.channel_rows(df.join(raster.clip_width(df, ["id"], ["start0"]), "id"), ["id"], "width").where("id = 'a'").orderBy("start0").collect()
    first = np.frombuffer(made[0].pixels, np.uint8).reshape(4, -1)
    assert [np.flatnonzero(x).tolist() for x in first] == [list(range(2, 12)), list(range(12, 16)), list(range(16, 21)), [0, 1]]
    assert np.flatnonzero(np.frombuffer(made[1].pixels, np.uint8).reshape(4, -1)[3]).tolist() == [30, 31]
    half = raster.four_channels([5, 4, 0, 7, 1, 3, 2], [3, 4, 10, 5, 6, 8, 2], 4, 60, half_clip=True)
    assert [np.flatnonzero(x).tolist() for x in half] == [list(range(4, 14)), list(range(16, 22)), [27, 28], [2, 3, 4, 5]]


def test_visible_segments_equal_painting(spark):
    """Disjoint segments and column sums against painting, with gaps (N, =, X), wide spans and all schemes."""
    rng, kind = random.Random(11), "array<struct<op:int,len:int>>"
    rows = [(i, rng.choice("ab"), rng.randrange(0, 260), [(rng.choice([0, 1, 2, 3, 4, 5, 7, 8]), rng.randrange(1, 60)) for _ in range(rng.randrange(0, 14))]) for i in range(250)]
    df = spark.createDataFrame(rows, f"id long, g string, width long, cigar {kind}")
    for scheme in (raster.WIDE, raster.TWO_LEVELS, raster.CLIPS_AS_MATCHES):
        seen = {r.id: r.v for r in df.select("id", raster.visible(raster.span_array(F.col("cigar"), F.lit(0), F.col("width"), scheme)).alias("v")).collect()}
        sums = {}
        for i, g, width, cigar in rows:
            full, got = np.full(width, -1), np.full(width, -1)
            for lo, hi, v in raster.spans(np.array([c[0] for c in cigar], int), np.array([c[1] for c in cigar], int), 0, width, scheme):
                full[lo:hi] = v
            for s in seen[i]:
                assert (got[s.lo : s.hi] == -1).all()
                got[s.lo : s.hi] = s.value
            assert (got == full).all()
            for x, v in enumerate(full.tolist()):
                grey, n = sums.get((g, x), (0, 0))
                sums[g, x] = (grey + max(v, 0), n + 1)
        assert {(r.g, r.x): (r.grey, r.reads) for r in raster.column_sums(df, ["g"], scheme).collect()} == sums


def test_raster_extras():
    assert raster.four_channels([0, 1, 4], [3, 2, 2], 0, 10)[:, :7].any(axis=1).tolist() == [True, True, False, True]
    assert raster.bars(np.array([0, 5, 10]), 10).sum(axis=0).tolist() == [0, 5 * 255, 10 * 255]


def test_metrics_small(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, score double")
    assert metrics.auc(metrics.roc(rows)).first().auc == pytest.approx(0.75)
    by = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("b", 0, 0.9), ("b", 1, 0.8)], "class string, y int, score double")
    assert metrics.macro_auc(metrics.roc(by, ["class"])).first().auc == pytest.approx(0.75)  # mean curve (0, 0.5), (1, 1)


def test_negatives_fit_whenever_a_start_is_free(spark):
    """Dense zones with few free bases: every copy has a window, its start is free, and lies where brute force says that starts fit."""
    rng = np.random.default_rng(6)
    gap, size = 1024, 300_000
    pos = sorted({*range(500, 120_000, 2000), *rng.integers(120_000, size, 200).tolist(), 70_001})
    calls = spark.createDataFrame([("1", int(p)) for p in pos] + [("2", 5)], "chrom string, pos long")
    sizes = spark.createDataFrame([("1", size), ("2", 5000), ("3", 900)], "chrom string, len long")
    dels = [(f"d{i}", "1", 1000 * i, 1000 * i + int(n)) for i, n in enumerate(rng.integers(2, 60_000, 40))] + [("e", "2", 10, 4000), ("f", "3", 0, 700), ("g", "2", 0, 9_999)]
    got = windows.negative_windows(spark.createDataFrame(dels, "id string, chrom string, begin long, end long"), calls, sizes, copies=3).collect()
    length, zone, found = {"1": size, "2": 5000, "3": 900}, {"1": pos, "2": [5], "3": []}, Counter()
    for i, c, b, e in dels:
        at = np.arange(1, length[c] + 1)
        begin, end = np.maximum(0, at - 1 - gap), at - 1 - gap + (e - b)
        end = np.where(end >= length[c], length[c] - 1, end)
        fits = end - begin >= (e - b) // 2 + 1
        for p in zone[c]:
            fits[max(0, p - gap - 1) : max(0, p + gap - 1)] = False
        found[i] = 3 * bool(fits.any())
        for r in (r for r in got if r.id == i):
            assert fits[r.start - 1]
            assert (r.begin, r.end) == (begin[r.start - 1], end[r.start - 1])
    assert Counter(r.id for r in got) == +found


def test_zoomed_rows_and_other_schemes():
    ops, lens = np.array([4, 0, 2, 0]), np.array([5, 40, 10, 30])
    full = np.zeros(80, int)
    for lo, hi, v in raster.spans(ops, lens, 0, 80, raster.WIDE):
        full[lo:hi] = v
    assert set(full[20:40]) == {255}
    assert raster.spans(ops, lens, 0, 20, raster.WIDE, zoom=4)[2] == (5, 15, 255)
    assert raster.spans(ops, lens, 0, 80, raster.TWO_LEVELS)[2] == (40, 50, 191)
    assert {s.value[1] for s in (raster.WIDE, raster.FOUR_LEVELS, raster.TWO_LEVELS, raster.CLIPS_AS_MATCHES)} == {127, 191, 63, 255}


def test_channel_rows_bars_and_pages(spark):
    kind = "id string, begin long, start0 long, cigar array<struct<op: int, len: int>>"
    rows = spark.createDataFrame([("a", 10, 12, [(4, 4), (0, 6), (1, 2), (2, 3)]), ("b", 0, 5, [(0, 50)])], kind)
    got = {r.id: np.frombuffer(r.pixels, np.uint8).reshape(4, 20) for r in raster.channel_rows(rows, ["id"], 20).collect()}
    assert (got["a"] == raster.four_channels([4, 0, 1, 2], [4, 6, 2, 3], 2, 20)).all()
    assert got["b"][0].tolist() == [0] * 5 + [255] * 15
    half = raster.channel_rows(rows, ["id"], 20, half_clip=True).where("id = 'a'").first().pixels
    assert (np.frombuffer(half, np.uint8).reshape(4, 20) == raster.four_channels([4, 0, 1, 2], [4, 6, 2, 3], 2, 20, True)).all()
    bar = raster.bar_images(spark.createDataFrame([("t", [0, 5, 10])], "id string, values array<long>"), ["id"], height=4).first()
    assert np.frombuffer(bar.pixels, np.uint8).reshape(4, 3).T.tolist() == [[0, 0, 0, 0], [0, 0, 255, 255], [255, 255, 255, 255]]
    reads = spark.range(20).selectExpr("id as start0")
    assert [r.start0 for r in overlap.nth_reads(reads, ["start0"], 5, 8).collect()] == [5, 6, 7]


def test_switches_and_counts(spark):
    a, b = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    assert score.training_rows(a, b).count() == 8
    assert score.training_rows(a, b, with_negatives=False).count() == 3
    assert score.same_counts(p=a, q=a).count() == 2
    with pytest.raises(Exception, match="differ in their counts"):
        score.same_counts(p=a, q=b).collect()


def test_centred_resize_and_wrapped_colours(spark):
    row = spark.createDataFrame([([0.0, 10.0, 20.0, 30.0],)], "r array<double>")
    assert row.select(A.resized_centred(F.col("r"), 4, 2).alias("r")).first().r == [5.0, 25.0]
    assert row.select(A.resized_centred(F.col("r"), 4, 8).alias("r")).first().r == [0.0, 2.5, 7.5, 12.5, 17.5, 22.5, 27.5, 30.0]
    grey = spark.createDataFrame([([127, 255],)], "g array<int>").select(A.rgb_normalised(F.col("g"), wrap=True).alias("c")).first().c
    assert grey[1] == pytest.approx([(129 / 255 - 0.458) / 0.224, (1 / 255 - 0.458) / 0.224])


def test_roc_by_ranges(spark):
    """Ties, a null key, a group of one class and many ranges: equal to counting for each threshold, and to the trapezoids."""
    rows = [(g, (i * 7919) % 3 % 2, (i * 31) % 97 / 97) for g in ("x", None) for i in range(400)] + [("one", 1, 0.5), ("one", 1, 0.25)]
    found = metrics.roc(spark.createDataFrame(rows, "g string, y int, score double"), ["g"])
    got = {(r.g, r.threshold): (r.fpr, r.tpr) for r in found.collect()}
    areas = {r.g: r.auc for r in metrics.auc(found, ["g"]).collect()}
    assert len(got) == len({(g, s) for g, _, s in rows})
    for g in ("x", None, "one"):
        mine = [(y, s) for k, y, s in rows if k == g]
        area, x0, y0 = 0.0, 0.0, 0.0
        for t in sorted({s for _, s in mine}, reverse=True):
            x, y = (sum(c == k and s >= t for c, s in mine) / n if (n := sum(c == k for c, _ in mine)) else None for k in (0, 1))
            assert got[g, t] == (x, y)
            if x is not None:
                area, x0, y0 = area + (x - x0) * (y + y0) / 2, x, y
        assert areas[g] is None if g == "one" else abs(areas[g] - area) < 1e-9


def test_exact_quantiles(spark):
    """Ties, tiny groups, outliers that leave nearly all values in one range, nulls: as numpy has them, with few bins and values a range."""
    rng, probs = np.random.default_rng(2), [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    groups = {
        "normal": rng.normal(size=3000).tolist(), "ties": rng.integers(0, 4, 2000).astype(float).tolist(), "same": [2.5] * 500, "one": [7.0], "two": [1.0, 4.0],
        "outlier": [*rng.random(2500).tolist(), 1.7e308, -1.7e308], "hot": [*([3.0] * 1500), *rng.random(700).tolist()], None: [1.0, 2.0, 9.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("nulls", None), ("nan", float("nan")), ("one", float("inf")), ("one", None)]
    df = spark.createDataFrame(rows, "v string, x double").repartition(5)
    for bins, few in ((8, 20), (1024, 10_000)):
        got = {r.v: (r.n, r.q) for r in quantiles.exact_quantiles(df, ["v"], "x", probs, bins, few).collect()}
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            assert got[k][0] == len(values)
            assert np.allclose(got[k][1], np.quantile(values, probs), rtol=1e-9, atol=1e-12), k
    assert quantiles.exact_quantiles(df.limit(0), ["v"], "x", probs).count() == 0
    assert np.allclose(quantiles.exact_quantiles(df.where("v = 'normal'"), [], "x", [0.5], 8, 20).first().q, np.median(groups["normal"]))


def test_counted_statistics_equal_those_of_arrays(spark):
    rng = random.Random(4)
    values = {k: sorted(rng.choice([1, 2, 7, 50, 51]) for _ in range(n)) for k, n in enumerate([1, 2, 3, 4, 5, 17, 400])}
    counts = spark.createDataFrame([(k, v, n) for k, vs in values.items() for v, n in Counter(vs).items()], "k long, v int, n long")
    got = {r.k: tuple(r)[1:] for r in quantiles.counted_stats11(counts, ["k"], "v", "n").collect()}
    arrays = spark.createDataFrame([(k, [0, *vs]) for k, vs in values.items()], "k long, v array<int>").select("k", A.stats11(F.col("v")).alias("s")).select("k", "s.*").collect()
    for r in arrays:
        assert np.allclose(got[r.k], tuple(r)[1:])


def test_pages_read_their_ranges_only(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.col("id").alias("b"))
    path = f"file://{tmp_path}/ranked"
    overlap.write_ranked(rows, ["a"], path, ranges=20)
    want = sorted(i * 7919 % 5003 for i in range(5000))
    for first, last in ((0, 10), (4490, 4520), (4999, 6000), (300, 300), (0, 5000)):
        got = overlap.page(spark, path, first, last)
        assert [(r.rank, r.a) for r in got.collect()] == list(enumerate(want))[first:last]
    few = overlap.page(spark, path, 4490, 4520)
    assert few.select(F.input_file_name()).distinct().count() <= 2
    assert overlap.page(spark, path, 9000, 9001).count() == 0


def test_sums_without_pairs(spark):
    """Extents and clip widths of windows of all sizes from running sums equal those of pairs, and no plan holds a join of windows with reads."""
    rng = np.random.default_rng(5)
    cigar = "array<struct<op:int,len:int>>"
    begins, starts = rng.integers(0, 60_000, 80).tolist(), rng.integers(0, 60_000, 1500).tolist()
    w = spark.createDataFrame([(i, "ab"[i % 2], b, b + int(rng.choice([0, 1, 300, 40_000]))) for i, b in enumerate(begins)], 'id int, chrom string, begin long, end long')
    reads = [("a" if i % 3 else "b", s, s + n, [(4, int(rng.integers(9))), (0, n), (1, int(rng.integers(30)))]) for i, s in enumerate(starts) for n in [int(rng.choice([5, 200, 9000]))]]
    r = spark.createDataFrame(reads, f"chrom string, start0 long, end0 long, cigar {cigar}")
    pairs = [(i, [x for x in reads if x[0] == c and x[1] < e and x[2] > b], b) for i, c, b, e in w.collect() if e > b]
    got = overlap.extents(w, r, ["id"])
    assert "start0 < end" not in got._jdf.queryExecution().toString() and "start0#" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    assert {x.id: (x.ref_min, x.ref_max, x.n) for x in got.collect()} == {i: (min(x[1] for x in p), max(x[2] for x in p), len(p)) for i, p, _ in pairs if p}
    ends = {i: (min(0, min(x[1] for x in p) - b), [x[1] - b + sum(n for _, n in x[3]) for x in p]) for i, p, b in pairs if p}
    want = {i: (s, int(round(np.mean(e) - s + 3 * np.std(e), 6))) for i, (s, e) in ends.items()}
    assert {x.id: (x.shift, x.width) for x in raster.clip_widths(w, r, ["id"]).collect()} == want


def test_first_reads_of_tiles(spark):
    """First reads of narrow, wide, empty and unread windows equal those of a loop, by orders that begin with the start or don't; a plan of narrow windows has no pairs."""
    rng = np.random.default_rng(6)
    w = [(i, "a", b, b + int(rng.choice([0, 50, 3000, 40_000]))) for i, b in enumerate(rng.integers(0, 50_000, 60).tolist())] + [(99, "b", 5, 90)]
    reads = [("a", s, s + int(rng.choice([3, 400, 7000])), i) for i, s in enumerate(rng.integers(0, 60_000, 900).tolist())]
    wd, rd = spark.createDataFrame(w, "id int, chrom string, begin long, end long"), spark.createDataFrame(reads, "chrom string, start0 long, end0 long, ord int")
    for order in (["start0", "end0", "ord"], ["ord"]):
        sort = lambda x: tuple(x[["chrom", "start0", "end0", "ord"].index(c)] for c in order)  # noqa: B023, E731
        want = {(i, x[3]) for i, c, b, e in w if e > b for x in sorted((x for x in reads if x[0] == c and x[1] < e and x[2] > b), key=sort)[:7]}
        got = overlap.capped_reads(wd, rd, ["id"], order, 7).select("id", "ord").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    near = overlap.capped_reads(wd.where("end - begin < 5000"), rd, ["id"], ["start0"], 7)
    assert "start0#" not in "".join(x for x in near._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)


@pytest.mark.parametrize("half", [False, True])
def test_channel_sums_equal_painted_rows(spark, half):
    """Sums of narrow and wide windows without a painted row equal those of ``four_channels``, marks of one read over each other included."""
    rng = np.random.default_rng(7)
    w = [(i, "a", b, b + int(rng.choice([1, 900, 36_000])), int(rng.integers(-40, 1)), int(rng.choice([0, 60, 2500]))) for i, b in enumerate(rng.integers(0, 30_000, 25).tolist())]
    r = [("a", s, s + int(rng.integers(1, 500)), [(int(rng.integers(0, 9)), int(rng.integers(1, 60))) for _ in range(int(rng.integers(1, 7)))]) for s in rng.integers(0, 40_000, 150).tolist()]
    wd = spark.createDataFrame(w, "id int, chrom string, begin long, end long, shift long, width long")
    rd = spark.createDataFrame(r, "chrom string, start0 long, end0 long, cigar array<struct<op:int,len:int>>")
    want = {}
    for i, _, b, e, shift, width in w:
        of = [raster.four_channels([o for o, _ in x[3]], [n for _, n in x[3]], x[1] - b - shift, width, half) for x in r if x[1] < e and x[2] > b]
        if of:
            want[i] = tuple((np.array(of) > 0).sum(axis=(0, 2)).tolist())
    assert {x.id: (x.m, x.i, x.d, x.s) for x in raster.channel_sums(wd, rd, ["id"], half).collect()} == want


def test_tracks_read_the_reads_once(spark):
    """All tracks come from one reading of the reads, null and empty operations included; sums before are held against SQL."""
    c = "array<struct<op:int,len:int>>"
    r = spark.createDataFrame([("a", 10, [(4, 4), (0, 5), (1, 3), (2, 2), (0, 1), (4, 2)]), ("a", 10, []), (None, 3, [(0, 2)]), ("a", 5, None)], f"chrom string, start0 long, cigar {c}")
    t = pileup.tracks(r)
    assert t._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4  # two branches of running, each with its tiles; seven before
    got = {(x.chrom, x.metric, x.pos): x.value for x in t.collect()}
    assert got == {
        ("a", "match", 10): 1, ("a", "match", 15): 0, ("a", "match", 17): 1, ("a", "match", 18): 0, ("a", "delete", 15): 1, ("a", "delete", 17): 0, ("a", "clip", 8): 1, ("a", "clip", 12): 0,
        ("a", "clip", 17): 1, ("a", "clip", 19): 0, ("a", "left", 10): 1, ("a", "left", 18): 0, ("a", "right", 10): 1, ("a", "right", 18): 0, ("a", "insert", 15): 3,
    } | {k: v for k, v in got.items() if k[0] is None}


def test_column_sums_are_made_in_batches(spark):
    """Rows' ends are summed in Arrow batches, not by interpreted expressions for each read; a group may be null, a read without operations is a dark row."""
    c = "array<struct<op:int,len:int>>"
    r = spark.createDataFrame([(None, 4, [(0, 1), (1, 1), (0, 2)]), ("g", 3, []), ("g", 2, None), ("g", 0, [(1, 5)])], f"g string, width long, cigar {c}")
    s = raster.column_sums(r, ["g"], raster.NARROW)
    assert "aggregate(" not in s._jdf.queryExecution().optimizedPlan().toString()
    want = [(None, 0, 127, 1), (None, 1, 127, 1), (None, 2, 0, 1), (None, 3, 0, 1), ("g", 0, 0, 2), ("g", 1, 0, 2), ("g", 2, 0, 1)]
    assert sorted(map(tuple, s.collect()), key=str) == sorted(want, key=str)
