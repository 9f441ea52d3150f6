"""Matching two call sets under position and length tolerances.

Three operators that differ on purpose: ``band_pairs`` (every equal pair), ``forward_match`` (each call of the first set takes
the first equal call of the second behind the last match) and ``two_pointer_match`` (a merge of both sets by position).

Calls are rows (ord, chrom, pos, id, svtype, svlen, ...), ``ord`` unique per set and breaking ties of pos. The two ordered
operators are sequential. They run over fixed tiles of positions: each tile is folded from an assumed entry state (nothing
behind its start taken), and those whose entry turns out to differ from their left neighbour's exit are folded again, until
none does. Only tiles whose entry is right stay, so the result is that of one pass, however dense the calls are.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POS, LEN = 500, 100
TILE_CELLS = 64  # a tile is so many times as wide as the tolerance; a state reaches beyond it by one tolerance


def equal_calls(a: str = "a", b: str = "b", pos: int = POS, length: int = LEN, only_ins_del: bool = False) -> Column:
    """Same chromosome and type (two nulls are the same), positions within ``pos``, lengths within ``length`` if both are known."""
    c = lambda s, k: F.col(f"{s}.{k}")
    same = (c(a, "chrom") == c(b, "chrom")) & c(a, "svtype").eqNullSafe(c(b, "svtype")) & (F.abs(c(a, "pos") - c(b, "pos")) <= pos)
    same &= F.coalesce(F.abs(c(a, "svlen") - c(b, "svlen")) <= length, F.lit(True))
    return same & F.coalesce(c(a, "svtype").isin("INS", "DEL"), F.lit(False)) if only_ins_del else same


def band_pairs(a: DataFrame, b: DataFrame, pos: int = POS, length: int = LEN, only_ins_del: bool = False, how: str = "inner") -> DataFrame:
    """Equal pairs, as columns ``a`` and ``b`` (structs of the rows); semi and anti joins give rows of ``a``. Joined on
    (chrom, bin), each call of ``b`` in its own bin, each of ``a`` in the bins its tolerance reaches."""
    width = max(2 * pos, 1)
    x = a.withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos") - pos) / width), F.floor((F.col("pos") + pos) / width)))).alias("a")
    y = b.withColumn("bin", F.floor(F.col("pos") / width)).alias("b")
    on = equal_calls("a", "b", pos, length, only_ins_del) & (F.col("a.bin") == F.col("b.bin"))
    if how == "inner":
        return x.join(y, on).select(*[F.struct(*[F.col(f"{s}.{c}") for c in cols]).alias(s) for s, cols in (("a", a.columns), ("b", b.columns))])
    hit = x.join(y, on, "left_semi").select("ord").distinct()
    return a.join(hit, "ord", "left_semi" if how == "left_semi" else "left_anti")


def _shared(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="svlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/svlake/{label}-{uuid.uuid4().hex}"


def _kept(df: DataFrame) -> DataFrame:
    """A table written to the folder that driver and executors share, and read back."""
    path = _shared(df.sparkSession, "tiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _equal(x: tuple, y: tuple, pos: int, length: int) -> bool:
    if x[2] != y[2] or abs(x[0] - y[0]) > pos:
        return False
    return x[3] is None or y[3] is None or abs(x[3] - y[3]) <= length


# A fold takes a tile's calls (pos, ord, svtype, svlen) of both sets in order, the tile's end and its entry state (at, i, j); it
# yields steps (at, i, j) and returns its exit state: the last call taken of either set that the next tile can see, or nulls.
_NONE = (None, None, None)


def _forward(pos: int, length: int, only_ins_del: bool) -> Callable:
    def fold(a: list[tuple], b: list[tuple], end: int, entry: tuple) -> Iterator[tuple]:
        at, last = 0, entry
        if entry[0] is not None:
            at = bisect_right(b, (entry[0], entry[2]), key=lambda y: y[:2])
        for x in a:
            while at < len(b) and b[at][0] < x[0] - pos:
                at += 1
            k = at if not only_ins_del or x[2] in ("INS", "DEL") else len(b)
            while k < len(b) and b[k][0] <= x[0] + pos:
                if _equal(x, b[k], pos, length):
                    yield x[0], x[1], b[k][1]
                    last, at = (b[k][0], None, b[k][1]), k + 1
                    break
                k += 1
        return last if last[0] is not None and last[0] >= end - pos else _NONE

    return fold


def _two_pointers(pos: int, length: int) -> Callable:
    def fold(a: list[tuple], b: list[tuple], end: int, entry: tuple) -> Iterator[tuple]:
        i = bisect_right(a, (entry[0], entry[1]), key=lambda x: x[:2]) if entry[1] is not None else 0
        j = bisect_right(b, (entry[0], entry[2]), key=lambda y: y[:2]) if entry[2] is not None else 0
        last = entry
        while (i < len(a) and a[i][0] < end) or (j < len(b) and b[j][0] < end):
            if i < len(a) and j < len(b) and _equal(a[i], b[j], pos, length):
                yield a[i][0], a[i][1], b[j][1]
                last = (a[i][0], a[i][1], None) if a[i][0] >= end else (b[j][0], None, b[j][1])
                i, j = i + 1, j + 1
            elif j == len(b) or (i < len(a) and a[i][0] < b[j][0]):  # at equal positions the second set goes on
                yield a[i][0], a[i][1], None
                i += 1
            else:
                yield b[j][0], None, b[j][1]
                j += 1
        return last if last[0] is not None and last[0] >= end else _NONE

    return fold


def _tiled(d: DataFrame, side: int | Column, before: int, behind: int, width: int) -> DataFrame:
    """Calls in each tile they are seen from: ``before`` bases before its start to ``behind`` bases behind its end."""
    first, last = F.floor((F.col("pos") - behind) / width), F.floor((F.col("pos") + before) / width)
    d = d.where("chrom is not null and pos is not null")
    return d.select("chrom", F.explode(F.sequence(first, last)).alias("tile"), (F.lit(side) if isinstance(side, int) else side).alias("side"), F.col("pos").cast("long").alias("pos"), F.col("ord").cast("long").alias("ord"), "svtype", F.col("svlen").cast("long").alias("svlen"))


def _sweep(calls: DataFrame, fold: Callable, width: int) -> DataFrame:
    """(chrom, tile, step, at, i, j) of a fold over all tiles, as if one pass had gone through each chromosome. ``calls`` has side 0
    or 1; an entry state is a row of side 2 with pos, ord (of the first set) and svlen (ord of the second)."""
    kinds = pa.schema([("chrom", pa.string()), ("tile", pa.int64()), ("step", pa.int64()), ("at", pa.int64()), ("i", pa.int64()), ("j", pa.int64())])

    def folded(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        sides = ([], [], [])
        for side, *row in zip(*[t.column(c).to_pylist() for c in ("side", "pos", "ord", "svtype", "svlen")], strict=True):
            sides[side].append(tuple(row))
        entry = (sides[2][0][0], sides[2][0][1], sides[2][0][3]) if sides[2] else _NONE
        steps, chrom, tile = [], key[0].as_py(), key[1].as_py()

        def run():
            exit_ = yield from fold(sorted(sides[0], key=lambda r: r[:2]), sorted(sides[1], key=lambda r: r[:2]), (tile + 1) * width, entry)
            steps.append((-1, *exit_))

        steps += [(n, *s) for n, s in enumerate(run())]
        columns = list(zip(*steps, strict=True))
        return pa.table([pa.array([chrom] * len(steps), pa.string()), pa.array([tile] * len(steps), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], schema=kinds)

    go = lambda d: d.groupBy("chrom", "tile").applyInArrow(folded, "chrom string, tile long, step long, at long, i long, j long")
    none = F.struct(*[F.lit(None).cast("long").alias(c) for c in ("at", "i", "j")])
    entry = [F.lit(2).alias("side"), F.col("now.at").alias("pos"), F.col("now.i").alias("ord"), F.lit(None).cast("string").alias("svtype"), F.col("now.j").alias("svlen")]
    return _settled(calls, go, F.struct("at", "i", "j"), none, entry)


def _settled(calls: DataFrame, go: Callable[[DataFrame], DataFrame], leave: Column, none: Column, entry: list[Column]) -> DataFrame:
    """What ``go`` gives for (chrom, tile) groups of calls once each tile has been entered with the state its left neighbour was left in. ``go``
    makes one row of step -1 for each tile, whose exit state is ``leave``; ``none`` is the state to begin with, and ``entry`` makes a row like those
    of ``calls`` of a state called now. Tiles are gone through again until no entry state changes."""
    exits = lambda d, n: d.where("step = -1").select("chrom", "tile", F.lit(n).alias("round"), leave.alias("leave"))
    calls = _kept(calls)
    rounds = [_kept(go(calls))]
    states = _kept(exits(rounds[0], 0).withColumn("enter", none))
    while True:
        ahead = states.select("chrom", (F.col("tile") + 1).alias("tile"), F.col("leave").alias("now"))
        due = states.join(ahead, ["chrom", "tile"], "left").withColumn("now", F.coalesce("now", none)).where(~F.col("now").eqNullSafe(F.col("enter")))
        due = _kept(due.select("chrom", "tile", "now"))
        if due.limit(1).count() == 0:
            break
        rounds.append(_kept(go(calls.join(due, ["chrom", "tile"], "left_semi").unionByName(due.select("chrom", "tile", *entry)))))
        new = exits(rounds[-1], len(rounds) - 1).join(due.withColumnRenamed("now", "enter"), ["chrom", "tile"])
        states = _kept(states.join(due, ["chrom", "tile"], "left_anti").unionByName(new))
    last = [r.where("step >= 0").join(states.where(F.col("round") == n), ["chrom", "tile"], "left_semi") for n, r in enumerate(rounds)]
    return reduce(DataFrame.union, last)


def forward_match(a: DataFrame, b: DataFrame, pos: int = POS, length: int = LEN, only_ins_del: bool = False) -> DataFrame:
    """(i, j): ord of matched calls. In the order of (pos, ord), each call of ``a`` takes the first equal call of ``b`` behind the
    call of ``b`` that was matched last; calls without one leave that place as it is."""
    width = TILE_CELLS * max(pos, 1)
    calls = _tiled(a, 0, 0, 0, width).unionByName(_tiled(b, 1, pos, pos, width))
    return _sweep(calls, _forward(pos, length, only_ins_del), width).select("i", "j")


def two_pointer_steps(a: DataFrame, b: DataFrame, pos: int = POS, length: int = LEN) -> DataFrame:
    """The merge of two sets by position, one row per step: chrom, tile, step, at, i, j - a matched pair has both i and j (ord of
    the calls), a call passed over has one. Order steps by (chrom, tile, step)."""
    width = TILE_CELLS * max(pos, 1)
    return _sweep(_tiled(a, 0, 0, pos, width).unionByName(_tiled(b, 1, 0, pos, width)), _two_pointers(pos, length), width)


def two_pointer_match(a: DataFrame, b: DataFrame, pos: int = POS, length: int = LEN) -> DataFrame:
    return two_pointer_steps(a, b, pos, length).where("i is not null and j is not null").select("i", "j")


def chain_taken(calls: DataFrame, sets: int, pos: int = POS, length: int = LEN) -> DataFrame:
    """(ord) of the calls that a chain of two-pointer merges takes: set 1 into set 0, set 2 into what is left of both, and so on. ``calls`` are those of
    all sets with their number ``set``; ord is unique over all sets and breaks ties of pos.

    One sweep runs all merges. In a tile the last merge goes to the tile's end, and each one before it a tolerance further than the one behind,
    since that must see what is left so far ahead. The state between tiles has the place of each merge and the calls already taken of those the next tile still sees.
    """
    width, stages = TILE_CELLS * max(pos, 1), sets - 1
    kinds = pa.schema([("chrom", pa.string()), ("tile", pa.int64()), ("step", pa.int64()), ("ord", pa.int64()), ("state", pa.string())])
    fold = _two_pointers(pos, length)

    def folded(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        chrom, tile = (k.as_py() for k in key)
        seen, entry = [[] for _ in range(sets)], None
        for side, *row in zip(*[t.column(c).to_pylist() for c in ("side", "pos", "ord", "svtype", "svlen")], strict=True):
            if side < 0:
                entry = row[2]
            else:
                seen[side].append(tuple(row))
        for s in seen:
            s.sort(key=lambda r: r[:2])
        places, gone = json.loads(entry) if entry else ([_NONE] * stages, [])
        gone, taken, left, exits = set(gone), [], seen[0], []
        for m in range(stages):
            begin, end = (n * width + (stages - 1 - m) * pos for n in (tile, tile + 1))
            a, b = ([r for r in s if begin <= r[0] < end + pos] for s in (left, seen[m + 1]))

            def merge(a=a, b=b, end=end, at=tuple(places[m])):
                exits.append((yield from fold(a, b, end, at)))

            new = [j for _, i, j in merge() if i is not None and j is not None]
            taken += new
            gone.update(new)
            left = sorted(left + [r for r in seen[m + 1] if r[1] not in gone], key=lambda r: r[:2])
        ahead = sorted(r[1] for s in seen[1:-1] for r in s if r[0] >= (tile + 1) * width and r[1] in gone)
        state = json.dumps([exits, ahead]) if ahead or any(e != _NONE for e in exits) else None
        n = len(taken) + 1
        columns = ([chrom] * n, [tile] * n, [-1, *range(n - 1)], [None, *taken], [state] + [None] * (n - 1))
        return pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    go = lambda d: d.groupBy("chrom", "tile").applyInArrow(folded, "chrom string, tile long, step long, ord long, state string")
    none, no = F.lit(None).cast("string"), F.lit(None).cast("long")
    entry = [F.lit(-1).alias("side"), no.alias("pos"), no.alias("ord"), F.col("now").alias("svtype"), no.alias("svlen")]
    return _settled(_tiled(calls, F.col("set"), 0, stages * pos, width), go, F.col("state"), none, entry).select("ord")


def summary(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: same, dif1, dif2."""
    n = lambda d, name: d.agg(F.count("*").alias(name))
    one = n(matches, "same").crossJoin(n(a, "n1")).crossJoin(n(b, "n2"))  # three single rows
    return one.select("same", (F.col("n1") - F.col("same")).alias("dif1"), (F.col("n2") - F.col("same")).alias("dif2"))
