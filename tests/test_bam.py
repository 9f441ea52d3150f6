"""BAM splits, regions and indexes against the whole file read in order."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from svlake.sources import bam

CONTIGS = [("1", 3_000_000), ("2", 400_000), ("empty", 1000), ("X", 90_000)]


def records(n: int, seed: int, sequences: bool = False) -> tuple[bytes, list[tuple]]:
    """Sorted records, some with sequences and tags, some very long, some unplaced; and their rows."""
    rng, out, rows = np.random.default_rng(seed), [], []
    places = sorted((int(rng.choice([0, 0, 1, 3])), int(rng.integers(0, 80_000))) for _ in range(n)) + [(-1, -1)] * 3
    for i, (ref, pos) in enumerate(places):
        cigar = [(int(rng.choice([0, 1, 2, 3, 4, 5, 7, 8])), int(rng.integers(1, 50 if rng.random() < 0.98 else 60_000))) for _ in range(rng.integers(0, 6))] if ref >= 0 else []
        l_seq = sum(k for op, k in cigar if op in (0, 1, 4, 7, 8)) if sequences else 0
        name, flag, mapq = f"read{i}" + "x" * int(rng.integers(0, 30)), 0 if ref >= 0 else 4, int(rng.integers(0, 61))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, l_seq, -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", k << 4 | op) for op, k in cigar) + rng.bytes((l_seq + 1) // 2 + l_seq) + (b"NMC" + rng.bytes(1) if sequences else b"")
        out.append(struct.pack("<i", len(body)) + body)
        end = pos + sum(k for op, k in cigar if op in (0, 2, 3, 7, 8))
        rows.append((CONTIGS[ref][0] if ref >= 0 else "*", pos, end, flag, tuple(cigar), name, mapq))
    return b"".join(out), rows


def written(path, n: int, seed: int, size: int = 700, sequences: bool = False) -> list[tuple]:
    body, rows = records(n, seed, sequences)
    data = bam.header_bytes(CONTIGS) + body
    path.write_bytes(b"".join(bam.block(data[i : i + size]) for i in range(0, len(data), size)) + bam.END_BLOCK)
    return rows


def got(df) -> list[tuple]:
    return sorted((r.chrom, r.start0, r.end0, r.flag, tuple((c.op, c.len) for c in r.cigar), r.name, r.mapq) for r in df.collect())


@pytest.mark.parametrize(("split", "size", "sequences"), [(1 << 25, 60_000, False), (3000, 700, False), (900, 300, True), (20_000, 5000, True)])
def test_splits_equal_the_whole(spark, tmp_path, split, size, sequences):
    rows = written(tmp_path / "a.bam", 400, split, size, sequences)
    df = bam.read_bam(spark, str(tmp_path / "a.bam"), split=split)
    assert df.rdd.getNumPartitions() == -(-(tmp_path / "a.bam").stat().st_size // split)
    assert got(df) == sorted(rows)


def test_a_record_begins_in_one_split_only(tmp_path):
    """Every split point of a small file: the two halves have the file's records, each once."""
    rows = written(tmp_path / "a.bam", 14, 9, 200, True)
    reader, size = bam.BamReader({"path": str(tmp_path / "a.bam")}), (tmp_path / "a.bam").stat().st_size
    for cut in range(1, size, max(1, size // 150)):
        names = [x for p in (bam.Part(str(tmp_path / "a.bam"), 0, cut << 16, False), bam.Part(str(tmp_path / "a.bam"), cut << 16, size << 16, False)) for b in reader.read(p) for x in b.column("name").to_pylist()]
        assert names == [r[5] for r in rows], cut


@pytest.mark.parametrize("split", [1500, 1 << 25])
def test_regions_through_the_index(spark, tmp_path, split):
    rows = written(tmp_path / "a.bam", 600, 4) + written(tmp_path / "b.bam", 300, 5)
    bam.build_indexes(spark, str(tmp_path), split=2000)
    assert (tmp_path / "a.bam.bai").exists()
    df, rng = bam.read_bam(spark, f"file://{tmp_path}", split=split), np.random.default_rng(0)
    for _ in range(12):
        chrom, begin = str(rng.choice(["1", "2", "X", "empty", "none"])), int(rng.integers(0, 90_000))
        end = begin + int(rng.choice([1, 50, 20_000]))
        assert got(bam.region(df, chrom, begin, end)) == sorted(r for r in rows if r[0] == chrom and r[1] < end and r[2] > begin)
    spanning = df.where("chrom in ('1', '2') and start0 <= 30000 and end0 >= 50000 and mapq > 5")
    assert got(spanning) == sorted(r for r in rows if r[0] in "12" and r[1] <= 30000 and r[2] >= 50000 and r[6] > 5)
    assert got(df.where("chrom = '*'")) == sorted(r for r in rows if r[0] == "*")


def test_a_region_reads_its_chunks_only(spark, tmp_path):
    written(tmp_path / "a.bam", 4000, 6)
    bam.build_indexes(spark, str(tmp_path / "a.bam"))
    reader = bam.BamReader({"path": str(tmp_path / "a.bam"), "split": "2000"})
    reader.wanted = bam.Wanted({"2"}, [("start0", "<", 20_000), ("end0", ">", 10_000)])
    parts, size = reader.partitions(), (tmp_path / "a.bam").stat().st_size
    assert len(parts) > 3
    assert sum((p.until >> 16) - (p.begin >> 16) for p in parts) < size / 3
    assert all(a.until <= b.begin for a, b in zip(parts, parts[1:], strict=False))


def test_index_round_trip_and_stats(spark, tmp_path):
    rows = written(tmp_path / "a.bam", 500, 7)
    bam.build_indexes(spark, str(tmp_path / "a.bam"), split=3000)
    data = (tmp_path / "a.bam.bai").read_bytes()
    index = bam.Index.parse(data)
    assert index.packed() == data
    want = {}
    for r in rows:
        if r[0] != "*":
            want[r[0]] = want.get(r[0], 0) + 1
    assert {r.chrom: (r.mapped, r.unmapped) for r in bam.index_stats(spark, str(tmp_path)).collect()} == {c: (n, 0) for c, n in want.items()}
    (tmp_path / "c.bam").write_bytes((tmp_path / "a.bam").read_bytes())
    with pytest.raises(Exception, match="no index with counts"):
        bam.index_stats(spark, str(tmp_path)).collect()


def test_bins():
    assert bam.bin_of(np.array([0, 0, 16_383, 1 << 14, 0, 3 << 20]), np.array([1, 1 << 14, 16_385, (1 << 14) + 5, 1 << 29, (3 << 20) + 9])).tolist() == [4681, 4681, 585, 4682, 0, 4681 + (3 << 6)]


def test_write_then_read(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(str(rng.choice(["1", "2", "X", "Y"])), int(rng.integers(0, 50_000)), [(0, int(rng.integers(1, 300))), (1, 5), (2, 3)], f"n{i}", int(i % 60)) for i in range(3000)] + [(None, None, [], None, None)]
    df = spark.createDataFrame(rows, f"chrom string, start0 long, cigar {bam.CIGAR_TYPE}, name string, mapq int")
    bam.write_bam(df, f"file://{tmp_path}/out", CONTIGS, files=3)
    back = bam.read_bam(spark, f"file://{tmp_path}/out", split=4000)
    known = {c for c, _ in CONTIGS}
    want = sorted((c if c in known else "*", s if s is not None else -1, tuple(g), n or "*", q if q is not None else 255) for c, s, g, n, q in rows)
    assert sorted((r.chrom, r.start0, tuple((x.op, x.len) for x in r.cigar), r.name, r.mapq) for r in back.collect()) == want
    assert back.where("chrom = '1'").select(F.max("end0")).first()[0] == max(s + sum(n for op, n in g if op != 1) for c, s, g, *_ in rows if c == "1")
    bam.write_bam(df.limit(0), f"file://{tmp_path}/none", CONTIGS, files=2)
    assert not list((tmp_path / "none").glob("*.bam"))


def test_cut_files_are_errors(spark, tmp_path):
    written(tmp_path / "a.bam", 50, 1, 2000)
    data = (tmp_path / "a.bam").read_bytes()
    (tmp_path / "a.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="no whole BGZF block|ends within"):
        bam.read_bam(spark, str(tmp_path / "a.bam")).collect()


def test_finding_a_record_holds_few_places_at_once(tmp_path):
    """A split that begins within a file looks for its first record without gathering the fields of every place of a megabyte."""
    import tracemalloc

    written(tmp_path / "a.bam", 30_000, 11, 60_000)
    with bam.open_uri(str(tmp_path / "a.bam"))[0].open_input_file(str(tmp_path / "a.bam")) as file:
        size, n = file.size(), len(CONTIGS)
        blocks = bam.Blocks(file, bam.first_block(file, 1000, size))
        tracemalloc.start()
        assert bam.resync(blocks, n, size)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert bam.is_record(blocks.data, 0, n)
    assert peak < 32 << 20
