from __future__ import annotations

import pytest

import numpy as np

import zlib

import gzip
import struct

from pyspark.sql import functions as F

from svlake.operators import clean, score
from svlake.sources import files, alignments
from svlake.streaming import calls as stream

READS = [("r1", 0, "1", 100, 60, [(4, 5), (0, 10), (2, 3), (0, 4)]), ("r2", 16, "2", 7, 20, [(0, 8), (1, 2)]), ("r3", 4, "*", -1, 0, [])]


def cigar_text(cigar):
    return "".join(f"{n}{alignments.OPS[op]}" for op, n in cigar) or "*"


def bam_bytes() -> bytes:
    refs = [("1", 1000), ("2", 500)]
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs))
    for name, n in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    for name, flag, chrom, pos, mapq, cigar in READS:
        ref = {"1": 0, "2": 1}.get(chrom, -1)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, 0, -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar)
        out += struct.pack("<i", len(body)) + body
    return out


EXPECTED = [("r1", "1", 100, 117), ("r2", "2", 7, 15), ("r3", "*", -1, -1)]


def test_bam(spark, tmp_path):
    data = bam_bytes()
    (tmp_path / "a.bam").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]) + gzip.compress(b""))
    reads = alignments.read_bam(spark, str(tmp_path / "a.bam"))
    assert sorted((r.name, r.chrom, r.start0, r.end0) for r in reads.collect()) == EXPECTED
    assert [r.name for r in reads.where("chrom = '2'").collect()] == ["r2"]
    assert reads.where("name = 'r1'").first().cigar[2].asDict() == {"op": 2, "len": 3}
    assert {(r.chrom, r.n) for r in alignments.mapped_contigs(reads).collect()} == {("1", 1), ("2", 1)}


def test_sam(spark, tmp_path):
    rows = ["@HD\tVN:1.6", "@SQ\tSN:1\tLN:1000", "@SQ\tSN:2\tLN:500"]
    rows += ["\t".join([n, str(f), c, str(p + 1), str(q), cigar_text(g), "*", "0", "0", "*", "*"]) for n, f, c, p, q, g in READS]
    (tmp_path / "a.sam").write_text("\n".join(rows) + "\n")
    assert sorted((r.name, r.chrom, r.start0, r.end0) for r in alignments.read_sam(spark, str(tmp_path / "a.sam")).collect()) == EXPECTED
    assert {tuple(r) for r in alignments.sam_contigs(spark, str(tmp_path / "a.sam")).collect()} == {("1", 1000), ("2", 500)}


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.vcf").write_text("#h\n1\t5\ta\tN\t<I>\t.\tPASS\tSVTYPE=INS\n1\t9\tb\tN\t<I>\t.\tPASS\tSVTYPE=DEL\n")
    keys = spark.createDataFrame([("1", 9, "b")], "chrom string, pos long, id string")
    q = stream.kept(stream.parsed(stream.read_lines(spark, str(folder))), keys).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.svtype) for r in spark.table("kept").collect()] == [("b", "DEL")]


def test_split_and_training(spark):
    rows = spark.range(200).select("id", F.array((F.col("id") % 2).cast("double"), F.rand(1)).alias("vector"), (F.col("id") % 2).cast("int").alias("label"))
    parts = {r.part: r["count"] for r in score.split_of(rows).groupBy("part").count().collect()}
    assert 120 < parts["train"] < 190
    assert {r.part for r in score.split_of(rows, test_is_all=True).select("part").distinct().collect()} == {"both", "test"}
    model = score.train(rows)
    right = score.scores(model, rows).where((F.col("scores")[1] > 0.5).cast("int") == F.col("label")).count()
    assert right == 200


def test_few_negatives_stay(spark):
    rows = spark.range(5).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    assert clean.cleaned(rows, rows, rows).count() == 5


def test_depth_lines_labels_reports(spark, tmp_path):
    depth = spark.createDataFrame([("1", 0, 3), ("1", 7, 1), ("X", 5, 2)], "chrom string, pos long, depth long")
    files.write_depth(depth, str(tmp_path / "depth"))
    files.write_depth(depth.limit(0), str(tmp_path / "depth"))  # what is there stays
    assert sorted(map(tuple, files.read_depth(spark, str(tmp_path / "depth")).collect())) == [("1", 0, 3), ("1", 7, 1), ("X", 5, 2)]
    assert sorted("".join(f.read_text() for f in (tmp_path / "depth/chrom=1").glob("*.csv")).splitlines()) == ["1\t1\t3", "1\t8\t1"]
    files.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "ord long, line string"), str(tmp_path / "dump"), head="CHROM")
    assert next((tmp_path / "dump").glob("*.txt")).read_text() == "CHROM\na\nb\n"
    files.write_labels(spark.createDataFrame([(1, 0), (0, 1), (2, 1)], "place long, label int"), str(tmp_path / "labels"))
    assert next((tmp_path / "labels").glob("*.txt")).read_text() == "1\n0\n1\n"
    files.write_report(spark.createDataFrame([("a", 1)], "name string, n long"), str(tmp_path / "report"))
    assert [tuple(r) for r in files.read_report(spark, str(tmp_path / "report"), "name string, n long").collect()] == [("a", 1)]
    (tmp_path / "whole.json").write_text('[{"name": "b",\n "n": 2}]')
    assert [tuple(r) for r in files.read_report(spark, str(tmp_path / "whole.json"), "name string, n long", whole=True).collect()] == [("b", 2)]


def png(grey, kind, colour=0):
    """A PNG whose rows all use one filter type."""
    h, w = grey.shape
    flat = (np.repeat(grey[:, :, None], 3, axis=2) if colour == 2 else grey[:, :, None]).reshape(h, -1).astype(int)
    n, raw = 3 if colour == 2 else 1, b""
    for y in range(h):
        up = flat[y - 1] if y else np.zeros_like(flat[0])
        left, corner = (np.concatenate([np.zeros(n, int), v[:-n]]) for v in (flat[y], up))
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        raw += bytes([kind]) + ((flat[y] - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    z = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", z[:5]) + chunk(b"IDAT", z[5:]) + chunk(b"IEND", b"")


def test_grey_images_and_listing(spark, tmp_path):
    rng = np.random.default_rng(0)
    made = {k: rng.integers(0, 256, (7, 9)) for k in range(10)}
    for k, grey in made.items():
        (tmp_path / f"{k + 1}.png").write_bytes(png(grey, k % 5, 0 if k < 5 else 2))
    (tmp_path / "notes.txt").write_text("none")
    got = {int(r.file.rsplit("/", 1)[1][:-4]) - 1: r for r in files.read_grey(spark, str(tmp_path)).collect()}
    for k, grey in made.items():
        assert (got[k].width, got[k].height) == (9, 7)
        assert got[k].pixels == grey.astype(np.uint8).tobytes()
    assert sorted((r.place for r in files.listing(spark, str(tmp_path)).collect()), key=str) == [*sorted(range(1, 11), key=str), None]
    with pytest.raises(ValueError, match="not a PNG"):
        files.grey_pixels(b"GIF89a")
