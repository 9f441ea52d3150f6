"""Variant-call text: scan, parse, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svlake.functions import vcf_info as V
from svlake.sources.files import write_sorted

COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line): lines of text files with a number that follows file order. Files are read by splits; a line's number is its
    split's rank and its place in it, so nothing passes through one task."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    where = lines.withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "n": F.monotonically_increasing_id()})
    counts = where.groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    from pyspark.sql import Window

    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    counts = counts.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    return where.join(counts, ["file", "block"]).select((F.col("before") + F.col("n") - F.col("first")).alias("ord"), "line")


def header(lines: DataFrame, anywhere: bool = False) -> DataFrame:
    """Header lines: those that begin with '#', or hold one anywhere."""
    return lines.where(F.contains(F.col("line"), F.lit("#")) if anywhere else F.startswith(F.col("line"), F.lit("#")))


def body(lines: DataFrame, anywhere: bool = False) -> DataFrame:
    return lines.where(~(F.contains(F.col("line"), F.lit("#")) if anywhere else F.startswith(F.col("line"), F.lit("#"))) & (F.trim("line") != ""))


def contigs(lines: DataFrame) -> DataFrame:
    """Distinct contig names of the header."""
    return header(lines).select(F.regexp_extract("line", r"contig=<ID=([^,>]*)", 1).alias("chrom")).where("chrom <> ''").distinct()


def records(lines: DataFrame) -> DataFrame:
    """Data lines split into columns; other columns of ``lines`` are kept. pos is a number, all else text."""
    # A generator of one row: the line is split once, not anew in each expression that reads a field.
    out = body(lines).select(*lines.columns, F.explode(F.array(F.split(F.rtrim("line"), "\t"))).alias("f"))
    return out.select(*lines.columns, *[(F.get("f", F.lit(i)).cast("bigint") if c == "pos" else F.get("f", F.lit(i))).alias(c) for i, c in enumerate(COLUMNS)])


def calls(lines: DataFrame) -> DataFrame:
    """Records as match keys: ord, chrom, pos, id, svtype, svlen (absolute), line."""
    r = records(lines)
    return r.select("ord", "chrom", "pos", "id", V.info_value(F.col("info"), "SVTYPE").alias("svtype"), V.abs_length(F.col("info")).alias("svlen"), "line")


def insertions(lines: DataFrame) -> DataFrame:
    """Records routed to INS with spos, epos (CIPOS) and svlen."""
    r = records(lines.where(V.route(F.col("line")) == "INS"))
    spos, epos = V.interval(F.col("info"), "CIPOS")
    return r.withColumns({"spos": spos, "epos": epos, "svlen": V.ins_length(F.col("info"), F.col("pos"))})


def deletions(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Records routed to DEL with spos, epos (CIPOS), end, send, eend (CIEND)."""
    r = records(lines.where(V.route(F.col("line")) == "DEL"))
    (spos, epos), (send, eend) = V.interval(F.col("info"), "CIPOS"), V.interval(F.col("info"), "CIEND")
    return r.withColumns({"spos": spos, "epos": epos, "end": V.del_end(F.col("info"), F.col("pos"), compat), "send": send, "eend": eend})


def header_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """(section, ord, line): the first header but for its last line, lines of the second that the first lacks (compared
    trimmed), the first's last line."""
    a, b = header(first), header(second)
    last = a.agg(F.max("ord").alias("last"))
    a = a.crossJoin(F.broadcast(last))  # one row
    missing = b.join(a.select(F.trim("line").alias("t")), F.trim(b.line) == F.col("t"), "left_anti").where(~F.startswith(F.col("line"), F.lit("#CHROM")))
    return (
        a.where("ord < last").select(F.lit(0).alias("section"), "ord", "line")
        .unionByName(missing.select(F.lit(1).alias("section"), "ord", "line"))
        .unionByName(a.where("ord = last").select(F.lit(2).alias("section"), "ord", "line"))
    )


def write_vcf(header_lines: DataFrame, body_lines: DataFrame, path: str) -> None:
    """One text file: the header (section, ord, line), then the body (ord, line) in order. A single file is what callers'
    tools read (``files.write_sorted``)."""
    rows = header_lines.select("section", "ord", "line").unionByName(body_lines.select(F.lit(9).alias("section"), "ord", "line"))
    write_sorted(rows, ["section", "ord"], "line", path)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; chrom is text when it is read again with read_table."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)
