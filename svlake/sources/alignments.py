"""Alignments as DataFrames: SAM text, split by column functions, and BAM through ``svlake.sources.bam``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svlake.sources.bam import BamSource, read_bam

__all__ = ["OPS", "BamSource", "cigar_array", "mapped_contigs", "read_bam", "read_sam", "sam_contigs"]

OPS = "MIDNSHP=X"


def cigar_array(text):
    """A CIGAR text column as an array of (op, len); '*' is empty."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct((F.instr(F.lit(OPS), F.substring(p, -1, 1)) - 1).cast("int").alias("op"), F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("len")))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of SAM text: chrom, start0, end0, flag, cigar, name, mapq."""
    from svlake.operators.pileup import end0

    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith(F.col("value"), F.lit("@")) & (F.col("value") != ""))
    rows = rows.select(f[2].alias("chrom"), (f[3].cast("long") - 1).alias("start0"), f[1].cast("int").alias("flag"), cigar_array(f[5]).alias("cigar"), f[0].alias("name"), f[4].cast("int").alias("mapq"))
    return rows.select("chrom", "start0", end0(F.col("cigar"), F.col("start0")).alias("end0"), "flag", "cigar", "name", "mapq")


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, len) of the @SQ lines."""
    rows = spark.read.text(path).where(F.startswith(F.col("value"), F.lit("@SQ")))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("len"))


def mapped_contigs(reads: DataFrame) -> DataFrame:
    """(chrom, n) of contigs with mapped reads."""
    return reads.where((F.col("chrom") != "*") & (F.col("flag").bitwiseAND(4) == 0)).groupBy("chrom").agg(F.count("*").alias("n"))
