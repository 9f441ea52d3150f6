"""Call sets as streams: parsing, keeping, de-duplicating and counting lines as files of them arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svlake.functions import vcf_info as V


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "line")


def parsed(lines: DataFrame) -> DataFrame:
    """chrom, pos, id, info, svtype, line of data lines; works on streams and tables."""
    f = F.split("line", "\t")
    info = f[7]
    rows = lines.where(~F.startswith(F.col("line"), F.lit("#")) & (F.trim("line") != ""))
    return rows.select(f[0].alias("chrom"), f[1].try_cast("bigint").alias("pos"), f[2].alias("id"), info.alias("info"), V.info_value(info, "SVTYPE").alias("svtype"), "line")


def kept(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Calls whose (chrom, pos, id) is in a table of keys."""
    return calls.join(keys.select("chrom", "pos", "id").distinct(), ["chrom", "pos", "id"], "left_semi")


def distinct_calls(calls: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Each (chrom, pos, id) once, as long as repeats come within ``late`` of each other by the column ``time``."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark(["chrom", "pos", "id"])


def counts_by_window(events: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, svtype, n) in tumbling windows; rows more than ``late`` behind are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "svtype").agg(F.count("*").alias("n"))
