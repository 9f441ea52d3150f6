"""Variant data over the generated tables: the same views for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHROM_LEN = 2_592_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str, caller: str | None = None) -> DataFrame:
    """ord, chrom, pos, id, svtype, svlen, k, caller."""
    out = _table(spark, sf_dir, "events").selectExpr(
        "event_id as ord", "cast(user_id % 4 + 1 as string) as chrom",
        "cast(floor(unix_micros(cast(ts as timestamp)) / 1000000.0) as bigint) - 1704067200 + 1 as pos", "concat('ev.', event_id) as id",
        "case event_type when 'click' then 'INS' when 'purchase' then 'DEL' when 'view' then 'DUP' when 'signup' then 'INV' else 'BND' end as svtype",
        "case when event_type = 'error' then null else cast(round(value * 10) as int) end as svlen",
        "cast(get_json_object(props, '$.k') as int) as k", "case when event_id % 2 = 0 then 'A' else 'B' end as caller",
    )
    return out.where(F.col("caller") == caller).drop("caller") if caller else out


CALLS = """calls as (select event_id as ord, cast(user_id % 4 + 1 as varchar) as chrom,
  cast(floor(epoch_us(ts) / 1000000.0) as bigint) - 1704067200 + 1 as pos, concat('ev.', event_id) as id,
  case event_type when 'click' then 'INS' when 'purchase' then 'DEL' when 'view' then 'DUP' when 'signup' then 'INV' else 'BND' end as svtype,
  case when event_type = 'error' then null else cast(round(value * 10) as int) end as svlen,
  cast(json_extract_string(props, '$.k') as int) as k, case when event_id % 2 = 0 then 'A' else 'B' end as caller from events)"""


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, line: header lines (negative ord), then a line per call."""
    body = calls(spark, sf_dir).selectExpr(
        "ord",
        "explode(array(concat(chrom, '\\t', pos, '\\t', id, '\\t', 'N', '\\t', '<', svtype, '>', '\\t', '.', '\\t', 'PASS', '\\t', "
        "case when k % 5 = 0 then 'IMPRECISE;' else 'PRECISE;' end, 'SVTYPE=', svtype, "
        "case when svlen is null then '' else concat(';SVLEN=', case when svtype = 'DEL' then -svlen else svlen end) end, "
        "case when k % 3 = 0 then concat(';CIPOS=-', k, ',', k) else '' end, case when k % 4 = 0 then concat(';CIEND=-', k, ',', k) else '' end, "
        "case when svtype = 'DEL' and k % 2 = 0 then concat(';END=', pos + svlen) else '' end, '\\t', 'GT', '\\t', '0/1'))) as line",  # made once, not anew in each expression that reads it
    )
    head = sizes(spark).select((F.col("chrom").cast("bigint") - 100).alias("ord"), F.format_string("##contig=<ID=%s,length=%d>", "chrom", "len").alias("line"))
    first = spark.range(1).select(F.lit(-200).cast("bigint").alias("ord"), F.lit("##fileformat=VCFv4.2").alias("line"))
    last = spark.range(1).select(F.lit(-1).cast("bigint").alias("ord"), F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE").alias("line"))
    return first.union(head).union(last).union(body)


def header_lines(spark: SparkSession, sf_dir: str, caller: str | None = None) -> DataFrame:
    """ord, line: the header over a caller's calls, its contigs as long as the last call says."""
    found = calls(spark, sf_dir, caller).groupBy("chrom").agg(F.max("pos").alias("len"))
    head = found.select((F.col("chrom").cast("bigint") - 100).alias("ord"), F.format_string("##contig=<ID=%s,length=%d>", "chrom", "len").alias("line"))
    return vcf_lines(spark, sf_dir).where(F.col("ord").isin(-200, -1)).unionByName(head)


VCF_LINES = (
    CALLS
    + """, vcf_lines as (select ord, chrom, pos, id, concat(chrom, chr(9), pos, chr(9), id, chr(9), 'N', chr(9), '<', svtype, '>', chr(9), '.', chr(9), 'PASS', chr(9),
  case when k % 5 = 0 then 'IMPRECISE;' else 'PRECISE;' end, 'SVTYPE=', svtype,
  case when svlen is null then '' else concat(';SVLEN=', case when svtype = 'DEL' then -svlen else svlen end) end,
  case when k % 3 = 0 then concat(';CIPOS=-', k, ',', k) else '' end, case when k % 4 = 0 then concat(';CIEND=-', k, ',', k) else '' end,
  case when svtype = 'DEL' and k % 2 = 0 then concat(';END=', pos + svlen) else '' end, chr(9), 'GT', chr(9), '0/1') as line from calls),
info as (select ord, chrom, pos, id, line, string_split(line, chr(9))[8] as info from vcf_lines)"""
)


def sizes(spark: SparkSession) -> DataFrame:
    return spark.range(4).select((F.col("id") + 1).cast("string").alias("chrom"), F.lit(CHROM_LEN).cast("bigint").alias("len"))


def ins_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svlake.operators.windows import insertion_windows

    return insertion_windows(calls(spark, sf_dir).where("svtype = 'INS'").select("id", "chrom", "pos"), sizes(spark))


INS_WINDOWS = (
    CALLS
    + f""", win_ins as (select id, chrom, pos, greatest(0, pos - 1 - 1024) as "begin",
  case when pos - 1 + 1024 >= {CHROM_LEN} then {CHROM_LEN - 1} else pos - 1 + 1024 end as "end" from calls where svtype = 'INS')"""
)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start0, end0, clip, m1, op, oplen, m2, cigar."""
    r = _table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey % 4 + 1 as string) as chrom", "cast(datediff(l_shipdate, timestamp_ntz'1995-01-01') as bigint) * 1000 + l_partkey % 1000 as start0",
        "cast(l_linenumber as int) as clip", "cast(l_quantity * 10 as int) as m1", "case l_returnflag when 'A' then 1 when 'N' then 2 else 8 end as op",
        "cast(round(l_discount * 1000) as int) + 1 as oplen", "cast(round(l_extendedprice) as bigint) % 700 + 50 as m2",
    )
    op = lambda o, n: F.struct(F.lit(o).alias("op") if isinstance(o, int) else F.col(o).alias("op"), F.col(n).cast("int").alias("len"))
    r = r.withColumn("end0", F.expr("start0 + m1 + m2 + case when op in (2, 8) then oplen else 0 end"))
    return r.withColumn("cigar", F.array(op(4, "clip"), op(0, "m1"), op("op", "oplen"), op(0, "m2")))


READS = """reads as (select *, start0 + m1 + m2 + case when op in (2, 8) then oplen else 0 end as end0 from (select cast(l_suppkey % 4 + 1 as varchar) as chrom,
  cast(date_diff('day', timestamp '1995-01-01', l_shipdate) as bigint) * 1000 + l_partkey % 1000 as start0,
  cast(l_linenumber as int) as clip, cast(l_quantity * 10 as int) as m1, case l_returnflag when 'A' then 1 when 'N' then 2 else 8 end as op,
  cast(round(l_discount * 1000) as int) + 1 as oplen, cast(round(l_extendedprice) as bigint) % 700 + 50 as m2 from lineitem))"""


def bam_files(spark: SparkSession, sf_dir: str) -> str:
    """The reads as BAM files with indexes, in a folder of their own."""
    from svlake.operators.match import _shared
    from svlake.sources import bam

    path = _shared(spark, "bam")
    ends = reads(spark, sf_dir).groupBy("chrom").agg(F.max("end0")).orderBy("chrom").collect()  # a row for each contig
    bam.write_bam(reads(spark, sf_dir), path, [tuple(r) for r in ends])
    bam.build_indexes(spark, path)
    return path


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector, cluster: clusters are made uneven, so that large and small ones occur."""
    cluster = F.when(F.col("label") < 3, 0).when(F.col("vec_id") % 50 == 0, 1).otherwise(F.col("label"))
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), cluster.cast("int").alias("cluster"))


VECTORS = "vectors as (select vec_id as id, cast(embedding as double[]) as vector, cast(case when label < 3 then 0 when vec_id % 50 = 0 then 1 else label end as int) as cluster from embeddings)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lang, y, score, y_hat."""
    d, lab = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), _table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "lang", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("y_hat"))


SCORED = "scored as (select d.doc_id as id, d.lang, l.quality as y, cast(d.n_chars as double) as score, l.toxic as y_hat from documents d join labels l on d.doc_id = l.doc_id)"
