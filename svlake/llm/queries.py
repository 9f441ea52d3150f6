"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compaction, decontaminate, filter_audit, hilbert_ann, licences, mixing, near_dedup, packing, periodic_runs, quality, token_files, toxicity, warc
from .common import scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.document_licences(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compaction.compacted(table(spark, sf_dir, "documents"), scratch(spark, "store"))
    return rows.select("doc_id", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"), block_words=64, shards=16)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.capture_histories(table(spark, sf_dir, "pages")).select(*columns)


def op10_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_periods(table(spark, sf_dir, "documents"))))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.place(made.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_licences, op3_near_dedup, op4_token_files, op5_compaction, op6_toxicity, op7_mixing, op8_decontaminate, op9_warc, op10_hilbert_ann,
        op11_periodic_runs, op12_packing, op13_filter_audit,
    )
}
# Near duplicates by comparing all pairs of documents that share a shingle; meant for small tables.
_NEAR = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 2 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
linked as (select a, b from e union all select b, a from e),
r(x, y) as (select doc_id, doc_id from documents union select r.x, linked.b from r join linked on linked.a = r.y),
m as (select x, min(y) as component_id from r group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from documents d join m on m.x = d.doc_id left join n on n.doc_id = d.doc_id"""

_CHARS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = f"array_to_string([array_to_string([{_CHARS}[((('0x' || sha[5 * i + 1:5 * i + 5])::bigint >> (15 - 5 * j)) & 31) + 1] for j in range(4)], '') for i in range(8)], '')"
_WARC = f"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
f as (select *, min(page_id) over (partition by html) as first from p)
select page_id, octet_length(encode(html)) as payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f"""

_STORED = "select doc_id, cast(octet_length(encode(text)) as int) as n_bytes, md5(text) as text_md5 from documents"

_AUDIT = r"""with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from t),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
d as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t),
 regexp_matches(t, '[#$%&*|]'), case when w.doc_id is null then first is not null else w.doc_id > first end] as f from w left join l on l.doc_id = w.doc_id),
h as (select part, f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from d group by part, f),
i as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as o from i a, i b, i c, i d, i e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select o, i as step, o[i] as own, o[:i - 1] as earlier from o, i),
x as (select part, o, step, own, n, good, toxic, f[own] as fails, len(list_filter(earlier, lambda e: f[e])) > 0 as gone, len(list_filter(f, lambda b: b)) = 1 as single from h, s),
r as (select part, o, step, own, sum(case when not fails and not gone then n else 0 end) as kept, sum(case when fails and not gone then n else 0 end) as removed, sum(case when fails and gone then n else 0 end) as redundant,
 sum(case when fails and single then n else 0 end) as unique_fails, sum(case when fails and not gone then good else 0 end) as good_lost, sum(case when fails and not gone then toxic else 0 end) as toxic_lost from x group by all),
v as (select *, sum(removed) over (partition by part, own) as shapley from r)
select part, array_to_string([substr('ABCDE', cast(k as int), 1) for k in o], '') as filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(shapley as bigint) as shapley from v"""

SQL: dict[str, str] = {"op13_filter_audit": _AUDIT, "op3_near_dedup": _NEAR, "op5_compaction": _STORED, "op9_warc": _WARC}
