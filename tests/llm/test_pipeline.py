from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks_by_hand
from test_mixing import fill as targets_by_hand
from test_near_dedup import brute as near_duplicate_components

import corpus_pipeline as P
from svlake.llm import decontaminate, near_dedup, quality
from svlake.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == COLUMNS
        path = f"{P.scratch(spark, 'test')}-{n}"
        out.write.parquet(path)
        before, docs = {r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(path)
        kept[name] = [r.doc_id for r in docs.collect()]
        assert set(kept[name]) <= set(before)
    assert len(kept["quality"]) > len(kept["near_dedup"]) >= len(kept["decontaminate"])
    assert len(set(kept["mixing"])) > 0
    assert near_dedup.near_duplicates(docs.dropDuplicates(["doc_id"])).where("not kept").count() == 0
    assert decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    got = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows, start = sorted((r.doc_id, r.text) for r in docs.collect()), 0
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_each_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Quality: the k largest keys, k as many as the weights expect.
    drawn = quality.importance_resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    k = round(sum(1 / (1 + math.exp(-r.log_weight)) for r in drawn if r.log_weight is not None))
    want = {r.doc_id for r in sorted((r for r in drawn if r.log_weight is not None), key=lambda r: -r.sample_key)[:k]}
    docs = P.materialise(P.quality_stage(spark, docs, sf_dir), "quality")
    assert {r.doc_id for r in docs.collect()} == want
    # Near duplicates: all pairs, 5-word shingles.
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    component = near_duplicate_components(rows, 5)
    docs = P.materialise(P.near_dedup_stage(spark, docs, sf_dir), "near")
    assert {r.doc_id for r in docs.collect()} == {i for i, c in component.items() if i == c}
    # Decontamination: every window of every item's length.
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if w]
    items = [(r.item_id, split(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, split(r.text)) for r in docs.collect()]
    grams = {g for _, w in items for g in zip(*[w[j:] for j in range(5)], strict=False)}
    suspects = [(i, w) for i, w in rows if not grams.isdisjoint(zip(*[w[j:] for j in range(5)], strict=False))]
    leaked = {i for i, _ in leaks_by_hand(suspects, [x for x in items if len(x[1]) >= 5])}
    docs = P.materialise(P.decontaminate_stage(spark, docs, sf_dir), "clean")
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in rows} - leaked
    # Mixing: targets by filling up, missed by half a document at most.
    sizes, longest, taken = Counter(), Counter(), Counter()
    for r in docs.collect():
        n = len((r.text or "").encode().split())
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    out = P.mixing_stage(spark, docs, sf_dir).collect()
    for r in out:
        taken[r.source] += len((r.text or "").encode().split())
    assert max(Counter(r.doc_id for r in out).values()) <= 3
    want = targets_by_hand(sizes)
    assert all(abs(taken[s] - want[s]) <= max(longest[s] / 2, 1) for s in sizes)


def test_stages_on_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, "one two three four", None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "same words in this row", "en", None, 1), (3, "same words in this row", "en", None, 1), (4, "same words in this row", "de", "b", 1)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == COLUMNS
        assert stage(spark, docs, sf_dir).count() >= 0
    assert sorted(str(r.doc_id) for r in P.near_dedup_stage(spark, odd, sf_dir).collect()) == ["1", "2", "3", "None"]


def test_verdicts_follow_rows_without_and_with_repeated_ids(spark, sf_dir):
    """Junk and benchmark passages without an id go; of rows that share an id only the bad one does; columns may have any name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad, good = (docs.join(marks.where(f"quality = {q}").select("doc_id"), "doc_id", "left_semi").where("n_chars > 400").orderBy("doc_id").first() for q in (0, 1))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    more = [(None, bad.text, "en", "a", 1), (10_001, good.text + " extra words at the end", "en", "a", 1), (10_001, bad.text, "en", "a", 1), (None, f"{good.text} {item}", "en", "a", 1), (10_002, good.text[::-1], "en", "a", 1), (10_002, item, "en", "a", 1)]
    odd = docs.unionByName(spark.createDataFrame(more, schema)).withColumns({"row_key": F.lit("k"), "kept": F.lit(1), "item_id": F.lit(None).cast("int"), "times": F.lit(2)})
    kept = P.quality_stage(spark, odd, sf_dir)
    assert kept.columns == odd.columns
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert (None, bad.text) not in texts
    assert (10_001, bad.text) not in texts
    assert (10_001, more[1][1]) in texts
    clean = P.decontaminate_stage(spark, odd, sf_dir)
    assert clean.columns == odd.columns
    texts = {(r.doc_id, r.text) for r in clean.collect()}
    assert (None, more[3][1]) not in texts
    assert (10_002, item) not in texts
    assert (10_002, more[4][1]) in texts
    unique = P.near_dedup_stage(spark, odd, sf_dir)
    assert unique.columns == odd.columns
    assert (None, bad.text) not in {(r.doc_id, r.text) for r in unique.collect()}
    assert P.mixing_stage(spark, odd, sf_dir).columns == odd.columns


def test_a_very_long_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    long = spark.createDataFrame([(99_999, " ".join(f"word{i}" for i in range(200_000)), "en", "a", 1)], docs.select(*COLUMNS).schema)
    for _, stage in P.STAGES[1:-1]:
        assert stage(spark, docs.unionByName(long), sf_dir).where("doc_id = 99999").count() >= 0
    assert P.STAGES[-1][1](spark, docs.unionByName(long), sf_dir).where("doc_id = 99999").first().n_tokens > 200_000


def test_empty_labels_and_benchmark(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.quality_stage(spark, docs, str(tmp_path)).count() == docs.where("text rlike '[^ \\t-\\r]'").count()
    assert P.decontaminate_stage(spark, docs, str(tmp_path)).count() == docs.count()
