from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from svlake.llm import compaction as C
from svlake.llm.common import scratch


def rows(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("x").alias("shard"))


def test_every_row_once(spark):
    docs = rows(spark, 500).unionByName(spark.createDataFrame([(None, None, None), (3, None, "s"), (3, None, "s"), (9, "y" * 200_000, None)], "doc_id long, text string, shard string"))
    got = C.compacted(docs, scratch(spark, "store"), arrivals=16)
    assert got.columns == ["doc_id", "text", "shard", "shard1"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.drop("shard1").collect())) == sorted(map(key, docs.collect()))
    assert C.compacted(docs.limit(0), scratch(spark, "store")).count() == 0


def test_tiers_versions_and_target(spark):
    store = C.ShardStore(spark, scratch(spark, "store"), target_bytes=40_000, base_bytes=1_000, fanout=4)
    for k in range(16):
        store.append(rows(spark, 200).withColumn("doc_id", F.col("doc_id") + 1000 * k).coalesce(1))
    before = store.runs()
    assert store.version() == 16
    assert len(before) == 16
    store.compact()
    runs = store.runs()
    assert len(runs) < 16
    assert store.version() > 16
    assert store.read().count() == 3200
    tiers = [r["tier"] for r in runs if not store.sealed(r)]
    assert all(tiers.count(t) < 4 for t in tiers)
    assert all(r["bytes"] / r["files"] < 4 * 40_000 for r in runs)
    assert store.runs(16) == before
    assert store._read(before).count() == 3200  # earlier versions stay readable
    rows(spark, 5).write.parquet(str(store._at("runs/orphan/all")))
    store.vacuum()
    assert store._fs.exists(store._at("runs/orphan"))  # it may be a writer's that hasn't committed yet
    store.vacuum(keep_versions=1, age_seconds=0)
    assert not store._fs.exists(store._at("runs/orphan"))
    assert not any(store._fs.exists(store._at(f"runs/{r['run']}")) for r in before if r not in runs)
    assert store.read().count() == 3200
    assert store.version() > 16


def test_an_append_is_one_version_and_outlives_conflicts(spark):
    store, other = (C.ShardStore(spark, path) for path in [scratch(spark, "store")] * 2)
    store.append(rows(spark, 100).withColumn("arrival", F.col("doc_id") % 5), "arrival")
    assert store.version() == 1
    assert len(store.runs()) == 5
    commit, calls = store.commit, []

    def late(runs, after):  # another writer commits between reading the version and committing
        if not calls:
            calls.append(other.append(rows(spark, 7)))
        return commit(runs, after)

    store.commit = late
    assert store.append(rows(spark, 20).withColumn("arrival", F.col("doc_id") % 2), "arrival") == 3
    assert store.read().count() == 127
    calls.clear()
    store.fanout = 2
    store.compact()  # an append in between is kept
    assert store.read().count() == 134
    assert len(store.runs()) < 9


def test_a_merge_of_sources_that_are_gone_is_dropped(spark):
    store, other = (C.ShardStore(spark, path, fanout=2) for path in [scratch(spark, "store")] * 2)
    for _ in range(2):
        store.append(rows(spark, 10))
    merge, calls = store._merge, []

    def late(due, folder):
        made = merge(due, folder)
        if not calls:
            calls.append(other.compact())
        return made

    store._merge = late
    store.compact()
    assert store.read().count() == 20
    assert len(store.runs()) == 1


def test_other_failures_are_not_conflicts(spark):
    store = C.ShardStore(spark, scratch(spark, "store"))
    store._fs.delete(store._at("manifest"), True)
    store._fs.create(store._at("manifest"), True).close()  # a file where the folder should be
    with pytest.raises(Exception) as e:  # noqa: PT011
        store.commit([], 0)
    assert not isinstance(e.value, C.ConcurrentCommit)


def test_labels_agree_between_runs(spark):
    docs = rows(spark, 300)
    a, b = ({(r.doc_id, r.shard1) for r in C.compacted(docs, scratch(spark, "store")).collect()} for _ in range(2))
    assert a == b


def test_commit_is_atomic(spark):
    store = C.ShardStore(spark, scratch(spark, "store"))
    store.append(rows(spark, 10))
    v = store.version()
    store.commit(store.runs(), v)
    with pytest.raises(C.ConcurrentCommit):
        store.commit([], v)
    assert store.read().count() == 10
    assert store.version() == v + 1
