"""Cleaning of negative samples: PCA, K-means, and cosine similarity of clusters to gold samples."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svlake.functions.arrays import cosine

KEEP, DROP, LIKE = 0.2, 0.05, 0.6


def cluster_shares(rows: DataFrame) -> DataFrame:
    """(cluster, n, share) of rows with a column ``cluster``."""
    n = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per cluster


def cluster_verdicts(rows: DataFrame, gold_ins: DataFrame, gold_del: DataFrame, keep: float = KEEP, drop: float = DROP, like: float = LIKE) -> DataFrame:
    """(cluster, n, share, verdict): large clusters are kept and small ones dropped; another is dropped if its representative - the
    member with the smallest id - resembles a gold insertion, or else a gold deletion. Rows are (id, vector, cluster), gold sets
    (vector), a few dozen each by construction."""
    shares = cluster_shares(rows)
    heads = rows.groupBy("cluster").agg(F.min_by("vector", "id").alias("vector"))
    gold = gold_ins.select(F.lit("ins").alias("kind"), F.col("vector").alias("g")).unionByName(gold_del.select(F.lit("del").alias("kind"), F.col("vector").alias("g")))
    seen = heads.crossJoin(F.broadcast(gold)).withColumn("c", cosine(F.col("vector"), F.col("g")))  # clusters x gold samples
    best = seen.groupBy("cluster").agg(F.max(F.when(F.col("kind") == "ins", F.col("c"))).alias("like_ins"), F.max(F.when(F.col("kind") == "del", F.col("c"))).alias("like_del"))
    verdict = (
        F.when(F.col("share") >= keep, "keep").when(F.col("share") <= drop, "drop_small")
        .when(F.col("like_ins") >= like, "drop_ins").when(F.col("like_del") >= like, "drop_del").otherwise("keep")
    )
    return shares.join(best, "cluster", "left").select("cluster", "n", "share", verdict.alias("verdict"))


def reduced(rows: DataFrame, k: int = 50, fit_on: DataFrame | None = None) -> DataFrame:
    """(id, vector) projected to k principal components, fitted on ``fit_on`` or the rows themselves."""
    as_vector = lambda d: d.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(as_vector(fit_on if fit_on is not None else rows))
    return model.transform(as_vector(rows)).select("id", vector_to_array("p").alias("vector"))


def clustered(rows: DataFrame, k: int = 15, seed: int = 1) -> DataFrame:
    """(id, vector, cluster) by K-means."""
    v = rows.select("id", "vector", array_to_vector("vector").alias("v"))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(v)
    return model.transform(v).select("id", "vector", "cluster")


def cleaned(negatives: DataFrame, gold_ins: DataFrame, gold_del: DataFrame, dims: int = 50, k: int = 15, least: int = 50, shared_pca: bool = True) -> DataFrame:
    """Rows (id, vector) of ``negatives`` that stay. Fewer than ``least`` are left as they are. With ``shared_pca`` all sets lie on the
    axes fitted to the negatives; without, each on its own, which makes them incomparable but is what some trained models saw."""
    if negatives.limit(least).count() < least:
        return negatives
    own = reduced(negatives, dims)
    gold = [reduced(g, dims, negatives if shared_pca else None) for g in (gold_ins, gold_del)]
    groups = clustered(own, k)
    stay = cluster_verdicts(groups, *gold).where("verdict = 'keep'").select("cluster")
    ids = groups.join(F.broadcast(stay), "cluster", "left_semi").select("id")  # k rows
    out = negatives.join(ids, "id", "left_semi")
    return out if out.limit(1).count() else negatives
