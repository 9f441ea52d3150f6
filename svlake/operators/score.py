"""Scoring of samples and filtering of call sets by predicted label; splits and samples for training."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_calls(calls: DataFrame, names: DataFrame, labels: DataFrame) -> DataFrame:
    """Calls (id, svtype, ...) with the label of their first place in ``names`` (svtype, id, place); labels are (svtype, place,
    predicted). Calls without a place are left out."""
    first = names.groupBy("svtype", "id").agg(F.min("place").alias("place"))
    return calls.join(first, ["svtype", "id"]).join(labels, ["svtype", "place"]).drop("place")


def filtered(records: DataFrame, kept: DataFrame) -> DataFrame:
    """Records whose (chrom, pos, id) is among ``kept``; file order is their ord's."""
    return records.join(kept.select("chrom", "pos", "id"), ["chrom", "pos", "id"], "left_semi")


def split_of(df: DataFrame, key: str = "id", train: float = 0.8, test_is_all: bool = False) -> DataFrame:
    """``part``: train or test, by a hash of the key. ``test_is_all`` instead marks train rows as both, as a reproduced leak."""
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    return df.withColumn("part", F.when(draw < train, "both" if test_is_all else "train").otherwise("test"))


def repeated_ids(samples: DataFrame) -> DataFrame:
    return samples.groupBy("class", "id").agg(F.count("*").alias("n")).where("n > 1")


def missing(expected: DataFrame, found: DataFrame, key: str = "chrom") -> DataFrame:
    return expected.join(found.select(key).distinct(), key, "left_anti")


def train(rows: DataFrame, seed: int = 10, parallelism: int = 4):
    """Best logistic regression over a grid of penalties, by area under the curve on a fifth of the rows (vector, label)."""
    v = rows.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=30)
    grid = ParamGridBuilder().addGrid(model.regParam, [1e-4, 1e-2]).addGrid(model.elasticNetParam, [0.0, 0.5]).build()
    return TrainValidationSplit(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), trainRatio=0.8, seed=seed, parallelism=parallelism).fit(v).bestModel


def scores(model, rows: DataFrame) -> DataFrame:
    """Rows with ``scores``, an array of class probabilities."""
    v = rows.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    out = model.transform(v)
    return out.select(*rows.columns, vector_to_array("probability").alias("scores"))


def scores_by(predict, rows: DataFrame, batch: int = 64, width: int | None = None) -> DataFrame:
    """Rows with ``scores`` from a function that makes a batch predictor: predict() returns f(array (n, width)) -> array (n, classes). Vectors are
    equally long; ``width`` is taken from one of them if it isn't given. A row without vector has no scores."""
    from pyspark.sql.types import ArrayType, FloatType

    if width is None:
        one = rows.where("vector is not null").select(F.size("vector")).first()
        width = one[0] if one else 1
    udf = predict_batch_udf(predict, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[width]])
    whole = F.coalesce(F.col("vector").cast("array<double>"), F.array_repeat(F.lit(0.0), width))
    return rows.withColumn("scores", F.when(F.col("vector").isNotNull(), udf(whole)))


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("nth = 1").drop("nth")


def training_rows(positives: DataFrame, negatives: DataFrame, with_negatives: bool = True) -> DataFrame:
    """Both sets, or with the switch off the positives alone; the columns are those of the positives."""
    return positives.unionByName(negatives.select(*positives.columns)) if with_negatives else positives


def same_counts(**sets: DataFrame) -> DataFrame:
    """(name, n) of sets that must be aligned; reading it fails if their counts differ."""
    counts = None
    for name, rows in sets.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    ends = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))  # one row
    checked = counts.crossJoin(ends).withColumn("ok", F.assert_true(F.col("lo") == F.col("hi"), F.lit("sets that should be aligned differ in their counts")))
    return checked.where("ok is null").select("name", "n")
