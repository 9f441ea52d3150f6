"""Classification metrics as aggregations: confusion, report, ROC curves and areas.

ROC sums run over distinct scores. The scores are counted first (map-side), so what is sorted is one row per score and
class, however many rows share it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svlake.operators import match as M


def confusion(rows: DataFrame) -> DataFrame:
    """(y, y_hat, n)."""
    return rows.groupBy("y", "y_hat").agg(F.count("*").alias("n"))


def report(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) per class that occurs in y or y_hat; a ratio over nothing is 0."""
    c = confusion(rows)
    classes = c.select(F.col("y").alias("class")).union(c.select("y_hat")).distinct()
    true = c.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(F.col("y_hat").alias("class")).agg(F.sum("n").alias("said"))
    r = classes.join(true, "class", "left").join(said, "class", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    r = r.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("support"))})
    return r.select("class", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: accuracy, macro precision and macro recall."""
    right = confusion(rows).agg((F.sum(F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return right.crossJoin(report(rows).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall")))  # single rows


def _ranged(rows: DataFrame, by: list[str], score: str, last: dict) -> DataFrame:
    """``rows`` dealt by ranges of (by, falling score) and written, with ``range`` and, from a row per range and group, the columns of ``last``:
    each an aggregate of a range, as a struct ``before`` of their values over the ranges before it (sums of sums, greatest of greatest)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = M._kept(rows.repartitionByRange(parts, *by, F.desc(score)).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*by, "range").agg(*[f(c).alias(c) for c, f in last.items()])
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in [*by, "range"]], F.struct(*[f(c).over(before).alias(c) for c, f in last.items()]).alias("before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("range") == F.col("_range"))
    return ranged.join(ends, same).drop(*[f"_{c}" for c in [*by, "range"]])


def roc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, threshold, fpr, tpr of rows (y 0 or 1, score), for each distinct score from the highest. Sums run within ranges of scores and start
    where the ranges before end, so no curve meets in one task."""
    by = by or []
    counts = rows.groupBy(*by, "score").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("q"))
    ranged = _ranged(counts, by, "score", {"p": F.sum, "q": F.sum})
    totals = counts.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q")).select(*[F.col(c).alias(f"_{c}") for c in by], "all_p", "all_q")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    down = Window.partitionBy(*by, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rate = lambda c: F.try_divide(F.sum(c).over(down) + F.coalesce(f"before.{c}", F.lit(0)), F.col(f"all_{c}"))
    joined = ranged.join(totals, same) if by else ranged.crossJoin(totals)  # without a key, a single row
    return joined.select(*by, F.col("score").alias("threshold"), rate("q").alias("fpr"), rate("p").alias("tpr"))


def auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, auc by trapezoids, the curve starting at (0, 0). By ranges of thresholds; a curve rises, so a range starts at the greatest point before it."""
    by = by or []
    ranged = _ranged(curve.select(*by, "threshold", "fpr", "tpr"), by, "threshold", {"fpr": F.max, "tpr": F.max})
    down = Window.partitionBy(*by, "range").orderBy(F.desc("threshold"))
    x0, y0 = (F.coalesce(F.lag(c).over(down), F.col(f"before.{c}"), F.lit(0.0)) for c in ("fpr", "tpr"))
    area = ranged.withColumn("part", (F.col("fpr") - x0) * (F.col("tpr") + y0) / 2)
    return area.groupBy(*by).agg(F.sum("part").alias("auc"))


def macro_auc(curve: DataFrame, by: str = "class") -> DataFrame:
    """One row: the area under the mean of the classes' curves, each interpolated linearly at every class's fpr."""
    classes = F.broadcast(curve.select(by).distinct())  # a row per class
    top = curve.groupBy(by, "fpr").agg(F.max("tpr").alias("hi"), F.min("tpr").alias("lo"))
    grid = curve.select("fpr").distinct().crossJoin(classes)  # each point for each of the few classes
    points = grid.join(top, [by, "fpr"], "left")
    back = Window.partitionBy(by).orderBy("fpr").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.desc("fpr")).rowsBetween(Window.unboundedPreceding, 0)  # a running value; a frame to the end would be read anew for each row
    known = F.when(F.col("hi").isNotNull(), F.struct("fpr", "hi", "lo"))
    points = points.withColumns({"a": F.last(known, ignorenulls=True).over(back), "b": F.last(known, ignorenulls=True).over(ahead)})
    x0, y0 = F.coalesce("a.fpr", F.lit(0.0)), F.coalesce("a.hi", F.lit(0.0))
    slope = F.try_divide(F.col("b.lo") - y0, F.col("b.fpr") - x0)
    points = points.withColumn("y", F.coalesce("hi", y0 + slope * (F.col("fpr") - x0)))
    mean = points.groupBy("fpr").agg(F.avg("y").alias("tpr"))
    order = Window.orderBy("fpr")  # distinct points of a curve
    x, y = F.coalesce(F.lag("fpr").over(order), F.lit(0.0)), F.coalesce(F.lag("tpr").over(order), F.lit(0.0))
    return mean.withColumn("part", (F.col("fpr") - x) * (F.col("tpr") + y) / 2).agg(F.sum("part").alias("auc"))
