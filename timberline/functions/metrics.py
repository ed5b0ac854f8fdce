"""Metrics of (y, prediction), each one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.sources.tables import partitions, settled


def mse(y: str = "y", prediction: str = "prediction") -> Column:
    return F.avg((F.col(y).cast("double") - F.col(prediction)) ** 2)


def rmse(y: str = "y", prediction: str = "prediction") -> Column:
    return F.sqrt(mse(y, prediction))


def log_loss(y: str = "y", prediction: str = "prediction") -> Column:
    """Of class labels and arrays of probabilities."""
    return F.avg(-F.ln(F.get(prediction, F.col(y).cast("int"))))


def auc_table(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """One row with auc, by rank sums with ties halved. Rows are first counted per distinct prediction; these are dealt to ranges of about equal size however scores are spread, and the ranges'
    totals (a row per range) carry counts across, so no task sorts everything."""
    score = F.col(prediction).cast("double")
    counts = df.groupBy(score.alias("p")).agg(F.sum(F.when(F.col(y) > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    ranged = settled(counts.repartitionByRange(partitions(df.sparkSession), "p").withColumn("range", F.spark_partition_id()), "scores")
    before = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("range").alias("r")).agg(F.sum(F.col("n") - F.col("pos")).alias("neg"))
    totals = totals.select("r", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("neg_before"))
    inside = W.partitionBy("range").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranged.join(F.broadcast(totals), F.col("range") == F.col("r")).withColumn("below", F.col("neg_before") + F.coalesce(F.sum(F.col("n") - F.col("pos")).over(inside), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2))
    return ranked.agg((wins / F.nullif(F.sum("pos") * F.sum(F.col("n") - F.col("pos")), F.lit(0))).alias("auc"))
