"""Scores as aggregates; every one has a defined value on an empty table."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORST = sys.float_info.max


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg((F.col(label) == F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"))


def rmse(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """A row without a prediction adds the greatest double, so the score shows it."""
    error = F.col(label) - F.col(predicted)
    return df.agg(F.coalesce(F.sqrt(F.avg(F.coalesce(error * error, F.lit(WORST)))), F.lit(WORST)).alias("rmse"))


def _f1(hits: Column, wrong: Column, missed: Column) -> Column:
    both = 2 * hits + wrong + missed
    return F.when(both > 0, 2 * hits / both).otherwise(0.0)


def f1(df: DataFrame, label: str, predicted: str, target: float = 1.0) -> DataFrame:
    """F1 of one label."""
    is_, said = F.col(label) == target, F.col(predicted) == target
    count = lambda c: F.count(F.when(c, 1))
    return df.agg(_f1(count(is_ & said), count(~is_ & said), count(is_ & ~said)).alias("f1"))


def f1_weighted(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Each label's F1 weighted by its frequency."""
    pairs = df.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("l").alias("c"), F.col("n").alias("own"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("said")))).alias("s")).select("s.*")
    by = sides.groupBy("c").agg(F.sum("own").alias("own"), F.sum("hit").alias("hit"), F.sum("said").alias("said"))
    each = by.select("own", _f1(F.col("hit"), F.col("said") - F.col("hit"), F.col("own") - F.col("hit")).alias("f"))
    return each.agg(F.coalesce(F.sum(F.col("f") * F.col("own")) / F.sum("own"), F.lit(0.0)).alias("f1"))


def inertia(df: DataFrame, squared: Column) -> DataFrame:
    """Sum of the given squared distances to the nearest centroids."""
    return df.agg(F.coalesce(F.sum(squared), F.lit(WORST)).alias("inertia"))
