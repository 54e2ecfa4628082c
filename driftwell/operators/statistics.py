"""Sufficient statistics of trees and naive Bayes as aggregates, and ridge regression from sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """class, n, fraction."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("class", "n", (F.col("n") / F.col("total")).alias("fraction"))


def entropy(distribution: DataFrame) -> DataFrame:
    return distribution.agg(F.coalesce(-F.sum(F.when(F.col("fraction") > 0, F.col("fraction") * F.log2("fraction"))), F.lit(0.0)).alias("entropy"))


def majority(distribution: DataFrame) -> DataFrame:
    """The most frequent class and its fraction; of equal ones the smallest."""
    top = F.max(F.struct("n", (-F.col("class")).alias("c"), "fraction")).alias("t")
    return distribution.agg(top).select((-F.col("t.c")).alias("class"), F.col("t.fraction").alias("fraction"))


def long_form(df: DataFrame, attributes: dict[str, Column], label: str, keep: list[str] = ()) -> DataFrame:
    """One row per point and attribute: attr, class, value."""
    cells = F.array(*[F.struct(F.lit(k).alias("attr"), v.cast("double").alias("value")) for k, v in attributes.items()])
    return df.select(*keep, F.col(label).alias("class"), F.explode(cells).alias("c")).select(*keep, "class", "c.attr", "c.value")


def gaussians(cells: DataFrame, *more: str) -> DataFrame:
    """n, mean, variance (of the sample; 0 for one value), d, lo, hi of each attribute and class."""
    return cells.groupBy("attr", "class", *more).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.nullif(F.var_samp("value"), F.lit(float("nan"))), F.lit(0.0)).alias("variance"), (F.var_pop("value") * F.count("value")).alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def merge_gaussians(parts: DataFrame) -> DataFrame:
    """Pools rows of (attr, class, n, mean, d) by mean and squared deviations; empty parts add nothing."""
    some = parts.where("n > 0")
    total = some.groupBy("attr", "class").agg(F.sum("n").alias("total"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("center"))
    gap = F.col("mean") - F.col("center")
    pooled = some.join(total, ["attr", "class"]).groupBy("attr", "class", "total", "center").agg(F.sum(F.col("d") + F.col("n") * gap * gap).alias("d"))
    return pooled.select("attr", "class", F.col("total").alias("n"), F.col("center").alias("mean"), F.when(F.col("total") > 1, F.col("d") / (F.col("total") - 1)).otherwise(0.0).alias("variance"))


def log_density(x: Column, mean: Column, variance: Column) -> Column:
    """Of a normal distribution; without variance 0 at the mean and a very small number elsewhere."""
    spread = -(x - mean) * (x - mean) / (2 * variance) - F.log(F.sqrt(variance * 2 * math.pi))
    return F.when(variance > 0, spread).when(x == mean, 0.0).otherwise(-1e9)


def naive_bayes(attributes: dict[str, Column], stats: DataFrame, distribution: DataFrame) -> Column:
    """The most likely class of a row, of equally likely ones the smallest, as an expression over the row alone.

    stats and distribution have a row per (attribute and) class; they are the model (its size doesn't follow the rows),
    are collected and become literals, so that no row is exploded, joined or shuffled.  Without any the result is null."""
    known = {(r["attr"], r["class"]): r for r in stats.select("attr", "class", "mean", "variance").collect()}
    each = []
    for r in distribution.select("class", "fraction").orderBy("class").collect():
        score = F.lit(math.log(r["fraction"]))
        for a, x in attributes.items():
            if (s := known.get((a, r["class"]))) is not None:
                score = score + log_density(x.cast("double"), F.lit(float(s["mean"])), F.lit(float(s["variance"])))
        each.append(F.struct(score.alias("score"), F.lit(-r["class"]).alias("c")))
    return -F.array_max(F.array(*each))["c"] if each else F.lit(None).cast("int")


def candidates(stats: DataFrame, splits: int = 10) -> DataFrame:
    """Evenly spaced thresholds between an attribute's least and greatest value: attr, i, at."""
    span = stats.groupBy("attr").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return span.select("attr", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("i")).select("attr", "i", (F.col("lo") + F.col("i") / F.lit(splits + 1) * (F.col("hi") - F.col("lo"))).alias("at"))


def discrete_counts(cells: DataFrame) -> DataFrame:
    """attr, value, class, n with zeros for classes that a value lacks."""
    counts = cells.groupBy("attr", "value", "class").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select("class").distinct()
    grid = counts.select("attr", "value").distinct().join(F.broadcast(classes))
    return grid.join(counts, ["attr", "value", "class"], "left").select("attr", "value", "class", F.coalesce("n", F.lit(0)).alias("n"))


def _plogp(n: Column, total: Column) -> Column:
    return F.when(n > 0, -n / total * F.log2(n / total)).otherwise(0.0)


def discrete_splits(counts: DataFrame) -> DataFrame:
    """Thresholds between sorted values with the weighted entropy of both sides: attr, at, weighted."""
    w = Window.partitionBy("attr", "class").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("attr", "class")
    sides = counts.withColumn("left", F.sum("n").over(w)).withColumn("right", F.sum("n").over(all_) - F.col("left"))
    both = Window.partitionBy("attr", "value")
    sides = sides.withColumn("nl", F.sum("left").over(both)).withColumn("nr", F.sum("right").over(both)).where("nr > 0")
    each = sides.groupBy("attr", "value", "nl", "nr").agg(F.sum(_plogp(F.col("left"), F.col("nl"))).alias("hl"), F.sum(_plogp(F.col("right"), F.col("nr"))).alias("hr"))
    return each.select("attr", F.col("value").alias("at"), ((F.col("nl") * F.col("hl") + F.col("nr") * F.col("hr")) / (F.col("nl") + F.col("nr"))).alias("weighted"))


def hoeffding(n: Column, classes: int = 2, delta: float = 1e-7) -> Column:
    return F.sqrt(F.lit(math.log2(classes) ** 2 * math.log(1 / delta)) / (2 * n))


def ridge_sums(df: DataFrame, x: list[Column], y: Column) -> DataFrame:
    """Sums of x xᵀ and y x, x ending in 1: columns a<i><j> for i <= j, b<i>, and n. Partial sums merge as all do."""
    z = [*x, F.lit(1.0)]
    a = [F.sum(z[i] * z[j]).alias(f"a{i}{j}") for i in range(len(z)) for j in range(i, len(z))]
    return df.agg(*a, *[F.sum(y * v).alias(f"b{i}") for i, v in enumerate(z)], F.count(F.lit(1)).alias("n"))


def ridge_weights(sums: DataFrame, lam: float = 0.0) -> list[float]:
    """Weights by pseudo-inverse of one row of sums, the intercept last; zeros without rows."""
    row = sums.first()
    d = sum(1 for c in sums.columns if c.startswith("b"))
    if not row["n"]:
        return [0.0] * d
    a = np.array([[row[f"a{min(i, j)}{max(i, j)}"] for j in range(d)] for i in range(d)]) + lam * np.eye(d)
    return (np.array([row[f"b{i}"] for i in range(d)]) @ np.linalg.pinv(a)).tolist()
