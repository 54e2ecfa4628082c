"""Preprocessors: as column expressions and running windows, and one that learns point by point within a pipeline."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import block_of, cuts_of


def min_max(x: Column, lo: float | list[float] = 0.0, hi: float | list[float] = 255.0) -> Column:
    """(x - lo) / (hi - lo) for each feature, not clamped; bounds for all features or one for each."""
    if isinstance(lo, list):
        bounds = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(lo, hi)])
        return F.zip_with(x, bounds, lambda v, b: (v - b["lo"]) / (b["hi"] - b["lo"]))
    return F.transform(x, lambda v: (v - F.lit(float(lo))) / F.lit(float(hi) - float(lo)))


def scaler_state(df: DataFrame, value: str) -> DataFrame:
    """count, mean and sum of squared deviations: what the scaler has learned from all rows."""
    return df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("d"))


def scale_batch(df: DataFrame, value: str, state: DataFrame | None = None) -> DataFrame:
    """Adds scaled: all rows by the statistics of all rows (or by a given state); one row alone is left as it is."""
    state = scaler_state(df, value) if state is None else state
    rows = df.join(F.broadcast(state.limit(1)))
    z = (F.col(value) - F.col("mean")) / F.sqrt(F.col("d") / F.col("count"))
    return rows.withColumn("scaled", F.when(F.col("count") <= 1, F.col(value)).otherwise(z)).drop("count", "mean", "d")


def running(df: DataFrame, value: str, order: str, parts: int | None = None) -> DataFrame:
    """Adds n, mean and d (sum of squared deviations) of all rows up to this one in order of a numeric key.

    Blocks of the order are scanned each for itself; the statistics of the blocks before, one row for each, are pooled
    in.  So the whole table is never one task's.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__block", F.coalesce(block_of(F.col(order), cuts_of(df, order, parts)), F.lit(-1)))
    stats = rows.groupBy("__block").agg(F.count(value).cast("double").alias("__n"), F.sum(value).alias("__s"), (F.var_pop(value) * F.count(value)).alias("__d"))
    # Pooled over the blocks before: deviations within blocks and of blocks' means from theirs together.
    w = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    some = F.collect_list(F.struct("__n", "__s", "__d")).over(w)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))

    def pool(a: Column, b: Column) -> Column:
        n = a["n"] + b["__n"]
        gap = b["__s"] / b["__n"] - a["m"]
        return F.struct(n.alias("n"), (a["m"] + gap * b["__n"] / n).alias("m"), (a["d"] + b["__d"] + gap * gap * a["n"] * b["__n"] / n).alias("d"))

    before = stats.select("__block", F.aggregate(some, zero, pool).alias("__b"))
    v = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__k", F.count(value).over(v).cast("double")).withColumn("__m", F.avg(value).over(v)).withColumn("__v", F.var_pop(value).over(v)).join(F.broadcast(before), "__block")
    n = F.col("__b.n") + F.col("__k")
    gap = F.col("__m") - F.col("__b.m")
    rows = rows.withColumn("n", n.cast("long")).withColumn("mean", F.col("__b.m") + gap * F.col("__k") / n)
    rows = rows.withColumn("d", F.col("__b.d") + F.col("__v") * F.col("__k") + gap * gap * F.col("__b.n") * F.col("__k") / n)
    return rows.drop("__block", "__b", "__k", "__m", "__v")


def scale_prequential(df: DataFrame, value: str, order: str) -> DataFrame:
    """Adds scaled: each row by the statistics up to and with itself; the first is left as it is. Equal values so far
    give a deviation of 0, whose quotient is null here."""
    rows = running(df, value, order)
    z = F.when(F.col("d") > 0, (F.col(value) - F.col("mean")) / F.sqrt(F.col("d") / F.col("n")))
    return rows.withColumn("scaled", F.when(F.col("n") <= 1, F.col(value)).otherwise(z))


def merge_states(states: DataFrame) -> DataFrame:
    """Pools rows of (count, mean, d); a side without rows adds nothing."""
    some = states.where("count > 0")
    total = some.agg(F.sum("count").alias("count"), (F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("mean"), F.sum(F.col("d") + F.col("mean") * F.col("mean") * F.col("count")).alias("raw"))
    return total.select("count", "mean", (F.col("raw") - F.col("mean") * F.col("mean") * F.col("count")).alias("d"))


def vector_state(df: DataFrame, x: Column, dims: int) -> DataFrame:
    """count, mean and d (arrays) of a vector column over all rows: one aggregate, one row."""
    each = [x[k] for k in range(dims)]
    return df.agg(F.count(F.lit(1)).alias("count"), F.array(*[F.avg(v) for v in each]).alias("mean"), F.array(*[F.var_pop(v) * F.count(v) for v in each]).alias("d"))


def scale_vectors(df: DataFrame, x: str, dims: int, state: DataFrame | None = None) -> DataFrame:
    """Adds scaled: (x - mean) / deviation for each feature, by all rows or by a given state; a feature that never varies
    gives NaN where it equals its mean and an infinity elsewhere; one row alone is left as it is."""
    state = vector_state(df, F.col(x), dims) if state is None else state
    rows = df.join(F.broadcast(state.limit(1)))
    deviation = F.transform("d", lambda v: F.sqrt(v / F.col("count")))
    gaps = F.zip_with(F.col(x), F.col("mean"), lambda a, m: a - m)
    z = F.zip_with(gaps, deviation, lambda g, s: F.when(s > 0, g / s).when(g > 0, float("inf")).when(g < 0, float("-inf")).otherwise(float("nan")))
    return rows.withColumn("scaled", F.when(F.col("count") <= 1, F.col(x)).otherwise(z)).drop("count", "mean", "d")


class Scaler:
    """A standard scaler that learns from each point before it scales it, until it is frozen.  Mean and squared deviations
    of each feature; the first point is left as it is.  A feature that hasn't varied gives NaN or an infinity, or
    ``flat`` where that is given."""

    def __init__(self, learn: bool = True, mean: list[float] | None = None, variance: list[float] | None = None, count: int = 0, flat: float | None = None):
        if (variance is None) != (count == 0):
            raise ValueError("variance and count go together")
        self.learn, self.flat, self.count = bool(learn), flat, int(count)
        self.mean = list(mean) if mean is not None else None
        self.d = [v * count for v in variance] if variance is not None else None

    def freeze(self) -> None:
        self.learn = False

    def thaw(self) -> None:
        self.learn = True

    def fit(self, x: list[float]) -> None:
        if self.mean is None or len(self.mean) != len(x):
            self.mean, self.d, self.count = [0.0] * len(x), [0.0] * len(x), 0
        self.count += 1
        mean = [m + (v - m) / self.count for m, v in zip(self.mean, x)]
        self.d = [d + (v - new) * (v - old) for d, v, new, old in zip(self.d, x, mean, self.mean)]
        self.mean = mean

    def transform(self, x: list[float]) -> list[float]:
        if self.count <= 1:
            return list(x)
        out = []
        for v, m, d in zip(x, self.mean, self.d):
            if d > 0:
                out.append((v - m) / math.sqrt(d / self.count))
            else:
                out.append(self.unvaried(v, m))
        return out

    def train(self, x: list[float]) -> list[float]:
        if self.learn:
            self.fit(x)
        return self.transform(x)

    def train_columns(self, columns: list[list[float]]) -> list[list[float]]:
        """train() of points one after another, given and returned as a list a feature."""
        if not self.learn:
            return [list(c) for c in zip(*map(self.transform, zip(*columns)))]
        if self.mean is None or len(self.mean) != len(columns):
            self.mean, self.d, self.count = [0.0] * len(columns), [0.0] * len(columns), 0
        out, root = [], math.sqrt
        for k, values in enumerate(columns):
            n, m, d, scaled = self.count, self.mean[k], self.d[k], []
            for v in values:
                n += 1
                old = m
                m = old + (v - old) / n
                d = d + (v - m) * (v - old)
                if n > 1:
                    v = (v - m) / root(d / n) if d > 0 else self.unvaried(v, m)
                scaled.append(v)
            self.mean[k], self.d[k] = m, d
            out.append(scaled)
        self.count += len(columns[0])
        return out

    def unvaried(self, v: float, mean: float) -> float:
        return self.flat if self.flat is not None else math.nan if v == mean else math.copysign(math.inf, v - mean)

    def merge(self, others: list[Scaler]) -> Scaler:
        """The scaler of all points that any of them has seen."""
        out = Scaler(self.learn, flat=self.flat)
        seen = [s for s in (self, *others) if s.count]
        if seen:
            out.count = sum(s.count for s in seen)
            out.mean = [sum(s.mean[k] * s.count for s in seen) / out.count for k in range(len(seen[0].mean))]
            out.d = [sum(s.d[k] + s.count * (s.mean[k] - m) ** 2 for s in seen) for k, m in enumerate(out.mean)]
        return out

    def state(self) -> str:
        return json.dumps([self.learn, self.mean, self.d, self.count])

    def restore(self, text: str) -> None:
        self.learn, self.mean, self.d, self.count = json.loads(text)
