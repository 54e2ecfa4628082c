"""Structured Streaming: training and forecasting by micro-batches, with models kept as a versioned table.

A micro-batch is one round.  Workers fold its rows in parallel, each from its own model; their parameters (a few numbers
each, as many rows as workers) are merged on the driver by the protocol's rule and written as the next version, beside
all else that each worker's pipeline has learned (counts, moments, held points, scalers, trees), which stays its own.  A
batch that is run again after a failure starts from the version before it and so gives the same model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spec import PipelineSpec
from ..plans.fold import fold

MODELS = "version bigint, worker int, params array<double>, fitted bigint, loss double, state string"


class Resume:
    """A pipeline that goes on from a state, with the hub's parameters if they are others."""

    def __init__(self, spec: PipelineSpec, state: str | None, params: list[float]):
        self.model = spec.make()
        if state:
            self.model.restore(state)
        if params and params != self.model.get():
            self.model.set(params)
        self.fitted, self.loss = 0, 0.0

    def row(self, x, y):
        self.loss += self.model.fit(x, y)
        self.fitted += 1

    def end(self):
        return [(self.model.get(), self.fitted, self.loss, self.model.state())]


class ModelTable:
    """Versions of a pipeline's model in a folder, one parquet folder a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame([(version, *r) for r in rows], MODELS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version:012d}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(MODELS).option("recursiveFileLookup", "true").parquet(self.path)

    def latest(self, before: int | None = None) -> list:
        """Rows of the last version (before a given one)."""
        try:
            rows = self.read()
            rows = rows.where(F.col("version") < before) if before is not None else rows
            last = rows.agg(F.max("version")).first()[0]
        except Exception as error:  # the folder doesn't exist before the first version
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return [] if last is None else rows.where(F.col("version") == last).collect()


def merge(spec: PipelineSpec, before: list[float], models: dict[int, list[float]], bases: dict[int, list[float]]) -> list[float]:
    """The next global model from the workers' models."""
    p = spec.protocol
    if not before:
        return list(models[min(models)])
    if p.name == "Synchronous":
        full = [models.get(k, before) for k in range(p.workers)]
        return [sum(v) / p.workers for v in zip(*full)]
    if p.name in ("GM", "FGM"):
        far = lambda m: sum((a - b) ** 2 for a, b in zip(m, before))
        limit = p.radius if p.name == "GM" else p.threshold
        full = [models.get(k, before) for k in range(p.workers)]
        return [sum(v) / p.workers for v in zip(*full)] if any(far(m) > limit for m in full) else before
    if p.name == "EASGD":
        for k in sorted(models):
            before = [g + p.elasticity * (w - g) for g, w in zip(before, models[k])]
        return before
    if p.name in ("CentralizedTraining", "Centralized"):
        return list(models[min(models)])
    for k in sorted(models):
        before = [g + (w - b) / p.workers for g, w, b in zip(before, models[k], bases[k])]
    return before


def train_batch(spec: PipelineSpec, table: ModelTable, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over rows with numeric, label, worker and the order's columns. Worker -1 is the hub."""

    def step(batch: DataFrame, version: int) -> None:
        known = {r["worker"]: r for r in table.latest(version)}
        center = list(known[-1]["params"]) if -1 in known else []
        fitted, loss = (known[-1]["fitted"], known[-1]["loss"]) if -1 in known else (0, 0.0)
        if batch.isEmpty():
            return
        keep_local = spec.protocol.name in ("GM", "FGM", "SSP", "EASGD")
        starts = {k: list(r["params"]) for k, r in known.items() if k >= 0} if keep_local else {}
        states = {k: r["state"] for k, r in known.items() if k >= 0}
        # A worker without a state of its own (there were fewer before) takes up the last one that has any.
        first = states[max(states)] if states else None

        class Here:
            """Waits for the first row, which says whose model to go on with."""

            def __init__(self):
                self.inner = None

            def row(self, worker, x, y):
                if self.inner is None:
                    self.inner = Resume(spec, states.get(worker, first), starts.get(worker, center))
                self.inner.row(x, y)

            def end(self):
                return self.inner.end() if self.inner else []

        got = fold(batch.withColumn("w", F.col("worker")), order, ["w", "numeric", "label"], Here, "params array<double>, fitted bigint, loss double, state string", by="worker").collect()
        models = {r["worker"]: list(r["params"]) for r in got}
        states |= {r["worker"]: r["state"] for r in got}
        new = merge(spec, center, models, {k: starts.get(k, center) for k in models})
        moved = new != center
        fitted, loss = fitted + sum(r["fitted"] for r in got), loss + sum(r["loss"] for r in sorted(got, key=lambda r: r["worker"]))
        out = [(-1, new, fitted, loss, None)]
        for k in range(spec.protocol.workers):
            local = new
            if keep_local:
                averaged = spec.protocol.name in ("GM", "FGM")
                local = new if averaged and moved else models.get(k, starts.get(k, new))
                if spec.protocol.name == "EASGD" and center and k in models:
                    local = [w - spec.protocol.elasticity * (w - g) for w, g in zip(models[k], center)]
            out.append((k, local, 0, 0.0, states.get(k)))
        table.write(version, out)

    return step


def model(spec: PipelineSpec, table: ModelTable):
    """The trained pipeline of the last version: the hub's parameters in the first worker's state; None before any."""
    rows = {r["worker"]: r for r in table.latest()}
    states = [r["state"] for k, r in sorted(rows.items()) if k >= 0 and r["state"]]
    if -1 not in rows or not states:
        return None
    return Resume(spec, states[0], list(rows[-1]["params"])).model


def rescale(spec: PipelineSpec, table: ModelTable, version: int) -> None:
    """Writes the last version again for spec's number of workers: states of workers that are no more go, new workers take
    up the last one."""
    rows = {r["worker"]: r for r in table.latest()}
    old = sorted(k for k in rows if k >= 0)
    out = [(-1, list(rows[-1]["params"]), rows[-1]["fitted"], rows[-1]["loss"], None)]
    for k in range(spec.protocol.workers):
        r = rows.get(k, rows[old[-1]])
        out.append((k, list(r["params"]), 0, 0.0, r["state"]))
    table.write(version, out)


def register(spec: PipelineSpec, table: ModelTable, name: str) -> str:
    """Registers the trained pipeline as SQL function predict_<name> of a vector, null for null; returns its name.  Points
    come in Arrow batches; the pipeline goes along as its state."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    trained = model(spec, table)
    state, params = (trained.state(), trained.get()) if trained is not None else (None, [])

    def score(batches):
        own = Resume(spec, state, params).model
        for xs in batches:
            yield pd.Series([None if x is None or state is None else float(own.predict(list(x))) for x in xs], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    table.spark.udf.register(f"predict_{name}", pandas_udf(score, "double"))
    return f"predict_{name}"


def predict(df: DataFrame, spec: PipelineSpec, params: list[float]) -> DataFrame:
    """Adds prediction by a linear pipeline's parameters, as column expressions; no model gives nulls."""
    from ..functions.vectors import dot, literal

    if not params:
        return df.withColumn("prediction", F.lit(None).cast("double"))
    margin = dot(spec.transform(F.col("numeric")), literal(params[:-1])) + F.lit(float(params[-1]))
    regress = spec.learner.name in ("RegressorPA", "regressorPA")
    return df.withColumn("prediction", margin if regress else F.when(margin >= 0, 1.0).otherwise(-1.0))


def answer(table: ModelTable, spec: PipelineSpec, query_id: int, score: float | None) -> DataFrame:
    """A query's response: the whole pipeline, or for query -1 only its progress."""
    rows = {r["worker"]: r for r in table.latest()}
    hub = rows.get(-1)
    fitted, loss = (hub["fitted"], hub["loss"]) if hub else (0, 0.0)
    full = query_id != -1
    row = (query_id, json.dumps([p.name for p in spec.preprocessors]) if full else None, spec.learner.name if full else None, spec.protocol.name if full else None, fitted, loss / fitted if fitted else 0.0, loss, score)
    return table.spark.createDataFrame([row], "query_id bigint, preprocessors string, learner string, protocol string, fitted bigint, mean_loss double, cumulative_loss double, score double")
