"""What to run: learners, preprocessors and protocols by name, checked before anything starts."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vectors
from . import learners, transforms
from .tree import HT

LEARNERS = {"PA": learners.PA, "RegressorPA": learners.RegressorPA, "regressorPA": learners.RegressorPA, "SVM": learners.SVM, "MulticlassPA": learners.MulticlassPA, "ORR": learners.ORR, "K-means": learners.KMeans, "KMeans": learners.KMeans, "NN": learners.NN, "HT": HT, "HoeffdingTree": HT}
PROTOCOLS = ("CentralizedTraining", "Centralized", "Asynchronous", "Synchronous", "SSP", "EASGD", "GM", "FGM")
SINGLE = ("CentralizedTraining", "Centralized")

#: name → function of the numeric vector and the hyper-parameters.
PREPROCESSORS = {
    "MinMaxScaler": lambda x, h: transforms.min_max(x, h.get("min", 0.0), h.get("max", 255.0)),
    "PolynomialFeatures": lambda x, h: vectors.polynomial(x, int(h.get("degree", 2))),
    "FeatureFilter": lambda x, h: vectors.without(x, [int(i) for i in h.get("numeric", [])]),
    "StandardScaler": lambda x, h: F.when(F.lit(len(h["mean"]) > 0), F.zip_with(F.zip_with(x, vectors.literal(h["mean"]), lambda a, m: a - m), vectors.literal(h["variance"]), lambda a, v: a / F.sqrt(v))),
}


def _bounds(h: dict, n: int) -> list[tuple[float, float]]:
    lo, hi = h.get("min", 0.0), h.get("max", 255.0)
    return list(zip(lo, hi)) if isinstance(lo, list) else [(float(lo), float(hi))] * n


def _powers(x: list[float], degree: int) -> list[float]:
    out = list(x)
    for _ in range(degree - 1):
        out += [a * f for a in out for f in x]
    return out


#: The same for one point, in a fold.
ROWS: dict[str, Callable[[list[float], dict], list[float]]] = {
    "MinMaxScaler": lambda x, h: [(v - a) / (b - a) for v, (a, b) in zip(x, _bounds(h, len(x)))],
    "PolynomialFeatures": lambda x, h: _powers(x, int(h.get("degree", 2))),
    "FeatureFilter": lambda x, h: [v for k, v in enumerate(x) if k not in {int(i) for i in h.get("numeric", [])}],
    "StandardScaler": lambda x, h: [(v - m) / math.sqrt(s) for v, m, s in zip(x, h["mean"], h["variance"])],
}


@dataclass(frozen=True)
class LearnerSpec:
    name: str
    hyper: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in LEARNERS:
            raise ValueError(f"unknown learner {self.name}")

    def make(self):
        return LEARNERS[self.name](**self.hyper)


@dataclass(frozen=True)
class PreprocessorSpec:
    name: str
    hyper: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in PREPROCESSORS:
            raise ValueError(f"unknown preprocessor {self.name}")
        if self.name == "StandardScaler" and not self.learns and not {"mean", "variance"} <= self.hyper.keys():
            raise ValueError("a StandardScaler that doesn't learn needs mean and variance")

    @property
    def learns(self) -> bool:
        """A StandardScaler learns unless it is told not to (learn: false) or has fixed statistics."""
        return self.name == "StandardScaler" and self.hyper.get("learn", "mean" not in self.hyper)


class Pipeline:
    """Preprocessors and a learner as one learner: each point goes through the preprocessors, of which those that learn
    learn from it first, and then to the learner.  Predictions teach nothing."""

    def __init__(self, spec: PipelineSpec):
        self.spec, self.learner = spec, spec.learner.make()
        self.scalers = {k: transforms.Scaler(**{n: v for n, v in p.hyper.items() if n in ("learn", "mean", "variance", "count", "flat")}) for k, p in enumerate(spec.preprocessors) if p.learns}
        self.parallel = self.learner.parallel
        if len(self.scalers) < len(spec.preprocessors) or not getattr(self.learner, "columns", None):
            self.columns = None

    def columns(self, x: np.ndarray, y: np.ndarray) -> list[list[float]]:
        return [*(c.tolist() for c in x.T), y.tolist()]

    def stretch(self, columns: list[list[float]], loss: float) -> float:
        *xs, y = columns
        for k in range(len(self.spec.preprocessors)):
            xs = self.scalers[k].train_columns(xs)
        x, y = np.array(xs).T, np.array(y)
        scaled = self.learner.columns(x, y) if np.isfinite(x).all() else None
        if scaled:
            return self.learner.stretch(scaled, loss)
        for p, q in zip(x.tolist(), y.tolist()):
            loss += self.learner.fit(p, q)
        return loss

    def through(self, x: list[float], train: bool) -> list[float]:
        for k, p in enumerate(self.spec.preprocessors):
            if k in self.scalers:
                x = self.scalers[k].train(x) if train else self.scalers[k].transform(x)
            else:
                x = ROWS[p.name](x, p.hyper)
        return x

    def fit(self, x: list[float], y: float) -> float:
        return self.learner.fit(self.through(x, True), y)

    def predict(self, x: list[float]) -> float:
        return self.learner.predict(self.through(x, False))

    def freeze(self) -> None:
        for s in self.scalers.values():
            s.freeze()

    def get(self) -> list[float]:
        return self.learner.get()

    def set(self, values: list[float]) -> None:
        self.learner.set(values)

    def state(self) -> str:
        return json.dumps([self.learner.state(), {k: s.state() for k, s in self.scalers.items()}])

    def restore(self, text: str) -> None:
        learner, scalers = json.loads(text)
        self.learner.restore(learner)
        for k, s in scalers.items():
            self.scalers[int(k)].restore(s)

    def merge(self, other: Pipeline) -> Pipeline:
        """When workers are put together: the other's learner and preprocessors are taken over (of several, the last's)."""
        self.restore(other.state())
        return self


@dataclass(frozen=True)
class ProtocolSpec:
    name: str = "Asynchronous"
    workers: int = 1
    mini_batch: int = 1
    mini_batches: int = 256
    max_message: int = 10_000
    staleness: int = 3
    radius: float = 0.0008
    threshold: float = 0.0008
    precision: float = 0.01
    alpha: float | None = None
    learning_rate: float = 0.001
    rho: float | None = None

    def __post_init__(self):
        if self.name not in PROTOCOLS:
            raise ValueError(f"unknown protocol {self.name}")

    @property
    def block(self) -> int:
        """Points a worker learns from between two synchronisations."""
        return self.mini_batch * self.mini_batches

    @property
    def elasticity(self) -> float:
        if self.alpha is not None:
            return self.alpha
        return self.learning_rate * self.rho if self.rho is not None else 0.9**8 / self.workers


@dataclass(frozen=True)
class PipelineSpec:
    learner: LearnerSpec
    preprocessors: tuple[PreprocessorSpec, ...] = ()
    protocol: ProtocolSpec = ProtocolSpec()

    def __post_init__(self):
        if not LEARNERS[self.learner.name].parallel and self.protocol.name not in SINGLE:
            raise ValueError(f"{self.learner.name} can't be averaged; it allows {' and '.join(SINGLE)} only")
        if self.protocol.name == "EASGD" and self.learner.name != "NN":
            raise ValueError("EASGD needs a learner with gradient steps")

    @classmethod
    def parse(cls, request: dict) -> PipelineSpec:
        """From a request: learner {name, hyper}, preprocessors [{name, hyper}], training {protocol, ...}."""
        training = dict(request.get("training", {}))
        names = {"protocol": "name", "miniBatches": "mini_batches", "miniBatchSize": "mini_batch", "maxMsgParams": "max_message", "s": "staleness", "learningRate": "learning_rate"}
        kinds = {"name": str, "workers": int, "mini_batch": int, "mini_batches": int, "max_message": int, "staleness": int}
        known = {names.get(k, k): v for k, v in training.items() if names.get(k, k) in ProtocolSpec.__dataclass_fields__}
        protocol = ProtocolSpec(**{k: kinds.get(k, float)(v) for k, v in known.items()})
        learner = LearnerSpec(request["learner"]["name"], dict(request["learner"].get("hyper", {})))
        return cls(learner, tuple(PreprocessorSpec(p["name"], dict(p.get("hyper", {}))) for p in request.get("preprocessors", ())), protocol)

    def with_preprocessor(self, p: PreprocessorSpec, at: int | None = None) -> PipelineSpec:
        have = list(self.preprocessors)
        have.insert(len(have) if at is None else at, p)
        return PipelineSpec(self.learner, tuple(have), self.protocol)

    def without_preprocessor(self, name: str) -> PipelineSpec:
        return PipelineSpec(self.learner, tuple(p for p in self.preprocessors if p.name != name), self.protocol)

    def describe(self) -> dict:
        return {"learner": {"name": self.learner.name, "hyper": dict(self.learner.hyper)}, "preprocessors": [{"name": p.name, "hyper": dict(p.hyper)} for p in self.preprocessors], "training": {"protocol": self.protocol.name, "workers": self.protocol.workers}}

    def make(self) -> Pipeline:
        return Pipeline(self)

    @property
    def learning(self) -> bool:
        return any(p.learns for p in self.preprocessors)

    def transform(self, x: Column) -> Column:
        """As a column expression, which only preprocessors that don't learn have."""
        if self.learning:
            raise ValueError("a preprocessor that learns needs the fold of make()")
        for p in self.preprocessors:
            x = PREPROCESSORS[p.name](x, p.hyper)
        return x
