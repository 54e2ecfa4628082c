"""Learners as deterministic folds: state, then one point after another.

Every learner has ``fit(x, y) -> loss``, ``predict(x)``, ``get() -> list`` and ``set(list)``; the lists are what protocols
average.  Arithmetic runs from left to right over plain doubles, so that another engine's fold gives the same digits.
"""

from __future__ import annotations

import functools
import json
import math
import random

import numpy as np
import pyarrow as pa

UNFITTED = -1.7976931348623157e308


def dot(a: list[float], b: list[float]) -> float:
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


class Learner:
    """state() is all that a learner would need to go on in another process, as text; restore() takes it up."""

    STATE: tuple[str, ...] = ()

    def state(self) -> str:
        return json.dumps({k: pack(getattr(self, k, None)) for k in self.STATE})

    def restore(self, text: str) -> None:
        for k, v in json.loads(text).items():
            setattr(self, k, unpack(v))


def pack(value):
    """Arrays as {"array": nested lists}, lists piece by piece."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    return [pack(v) for v in value] if isinstance(value, (list, tuple)) else value


def unpack(value):
    if isinstance(value, dict):
        return np.array(value["array"])
    return [unpack(v) for v in value] if isinstance(value, list) else value


class Held:
    """Points of a batch, from which a model learns stretch by stretch what fit() would teach it one after another.

    A learner may have ``columns(x, y)``, which makes lists of a matrix of finite numbers and its labels (or None where it
    can't), and ``stretch(columns, loss)``, which learns from parts of such lists and returns loss with theirs added in order.
    """

    def __init__(self, model, xs: pa.Array, ys: pa.Array):
        self.columns, self.matrix, self.points = None, None, (xs, ys)
        fast = getattr(model, "columns", None)
        if (fast or hasattr(model, "absorb")) and len(xs) and not xs.null_count and not ys.null_count:
            flat, sizes = xs.flatten(), np.diff(xs.offsets.to_numpy())
            if sizes[0] and (sizes == sizes[0]).all() and not flat.null_count:
                x = flat.to_numpy().reshape(len(xs), sizes[0])
                if np.isfinite(x).all():
                    self.matrix = x, ys.to_numpy()
                    self.columns = fast(*self.matrix) if fast else None

    @functools.cached_property
    def rows(self) -> tuple[list, list]:
        return self.points[0].to_pylist(), self.points[1].to_pylist()

    def learn(self, model, start: int, stop: int, loss: float | None) -> float | None:
        """loss: None where nobody asks for it, which spares a learner with ``absorb(x, y)`` its predictions."""
        if loss is None and self.matrix and hasattr(model, "absorb"):
            model.absorb(self.matrix[0][start:stop], self.matrix[1][start:stop])
            return None
        if self.columns:
            return model.stretch([c[start:stop] for c in self.columns], loss)
        total = loss or 0.0
        for x, y in zip(self.rows[0][start:stop], self.rows[1][start:stop]):
            total += model.fit(x, y)
        return None if loss is None else total


#: What a linear learner does with a point after its margin m: conditions and steps of the factor t.
STEPS = {
    "PA": ("l = 1.0 - y * m", "if l > 0.0:", "loss += l", "t = l / q * y"),
    "PA-I": ("l = 1.0 - y * m", "if l > 0.0:", "loss += l", "t = min(C, l / q) * y"),
    "Regressor": ("g = y - m; l = abs(g) - epsilon; loss += l", "if l > 0.0:", "t = l / q * (1.0 if g >= 0 else -1.0)"),
    "Regressor-I": ("g = y - m; l = abs(g) - epsilon; loss += l", "if l > 0.0:", "t = min(C, l / q) * (1.0 if g >= 0 else -1.0)"),
}


@functools.cache
def unrolled(kind: str, d: int):
    """The loop of a linear learner over lists of d features, of labels and of q, without a list of weights."""
    each = range(d)
    head = f"def loop(columns, w, b, n, loss, C, epsilon):\n    {', '.join(f'w{k}' for k in each)}, = w\n    for {', '.join(f'x{k}' for k in each)}, y, q in zip(*columns):\n        m = {' + '.join(f'x{k} * w{k}' for k in each)} + b\n"
    if kind == "SVM":
        body = ["n += 1", "y_m = y * m", "if y_m < 1.0:", "    loss += 1.0 - y_m", "    c = C * y", *[f"    w{k} = w{k} - (w{k} - c * x{k}) / n" for k in each], "    b = b + y / n", "else:", *[f"    w{k} = w{k} - w{k} / n" for k in each]]
    else:
        first, when, *then = STEPS[kind]
        body = [first, when, *[f"    {line}" for line in (*then, *[f"w{k} += t * x{k}" for k in each], "b += t")]]
    space: dict = {}
    exec(head + "".join(f"        {line}\n" for line in body) + f"    return [{', '.join(f'w{k}' for k in each)}], b, n, loss\n", space)  # noqa: S102
    return space["loop"]


def norms(x: np.ndarray) -> np.ndarray:
    """Of each row with a 1 behind it, summed from left to right."""
    s = x[:, 0] * x[:, 0]
    for k in range(1, x.shape[1]):
        s = s + x[:, k] * x[:, k]
    return s + 1.0


class Linear(Learner):
    """Weights and an intercept, which appear with the first point."""

    parallel = True
    STATE = ("w", "b")

    def __init__(self, **hyper):
        self.w: list[float] | None = None
        self.b = 0.0
        for name, value in hyper.items():
            if not hasattr(self, name):
                raise ValueError(f"{type(self).__name__} has no hyper-parameter {name}")
            kind = type(getattr(self, name))
            setattr(self, name, kind(value))

    def grow(self, x: list[float]) -> None:
        if self.w is None:
            self.w = [0.0] * len(x)
        elif len(self.w) != len(x):
            raise ValueError(f"model has {len(self.w)} weights, point has {len(x)} features")

    def margin(self, x: list[float]) -> float:
        return dot(x, self.w) + self.b

    def step(self, factor: float, x: list[float]) -> None:
        self.w = [w + factor * v for w, v in zip(self.w, x)]
        self.b += factor

    def get(self) -> list[float]:
        return [*(self.w or []), self.b]

    def set(self, values: list[float]) -> None:
        self.w, self.b = list(values[:-1]), values[-1]

    def stretch(self, columns: list[list[float]], loss: float) -> float:
        self.grow(columns[:-2])
        self.w, self.b, n, loss = unrolled(self.kind(), len(self.w))(columns, self.w, self.b, getattr(self, "count", 0), loss, self.C, getattr(self, "epsilon", 0.0))
        if "count" in self.STATE:
            self.count = n
        return loss


class PA(Linear):
    """Passive-aggressive classifier of labels 1 and -1 (any other label than the target counts as -1)."""

    C, updateType, targetLabel = 0.01, "PA-II", 1.0

    def tau(self, loss: float, x: list[float]) -> float:
        norm = dot(x, x) + 1.0
        if self.updateType == "STANDARD":
            return loss / (1.0 + norm)
        if self.updateType == "PA-I":
            return min(self.C, loss / norm)
        if self.updateType == "PA-II":
            return loss / (norm + 1.0 / (2.0 * self.C))
        raise ValueError(f"unknown update type {self.updateType}")

    def fit(self, x: list[float], y: float) -> float:
        self.grow(x)
        y = y if y == self.targetLabel else -1.0
        loss = max(0.0, 1.0 - y * self.margin(x))
        if loss > 0.0:
            self.step(self.tau(loss, x) * y, x)
        return loss

    def labels(self, y: np.ndarray) -> np.ndarray:
        return np.where(y == self.targetLabel, y, -1.0)

    def kind(self) -> str:
        return "PA-I" if self.updateType == "PA-I" else "PA"

    def columns(self, x: np.ndarray, y: np.ndarray) -> list[list[float]] | None:
        norm = norms(x)
        q = {"STANDARD": lambda: 1.0 + norm, "PA-I": lambda: norm, "PA-II": lambda: norm + 1.0 / (2.0 * self.C)}.get(self.updateType)
        return None if q is None else [*(c.tolist() for c in x.T), self.labels(y).tolist(), q().tolist()]

    def predict(self, x: list[float]) -> float:
        if self.w is None:
            return UNFITTED
        return 1.0 if self.margin(x) >= 0.0 else -1.0


class RegressorPA(PA):
    """Passive-aggressive regressor with an insensitive zone."""

    epsilon = 0.0

    def labels(self, y: np.ndarray) -> np.ndarray:
        return y

    def kind(self) -> str:
        return "Regressor-I" if self.updateType == "PA-I" else "Regressor"

    def fit(self, x: list[float], y: float) -> float:
        self.grow(x)
        miss = y - self.margin(x)
        loss = abs(miss) - self.epsilon
        if loss > 0.0:
            self.step(self.tau(loss, x) * (1.0 if miss >= 0 else -1.0), x)
        return loss

    def predict(self, x: list[float]) -> float:
        return UNFITTED if self.w is None else self.margin(x)


class SVM(Linear):
    """Linear support vector machine whose steps shrink with the number of points; label 0 counts as -1."""

    C = 0.01
    STATE = ("w", "b", "count")

    def __init__(self, **hyper):
        super().__init__(**hyper)
        self.count = 0

    def fit(self, x: list[float], y: float) -> float:
        self.grow(x)
        y = -1.0 if y == 0.0 else y
        self.count += 1
        margin = self.margin(x)
        sign = 1.0 if y * margin < 1.0 else 0.0
        self.w = [w - (w - self.C * y * sign * v) / self.count for w, v in zip(self.w, x)]
        self.b = self.b - (-y * sign) / self.count
        return max(0.0, 1.0 - y * margin)

    def kind(self) -> str:
        return "SVM"

    def columns(self, x: np.ndarray, y: np.ndarray) -> list[list[float]] | None:
        if not np.isfinite(y).all():
            return None
        y = np.where(y == 0.0, -1.0, y).tolist()
        return [*(c.tolist() for c in x.T), y, y]

    def predict(self, x: list[float]) -> float:
        if self.w is None:
            return UNFITTED
        return 1.0 if self.margin(x) >= 0.0 else -1.0


class MulticlassPA(Learner):
    """Passive-aggressive classifier of labels 0 to nClasses - 1, one linear model each.  Equal scores go to the lowest
    label.  It also updates when it is right (the loss is then 1)."""

    parallel = True
    STATE = ("w", "b")

    def __init__(self, nClasses: int = 3, C: float = 0.01, updateType: str = "PA-II"):
        self.n, self.C, self.updateType = int(nClasses), float(C), updateType
        self.w: list[list[float]] | None = None
        self.b = [0.0] * self.n

    def tau(self, loss: float, x: list[float]) -> float:
        norm = dot(x, x) + 1.0
        if self.updateType == "STANDARD":
            return loss / (1.0 + 2.0 * norm)
        if self.updateType == "PA-I":
            return min(self.C / 2.0, loss / (2.0 * norm))
        return 0.5 * loss / (norm + 1.0 / (2.0 * self.C))

    def scores(self, x: list[float]) -> list[float]:
        return [dot(x, w) + b for w, b in zip(self.w, self.b)]

    def fit(self, x: list[float], y: float) -> float:
        if self.w is None:
            self.w = [[0.0] * len(x) for _ in range(self.n)]
        label = int(y)
        s = self.scores(x)
        said = s.index(max(s))
        loss = 1.0 - (s[label] - s[said])
        t = self.tau(loss, x)
        self.w[label] = [w + t * v for w, v in zip(self.w[label], x)]
        self.b[label] += t
        if said != label:
            self.w[said] = [w - t * v for w, v in zip(self.w[said], x)]
            self.b[said] -= t
        return loss

    def predict(self, x: list[float]) -> float:
        if self.w is None:
            return UNFITTED
        s = self.scores(x)
        return float(s.index(max(s)))

    def get(self) -> list[float]:
        return [v for w, b in zip(self.w or [], self.b) for v in (*w, b)]

    def set(self, values: list[float]) -> None:
        d = len(values) // self.n
        self.w = [list(values[k * d : (k + 1) * d - 1]) for k in range(self.n)]
        self.b = [values[(k + 1) * d - 1] for k in range(self.n)]


class ORR(Learner):
    """Online ridge regression by sums of x xᵀ and y x (x ends in 1); ``ridge`` adds lambda to the diagonal."""

    parallel = True
    STATE = ("a", "v")

    def __init__(self, **hyper):
        self.lam, self.ridge = float(hyper.get("lambda", 0.0)), bool(hyper.get("ridge", False))
        self.a: np.ndarray | None = None
        self.v: np.ndarray | None = None

    def weights(self) -> np.ndarray:
        a = self.a + self.lam * np.eye(len(self.a)) if self.ridge else self.a
        return self.v @ np.linalg.pinv(a)

    def predict(self, x: list[float]) -> float:
        return 0.0 if self.a is None else float(self.weights() @ np.array([*x, 1.0]))

    def loss(self, x: list[float], y: float) -> float:
        penalty = 0.0 if self.a is None else self.lam * float((self.a**2).sum() + (self.v**2).sum())
        return (y - self.predict(x)) ** 2 + penalty

    def fit(self, x: list[float], y: float) -> float:
        z = np.array([*x, 1.0])
        loss = self.loss(x, y)
        if self.a is None:
            self.a, self.v = np.zeros((len(z), len(z))), np.zeros(len(z))
        self.a += np.outer(z, z)
        self.v += y * z
        return loss

    def absorb(self, x: np.ndarray, y: np.ndarray) -> None:
        """What fit() of each row would add, in the same order, without their losses."""
        z = np.column_stack([x, np.ones(len(x))])
        n = z.shape[1]
        if self.a is None:
            self.a, self.v = np.zeros((n, n)), np.zeros(n)
        terms = np.concatenate([(z[:, :, None] * z[:, None, :]).reshape(len(z), n * n), y[:, None] * z], 1)
        sums = np.add.accumulate(np.vstack([[*self.a.ravel(), *self.v], terms]))[-1]
        self.a, self.v = sums[: n * n].reshape(n, n), sums[n * n :]

    def get(self) -> list[float]:
        return [] if self.a is None else [*self.a.ravel().tolist(), *self.v.tolist()]

    def set(self, values: list[float]) -> None:
        n = int((math.isqrt(1 + 4 * len(values)) - 1) // 2)
        self.a, self.v = np.array(values[: n * n]).reshape(n, n), np.array(values[n * n :])


class KMeans(Learner):
    """Sequential or forgetful k-means from given centroids, or from the first graceInit * nClusters points: ``random``
    distinct picks or ``kmeans++``, by seed; those points are then learned from."""

    parallel = False
    STATE = ("c", "n", "buffer")

    def __init__(self, nClusters: int = 2, method: str = "sequential", stepSize: float = 0.01, initMethod: str = "random", graceInit: int = 10, seed: int = 1, centroids: list[list[float]] | None = None):
        if method not in ("sequential", "forgetful") or initMethod not in ("random", "kmeans++"):
            raise ValueError("unknown method")
        self.k, self.method, self.step, self.init, self.grace, self.seed = int(nClusters), method, float(stepSize), initMethod, int(graceInit), seed
        self.c = [list(c) for c in centroids] if centroids else None
        self.n = [0] * self.k
        self.buffer: list[list[float]] = []

    def distances(self, x: list[float]) -> list[float]:
        return [math.sqrt(dot(e, e)) for e in ([a - b for a, b in zip(x, c)] for c in self.c)]

    def start(self) -> None:
        rng, points = random.Random(self.seed), list(self.buffer)
        chosen = [points.pop(rng.randrange(len(points)))]
        while len(chosen) < self.k and points:
            if self.init == "random":
                chosen.append(points.pop(rng.randrange(len(points))))
            else:
                far = [min(dot(e, e) for e in ([a - b for a, b in zip(p, c)] for c in chosen)) for p in points]
                chosen.append(points.pop(rng.choices(range(len(points)), far if sum(far) > 0 else None)[0]))
        self.c, self.n, self.buffer = [list(c) for c in chosen], [0] * len(chosen), []
        for p in points:
            self.fit(p)

    def fit(self, x: list[float], y: float | None = None) -> float:
        if self.c is None:
            self.buffer.append(list(x))
            if len(self.buffer) >= self.grace * self.k:
                self.start()
            return 0.0
        d = self.distances(x)
        j = d.index(min(d))
        self.n[j] += 1
        rate = 1.0 / self.n[j] if self.method == "sequential" else self.step
        if self.method == "sequential":
            self.c[j] = [c + (v - c) / self.n[j] for c, v in zip(self.c[j], x)]
        else:
            self.c[j] = [c + rate * (v - c) for c, v in zip(self.c[j], x)]
        return d[j] * d[j]

    def predict(self, x: list[float]) -> float:
        if self.c is None:
            return UNFITTED
        d = self.distances(x)
        return float(d.index(min(d)))

    def get(self) -> list[float]:
        return [v for c in self.c or [] for v in c]

    def set(self, values: list[float]) -> None:
        d = len(values) // self.k
        self.c = [list(values[k * d : (k + 1) * d]) for k in range(self.k)]


def configured(config: str | list | dict) -> list[dict]:
    """A network's layers from a list, or from JSON or YAML text of one (or of {"layers": [...]})."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except ValueError:
            try:
                import yaml
            except ImportError:
                raise ValueError("the network isn't JSON, and YAML can't be read here") from None
            try:
                config = yaml.safe_load(config)
            except yaml.YAMLError as error:
                raise ValueError("the network is neither JSON nor YAML") from error
    layers = config.get("layers") if isinstance(config, dict) else config
    if not isinstance(layers, (list, tuple)):
        raise ValueError("a network is a list of layers")
    out = [{"type": "dense", "size": int(v)} if not isinstance(v, dict) else dict(v) for v in layers]
    for layer in out:
        if layer.get("type") not in ("dense", "conv", "pool", "norm", "dropout"):
            raise ValueError(f"unknown layer {layer.get('type')}")
    return out


def cut_patches(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """[points, height, width, channels] → [points, rows, columns, size, size, channels]."""
    views = np.lib.stride_tricks.sliding_window_view(x, (size, size), (1, 2))[:, ::stride, ::stride]
    return views.transpose(0, 1, 2, 4, 5, 3)


class NN(Learner):
    """A feed-forward classifier: softmax on top, Adam on mini-batches of batchSize points, L2, Xavier weights by seed.

    ``layers``: sizes of dense layers with ReLU, or layers as dicts (or JSON or YAML of either): dense (size), conv (filters,
    kernel, stride), pool (kernel, stride; the maximum), norm (by batch, by running statistics when predicting) and dropout
    (rate), with ``relu`` true or false (default: dense and conv without a norm right after them have it, and so do norms).
    conv and pool need ``inputShape`` (height, width, channels).  Labels start at label_offset."""

    parallel = True
    STATE = ("p", "m", "v", "t", "held", "running")

    def __init__(self, nClasses: int = 10, layers: list | dict | str = (32,), learningRate: float = 0.001, batchSize: int = 64, l2: float = 5e-4, seed: int = 1234, label_offset: int = 0, inputShape: list[int] | None = None):
        self.classes, self.layers = int(nClasses), [*configured(layers), {"type": "dense", "size": int(nClasses), "relu": False}]
        for layer, after in zip(self.layers, [*self.layers[1:], {}]):
            layer.setdefault("relu", layer["type"] in ("dense", "conv") and after.get("type") != "norm" or layer["type"] == "norm")
        self.learningRate, self.batch, self.l2, self.seed, self.offset = float(learningRate), int(batchSize), float(l2), int(seed), int(label_offset)
        self.shape = tuple(inputShape) if inputShape else None
        self.p: list[np.ndarray] | None = None
        self.running: list[np.ndarray] = []
        self.held: list[tuple[list[float], float]] = []
        self.t = 0

    def grow(self, x: list[float]) -> None:
        if self.p is not None:
            return
        rng, shape = np.random.default_rng(self.seed), self.shape or (len(x),)
        if math.prod(shape) != len(x):
            raise ValueError(f"a point has {len(x)} features, the network takes {math.prod(shape)}")
        self.p, self.running = [], []
        for layer in self.layers:
            if layer["type"] in ("conv", "pool"):
                if len(shape) != 3:
                    raise ValueError(f"{layer['type']} needs an input of height, width and channels")
                size = int(layer.get("kernel", 5 if layer["type"] == "conv" else 2))
                stride = int(layer.get("stride", 1 if layer["type"] == "conv" else size))
                layer["kernel"], layer["stride"] = size, stride
                over = tuple((n - size) // stride + 1 for n in shape[:2])
                if min(over) < 1:
                    raise ValueError(f"an input of {shape} is too small for {layer['type']}")
                if layer["type"] == "conv":
                    ins, outs = size * size * shape[2], int(layer["filters"])
                    self.p += [rng.normal(0, math.sqrt(2.0 / (ins + outs)), (ins, outs)), np.zeros(outs)]
                    shape = (*over, outs)
                else:
                    shape = (*over, shape[2])
            elif layer["type"] == "dense":
                ins, outs = math.prod(shape), int(layer["size"])
                self.p += [rng.normal(0, math.sqrt(2.0 / (ins + outs)), (ins, outs)), np.zeros(outs)]
                shape = (outs,)
            elif layer["type"] == "norm":
                self.p += [np.ones(shape[-1]), np.zeros(shape[-1])]
                self.running += [np.zeros(shape[-1]), np.ones(shape[-1])]
        self.m, self.v = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p]

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list[tuple]]:
        """Class probabilities, and what each layer needs to go back."""
        x, k, r, kept = x.reshape(len(x), *(self.shape or x.shape[1:])), 0, 0, []
        rng = np.random.default_rng((self.seed, self.t))
        for layer in self.layers:
            kind, before = layer["type"], x
            if kind == "dense":
                note = x.reshape(len(x), -1)
                x = note @ self.p[k] + self.p[k + 1]
            elif kind == "conv":
                cut = cut_patches(x, layer["kernel"], layer["stride"])
                note = cut.reshape(*cut.shape[:3], -1)
                x = note @ self.p[k] + self.p[k + 1]
            elif kind == "pool":
                cut = cut_patches(x, layer["kernel"], layer["stride"])
                flat = cut.reshape(*cut.shape[:3], -1, cut.shape[-1])
                note = flat.argmax(3)
                x = flat.max(3)
            elif kind == "norm":
                axes = tuple(range(x.ndim - 1))
                if train:
                    mean, var = x.mean(axes), x.var(axes)
                    self.running[r], self.running[r + 1] = 0.9 * self.running[r] + 0.1 * mean, 0.9 * self.running[r + 1] + 0.1 * var
                else:
                    mean, var = self.running[r], self.running[r + 1]
                r += 2
                scale = 1 / np.sqrt(var + 1e-5)
                note = ((x - mean) * scale, scale)
                x = note[0] * self.p[k] + self.p[k + 1]
            else:
                rate = float(layer.get("rate", 0.5))
                note = (rng.random(x.shape) >= rate) / (1 - rate) if train else np.ones(x.shape)
                x = x * note
            kept.append((before.shape, note, k, x > 0 if layer["relu"] else None))
            x = np.maximum(x, 0) if layer["relu"] else x
            k += 2 * (kind in ("dense", "conv", "norm"))
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), kept

    def gradients(self, delta: np.ndarray, kept: list[tuple]) -> list[np.ndarray]:
        """Of all parameters, from the loss's gradient before the softmax; weights with their L2 part."""
        grads: list[np.ndarray] = [None] * len(self.p)
        for layer, (shape, note, k, positive) in zip(self.layers[::-1], kept[::-1]):
            kind = layer["type"]
            delta = delta if positive is None else delta * positive
            if kind == "dense":
                grads[k], grads[k + 1] = note.T @ delta + self.l2 * self.p[k], delta.sum(0)
                delta = (delta @ self.p[k].T).reshape(shape)
            elif kind == "norm":
                normal, scale = note
                axes, n = tuple(range(delta.ndim - 1)), delta.size / delta.shape[-1]
                grads[k], grads[k + 1] = (delta * normal).sum(axes), delta.sum(axes)
                delta = self.p[k] * scale * (delta - grads[k + 1] / n - normal * grads[k] / n)
            elif kind == "dropout":
                delta = delta * note
            else:
                size, stride, back = layer["kernel"], layer["stride"], np.zeros(shape)
                if kind == "conv":
                    ins, outs = self.p[k].shape
                    grads[k], grads[k + 1] = note.reshape(-1, ins).T @ delta.reshape(-1, outs) + self.l2 * self.p[k], delta.reshape(-1, outs).sum(0)
                    each = (delta @ self.p[k].T).reshape(*delta.shape[:3], size, size, shape[3])
                else:
                    each = ((np.arange(size * size)[:, None] == note[..., None, :]) * delta[..., None, :]).reshape(*delta.shape[:3], size, size, shape[3])
                rows, columns = delta.shape[1:3]
                for i in range(size):
                    for j in range(size):
                        back[:, i : i + rows * stride : stride, j : j + columns * stride : stride] += each[:, :, :, i, j]
                delta = back
        return grads

    def fit(self, x: list[float], y: float) -> float:
        """0 until a mini-batch is full, then its mean negative log-likelihood."""
        self.grow(x)
        self.held.append((x, y))
        if len(self.held) < self.batch:
            return 0.0
        xs, ys = np.array([p for p, _ in self.held]), np.array([int(q) - self.offset for _, q in self.held])
        self.held = []
        said, kept = self.forward(xs, True)
        loss = float(-np.log(np.maximum(said[np.arange(len(ys)), ys], 1e-12)).mean())
        delta = said.copy()
        delta[np.arange(len(ys)), ys] -= 1
        self.t += 1
        for k, g in enumerate(self.gradients(delta / len(ys), kept)):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = self.p[k] - self.learningRate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        return loss

    def predict(self, x: list[float]) -> float:
        return UNFITTED if self.p is None else float(self.forward(np.array([x]))[0].argmax() + self.offset)

    def get(self) -> list[float]:
        return [] if self.p is None else np.concatenate([q.ravel() for q in self.p]).tolist()

    def set(self, values: list[float]) -> None:
        flat, at = np.array(values), 0
        for k, q in enumerate(self.p):
            self.p[k] = flat[at : at + q.size].reshape(q.shape)
            at += q.size
