"""A Hoeffding tree: leaves hold Gaussian (or counted) statistics of every attribute and class, and split when the
best attribute's gain is ahead of the second's by Hoeffding's bound."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np


def bound(span: float, delta: float, n: float) -> float:
    return math.sqrt(span * span * math.log(1 / delta) / (2 * n))


def entropy(counts: list[float]) -> float:
    n = sum(counts)
    return -sum([c / n * math.log2(c / n) for c in counts if c > 0]) if n > 0 else 0.0


class Gaussian:
    """Count, mean and squared deviations of one attribute in one class."""

    def __init__(self, n: float = 0, mean: float = 0.0, d: float = 0.0):
        self.n, self.mean, self.d = n, mean, d

    def add(self, x: float) -> None:
        self.n += 1
        gap = x - self.mean
        self.mean += gap / self.n
        self.d += gap * (x - self.mean)

    def merge(self, o: Gaussian) -> Gaussian:
        n = self.n + o.n
        if not n:
            return Gaussian()
        gap = o.mean - self.mean
        return Gaussian(n, self.mean + gap * o.n / n, self.d + o.d + gap * gap * self.n * o.n / n)

    @property
    def variance(self) -> float:
        return self.d / (self.n - 1) if self.n > 1 else 0.0

    def density(self, x: float) -> float:
        s = math.sqrt(self.variance)
        if s == 0:
            return 1.0 if x == self.mean else 0.0
        return math.exp(-((x - self.mean) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))

    def weights(self, x: float) -> tuple[float, float, float]:
        """How much of the weight lies below, at and above x."""
        s = math.sqrt(self.variance)
        same = self.density(x) * self.n
        below = (0.5 * math.erfc(-(x - self.mean) / (s * math.sqrt(2))) if s else float(x >= self.mean)) * self.n - same
        return below, same, max(0.0, self.n - below - same)


class Leaf:
    def __init__(self, attributes: int, discrete: bool, height: int = 0, majority: float | None = None, share: float = 0.0):
        self.attributes, self.discrete, self.height = attributes, discrete, height
        self.counts: dict[float, int] = {}
        self.n = self.errors = 0
        self.inherited, self.share = majority, share
        self.active = True
        self.dropped: set[int] = set()
        self.stats: list[dict] = [{} for _ in range(attributes)]
        self.low, self.high = [math.inf] * attributes, [-math.inf] * attributes

    def majority(self) -> tuple[float | None, float]:
        """Class and fraction; of equal counts the class that came first."""
        if not self.n:
            return self.inherited, self.share
        best = max(self.counts, key=self.counts.get)
        return best, self.counts[best] / self.n

    def add(self, x: list[float], y: float) -> None:
        self.errors += self.majority()[0] != y
        self.counts[y] = self.counts.get(y, 0) + 1
        self.n += 1
        if self.active:
            for a, v in enumerate(x):
                if a in self.dropped:
                    continue
                self.low[a], self.high[a] = min(self.low[a], v), max(self.high[a], v)
                if self.discrete:
                    by = self.stats[a].setdefault(v, {})
                    by[y] = by.get(y, 0) + 1
                else:
                    self.stats[a].setdefault(y, Gaussian()).add(v)

    def add_all(self, x: np.ndarray, y: np.ndarray) -> None:
        """add() of finite rows one after another, a column at a time."""
        counts, best, errors, labels = self.counts, self.majority()[0], self.errors, y.tolist()
        for c in labels:
            errors += best != c
            k = counts[c] = counts.get(c, 0) + 1
            if best != c and (best not in counts or k >= counts[best]):
                best = max(counts, key=counts.get)
        self.errors, self.n = errors, self.n + len(labels)
        if not self.active:
            return
        of = {c: x[y == c].T.tolist() for c in dict.fromkeys(labels)}
        low, high = x.min(0).tolist(), x.max(0).tolist()
        for a in range(x.shape[1]):
            if a in self.dropped:
                continue
            self.low[a], self.high[a] = min(self.low[a], low[a]), max(self.high[a], high[a])
            for c, columns in of.items():
                g = self.stats[a].setdefault(c, Gaussian())
                n, mean, d = g.n, g.mean, g.d
                for v in columns[a]:
                    n += 1
                    gap = v - mean
                    mean += gap / n
                    d += gap * (v - mean)
                g.n, g.mean, g.d = n, mean, d

    def deactivate(self) -> None:
        """Statistics of attributes go, class counts stay."""
        self.active, self.stats = False, [{} for _ in range(self.attributes)]

    def activate(self) -> None:
        """Statistics are gathered again, from nothing."""
        if not self.active:
            self.active = True
            self.low, self.high = [math.inf] * self.attributes, [-math.inf] * self.attributes

    def drop(self, a: int) -> None:
        """Attribute a is neither counted nor split on nor judged by any more."""
        self.dropped.add(a)
        self.stats[a] = {}

    def candidates(self, a: int, splits: int) -> list[float]:
        if self.discrete:
            return sorted(self.stats[a])[:-1]
        return [self.low[a] + i / (splits + 1) * (self.high[a] - self.low[a]) for i in range(1, splits + 1)]

    def sides(self, a: int, at: float) -> tuple[dict[float, float], dict[float, float]]:
        left: dict[float, float] = dict.fromkeys(self.counts, 0.0)
        right = dict(left)
        if self.discrete:
            for v, by in self.stats[a].items():
                for c, k in by.items():
                    side = left if v <= at else right
                    side[c] += k
        else:
            for c, g in self.stats[a].items():
                below, same, above = g.weights(at)
                left[c], right[c] = below + same, above
        return left, right

    def cuts(self, a: int, splits: int) -> Iterator[tuple[float, list[float], list[float]]]:
        """Each candidate with what sides() gives for it; what doesn't depend on the candidate is worked out once."""
        if self.discrete:
            for at in self.candidates(a, splits):
                yield at, *(list(side.values()) for side in self.sides(a, at))
            return
        seen, root, half = [], math.sqrt(2 * math.pi), math.sqrt(2)
        for k, c in enumerate(self.counts):
            if g := self.stats[a].get(c):
                s = math.sqrt(g.variance)
                seen.append((k, g.n, g.mean, s, 2 * s * s, s * root, s * half))
        exp, erfc = math.exp, math.erfc
        for at in self.candidates(a, splits):
            lefts, rights = [0.0] * len(self.counts), [0.0] * len(self.counts)
            for k, n, mean, s, twice, scale, width in seen:
                # As Gaussian.weights() does it, bit for bit.
                if s:
                    same = exp(-((at - mean) ** 2) / twice) / scale * n
                    below = 0.5 * erfc(-(at - mean) / width) * n - same
                else:
                    same = (1.0 if at == mean else 0.0) * n
                    below = float(at >= mean) * n - same
                lefts[k], rights[k] = below + same, max(0.0, n - below - same)
            yield at, lefts, rights

    def gains(self, splits: int) -> list[tuple[float, int, float]]:
        """Best gain of each attribute with its threshold, best first; a side of less than 1 % counts for nothing."""
        whole, out = entropy(list(self.counts.values())), []
        for a in range(self.attributes):
            best = (-math.inf, a, math.nan)
            if a in self.dropped:
                continue
            for at, lefts, rights in self.cuts(a, splits):
                l, r = sum(lefts), sum(rights)
                if l + r and min(l, r) / (l + r) >= 0.01:
                    gain = whole - (l * entropy(lefts) + r * entropy(rights)) / (l + r)
                    if gain > best[0]:
                        best = (gain, a, at)
            out.append(best)
        return sorted(out, key=lambda g: -g[0])

    def predict(self, x: list[float]) -> tuple[float | None, float]:
        """Naive Bayes by what the leaf has seen; else its majority."""
        if not self.n or not self.active:
            return self.majority()
        best, score = None, -1.0
        for c, k in self.counts.items():
            p = k / self.n
            for a, v in enumerate(x):
                if a in self.dropped:
                    continue
                p *= self.stats[a].get(v, {}).get(c, 0) / k if self.discrete else self.stats[a][c].density(v) if c in self.stats[a] else 0.0
            if p > score:
                best, score = c, p
        return (best, score) if score > 0 else self.majority()

    def bytes(self) -> int:
        return 64 + sum(24 * (sum(map(len, s.values())) if self.discrete else len(s)) for s in self.stats)


class HT:
    """The tree; nodes are leaves or [attribute, value, left, right, height]."""

    parallel = False

    def __init__(self, n_min: int = 200, tau: float = 0.05, delta: float = 1e-7, splits: int = 10, discrete: bool = False, classes: int = 2, mem_period: int = 100_000, maxByteSize: int = 33_554_432):
        self.n_min, self.tau, self.delta, self.splits, self.discrete, self.classes = int(n_min), float(tau), float(delta), int(splits), discrete, int(classes)
        self.mem_period, self.max_bytes = int(mem_period), int(maxByteSize)
        self.root = None
        self.seen = 0

    def route(self, x: list[float]) -> tuple[Leaf, list | None, int]:
        node, parent, side = self.root, None, 0
        while isinstance(node, list):
            parent, side = node, 2 if x[node[0]] <= node[1] else 3
            node = node[side]
        return node, parent, side

    def fit(self, x: list[float], y: float) -> float:
        if self.root is None:
            self.root = Leaf(len(x), self.discrete)
        self.seen += 1
        leaf, parent, side = self.route(x)
        loss = float(leaf.predict(x)[0] != y)
        leaf.add(x, y)
        self.judge(leaf, parent, side)
        if self.seen % self.mem_period == 0:
            self.limit()
        return loss

    def judge(self, leaf: Leaf, parent: list | None, side: int) -> bool:
        """Splits a leaf that has come to a multiple of n_min points and whose best gain is far enough ahead."""
        if not (leaf.active and leaf.n % self.n_min == 0 and len(leaf.counts) > 1):
            return False
        gains = leaf.gains(self.splits) or [(0.0, 0, math.nan)]
        second = gains[1][0] if len(gains) > 1 and gains[1][0] > -math.inf else 0.0
        eps = bound(math.log2(max(self.classes, len(leaf.counts))), self.delta, leaf.n)
        if gains[0][0] > 0 and (gains[0][0] - second > eps or eps < self.tau):
            self.split(leaf, parent, side, gains[0])
            return True
        return False

    def absorb(self, x: np.ndarray, y: np.ndarray) -> None:
        """What fit() of finite rows one after another makes of the tree, without losses.  Between two checks of the byte
        budget leaves don't depend on each other, so each takes its rows at once."""
        if self.discrete:
            for p, q in zip(x.tolist(), y.tolist()):
                self.fit(p, q)
            return
        if self.root is None and len(x):
            self.root = Leaf(x.shape[1], False)
        at = 0
        while at < len(x):
            stop = min(len(x), at + self.mem_period - self.seen % self.mem_period)
            self.descend(x[at:stop], y[at:stop])
            self.seen += stop - at
            at = stop
            if self.seen % self.mem_period == 0:
                self.limit()

    def descend(self, x: np.ndarray, y: np.ndarray) -> None:
        stack = [(self.root, None, 0, np.arange(len(x)))]
        while stack:
            node, parent, side, rows = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, list):
                left = x[rows, node[0]] <= node[1]
                stack += [(node[3], node, 3, rows[~left]), (node[2], node, 2, rows[left])]
                continue
            at = 0
            while at < len(rows):
                stop = min(len(rows), at + self.n_min - node.n % self.n_min)
                node.add_all(x[rows[at:stop]], y[rows[at:stop]])
                at = stop
                if self.judge(node, parent, side):
                    stack.append((self.root if parent is None else parent[side], parent, side, rows[at:]))
                    break

    def split(self, leaf: Leaf, parent: list | None, side: int, gain: tuple[float, int, float]) -> None:
        _, a, at = gain
        children = []
        for counts in leaf.sides(a, at):
            best = max(counts, key=counts.get)
            children.append(Leaf(leaf.attributes, self.discrete, leaf.height + 1, best, counts[best] / max(1e-12, sum(counts.values()))))
            children[-1].dropped = set(leaf.dropped)
        node = [a, at, *children, leaf.height]
        if parent is None:
            self.root = node
        else:
            parent[side] = node

    def leaves(self) -> list[Leaf]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[3], node[2]]
            else:
                out.append(node)
        return out

    def places(self) -> list[tuple[list | None, int]]:
        """Where each leaf hangs, in the order of leaves(): its parent (None: it is the root) and side."""
        out, stack = [], [(self.root, None, 0)] if self.root is not None else []
        while stack:
            node, parent, side = stack.pop()
            if isinstance(node, list):
                stack += [(node[3], node, 3), (node[2], node, 2)]
            else:
                out.append((parent, side))
        return out

    def idle(self, leaves: int, classes: int) -> bool:
        """Whether limit() changes nothing while there are at most so many leaves, of so many classes."""
        now = self.leaves()
        attributes = now[0].attributes if now else 0
        return not self.discrete and all(f.active for f in now) and leaves * (64 + 24 * attributes * classes) <= self.max_bytes

    def limit(self) -> None:
        """Within the byte budget the leaves with the most errors stay active, or become so again; an inactive one is
        taken to grow to the mean size of the active."""
        leaves = sorted(self.leaves(), key=lambda f: -f.errors)
        sizes = [f.bytes() for f in leaves if f.active]
        mean, left = sum(sizes) / max(1, len(sizes)), self.max_bytes
        if sum(sizes) <= left and len(sizes) == len(leaves):
            return
        for leaf in leaves:
            left -= leaf.bytes() if leaf.active else max(mean, leaf.bytes())
            if left < 0:
                leaf.deactivate()
            else:
                leaf.activate()

    def predict(self, x: list[float]) -> float:
        got = self.route(x)[0].predict(x)[0] if self.root is not None else None
        return math.nan if got is None else got

    def nodes(self) -> list[tuple]:
        """node_id, parent_id, is_left, attribute, value, height, is_leaf, n, errors, active, majority."""
        out, stack = [], [(self.root, None, None)] if self.root is not None else []
        while stack:
            node, parent, left = stack.pop()
            k = len(out)
            if isinstance(node, list):
                out.append((k, parent, left, node[0], node[1], node[4], False, None, None, None, None))
                stack += [(node[3], k, False), (node[2], k, True)]
            else:
                out.append((k, parent, left, None, None, node.height, True, node.n, node.errors, node.active, node.majority()[0]))
        return out

    def dump(self) -> str:
        def leaf(f: Leaf) -> dict:
            stats = [[[k, v if self.discrete else [v.n, v.mean, v.d]] for k, v in s.items()] for s in f.stats]
            if self.discrete:
                stats = [[[k, list(v.items())] for k, v in s.items()] for s in f.stats]
            return {"counts": list(f.counts.items()), "n": f.n, "errors": f.errors, "height": f.height, "inherited": f.inherited, "share": f.share, "active": f.active, "dropped": sorted(f.dropped), "stats": stats, "low": f.low, "high": f.high}

        def walk(node):
            return {"leaf": leaf(node)} if isinstance(node, Leaf) else {"a": node[0], "at": node[1], "left": walk(node[2]), "right": walk(node[3]), "height": node[4]}

        hyper = {"n_min": self.n_min, "tau": self.tau, "delta": self.delta, "splits": self.splits, "discrete": self.discrete, "classes": self.classes, "mem_period": self.mem_period, "maxByteSize": self.max_bytes}
        return json.dumps({"hyper": hyper, "seen": self.seen, "root": None if self.root is None else walk(self.root)})

    def state(self) -> str:
        return self.dump()

    def restore(self, text: str) -> None:
        self.__dict__.update(HT.load(text).__dict__)

    def get(self) -> list[float]:
        """A tree isn't a list of numbers: it goes as its state."""
        return []

    def set(self, values: list[float]) -> None:
        if values:
            raise ValueError("a tree can't be averaged")

    @classmethod
    def load(cls, text: str) -> HT:
        spec = json.loads(text)
        tree = cls(**spec["hyper"])
        tree.seen = spec["seen"]

        def walk(d):
            if "leaf" not in d:
                return [d["a"], d["at"], walk(d["left"]), walk(d["right"]), d["height"]]
            f = d["leaf"]
            leaf = Leaf(len(f["stats"]), tree.discrete, f["height"], f["inherited"], f["share"])
            leaf.counts, leaf.n, leaf.errors, leaf.active, leaf.low, leaf.high = dict(map(tuple, f["counts"])), f["n"], f["errors"], f["active"], f["low"], f["high"]
            leaf.dropped = set(f.get("dropped", ()))
            leaf.stats = [{k: dict(map(tuple, v)) if tree.discrete else Gaussian(*v) for k, v in s} for s in f["stats"]]
            return leaf

        tree.root = None if spec["root"] is None else walk(spec["root"])
        return tree
