"""Trees as plans: routing by conditions, predictions of leaves by a join, gains of numeric splits by aggregates."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .learners import Held
from .tree import HT, Leaf

#: Leaves up to which routing is by conditions on the row; nested deeper or wider they don't compile.
CONDITIONS = 64


def route(tree: HT, x: Column) -> Column:
    """The number of the leaf that a point falls into, leaves counted from the left."""
    number = {id(leaf): k for k, leaf in enumerate(tree.leaves())}

    def walk(node) -> Column:
        if isinstance(node, Leaf):
            return F.lit(number[id(node)])
        return F.when(x[node[0]] <= F.lit(float(node[1])), walk(node[2])).otherwise(walk(node[3]))

    return walk(tree.root) if tree.root is not None else F.lit(None).cast("int")


def matrix(xs: pa.Array) -> np.ndarray:
    """Of vectors of one size; NaN where something is missing."""
    sizes = np.diff(xs.offsets.to_numpy())
    if not xs.null_count and len(sizes) and sizes[0] and (sizes == sizes[0]).all():
        return xs.flatten().to_numpy(zero_copy_only=False).reshape(len(xs), sizes[0])
    rows = [x or [] for x in xs.to_pylist()]
    width = max(map(len, rows), default=0)
    return np.array([[*(math.nan if v is None else v for v in x), *[math.nan] * (width - len(x))] for x in rows]).reshape(len(rows), width)


class Router:
    """A tree's tests as arrays: points go down all at once, a level at a time; no further than to nodes of ``ends``."""

    def __init__(self, tree: HT, ends: Iterable = ()):
        stop = {id(node) for node in ends}
        self.attribute, self.at, self.next, self.leaf = [], [], [], []
        stack, leaves = [(tree.root, None, 0)], 0
        while stack:
            node, parent, side = stack.pop()
            k = len(self.leaf)
            if parent is not None:
                self.next[parent][side] = k
            inner = isinstance(node, list) and id(node) not in stop
            self.attribute.append(node[0] if inner else 0)
            self.at.append(float(node[1]) if inner else math.nan)
            self.next.append([k, k])
            self.leaf.append(-1 if inner else leaves)
            leaves += not inner
            if inner:
                stack += [(node[3], k, 1), (node[2], k, 0)]
        self.attribute, self.at, self.next, self.leaf = np.array(self.attribute), np.array(self.at), np.array(self.next, np.int32), np.array(self.leaf, np.int32)

    def route(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int32)
        going = np.flatnonzero(self.leaf[node] < 0)
        while len(going):
            here = node[going]
            right = ~(x[going, self.attribute[here]] <= self.at[here])
            node[going] = here = self.next[here, right.astype(np.int8)]
            going = going[self.leaf[here] < 0]
        return self.leaf[node]


def with_leaf(df: DataFrame, tree: HT, numeric: str, name: str = "__leaf") -> DataFrame:
    """Adds route(), for a tree of any size."""
    if tree.root is None or len(tree.leaves()) <= CONDITIONS:
        return df.withColumn(name, route(tree, F.col(numeric)))
    router, schema = Router(tree), StructType([*df.schema.fields]).add(name, IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(router.route(matrix(b.column(numeric))))], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


class Grown:
    """A tree that goes on; at the end itself."""

    quiet = True

    def __init__(self, tree: HT):
        self.tree = tree

    def many(self, columns: list[pa.Array]):
        Held(self.tree, *columns).learn(self.tree, 0, len(columns[0]), None)

    def end(self):
        return [(cloudpickle.dumps(self.tree),)]


#: Rows that a branch's task is to take, about; rows that are parted by branch or learned from at once.
BRANCH_ROWS, TOGETHER = 500_000, 1 << 16
STORED = "seq bigint, n bigint, data binary, part int"


def grow(df: DataFrame, order: list[str], tree: HT, first: int = 200_000, times: int = 4) -> HT:
    """The tree after all points (numeric, label) in order, without their losses.

    Points are sorted once and stored as batches, in which they stay.  The first ones are one fold.  Then leaves don't depend
    on each other, so the next, up to ``times`` as many as before, are parted by branches of the tree, and each branch grows by
    a task; the tree put together from them parts the points after.  A leaf splits after some thousand points, so no branch's
    share of a part grows with the table.  Where the byte budget may make leaves depend on each other, that part is a fold
    too."""
    from ..plans.fold import PIECE, fold, store
    from ..sources.tables import drop_dir

    rows, spark = df.select(*dict.fromkeys([*order, "numeric", "label"])), df.sparkSession
    n = rows.count()
    if n <= first:
        got = fold(rows, order, ["numeric", "label"], lambda: Grown(tree), "tree binary").collect()
        return cloudpickle.loads(got[0][0]) if got else tree
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PIECE))
    path = store(rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order).select("numeric", "label"), first)
    try:
        stored = spark.read.schema(STORED).parquet(path)
        batches = [tuple(r) for r in stored.select("part", "seq", "n").collect()]
        batches.sort()
        sizes = [first]
        while sizes[-1] * (times + 1) < n:
            sizes.append(sizes[-1] * (times + 1))
        upto = np.cumsum([b[2] for b in batches])
        # Rounds end with the batch that reaches their size.
        ends = sorted({min(len(batches), int(np.searchsorted(upto, s)) + 1) for s in sizes} | {len(batches)})
        for start, stop in zip([0, *ends], ends):
            if start == 0 or not grow_apart(between(stored, batches[start:stop]), int(upto[stop - 1] - upto[start - 1]), tree):
                while start < stop:
                    at = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PIECE, "right")))
                    tree = grow_in_order(between(stored, batches[start : min(at, stop)]), tree)
                    start = at
        return tree
    finally:
        drop_dir(spark, path)


def between(stored: DataFrame, batches: list[tuple]) -> DataFrame:
    """The batches from the first to the last of these (part, seq, n)."""
    (a, s, _), (b, t, _) = batches[0], batches[-1]
    part, seq = F.col("part"), F.col("seq")
    return stored.where(part.between(a, b) & ((part > a) | (seq >= s)) & ((part < b) | (seq <= t)))


def points(data: Iterable[pa.Scalar]) -> Iterator[list[pa.Array]]:
    """Numeric and label of stored batches, several put together."""
    held, size = [], 0
    for value in data:
        for piece in pa.ipc.open_stream(value.as_buffer()):
            held.append(piece)
            size += piece.num_rows
        if size >= TOGETHER:
            yield [pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)]
            held, size = [], 0
    if held:
        yield [pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)]


def grow_in_order(stored: DataFrame, tree: HT) -> HT:
    """One task lets the tree learn from these batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Grown(tree)
        for columns in points(value for batch in batches for value in batch.column(0)):
            state.many(columns)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in state.end()], pa.binary())], ["tree"])

    return cloudpickle.loads(stored.coalesce(1).sortWithinPartitions("part", "seq").select("data").mapInArrow(run, "tree binary").first()[0])


def branches(tree: HT, many: int) -> list[tuple]:
    """At most so many nodes, (node, its parent or None, side) from left to right, under which all leaves hang, about as many
    under each."""
    size: dict[int, int] = {}
    stack = [(tree.root, False)]
    while stack:
        node, done = stack.pop()
        if not isinstance(node, list):
            size[id(node)] = 1
        elif done:
            size[id(node)] = size[id(node[2])] + size[id(node[3])]
        else:
            stack += [(node, True), (node[2], False), (node[3], False)]
    heap, opened = [(-size[id(tree.root)], 0, tree.root)], set()
    while len(heap) < many and -heap[0][0] > 1:
        node = heapq.heappop(heap)[2]
        opened.add(id(node))
        for k, child in enumerate(node[2:4]):
            heapq.heappush(heap, (-size[id(child)], 2 * len(opened) + k, child))
    out, walk = [], [(tree.root, None, 0)]
    while walk:
        node, parent, side = walk.pop()
        if id(node) in opened:
            walk += [(node[3], node, 3), (node[2], node, 2)]
        else:
            out.append((node, parent, side))
    return out


def part_by_branch(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part, seq, data → branch, part, seq, data: each branch's rows of some batches that follow on each other."""
        held, size, last = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            x, y = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            at = router.route(matrix(x)) if len(x) else np.empty(0, np.int32)
            sort = np.argsort(at, kind="stable")
            rows, at = pa.RecordBatch.from_arrays([x, y], ["numeric", "label"]).take(pa.array(sort)), at[sort]
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            data = []
            for start, stop in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows.slice(start, stop - start))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]], pa.int32()), pa.array([last[0]] * len(data), pa.int32()), pa.array([last[1]] * len(data), pa.int64()), pa.array(data, pa.binary())], ["branch", "part", "seq", "data"])

        for batch in batches:
            for part, seq, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and (size >= TOGETHER or last != (part, seq - 1)):
                    yield from flush()
                    held, size = [], 0
                for piece in pa.ipc.open_stream(value.as_buffer()):
                    held.append(piece)
                    size += piece.num_rows
                last = (part, seq)
        if held:
            yield from flush()

    return run, "branch int, part int, seq bigint, data binary"


def grow_apart(stored: DataFrame, n: int, tree: HT) -> bool:
    """Lets each branch grow by its own points of n; false, and nothing changes, where the byte budget may interfere."""
    leaves = tree.leaves()
    if not leaves or not tree.idle(len(leaves), tree.classes):
        return False
    spark = stored.sparkSession
    parted = branches(tree, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BRANCH_ROWS)))
    hyper = {"n_min": tree.n_min, "tau": tree.tau, "delta": tree.delta, "splits": tree.splits, "classes": tree.classes, "mem_period": 1 << 62}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """branch, seq (none: the branch itself, which comes first), data → branch, n, root."""
        rows = ((int(b), None if s is None else int(s), value) for batch in batches for b, s, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))
        for branch, own in itertools.groupby(rows, key=lambda r: r[0]):
            sub = HT(**hyper)
            sub.root = cloudpickle.loads(next(own)[2].as_py())
            for columns in points(value for *_, value in own):
                Held(sub, *columns).learn(sub, 0, len(columns[0]), None)
            if sub.seen:
                yield pa.RecordBatch.from_arrays([pa.array([branch], pa.int32()), pa.array([sub.seen], pa.int64()), pa.array([cloudpickle.dumps(sub.root)], pa.binary())], ["branch", "n", "root"])

    split, schema = part_by_branch(Router(tree, [node for node, *_ in parted]))
    roots = spark.createDataFrame([(k, None, None, bytearray(cloudpickle.dumps(node))) for k, (node, *_) in enumerate(parted)], schema)
    # Nulls come first.
    routed = stored.select("part", "seq", "data").mapInArrow(split, schema).unionByName(roots).repartitionById(len(parted), F.col("branch")).sortWithinPartitions("branch", "part", "seq")
    got = routed.select("branch", "seq", "data").mapInArrow(run, "branch int, n bigint, root binary").collect()
    new = {r["branch"]: cloudpickle.loads(r["root"]) for r in got}
    grown, many, classes = HT(), 0, set()
    for k, (node, *_) in enumerate(parted):
        grown.root = new.get(k, node)
        below = grown.leaves()
        many, classes = many + len(below), classes | {c for f in below for c in f.counts}
    if not tree.idle(many, max(tree.classes, len(classes))):
        return False
    for k, root in new.items():
        _, parent, side = parted[k]
        if parent is None:
            tree.root = root
        else:
            parent[side] = root
    tree.seen += sum(r["n"] for r in got)
    return True


MODEL = "leaf int, majority double, classes array<struct<class: double, share: double, mean: array<double>, sd: array<double>>>"


def leaf_table(spark: SparkSession, tree: HT) -> DataFrame:
    """A row a leaf: its majority and, where it has seen points and is active, each class's share and each attribute's mean
    and deviation (null: not seen), classes in the order in which they came."""
    if tree.discrete:
        raise ValueError("leaves of counted attributes have no densities")
    rows = []
    for k, leaf in enumerate(tree.leaves()):
        seen = leaf.n and leaf.active
        kept = [a for a in range(leaf.attributes) if a not in leaf.dropped]
        of = lambda c, what, leaf=leaf: [(getattr(leaf.stats[a][c], what) if c in leaf.stats[a] else None) if a in kept else math.nan for a in range(leaf.attributes)]  # noqa: B023, E731
        classes = [(float(c), n / leaf.n, of(c, "mean"), [v if v is None or math.isnan(v) else math.sqrt(v) for v in of(c, "variance")]) for c, n in leaf.counts.items()] if seen else []
        majority = leaf.majority()[0]
        rows.append((k, None if majority is None else float(majority), classes))
    return spark.createDataFrame(rows, MODEL)


def density(x: Column, mean: Column, sd: Column) -> Column:
    """Of a normal distribution; without deviation 1 at the mean and 0 elsewhere; a dropped attribute (NaN) counts for nothing
    and one that a class lacks (null) rules it out."""
    normal = F.exp(-(x - mean) * (x - mean) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))
    return F.when(mean.isNull(), 0.0).when(F.isnan(mean), 1.0).when(sd == 0, F.when(x == mean, 1.0).otherwise(0.0)).otherwise(normal)


class Scorer:
    """leaf_table() as arrays of leaves, classes and attributes; classes that a leaf lacks have a share of 0."""

    def __init__(self, tree: HT):
        if tree.discrete:
            raise ValueError("leaves of counted attributes have no densities")
        leaves = tree.leaves()
        classes, attributes = max(1, *(len(f.counts) for f in leaves)), leaves[0].attributes
        self.share, self.label = np.zeros((len(leaves), classes)), np.full((len(leaves), classes), math.nan)
        self.mean, self.sd = np.zeros((len(leaves), classes, attributes)), np.full((len(leaves), classes, attributes), math.nan)
        self.majority, self.dropped = np.full(len(leaves), math.nan), np.zeros((len(leaves), attributes), bool)
        for k, f in enumerate(leaves):
            best = f.majority()[0]
            self.majority[k] = math.nan if best is None else best
            self.dropped[k, list(f.dropped)] = True
            for i, (c, n) in enumerate(f.counts.items() if f.n and f.active else ()):
                self.share[k, i], self.label[k, i] = n / f.n, c
                for a in range(attributes):
                    if a not in f.dropped and c in f.stats[a]:
                        self.mean[k, i, a], self.sd[k, i, a] = f.stats[a][c].mean, math.sqrt(f.stats[a][c].variance)

        # What doesn't depend on the point, a table an attribute; classes that lack an attribute have a density of 0.
        lacks, root = np.isnan(self.sd), math.sqrt(2 * math.pi)
        means, twice, scale = np.where(lacks, 0.0, self.mean), np.where(lacks, 1.0, 2 * self.sd * self.sd), np.where(lacks, math.inf, self.sd * root)
        self.tables = [[np.ascontiguousarray(t[:, :, a]) for t in (means, twice, scale)] for a in range(attributes)]
        self.zero = (self.sd == 0).any((0, 1))

    def predict(self, leaf: np.ndarray, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """x: NaN where missing, which leaves the majority unless the attribute was dropped."""
        p, root = self.share[leaf], math.sqrt(2 * math.pi)
        with np.errstate(all="ignore"):
            for a in range(x.shape[1]):
                v = x[:, a : a + 1]
                if not (self.zero[a] or self.dropped[:, a].any() or np.isnan(v).any()):
                    # The same steps, in place.
                    mean, twice, scale = (t.take(leaf, 0) for t in self.tables[a])
                    np.subtract(v, mean, out=mean)
                    np.multiply(mean, mean, out=mean)
                    np.negative(mean, out=mean)
                    np.divide(mean, twice, out=mean)
                    np.exp(mean, out=mean)
                    np.divide(mean, scale, out=mean)
                    p *= mean
                    continue
                mean, sd = self.mean[leaf, :, a], self.sd[leaf, :, a]
                density = np.exp(-(v - mean) * (v - mean) / (2 * sd * sd)) / (sd * root)
                density = np.where(np.isnan(sd), 0.0, np.where(sd == 0, (v == mean).astype(float), density))
                p = p * np.where(self.dropped[leaf, a][:, None], 1.0, np.where(missing[:, a : a + 1], 0.0, density))
        # Of equal scores the class that came first.
        best = p.argmax(1)[:, None]
        top = np.take_along_axis(p, best, 1)[:, 0]
        return np.where((top > 0) | np.isnan(top), np.take_along_axis(self.label[leaf], best, 1)[:, 0], self.majority[leaf])


def predict_by_arrays(df: DataFrame, tree: HT, numeric: str, keep: list[str]) -> DataFrame:
    router, scorer, schema = Router(tree), Scorer(tree), StructType([df.schema[c] for c in keep]).add("predicted", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            xs = b.column(numeric)
            x = matrix(xs)
            if not x.shape[1]:
                x = np.full((len(x), scorer.mean.shape[2]), math.nan)
            missing = np.zeros(x.shape, bool)
            if xs.null_count or xs.flatten().null_count:
                missing = np.array([[k >= len(row or ()) or row[k] is None for k in range(x.shape[1])] for row in xs.to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scorer.predict(router.route(x), x, missing))], [*keep, "predicted"])

    return df.select(*dict.fromkeys([*keep, numeric])).mapInArrow(run, schema)


def predict(df: DataFrame, tree: HT, numeric: str = "numeric", keep: list[str] | None = None) -> DataFrame:
    """df's columns, or those to keep, and predicted: naive Bayes at the leaf, or its majority; NaN before there is any.  A
    small tree's leaves are broadcast to expressions over the row; a large one's are arrays beside its tests."""
    keep = df.columns if keep is None else keep
    if tree.root is not None and len(tree.leaves()) > CONDITIONS:
        return predict_by_arrays(df, tree, numeric, keep)
    rows = df.withColumn("__leaf", route(tree, F.col(numeric)))
    model = leaf_table(df.sparkSession, tree).withColumnRenamed("leaf", "__leaf")

    def score(c: Column) -> Column:
        cells = F.zip_with(F.col(numeric), F.zip_with(c["mean"], c["sd"], lambda m, s: F.struct(m.alias("m"), s.alias("s"))), lambda v, g: density(v, g["m"], g["s"]))
        return F.aggregate(cells, c["share"], lambda p, q: p * q)

    # Of equal scores the class that came first.
    scored = F.transform("classes", lambda c, i: F.struct(score(c).alias("p"), (-i).alias("i"), c["class"].alias("class")))
    best = F.array_max(scored)
    said = F.when(best["p"] > 0, best["class"]).otherwise(F.coalesce("majority", F.lit(math.nan)))
    return rows.join(F.broadcast(model), "__leaf", "left").select(*keep, F.coalesce(said, F.lit(math.nan)).alias("predicted"))


#: Coefficients of a rational approximation of the error function (Abramowitz and Stegun 7.1.26; error below 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    a = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    tail = F.lit(0.0)
    for c in ERF[::-1]:
        tail = (tail + c) * t
    tail = tail * F.exp(-a * a) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def weights(at: Column, n: Column, mean: Column, variance: Column) -> tuple[Column, Column, Column]:
    """How much of a class's n points lies below, at and above a threshold, by its normal distribution."""
    s = F.sqrt(variance)
    same = F.when(s > 0, F.exp(-(at - mean) * (at - mean) / (2 * variance)) / (s * math.sqrt(2 * math.pi))).when(at == mean, 1.0).otherwise(0.0) * n
    below = F.when(s > 0, normal_cdf((at - mean) / s)).when(at >= mean, 1.0).otherwise(0.0) * n - same
    return below, same, F.greatest(F.lit(0.0), n - below - same)


def numeric_gains(stats: DataFrame, thresholds: DataFrame, least: float = 0.01) -> DataFrame:
    """stats: attr, class, n, mean, variance; thresholds: attr, i, at.  attr, i, at, gain of every threshold whose sides both
    have a share of ``least`` of the weight."""
    below, same, above = weights(F.col("at"), F.col("n"), F.col("mean"), F.col("variance"))
    sides = thresholds.join(stats.select("attr", "class", "n", "mean", "variance"), "attr").select("attr", "i", "at", "n", (below + same).alias("l"), above.alias("r"))
    whole = sides.groupBy("attr", "i", "at").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("r").alias("r"), F.collect_list(F.struct("n", "l", "r")).alias("each"))

    def entropy(c: str) -> Column:
        return F.aggregate("each", F.lit(0.0), lambda s, e: s - F.when(e[c] > 0, e[c] / F.col(c) * F.log2(e[c] / F.col(c))).otherwise(0.0))

    gain = entropy("n") - (F.col("l") * entropy("l") + F.col("r") * entropy("r")) / (F.col("l") + F.col("r"))
    return whole.where(F.least("l", "r") / (F.col("l") + F.col("r")) >= least).select("attr", "i", "at", gain.alias("gain"))
