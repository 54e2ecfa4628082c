"""Ordered folds: one pass over rows in a total order, with a small state, as a streaming Arrow job; over long tables as a
chain of such jobs, a range of rows each."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators.learners import Held
from ..operators.spec import LearnerSpec
from ..sources.tables import drop_dir, shared_dir

#: Rows of one task of a long fold.
PIECE = 2_000_000


def in_order(df: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """Rows so that one task reads them in order; with ``by``, all rows of a key in order, keys in parallel.

    Merging sorted partitions by coalesce wouldn't do, since that may visit them in an order of locality.
    """
    if by is None:
        return df.repartition(1).sortWithinPartitions(*order)
    return df.repartition(by).sortWithinPartitions(by, *order)


def feed(state, columns: list[pa.Array]) -> list[tuple]:
    """Rows of a batch one after another, or all at once where the state has ``many(columns)``."""
    if hasattr(state, "many"):
        return state.many(columns) or []
    found: list[tuple] = []
    for values in zip(*(c.to_pylist() for c in columns)):
        got = state.row(*values)
        if got:
            found += got
    return found


def packer(arrow: pa.Schema) -> Callable[[list[tuple]], pa.RecordBatch]:
    return lambda found: pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(arrow)], arrow.names)


def fold(df: DataFrame, order: list[str], columns: list[str], make: Callable[[], object], schema: str, by: str | None = None, piece: int = PIECE) -> DataFrame:
    """make() gives an object with ``row(*values)``, which may yield result rows, and ``end()``, which yields the last.
    Results have the key as their first column if there is one.  Without a key, a table of more than ``piece`` rows is
    folded range by range."""
    rows = df.select(*dict.fromkeys([*([by] if by else []), *order, *columns]))
    if by is None and (n := rows.count()) > piece:
        path = store(rows.repartitionByRange(-(-n // piece), *order).sortWithinPartitions(*order).select(*columns))
        try:
            return chain(df.sparkSession, path, make, schema)
        finally:
            drop_dir(df.sparkSession, path)
    rows = in_order(rows, order, by).select(*([by] if by else []), *columns)
    full = f"{by} {df.schema[by].dataType.simpleString()}, {schema}" if by else schema
    pack = packer(to_arrow_schema(_parse_datatype_string(full)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, found = None if by else make(), None, []
        for batch in batches:
            keys = batch.column(0).to_pylist() if by else [None] * batch.num_rows
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if by else [0, len(keys)]
            for start, stop in zip(cuts, cuts[1:]) if keys else ():
                if by and (state is None or keys[start] != key):
                    if state is not None:
                        found += [(key, *r) for r in state.end()]
                    state, key = make(), keys[start]
                got = feed(state, [c.slice(start, stop - start) for c in batch.columns[bool(by) :]])
                found += [(key, *r) for r in got] if by else got
            if len(found) >= 10_000:
                yield pack(found)
                found = []
        if state is not None:
            found += [(key, *r) for r in state.end()] if by else list(state.end())
        if found:
            yield pack(found)

    return rows.mapInArrow(run, full)


def store(pieces: DataFrame, most: int | None = None) -> str:
    """Writes rows that are parted and sorted already, a folder a partition, each batch (of ``most`` rows at most) as one
    binary value, numbered and with its number of rows n."""
    path = f"{shared_dir(pieces.sparkSession)}/fold-{uuid.uuid4().hex}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(b.slice(at, most or b.num_rows) for b in batches for at in range(0, b.num_rows, most or b.num_rows or 1)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([batch.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "seq", "n", "data"])

    pieces.mapInArrow(pack, "part int, seq bigint, n bigint, data binary").write.partitionBy("part").parquet(path)
    return path


def chain(spark: SparkSession, path: str, make: Callable[[], object], schema: str) -> DataFrame:
    """A fold over what store() wrote: one task a piece, in order, the state going from each to the next by the driver.
    So no task reads more than its piece, and a lost one repeats its piece only."""
    stored = spark.read.schema("seq bigint, data binary, part int").parquet(path)
    parts = sorted(r["part"] for r in stored.select("part").distinct().collect())
    pack, out = packer(to_arrow_schema(_parse_datatype_string(f"__state binary, {schema}"))), f"{shared_dir(spark)}/folded-{uuid.uuid4().hex}"
    width = len(_parse_datatype_string(schema).fields)
    state, ended = cloudpickle.dumps(make()), []
    # What says that it has rows at its end only leaves nothing on the way.
    quiet = getattr(make(), "quiet", False)
    for part in parts:

        def run(batches: Iterator[pa.RecordBatch], before: bytes = state, last: bool = part == parts[-1]) -> Iterator[pa.RecordBatch]:
            now, found = cloudpickle.loads(before), []
            for batch in batches:
                for data in batch.column(0):
                    for piece in pa.ipc.open_stream(data.as_buffer()):
                        found += [(None, *r) for r in feed(now, piece.columns)]
                        if len(found) >= 10_000:
                            yield pack(found)
                            found = []
            if last:
                found += [(None, *r) for r in now.end()]
            yield pack([*found, (b"" if last else cloudpickle.dumps(now), *[None] * width)])

        piece = stored.where(F.col("part") == part).coalesce(1).sortWithinPartitions("seq").select("data").mapInArrow(run, f"__state binary, {schema}")
        if quiet:
            rows = piece.collect()
            state = next(r[0] for r in rows if r[0] is not None)
            ended += [tuple(r)[1:] for r in rows if r[0] is None]
        else:
            piece.write.parquet(f"{out}/{part:08d}")
            state = spark.read.schema(f"__state binary, {schema}").parquet(f"{out}/{part:08d}").where("__state is not null").select("__state").first()[0]
    if quiet:
        return spark.createDataFrame(ended, schema)
    return spark.read.schema(f"__state binary, {schema}").option("recursiveFileLookup", "true").parquet(out).where("__state is null").drop("__state")


class Train:
    """Fits one learner; at the end its parameters as (pos, value) rows, then how many points and their loss."""

    quiet = True

    def __init__(self, spec: LearnerSpec):
        self.model = spec.make()
        self.fitted, self.loss = 0, 0.0

    def many(self, columns: list[pa.Array]):
        self.learn(Held(self.model, *columns), 0, len(columns[0]))

    def learn(self, points: Held, start: int, stop: int) -> None:
        self.loss = points.learn(self.model, start, stop, self.loss)
        self.fitted += stop - start

    def end(self):
        return [(k, v, self.fitted, self.loss) for k, v in enumerate(self.model.get())]


class Curve(Train):
    """Mean loss of every ``every`` points: (bucket, mean loss, fitted)."""

    quiet = False

    def __init__(self, spec: LearnerSpec, every: int = 256):
        super().__init__(spec)
        self.every, self.before = every, 0.0

    def many(self, columns: list[pa.Array]):
        points, at, n, found = Held(self.model, *columns), 0, len(columns[0]), []
        while at < n:
            stop = min(n, at + self.every - self.fitted % self.every)
            self.learn(points, at, stop)
            at = stop
            if self.fitted % self.every == 0:
                mean, self.before = (self.loss - self.before) / self.every, self.loss
                found.append((self.fitted // self.every - 1, mean, self.fitted))
        return found

    def end(self):
        return []


def train(df: DataFrame, spec: LearnerSpec, order: list[str], by: str | None = None) -> DataFrame:
    """df: numeric, label and the order's columns.  pos, value, fitted, loss."""
    return fold(df, order, ["numeric", "label"], lambda: Train(spec), "pos int, value double, fitted bigint, loss double", by)


def learning_curve(df: DataFrame, spec: LearnerSpec, order: list[str], every: int = 256) -> DataFrame:
    return fold(df, order, ["numeric", "label"], lambda: Curve(spec, every), "bucket int, mean_loss double, fitted bigint")
