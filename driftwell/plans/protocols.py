"""Distributed training protocols as merge rules over models.

Workers' interleaving is fixed: rounds in order, within a round workers in order, within a worker rows in order.  In the
first round only worker 0 trains; its model then starts all others.  A block that isn't full at the end of the data is
learned from locally and never merged.

Workers run in parallel: each is a task of a barrier stage that folds its own rows and, after each block, gathers the
models of all (no rows) through the first worker's task.  If a task is lost, Spark begins the stage again.  Every task goes through the same pushes in the order of workers, so all know the hub's
state.  Where a push changes the model that a later worker should have begun its block with, that worker does its block
again.  The same can be simulated by one streaming pass over the rows of all workers, which holds one model a worker; both
give the same results.  Learners that have a fast loop over a batch are simulated, since a block costs them less than the
meeting after it, and over long tables that pass is a chain of tasks which read some rounds each.
"""

from __future__ import annotations

import copy
import json
import math
import secrets
import socket
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.learners import Held
from ..operators.spec import LearnerSpec, ProtocolSpec
from ..sources.tables import drop_dir, numbered, shared_dir
from .fold import PIECE, chain, fold, store

LABELS = {"Asynchronous": "AsynchronousAveraging", "Synchronous": "SynchronousAveraging", "SSP": "StaleSynchronousParallel", "EASGD": "ElasticAveragingSGD", "Centralized": "Centralized", "CentralizedTraining": "SingleLearner", "GM": "GM", "FGM": "FGM"}


def distance(a: list[float], b: list[float]) -> float:
    return math.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b)))


def safe_zone(model: list[float], center: list[float], threshold: float = 0.0008) -> float:
    """How far a model is from leaving its zone: positive inside."""
    return math.sqrt(threshold) - distance(model, center)


def buckets(size: int, hubs: int, most: int = 10_000) -> list[tuple[int, int, int]]:
    """(hub, start, end), ends inclusive: parameters are dealt evenly over hubs, the first ones taking the remainder, and
    each hub's range is cut into messages of at most ``most``."""
    out, start = [], 0
    for hub in range(hubs):
        length = size // hubs + (hub < size % hubs)
        for at in range(start, start + length, most):
            out.append((hub, at, min(at + most, start + length) - 1))
        start += length
    return out


def message_bytes(parameters: int, loss: bool = True) -> int:
    """Bytes of one message: 8 for each parameter, 16 for its bucket, 8 for the count of fitted points and 8 for a loss."""
    return 8 * parameters + 16 + 8 + (8 if loss else 0)


def sparse_message_bytes(parameters: int, zeros: int, loss: bool = True) -> int:
    """The same where zeros are left out: 8 bytes for each other parameter, 4 for its position, and 4 for the size."""
    return 12 * (parameters - zeros) + 4 + 16 + 8 + (8 if loss else 0)


class Simulation:
    """Losses are null where ``losses`` is false."""

    def __init__(self, spec: LearnerSpec, protocol: ProtocolSpec, losses: bool = True):
        self.spec, self.p, self.losses = spec, protocol, losses
        n = protocol.workers
        self.local = [spec.make() for _ in range(n)]
        self.base: list[list[float]] = [[] for _ in range(n)]
        self.clock, self.in_block, self.block_loss = [0] * n, [0] * n, [0.0] * n
        self.global_: list[float] = []
        self.loss, self.fitted, self.merged_loss, self.merged = 0.0, 0, 0.0, 0
        self.round, self.ready = 0, set()
        self.models = self.bytes = self.blocks = self.rounds = self.subrounds = 0
        self.quantum, self.count, self.sent, self.zeta0 = 0.0, 0, [0] * n, 0.0
        self.out: list[tuple] = []

    # Accounting of models that go over the wire.
    def ship(self, times: int = 1) -> None:
        slices = buckets(len(self.global_), 1, self.p.max_message)
        self.models += times
        self.blocks += times * len(slices)
        self.bytes += times * sum(message_bytes(b - a + 1) for _, a, b in slices)

    def params(self, k: int) -> list[float]:
        return self.local[k].get()

    def put(self, k: int, values: list[float]) -> None:
        if self.local[k].get() and len(self.local[k].get()) == len(values):
            self.local[k].set(values)
        else:
            self.local[k] = copy.deepcopy(self.local[0])
            self.local[k].set(values)

    def install(self, k: int, values: list[float]) -> None:
        self.put(k, values)
        self.base[k] = list(values)

    def many(self, columns: list[pa.Array]):
        """Rows (round, worker, numeric, label) in order: each run of one worker's rows within a round is learned at once."""
        round_, worker = columns[0].to_numpy(), columns[1].to_numpy()
        points, n = Held(self.local[0], *columns[2:]), len(round_)
        cuts = (np.flatnonzero((round_[1:] != round_[:-1]) | (worker[1:] != worker[:-1])) + 1).tolist()
        for start, stop in zip([0, *cuts], [*cuts, n]) if n else ():
            if round_[start] != self.round:
                self.close()
                self.round = int(round_[start])
            k = int(worker[start])
            while start < stop:
                end = min(stop, start + self.p.block - self.in_block[k])
                loss = points.learn(self.local[k], start, end, self.block_loss[k] if self.losses else None)
                self.block_loss[k] = loss if self.losses else math.nan
                self.in_block[k] += end - start
                start = end
                if self.in_block[k] == self.p.block:
                    self.count_in(k)
        found, self.out = self.out, []
        return found

    def count_in(self, k: int) -> None:
        """What worker k's block adds, and its push if the block is full."""
        n, loss = self.in_block[k], self.block_loss[k]
        self.in_block[k], self.block_loss[k] = 0, 0.0
        self.fitted += n
        self.loss += loss
        if n == self.p.block:
            self.clock[k] += 1
            self.merged_loss += loss
            self.merged += n
            self.push(k)

    def push(self, k: int) -> None:
        name, n = self.p.name, self.p.workers
        model = self.params(k)
        if not self.global_:
            # Warm-up: worker 0's first model starts everyone.
            self.global_ = list(model)
            self.ship(1 if name in ("CentralizedTraining", "Centralized") else n)
            for j in range(n):
                self.install(j, self.global_)
            self.begin_zone()
        elif name in ("CentralizedTraining", "Centralized"):
            self.global_ = list(model)
            self.ship(1 if name == "CentralizedTraining" else 0)
        elif name == "Asynchronous":
            self.global_ = [g + (w - b) / n for g, w, b in zip(self.global_, model, self.base[k])]
            self.ship(2)
            self.install(k, self.global_)
        elif name == "SSP":
            self.global_ = [g + (w - b) / n for g, w, b in zip(self.global_, model, self.base[k])]
            self.ship()
            self.base[k] = list(model)
            if self.clock[k] - min(self.clock) > self.p.staleness:
                self.ship()
                self.install(k, self.global_)
        elif name == "EASGD":
            a = self.p.elasticity
            d = [w - g for w, g in zip(model, self.global_)]
            self.put(k, [w - a * e for w, e in zip(model, d)])
            self.global_ = [g + a * e for g, e in zip(self.global_, d)]
            self.ship(2)
        else:
            self.ready.add(k)
            if name == "FGM":
                self.increment(k)
            if name == "Synchronous" and len(self.ready) == n:
                self.average()
        self.out.append((self.round, k, self.merged_loss / max(1, self.merged), self.merged))

    def average(self) -> None:
        n = self.p.workers
        models = [self.params(j) for j in range(n)]
        self.global_ = [sum(v) / n for v in zip(*models)]
        self.ship(2 * n)
        self.rounds += 1
        for j in range(n):
            self.install(j, self.global_)
        self.ready.clear()
        self.begin_zone()

    # Functional geometric monitoring: zones, quanta, subrounds.
    def begin_zone(self) -> None:
        self.zeta0 = math.sqrt(self.p.threshold)
        self.quantum, self.count, self.sent = self.zeta0 / 2, 0, [0] * self.p.workers

    def zeta(self, k: int) -> float:
        return safe_zone(self.params(k), self.base[k], self.p.threshold)

    def increment(self, k: int) -> None:
        now = max(0, math.floor((self.zeta0 - self.zeta(k)) / self.quantum)) if self.quantum > 0 else 0
        self.count += max(0, now - self.sent[k])
        self.sent[k] = max(now, self.sent[k])
        n = self.p.workers
        if self.count > n:
            psi = sum(self.zeta(j) for j in range(n))
            if psi > self.p.precision * n * self.zeta0:
                self.subrounds += 1
                self.quantum, self.count, self.sent = psi / (2 * n), 0, [0] * n
            else:
                self.average()

    def close(self) -> None:
        """The end of a round: geometric monitoring averages if any model left its ball."""
        if self.p.name == "GM" and self.ready and self.global_:
            if any(distance(self.params(k), self.base[k]) ** 2 > self.p.radius for k in sorted(self.ready)):
                self.average()
        self.ready.clear()

    def end(self):
        self.close()
        for k in range(self.p.workers):
            if self.in_block[k]:
                self.count_in(k)
        return self.out


class Rounds(Simulation):
    """One worker's part of a run in parallel: its own learner, and what all pushes made of the hub and of the others'
    parameters.  gather(message) gives every worker's message, in order of workers."""

    def __init__(self, spec: LearnerSpec, protocol: ProtocolSpec, me: int, gather: Callable[[str], list[str]]):
        super().__init__(spec, protocol)
        self.me, self.gather = me, gather
        self.mine, self.known = self.local[me], [m.get() for m in self.local]
        self.local = []
        self.changed: set[int] = set()
        self.first_state = ""

    def params(self, k: int) -> list[float]:
        return self.known[k]

    def put(self, k: int, values: list[float]) -> None:
        self.known[k] = list(values)
        self.changed.add(k)
        if k == self.me:
            self.take(values)

    def take(self, values: list[float]) -> None:
        have = self.mine.get()
        if not have or len(have) != len(values):
            self.mine.restore(self.first_state)
        self.mine.set(values)

    def learn(self, block: list[tuple]) -> float:
        loss = 0.0
        for x, y in block:
            loss += self.mine.fit(x, y)
        return loss

    def run(self, blocks: Iterator[list[tuple]]) -> Iterator[tuple]:
        """blocks: this worker's points.  Rows of what is pushed, the same for every worker."""
        n, last = self.p.workers, False
        self.round = 0
        while not last:
            block = next(blocks, []) if self.round or self.me == 0 else []
            # Until there is a model at the hub, and with zones, a push may change what later workers begin with.
            before = self.mine.state() if not self.global_ or self.p.name == "FGM" else None
            loss, at, again = self.learn(block), 0, True
            while again:
                said = {"n": len(block), "loss": loss, "params": self.mine.get(), "state": self.mine.state() if self.me == 0 and not self.global_ else ""}
                heard = [json.loads(m) for m in self.gather(json.dumps(said))]
                last, again = not any(m["n"] for m in heard) and self.round > 0, False
                self.first_state = heard[0]["state"] or self.first_state
                for k in range(at, n):
                    if not heard[k]["n"]:
                        continue
                    self.known[k], self.in_block[k], self.block_loss[k], self.changed = heard[k]["params"], heard[k]["n"], heard[k]["loss"], set()
                    self.count_in(k)
                    if any(j > k and heard[j]["n"] for j in self.changed):
                        at, again = k + 1, True
                        break
                if again and self.me >= at and block:
                    self.mine.restore(before)
                    self.take(self.known[self.me])
                    loss = self.learn(block)
            yield from self.out
            self.out = []
            self.close()
            self.round += 1


class Final(Simulation):
    """Only the result: the global model's parameters with the run's statistics on each row."""

    quiet = True

    def many(self, columns: list[pa.Array]):
        super().many(columns)

    def end(self):
        super().end()
        return final(self)


FINAL = "pos int, value double, fitted bigint, loss double, models_shipped bigint, bytes_shipped bigint, blocks bigint, rounds bigint, subrounds bigint"


def rounds(df: DataFrame, order: list[str], protocol: ProtocolSpec) -> DataFrame:
    """Adds rn (place within the worker's rows) and round to rows that have a worker."""
    w = Window.partitionBy("worker").orderBy(*order)
    return in_rounds(df.withColumn("rn", F.row_number().over(w) - 1), protocol)


def in_rounds(df: DataFrame, protocol: ProtocolSpec) -> DataFrame:
    late = F.when(F.col("worker") == 0, 0).otherwise(1)
    return df.withColumn("round", (F.floor(F.col("rn") / protocol.block) + late).cast("int"))


def in_parallel(df: DataFrame, spec: LearnerSpec, protocol: ProtocolSpec, order: list[str], result: Callable[[Rounds, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """A task a worker, all at once; the first one's results are kept (all have the same).  They are written to the shared
    folder, since a barrier stage can't be part of a union or be read in part."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    n, block, arrow = protocol.workers, protocol.block, to_arrow_schema(_parse_datatype_string(schema))
    rows = df.where(F.col("worker").between(0, n - 1)).repartitionById(n, F.col("worker")).sortWithinPartitions(*order).select("worker", "numeric", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        me = context.partitionId()

        def blocks() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for batch in batches:
                for worker, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if worker != me:
                        raise ValueError(f"a row of worker {worker} is with worker {me}")
                    held.append((x, y))
                    if len(held) == block:
                        yield held
                        held = []
            if held:
                yield held

        run = Rounds(spec, protocol, me, meet(context, me, n))
        found = result(run, list(run.run(blocks())))
        if me == 0 and found:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(arrow)], arrow.names)

    path = f"{shared_dir(df.sparkSession)}/protocol-{uuid.uuid4().hex}"
    rows.mapInArrow(work, schema, barrier=True).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def meet(context, me: int, n: int) -> Callable[[str], list[str]]:
    """A function that gives all tasks of the barrier stage every task's message.  Spark's own gathering takes a second
    each time, so it only tells where the first task listens (and the word by which it knows the others)."""
    server = socket.create_server(("", 0), backlog=n) if me == 0 else None
    told = context.allGather(json.dumps([server.getsockname()[1], secrets.token_hex(16)]) if server else "")
    port, word = json.loads(told[0])
    peers: dict[int, socket.socket] = {}

    def send(to: socket.socket, text: str) -> None:
        data = text.encode()
        to.sendall(len(data).to_bytes(8, "big") + data)

    def receive(of: socket.socket) -> str:
        def exactly(size: int) -> bytes:
            got = bytearray()
            while len(got) < size:
                part = of.recv(min(1 << 20, size - len(got)))
                if not part:
                    raise ConnectionError("a worker is gone")
                got += part
            return bytes(got)

        return exactly(int.from_bytes(exactly(8), "big")).decode()

    if server:
        while len(peers) < n - 1:
            peer, _ = server.accept()
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            who, said = json.loads(receive(peer))
            if secrets.compare_digest(said, word):
                peers[who] = peer
            else:
                peer.close()
        server.close()
    else:
        hub = socket.create_connection((context.getTaskInfos()[0].address.rsplit(":", 1)[0], port))
        hub.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        send(hub, json.dumps([me, word]))

    def gather(message: str) -> list[str]:
        if server is None:
            send(hub, message)
            return json.loads(receive(hub))
        every = [message, *(receive(peers[k]) for k in range(1, n))]
        for peer in peers.values():
            send(peer, json.dumps(every))
        return every

    return gather


def slots(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def final(run: Simulation) -> list[tuple]:
    stats = (run.fitted, run.loss if run.losses else None, run.models, run.bytes, run.blocks, run.rounds, run.subrounds)
    return [(k, v, *stats) for k, v in enumerate(run.global_ or run.params(0))]


def apart(spec: LearnerSpec, df: DataFrame, protocol: ProtocolSpec) -> bool:
    """Whether workers are worth tasks of their own."""
    return slots(df) >= protocol.workers and not getattr(spec.make(), "columns", None)


def simulated(df: DataFrame, protocol: ProtocolSpec, order: list[str], makes: list[Callable[[], Simulation]], schema: str, piece: int = PIECE) -> list[DataFrame]:
    """The results of several simulations over the same rows, which are put in order once; each is a chain of its own."""
    rows = df.where(F.col("worker").between(0, protocol.workers - 1)).select(*dict.fromkeys(["worker", *order, "numeric", "label"]))
    sizes = [r["count"] for r in rows.groupBy("worker").count().collect()]
    columns, key = ["round", "worker", "numeric", "label"], ["round", "worker", "rn"]
    if sum(sizes) <= piece:
        return [fold(rounds(rows, order, protocol), key, columns, make, schema, piece=piece) for make in makes]
    # A round has at most a block of each worker's rows.
    each = max(1, piece // (protocol.workers * protocol.block))
    spark, parts = df.sparkSession, (max(sizes) // protocol.block + 1) // each + 1
    rows = numbered(rows, order, by="worker", parts=max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = in_rounds(rows, protocol).select(*key, "numeric", "label")
    path = store(rows.repartitionById(parts, F.expr(f"round div {each}").cast("int")).sortWithinPartitions(*key).select(*columns))
    try:
        with ThreadPoolExecutor(len(makes)) as pool:
            return list(pool.map(lambda make: chain(spark, path, make, schema), makes))
    finally:
        drop_dir(spark, path)


def train(df: DataFrame, spec: LearnerSpec, protocol: ProtocolSpec, order: list[str], parallel: bool | None = None, losses: bool = True, piece: int = PIECE) -> DataFrame:
    """df: worker, numeric, label and the order's columns.  The global model and the statistics of the run.
    parallel: None for as many tasks as workers where that is worth it and there are slots for them.
    losses: false leaves loss null, for learners that learn faster without it."""
    if parallel or parallel is None and losses and apart(spec, df, protocol):
        return in_parallel(df, spec, protocol, order, lambda run, out: final(run), FINAL)
    return simulated(df, protocol, order, [lambda: Final(spec, protocol, losses)], FINAL, piece)[0]


def trains(df: DataFrame, spec: LearnerSpec, protocols: list[ProtocolSpec], order: list[str], piece: int = PIECE) -> list[DataFrame]:
    """train() by several protocols of the same workers and blocks."""
    if len({(p.workers, p.block) for p in protocols}) > 1:
        raise ValueError("protocols that are run together have the same workers and blocks")
    return simulated(df, protocols[0], order, [lambda p=p: Final(spec, p) for p in protocols], FINAL, piece)


def curve(df: DataFrame, spec: LearnerSpec, protocol: ProtocolSpec, order: list[str], parallel: bool | None = None, piece: int = PIECE) -> DataFrame:
    """Mean loss of all merged blocks after each push: round, worker, mean_loss, fitted."""
    schema = "round int, worker int, mean_loss double, fitted bigint"
    if parallel or parallel is None and apart(spec, df, protocol):
        return in_parallel(df, spec, protocol, order, lambda run, out: out, schema)
    return simulated(df, protocol, order, [lambda: Simulation(spec, protocol)], schema, piece)[0]
