"""Near-duplicate documents by ProbMinHash, banding and verification.

A text is the weighted set of its five-word shingles (lower-cased runs of letters and digits; a text of one to four
words has a single shingle), a shingle seen c times weighing 1 + ln c.  Every shingle is a Poisson process whose rate is
its weight; each arrival falls on one of the signature's registers, and the first arrival there wins it.  Arrivals are
made round by round and a shingle stops when its time is past the slowest register, so few arrivals are made beyond
those that count.  Two texts agree in a register with the probability Jaccard of their weighted sets.  A text in which
a shingle recurs has a second signature, of weights of 1 each, whose registers agree with the Jaccard of distinct
shingles; other texts' first signature is that too.

Candidates agree in a whole band of registers of either signature.  A pair is a link if its exact probability Jaccard or its exact Jaccard
of distinct shingles is at least the threshold; classes are what links connect.  Verification goes in two steps:

1. every text against the most similar of the leaders (smallest ids) of its buckets: one pair a text;
2. in each bucket that still holds several classes, all members outside its largest class against all members of other
   classes, in blocks: registers are compared first, and pairs whose estimate isn't below the threshold by five standard
   deviations are verified exactly.

So no bucket is capped and no pair within a class is made.  Texts with equal words are one node throughout.

Cases: null and empty texts and texts without words are alone in their class; the class id is its smallest doc_id,
nulls last; repeated rows give repeated result rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import broadcast_if, lean, saved, table
from .components import components
from .textwords import ODD, WordHashes, mix, shingles, tokens

REGISTERS, BANDS = 192, 32
THRESHOLD = 0.8
#: Five standard deviations of an estimate by REGISTERS registers.
MARGIN = 5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
BATCH_WORDS, BATCH_TEXTS = 200_000, 500
PROBES, TARGETS = 64, 1024
#: Ids of so many texts (16 bytes each) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights."""
    values, counts = np.unique(shingles(hashes), return_counts=True)
    return values, 1 + np.log(counts)


def probminhash(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Signatures of weighted sets (none of them empty): for each register the shingle that came first."""
    n = len(sets)
    if not n:
        return np.empty((0, registers), np.uint64)
    item = np.concatenate([v for v, _ in sets])
    rate = np.concatenate([w for _, w in sets])
    of = np.repeat(np.arange(n), [len(v) for v, _ in sets])
    first, winner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    time, rounds = np.zeros(len(item)), 0
    while len(item):
        rounds += 1
        h = mix(item + np.uint64(rounds * int(ODD) % 2**64))
        time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = of * registers + (mix(h ^ ODD) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        winner[at[won]] = item[won]
        go = time < first.reshape(n, registers).max(1)[of]
        item, rate, of, time = item[go], rate[go], of[go], time[go]
    return winner.reshape(n, registers)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signatures.shape[1] // bands
    parts = signatures.reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * ODD, parts.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * ODD + parts[:, :, k])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard and Jaccard of distinct shingles, both exact."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    x, y = a[1][i], b[1][j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    # Shingles of at least this ratio count by their weight in a, those below it by their weight in b.
    low = np.searchsorted(ratio, ratio, "left")
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])[low] + only_a
    below = np.concatenate([[0], np.cumsum(y)])[low] + only_b
    return max(plain, float((1 / (above / x + below / y)).sum()))


def content_id(words: list[str]) -> bytes:
    return xxhash.xxh128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def unweighted(sets: list[tuple[np.ndarray, np.ndarray]], signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sets have weights other than 1, and all sets' signatures without weights."""
    heavy = np.flatnonzero([w.max() > 1 for _, w in sets])
    plain = signatures.copy()
    if len(heavy):
        plain[heavy] = probminhash([(sets[k][0], np.ones(len(sets[k][0]))) for k in heavy])
    return heavy, plain


def both(registers: list[bytes]) -> np.ndarray:
    """[texts, signatures (with weights, without), registers]; texts with equal signatures have one of them stored."""
    return np.frombuffer(b"".join(r if len(r) > REGISTERS else r + r for r in registers), np.uint8).reshape(-1, 2, REGISTERS)


SIGNED = "doc_id bigint, node binary, bands array<bigint>, registers binary"


@lean
def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text → doc_id, node (hash of its words), bands, registers (eight bits each, of one signature or both);
    nulls without words."""
    memo = WordHashes()
    ids, nodes, sets, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        live = [k for k, s in enumerate(sets) if s is not None]
        signatures = probminhash([sets[k] for k in live])
        heavy, plain = unweighted([sets[k] for k in live], signatures)
        bands, short = [None] * len(sets), [None] * len(sets)
        for row, k in enumerate(live):
            short[k] = row
        hashes, bits = band_hashes(signatures), mix(signatures).astype(np.uint8)
        second, more = mix(plain).astype(np.uint8), dict(zip(heavy.tolist(), band_hashes(plain[heavy])))
        for k in live:
            row = short[k]
            bands[k] = hashes[row] if row not in more else np.unique(np.concatenate([hashes[row], more[row]]))
            short[k] = bits[row].tobytes() + (second[row].tobytes() if row in more else b"")
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "node", "bands", "registers"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = tokens(text.as_py())
            ids.append(doc_id)
            nodes.append(content_id(words) if words else None)
            sets.append(weighted(memo.of(words)) if words else None)
            held += len(words)
            if held >= BATCH_WORDS or len(ids) >= BATCH_TEXTS:
                yield flush()
                ids, nodes, sets, held = [], [], [], 0
    if ids:
        yield flush()


@lean
def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, registers of a, of b → a, b, estimate; pairs that can't reach the threshold go."""
    for batch in batches:
        x, y = (both(batch.column(k).to_pylist()) for k in (2, 3))
        estimate = (x == y).mean(2).max(1)
        keep = pa.array(np.flatnonzero(estimate >= THRESHOLD - MARGIN))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(estimate).take(keep)], ["a", "b", "estimate"])


@lean
def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, salt, b, text in order, each a's own text (b null) before its partners → a, b of true links."""
    memo = WordHashes()
    current, own = None, None
    for batch in batches:
        left, right = [], []
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text")):
            words = tokens(text.as_py())
            if b is None:
                if content_id(words) == a:
                    current, own = a, weighted(memo.of(words))
            elif current == a and content_id(words) == b and similarity(own, weighted(memo.of(words))) >= THRESHOLD:
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


@lean
def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks of a bucket, in order of block and then probes first → plausible pairs of different classes."""
    key, probes, targets = None, [], []

    def pairs() -> pa.RecordBatch:
        left, right = [], []
        if probes and targets:
            p, t = both([r for _, _, r in probes]), both([r for _, _, r in targets])
            least = (THRESHOLD - MARGIN) * REGISTERS
            for k, (node, label, _) in enumerate(probes):
                for j in np.flatnonzero((t == p[k]).sum(2).max(1) >= least):
                    if targets[j][1] != label:
                        left.append(min(node, targets[j][0]))
                        right.append(max(node, targets[j][0]))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            if (now := (row["band"], row["pb"], row["tb"])) != key:
                if key is not None:
                    yield pairs()
                key, probes, targets = now, [], []
            (probes if row["probe"] else targets).append((row["node"], row["label"], row["registers"]))
    if key is not None:
        yield pairs()


def verify(pairs: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """pairs: a, b.  Those that are links.  Each text is sent once a pair, each leader's once for 512 partners."""
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    some = saved(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "first_id"), "node"), "wanted")
    wanted = broadcast_if(some, some.count(), BROADCAST_IDS)
    texts = documents.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")
    salts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / 512).cast("int") + 1).alias("salts"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    texts = saved(texts, "texts")
    own = salts.join(texts, salts["a"] == texts["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "text")
    partners = salted.join(texts, salted["b"] == texts["node"]).select("a", "salt", "b", "text")
    rows = own.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return saved(rows.mapInArrow(verified, "a binary, b binary"), "links")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """documents: doc_id, text.  Returns doc_id, node, class_id for every row."""
    signed = saved(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sign, SIGNED), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    nodes = saved(nodes, "nodes")
    members = nodes.select("node", "first_id", F.explode("bands").alias("band"))
    full = members.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = saved(members.join(full, "band"), "buckets")
    leaders = buckets.groupBy("band").agg(F.min(F.struct("first_id", "node")).alias("leader"))
    led = buckets.join(leaders, "band").where("node <> leader.node").select("node", F.col("leader.node").alias("a")).distinct()
    sig = nodes.select("node", "registers")
    sigs = led.join(sig, "node").withColumnRenamed("node", "b").withColumnRenamed("registers", "rb")
    sigs = sigs.join(sig.withColumnRenamed("node", "a"), "a").select("a", "b", F.col("registers").alias("ra"), "rb")
    near = sigs.mapInArrow(estimated, "a binary, b binary, estimate double")
    best = near.groupBy("b").agg(F.max(F.struct("estimate", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    tried = saved(best, "tried")
    links = verify(tried, nodes, documents)
    labels = components(links)
    # What is left: buckets with several classes.
    labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("top")).where("classes > 1")
    mixed = mixed.select("band", F.col("top.label").alias("top"), F.ceil((F.col("members") - F.col("top.n")) / PROBES).cast("int").alias("pbs"), F.ceil(F.col("members") / TARGETS).cast("int").alias("tbs"))
    rest = labelled.select("band", "node", "label").join(mixed, "band").join(sig, "node")
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    probes = rest.where("label <> top").select("band", part("pbs", 1).alias("pb"), F.explode(F.sequence(F.lit(0), F.col("tbs") - 1)).alias("tb"), "node", "label", "registers", F.lit(True).alias("probe"))
    targets = rest.select("band", F.explode(F.sequence(F.lit(0), F.col("pbs") - 1)).alias("pb"), part("tbs", 2).alias("tb"), "node", "label", "registers", F.lit(False).alias("probe"))
    blocks = probes.unionByName(targets).repartition("band", "pb", "tb").sortWithinPartitions("band", "pb", "tb", F.col("probe").desc())
    more = blocks.mapInArrow(crossing, "a binary, b binary").distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.unionByName(verify(more.join(known, ["a", "b"], "left_anti"), nodes, documents))
    labels = components(links)
    grouped = signed.select("doc_id", "node").join(nodes.select("node", "first_id"), "node", "left").join(labels, "node", "left")
    grouped = saved(grouped.select("doc_id", "node", "first_id", F.coalesce("label", "node").alias("label")), "grouped")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least")
    classes = grouped.where("label is not null").groupBy("label").agg(least, F.count(F.lit(1)).alias("class_size"))
    rows = grouped.join(classes, "label", "left")
    first = (F.col("label").isNull()) | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node")))
    return rows.select("doc_id", "node", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), first.alias("first"))


def add_node(schema):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, text → row, node (hash of the text's words)."""
        for batch in batches:
            words = [tokens(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([content_id(w) if w else None for w in words], pa.binary())], ["row", "node"])

    return run, StructType([StructField("row", schema), StructField("node", BinaryType())])


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: the one with the smallest doc_id (any one of equal rows)."""
    found = saved(near_duplicates(documents), "classes")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("first").alias("first"))
    gone = saved(ids.where("n > 1 or not first").select(F.col("doc_id").alias("id"), "n"), "gone")
    some = broadcast_if(gone, gone.count(), BROADCAST_IDS)
    # Rows as structs, so that no column of theirs clashes with one of these.
    packed, same = documents.select(F.struct("*").alias("row")), F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("id"))
    kept = packed.join(some, same, "left_anti").select("row.*")
    # Ids that occur more than once are told apart by their words too.
    many = gone.where("n > 1").select("id")
    if many.isEmpty():
        return kept
    run, schema = add_node(documents.schema)
    rows = packed.join(many, same, "left_semi").select("row", F.col("row.text").alias("text")).mapInArrow(run, schema)
    firsts = found.where("first and node is not null").select(F.col("doc_id").alias("id"), F.col("node").alias("first")).distinct()
    alike = rows.join(firsts, same & (F.col("node") == F.col("first")), "left_semi")
    # Rows without words are in no class, so all of them stay.
    alike = alike.withColumn("doc_id", F.col("row.doc_id")).dropDuplicates(["doc_id", "node"])
    return kept.unionByName(alike.select("row.*")).unionByName(rows.where("node is null").select("row.*"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
