"""Removal of strings that start elsewhere too, by run-length indexes, over bytes or over words.

The corpus is parted so that equal strings of the wanted length meet: each string's anchor is the smallest hash of its
shorter runs, anchors seen once go, and the stretch of text whose strings share an anchor (a context) is sent to the
anchor's part.  Contexts are long only where texts repeat.  Strings whose hash is the only one of its kind in the part match
nothing, so they go (others with equal hashes are what is compared).  Each part then indexes the rest of its distinct
contexts: their suffixes are ordered, the Burrows-Wheeler transform is kept as runs, and the length of agreement with the suffix next to it is
computed at run ends alone.  Within a run those lengths follow from their neighbour in the text (one less for each
step), so matching statistics are streamed from the samples through the text.  Places that agree with another suffix
over the wanted length are marked.

A unit says what a text's symbols are.  ``BYTES``: strings of 400 bytes, wherever else they start, the same text
included.  ``WORDS``: passages of 50 words (runs other than white space, so that other spacing is no difference), which
another document has too; words compare by 64-bit hashes.

Equal texts are indexed once, equal contexts too.  A context that occurs twice is marked as a whole.  An anchor whose
distinct contexts have more than ``hot`` symbols together would make one part too large; its strings are compared by two
64-bit hashes in an aggregation, which Spark combines before it shuffles.

Cases: null and empty texts have no symbols; texts shorter than the length lose nothing; strings may overlap and may
repeat within one text; doc_id serves as a name only (nulls and repeated ids are as good as others; equal rows are copies);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, run_hashes, sliding_min, span_hashes, value_runs
from .common import broadcast_if, forget, lean, pieces, salted_join, saved, table, text_or_empty
from .textwords import ODD, mix, windows

#: Starts of a context at most; a longer stretch is cut into several.
CONTEXT_STARTS = 8192
#: Symbols that are indexed at once, and symbols of one anchor's distinct contexts that are.
BATCH_SYMBOLS, HOT = 1 << 19, 1 << 19
BROADCAST_IDS = 1_000_000


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Unit:
    """Texts as sequences of symbols.  length: symbols of a string; run: symbols of the runs that give its anchor;
    across: only strings of another text count."""

    kind: str
    length: int
    run: int
    across: bool

    def symbols(self, data: bytes) -> np.ndarray:
        array = np.frombuffer(data, np.uint8)
        return array if self.kind == "bytes" else span_hashes(array, *word_places(array))

    def hashes(self, symbols: np.ndarray, size: int) -> np.ndarray:
        return run_hashes(symbols, size) if self.kind == "bytes" else windows(symbols, size)

    def anchors_of(self, symbols: np.ndarray) -> np.ndarray:
        """The text's anchors; one that has several places is listed twice, where the same text counts."""
        if len(symbols) < self.length:
            return np.empty(0, np.int64)
        values, counts = np.unique(anchors(self.hashes(symbols, self.run), self.length - self.run + 1)[1], return_counts=True)
        return (values if self.across else np.concatenate([values, values[counts > 1]])).view(np.int64)

    def unpack(self, context: bytes) -> np.ndarray:
        return np.frombuffer(context, np.uint8 if self.kind == "bytes" else np.uint64)

    @property
    def width(self) -> int:
        return 1 if self.kind == "bytes" else 8

    def bounds(self, data: np.ndarray) -> np.ndarray:
        """Where each symbol's bytes begin, and the end; a word's bytes reach to the next word."""
        return np.arange(len(data) + 1) if self.kind == "bytes" else np.append(word_places(data)[0], len(data))


BYTES, WORDS = Unit("bytes", 400, 64, False), Unit("words", 50, 8, True)


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes other than space and 9 to 13."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of non-negative symbols, by prefix doubling; settled suffixes aren't sorted again."""
    n = len(symbols)
    base, key, width = int(symbols.max()) + 2, np.zeros(n, np.int64), 0
    while base ** (width + 1) < 1 << 62 and width < 4:
        width += 1
    padded = np.concatenate([symbols + 1, np.zeros(width, symbols.dtype)]).astype(np.int64)
    for k in range(width):
        key = key * base + padded[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]), np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = start, -1
    place = order.copy()
    sizes = np.bincount(start, minlength=n)
    open_ = order[sizes[start] > 1]
    while len(open_):
        first = rank[open_]
        second = rank[np.minimum(open_ + width, n)] + 1
        sort = np.argsort(first * (n + 1) + second)
        open_, first, second = open_[sort], first[sort], second[sort]
        at = np.arange(len(open_))
        new_first = np.concatenate([[True], first[1:] != first[:-1]])
        new_key = new_first | np.concatenate([[True], second[1:] != second[:-1]])
        group = np.maximum.accumulate(np.where(new_first, at, 0))
        own = np.maximum.accumulate(np.where(new_key, at, 0))
        place[first + (at - group)] = open_
        rank[open_] = first + (own - group)
        last = np.concatenate([own[1:] != own[:-1], [True]])
        open_ = open_[~(last & (own == at))]
        width *= 2
    return place


def agreement(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths to which the suffixes at a and b agree; every pair must differ somewhere."""
    n, length, live = len(symbols), np.zeros(len(a), np.int64), np.arange(len(a))
    eight = np.zeros(n + 8, np.uint64)
    hashed = np.concatenate([symbols.astype(np.uint64), np.arange(8, dtype=np.uint64) + np.uint64(1 << 40)])
    for k in range(8):
        eight[:n] = eight[:n] * ODD + mix(hashed[k : k + n] + ODD)
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        same = (eight[np.minimum(x, n)] == eight[np.minimum(y, n)]) & (x < n) & (y < n)
        live = live[same]
        length[live] += 8
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        same = (x < n) & (y < n)
        same[same] = symbols[x[same]] == symbols[y[same]]
        live = live[same]
        length[live] += 1
    return length


def matching_statistics(symbols: np.ndarray, owner: np.ndarray | None = None, length: int = 1) -> tuple[np.ndarray, int]:
    """For each place, how long its suffix agrees with any other; also the number of runs of the transform.
    With ``owner`` (one row, or two: least and greatest owner, per place) a place counts only if a suffix of another
    owner agrees over ``length`` at least; others get 0."""
    n = len(symbols)
    order = suffix_array(symbols)
    before = symbols[order - 1]  # the transform
    heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    lengths = np.zeros(len(heads), np.int64)
    lengths[1:] = agreement(symbols, order[heads[1:] - 1], order[heads[1:]])

    def streamed(places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Lengths at all places from those at sampled ones: each step through the text takes one off."""
        sample = np.full(n, -1, np.int64)
        sample[places] = values + places
        return sample[np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))] - np.arange(n)

    # Agreement with the suffix before (sampled at heads of runs) and with the one after (at ends of runs).
    previous = streamed(order[heads], lengths)
    best = np.maximum(previous, streamed(order[np.concatenate([heads[1:] - 1, [n - 1]])], np.concatenate([lengths[1:], [0]])))
    if owner is not None:
        # Suffixes that agree over the length stand together; such a group counts if it has several owners.
        group = np.cumsum(previous[order] < length) - 1
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least, most = np.minimum.reduceat(owner[0][order], first), np.maximum.reduceat(owner[-1][order], first)
        several = np.zeros(n, bool)
        several[order] = (least != most)[group]
        best = np.where(several, best, 0)
    return best, len(heads)


def joined(contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as one row of symbols, each ended by a symbol of its own; and where each begins."""
    sizes = np.array([len(c) + 1 for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    every = np.concatenate(contexts)
    dense = every.astype(np.int64) if every.dtype == np.uint8 else np.unique(every, return_inverse=True)[1]
    symbols = np.empty(starts[-1], np.int64)
    symbols[np.delete(np.arange(starts[-1]), starts[1:] - 1)] = dense + len(contexts)
    symbols[starts[1:] - 1] = np.arange(len(contexts))
    return symbols, starts[:-1]


def text_id(name: str = "text") -> Column:
    """A text's name: its SHA-256, as scan() has it too."""
    return F.unhex(F.sha2(text_or_empty(name), 256))


def scan(units: list[Unit]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text → doc_id, text_id, n_bytes, and for each unit how many symbols and the anchors."""
        for batch in batches:
            ids, sizes, counts, found = [], [], [[] for _ in units], [[] for _ in units]
            for text in batch.column(1):
                data = encoded(text.as_py())
                ids.append(hashlib.sha256(data).digest())
                sizes.append(len(data))
                for k, unit in enumerate(units):
                    symbols = unit.symbols(data)
                    counts[k].append(len(symbols))
                    found[k].append(unit.anchors_of(symbols))
            columns = [batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64())]
            names = ["doc_id", "text_id", "n_bytes"]
            for k in range(len(units)):
                columns += [pa.array(counts[k], pa.int64()), pa.array(found[k], pa.list_(pa.int64()))]
                names += [f"n{k}", f"anchors{k}"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run, "doc_id bigint, text_id binary, n_bytes bigint" + "".join(f", n{k} bigint, anchors{k} array<bigint>" for k in range(len(units)))


def cut_contexts(unit: Unit):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text_id, anchors, text → text_id, at, anchor, same (hash of the context), size (symbols), context."""
        for batch in pieces(batches):
            keys, places, values, same, sizes, contexts = [], [], [], [], [], []
            for key, some, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = encoded(text.as_py())
                symbols = unit.symbols(data)
                least = sliding_min(unit.hashes(symbols, unit.run), unit.length - unit.run + 1)
                wanted = np.isin(least, some.values.to_numpy().view(np.uint64))
                packed = data if unit.kind == "bytes" else symbols.tobytes()
                for a, b in zip(*value_runs(least)):
                    for at in range(int(a), int(b), CONTEXT_STARTS) if wanted[a] else ():
                        to = min(int(b), at + CONTEXT_STARTS) + unit.length - 1
                        context = packed[at * unit.width : to * unit.width]
                        keys.append(key)
                        places.append(at)
                        values.append(int(least[a]) - (1 << 64 if least[a] >> np.uint64(63) else 0))
                        same.append(xxhash.xxh128_digest(context))
                        sizes.append(to - at)
                        contexts.append(context)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.int32()), pa.array(values, pa.int64()), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(contexts, pa.binary())], ["text_id", "at", "anchor", "same", "size", "context"])

    return run, "text_id binary, at int, anchor bigint, same binary, size bigint, context binary"


def alike(unit: Unit, held: list[tuple]) -> list[tuple]:
    """(same, context, twice, owner) → (same, piece, twice, owner, where it begins): of each context the piece from its first
    to its last string whose hash another string has too, unless all of them are in contexts that are marked as a whole."""
    sizes = np.array([len(c) for _, c, *_ in held])
    number, begin = np.repeat(np.arange(len(held)), sizes - unit.length + 1), np.cumsum(sizes) - sizes
    first = np.cumsum(sizes - unit.length + 1) - (sizes - unit.length + 1)
    at = np.arange(len(number)) - first[number]
    hashes = unit.hashes(np.concatenate([c for _, c, *_ in held]), unit.length)[begin[number] + at]
    order = np.argsort(hashes)
    ordered = hashes[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    single = np.array([not twice for *_, twice, _ in held])[number[order]]
    wanted = (np.diff(np.append(head, len(ordered))) > 1) & np.logical_or.reduceat(single, head)
    hit = np.zeros(len(number), bool)
    hit[order] = np.repeat(wanted, np.diff(np.append(head, len(ordered))))
    hit = np.flatnonzero(hit)
    if not len(hit):
        return []
    which, low = number[hit], at[hit]
    cut = np.flatnonzero(which[1:] != which[:-1]) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(hit)) - 1
    return [(held[k][0], held[k][1][a : b + unit.length], *held[k][2:], a) for k, a, b in zip(which[starts].tolist(), low[starts].tolist(), low[ends].tolist())]


def mark(unit: Unit):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """anchor, same, context, twice, owner (a text that has it), in order of anchor → same, lo, hi: runs of starts that match."""
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            keys, low, high = [], [], []
            kept = alike(unit, held)
            if not kept:
                return
            symbols, starts = joined([c for _, c, *_ in kept])
            owners = None
            if unit.across:
                number: dict[bytes, int] = {}
                least = np.array([number.setdefault(owner, len(number)) for *_, owner, _ in kept])
                # A context of several texts has another owner than any other by itself.
                most = np.where([twice for *_, twice, _, _ in kept], len(kept) + np.arange(len(kept)), least)
                sizes = np.diff(np.append(starts, len(symbols)))
                owners = np.repeat(np.stack([least, most]), sizes, axis=1)
            best, _ = matching_statistics(symbols, owners, unit.length)
            for (key, context, *_, begin), at in zip(kept, starts):
                hit = best[at : at + len(context) - unit.length + 1] >= unit.length
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))) + begin
                    keys.append(key)
                    low.append(edge[::2].astype(np.int32))
                    high.append(edge[1::2].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(low, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int32()))], ["same", "lo", "hi"])

        group: list[tuple] = []

        def close() -> None:
            """A group of one context that occurs twice is marked as a whole anyway; one of one text's contexts, where
            only other texts count, has nothing to mark."""
            nonlocal size
            alone = unit.across and not any(x[2] for x in group) and len({x[3] for x in group}) == 1
            if len(group) > 1 and not alone or len(group) == 1 and not unit.across and not group[0][2]:
                held.extend(group)
                size += sum(len(x[1]) + 1 for x in group)
            group.clear()

        for batch in pieces(batches):
            for anchor, key, context, twice, owner in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if anchor != last:
                    close()
                    if size >= BATCH_SYMBOLS:
                        yield from flush()
                        held, size = [], 0
                last = anchor
                group.append((key, unit.unpack(context), twice, owner))
        close()
        if held:
            yield from flush()

    return run, "same binary, lo array<int>, hi array<int>"


def explode_strings(unit: Unit):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """same, twice, owner, context → same, twice, owner, place, and two hashes of each string in it."""
        for batch in batches:
            for key, twice, owner, context in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = unit.unpack(context)
                h, g = unit.hashes(data, unit.length), unit.hashes(data[::-1], unit.length)[::-1]
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array([twice] * n), pa.array([owner] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(np.ascontiguousarray(g).view(np.int64))], ["same", "twice", "owner", "place", "h", "g"])

    return run, "same binary, twice boolean, owner binary, place int, h bigint, g bigint"


def fetch(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted rows (doc_id, text_id and more). Only texts of wanted ids are shuffled, if there are few enough."""
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    some = broadcast_if(ids, ids.count(), BROADCAST_IDS)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("id2"), "text").join(some, F.col("id2").eqNullSafe(F.col("id")), "left_semi")
    return texts.select(text_id().alias("text_id"), "text").join(wanted, "text_id")


def scanned(documents: DataFrame, units: list[Unit]) -> tuple[DataFrame, DataFrame]:
    """documents: doc_id, text.  (rows, texts), both saved: rows has doc_id, text_id, n_bytes and n0, n1... (symbols by
    unit) for every row; texts has text_id, doc_id (the least), copies and anchors0, anchors1... for every text."""
    run, schema = scan(units)
    rows = saved(documents.select("doc_id", "text").mapInArrow(run, schema), "scan")
    lists = [F.first(f"anchors{k}").alias(f"anchors{k}") for k in range(len(units))]
    return rows, saved(rows.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *lists), "texts")


def marked(documents: DataFrame, texts: DataFrame, k: int, unit: Unit, hot: int = HOT) -> DataFrame:
    """doc_id, text_id, runs (array<struct<lo, hi>> of starts of strings that start elsewhere too, hi exclusive) for each
    text of one row alone that has any.  texts: of scanned(), whose unit number k this is."""
    each = texts.select("text_id", "doc_id", F.explode(f"anchors{k}").alias("anchor"))
    again = saved(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    alive = saved(salted_join(each, again, "anchor", "text_id").groupBy("text_id", "doc_id").agg(F.collect_set("anchor").alias("anchors")), "alive")
    run, schema = cut_contexts(unit)
    contexts = saved(fetch(documents, alive).select("text_id", "anchors", "text").mapInArrow(run, schema), "contexts")
    # Different contexts with how often each occurs, and the anchors that have very many of them.
    twice = F.min("text_id") != F.max("text_id") if unit.across else F.count(F.lit(1)) > 1
    one = contexts.groupBy("anchor", "same").agg(F.first("context").alias("context"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"), twice.alias("twice"), F.min("text_id").alias("owner"))
    one = saved(one, "one")
    many = saved(one.groupBy("anchor").agg(F.sum("size").alias("size")).where(F.col("size") > hot).select("anchor"), "hot")
    few = broadcast_if(many, many.count(), BROADCAST_IDS)
    cold = one.join(few, "anchor", "left_anti").select("anchor", "same", "context", "twice", "owner")
    run, schema = mark(unit)
    found, used = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema), [again, alive, contexts, one, many]
    if not many.isEmpty():
        run, schema = explode_strings(unit)
        strings = one.join(few, "anchor", "left_semi").select("same", "twice", "owner", "context").mapInArrow(run, schema)
        several = F.max("twice") | (F.min("owner") != F.max("owner")) if unit.across else F.count(F.lit(1)) > 1
        shared = saved(strings.groupBy(F.struct("h", "g").alias("hg")).agg(F.count(F.lit(1)).alias("n"), several.alias("several")).where("several").drop("several"), "strings")
        warm = salted_join(strings.withColumn("hg", F.struct("h", "g")), shared, "hg", "same").groupBy("same").agg(F.array_sort(F.collect_set("place")).alias("lo"))
        found = found.unionByName(warm.select("same", "lo", F.transform("lo", lambda x: x + 1).alias("hi")))
        used.append(shared)
    found = saved(found, "marks")
    placed = contexts.select("text_id", F.struct("anchor", "same").alias("key"), "same", "at", (F.col("size") - (unit.length - 1)).cast("int").alias("starts"))
    placed = salted_join(placed, one.select(F.struct("anchor", "same").alias("key"), "n", "twice"), "key", "text_id").join(found, "same", "left")
    runs = F.when(F.col("twice"), F.array(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("starts")).alias("hi")))).otherwise(F.arrays_zip(F.transform("lo", lambda x: x + F.col("at")).alias("lo"), F.transform("hi", lambda x: x + F.col("at")).alias("hi")))
    runs = placed.where("twice or lo is not null").select("text_id", runs.alias("runs")).groupBy("text_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    out = saved(runs.join(texts.where("copies = 1").select("text_id", "doc_id"), "text_id"), "runs")
    forget(found, *used)
    return out


def covered(runs: str, length: int):
    """How many symbols the strings of given starts cover together."""
    spans = F.array_sort(F.transform(runs, lambda r: F.struct(r["lo"].alias("s"), (r["hi"] + F.lit(length - 1)).alias("e"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(spans, zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["s"], a["to"]))).alias("n"), F.greatest(a["to"], s["e"]).alias("to")))["n"].cast("bigint")


def cut_strings(unit: Unit):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text_id, runs, text → text_id, n_removed (symbols), n_spans, kept_sha256, kept (whole characters only)."""
        for batch in pieces(batches):
            out = []
            for key, runs, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = encoded(text.as_py())
                array = np.frombuffer(data, np.uint8)
                bounds = unit.bounds(array)
                lo, hi = (runs.values.field(k).to_numpy() for k in (0, 1))
                gone = np.zeros(len(bounds), np.int64)
                np.add.at(gone, lo, 1)
                np.add.at(gone, hi + unit.length - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                cut = gone
                if unit.kind != "bytes":
                    cut = np.zeros(len(array), bool)
                    cut[bounds[0] :] = np.repeat(gone, np.diff(bounds))
                kept = array[~cut].tobytes()
                # A character goes if any of its bytes does.
                char = np.cumsum((array & 0xC0) != 0x80) - 1
                hit = np.zeros(char[-1] + 1, bool)
                hit[char[cut]] = True
                text = array[~hit[char]].tobytes().decode("utf-8", "surrogatepass")
                out.append((key, int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)), hashlib.sha256(kept).hexdigest(), text))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["text_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run, "text_id binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def remove_matches(documents: DataFrame, unit: Unit = BYTES, hot: int = HOT, also: Unit | None = None) -> DataFrame:
    """For every row doc_id, text_id, copies (rows with this text), n_bytes, n_removed (symbols), n_spans, kept_sha256,
    kept (null: the text is unchanged).  also: a second unit, which only counts: n_also, the symbols its strings cover."""
    units = [unit, also] if also else [unit]
    rows, texts = scanned(documents, units)
    marks = marked(documents, texts, 0, unit, hot)
    run, schema = cut_strings(unit)
    cut = saved(fetch(documents, marks).select("text_id", "runs", "text").mapInArrow(run, schema), "cut")
    counts = marked(documents, texts, 1, also, hot).select("text_id", covered("runs", also.length).alias("n_also")) if also else None
    named = saved(salted_join(rows.drop("anchors0", "anchors1"), texts.select("text_id", F.col("copies").alias("n"), "copies"), "text_id", "doc_id"), "rows")
    forget(rows, texts, marks)
    # Texts of several rows go as a whole if they are long enough, so only the others meet what was found in them.
    single, several = named.where("copies = 1").join(cut, "text_id", "left"), named.where("copies > 1")
    whole, gone = F.lower(F.hex("text_id")), F.col("n0") >= unit.length
    common = ["doc_id", "text_id", "copies", "n_bytes"]
    left = [F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", whole).alias("kept_sha256"), F.col("kept")]
    none = [F.when(gone, F.col("n0")).otherwise(0).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("bigint").alias("n_spans"), F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(whole).alias("kept_sha256"), F.when(gone, "").alias("kept")]
    if also:
        single = single.join(counts, "text_id", "left")
        left.append(F.coalesce("n_also", F.lit(0)).alias("n_also"))
        none.append(F.when(F.col("n1") >= also.length, F.col("n1")).otherwise(0).alias("n_also"))
    return single.select(*common, *left).unionByName(several.select(*common, *none))


def cut_documents(documents: DataFrame, unit: Unit = WORDS) -> DataFrame:
    """All rows with all columns; text (and n_chars, where there is one) without the characters that matches cover.
    A word goes with the white space after it."""
    cuts = saved(remove_matches(documents, unit).where("kept is not null").select("doc_id", "text_id", "copies", "kept"), "cuts")
    ids = cuts.select(F.col("doc_id").alias("id")).distinct()
    some = broadcast_if(ids, ids.count(), BROADCAST_IDS)
    # Rows as structs, so that no column of theirs clashes with one of these.
    packed, same = documents.select(F.struct("*").alias("row")), F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("id"))
    # Of an id with several texts some may be unchanged, so texts decide.
    new = cuts.groupBy("text_id").agg(F.first("copies").alias("n"), F.first("kept").alias("kept"))
    touched = salted_join(packed.join(some, same, "left_semi").withColumn("text_id", text_id("row.text")), new, "text_id", "row.doc_id", "left")
    columns = {"text": F.coalesce("kept", "row.text"), "n_chars": F.when(F.col("kept").isNull(), F.col("row.n_chars") if "n_chars" in documents.columns else None).otherwise(F.length("kept"))}
    touched = touched.select(*((columns[f.name] if f.name in columns else F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in documents.schema))
    return packed.join(some, same, "left_anti").select("row.*").unionByName(touched)


def op9_run_index(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, by bytes; and n_shared_words: words in passages of 50 words that another document has too,
    however they are spaced."""
    out = remove_matches(table(spark, sf_dir, "documents"), also=WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("n_also").alias("n_shared_words"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT r, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
hit AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
edge AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit),
isl AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM edge),
span AS (SELECT r, k, min(i) AS a, max(i) + 399 AS z FROM isl GROUP BY r, k),
gap AS (SELECT r, k, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS pz FROM span),
tot AS (SELECT r, CAST(sum(z - a + 1) AS BIGINT) AS n, count(*) AS s, max(z) AS lz FROM gap GROUP BY r),
part AS (SELECT r, k, hex(array_slice(b, pz + 1, a - 1)) AS t FROM gap JOIN d USING (r) WHERE a > pz + 1 UNION ALL SELECT r, 1000000000, hex(array_slice(b, lz + 1, octet_length(b))) FROM tot JOIN d USING (r) WHERE lz < octet_length(b)),
kept AS (SELECT r, string_agg(t, '' ORDER BY k) AS t FROM part GROUP BY r),
ww AS (SELECT r, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 48)) AS i FROM (SELECT row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) WHERE len(w) >= 50)),
wh AS (SELECT r, i FROM ww WHERE h IN (SELECT h FROM ww GROUP BY h HAVING min(r) < max(r))),
wn AS (SELECT r, count(DISTINCT p) AS shared FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM wh) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(s, 0) AS n_spans, CASE WHEN n IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(t, ''))) END AS kept_sha256, coalesce(shared, 0) AS n_shared_words
FROM d LEFT JOIN tot USING (r) LEFT JOIN kept USING (r) LEFT JOIN wn USING (r)
"""
