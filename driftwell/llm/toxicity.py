"""Toxicity by two class-conditional Kneser-Ney models that share their backoff counts.

A word is read as its characters, from a start mark to an end mark.  For each class (toxic, ordinary) a model of order
ORDER predicts every character from those before it: of its count in that context a discount is taken, and what the
discounts free, and CONCENTRATION counts besides, goes to a lower-order model which both classes share.  That is itself
a Kneser-Ney model of orders 1 to ORDER - 1 on continuation counts (in how many distinct words an n-gram occurs), over
all documents, labelled or not.  So an expression that the labels show rarely, or in another form, is judged by its
parts, and parts that say nothing of a class cancel.  Counts of a class are of labelled texts that have the word; the
larger class's are scaled down to the smaller's total, else any novelty would look like the smaller class.

Counts are gathered by Spark as (n-gram, context, class) rows, by 64-bit hashes of both: every n-gram has a count of its
own, and there are as many as the corpus shows.  Up to ``max_grams`` of them, counted, they are broadcast; beyond that
each distinct word of the texts to be judged is looked up by joins, and texts meet their words' values in chunks.

A text's score compares length-normalised log-likelihoods: the mean over its words of the difference of the classes, and
the greatest such mean over passages of 16 words, so that a long text doesn't hide a short passage; with them go the
second and third greatest differences among its distinct words, the logarithm of what its clearly toxic words add up to,
and that of its length, since the greatest of many differences is greater by chance.  A logistic curve over these figures, fitted to at most FIT_ROWS labelled texts of each class
(smallest hashes of doc_id first), gives a score from 0 to 1.  Nothing but the text enters a score.

Cases: null and empty texts and texts without words have all figures 0 and so the score of the intercept; several labels
of one doc_id count as toxic if any is; null labels are no labels; repeated rows give repeated result rows; without
labels of both classes every score is 0; a labelled text is judged without its own count when the curve is fitted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, lean, pieces, saved, table
from .textwords import ODD, mix, tokens

ORDER = 6
#: Kinds of counts, 4 * order + class (class 2: shared), and how many counts are broadcast at most (up to 50 bytes each).
KINDS = [4 * n + 2 for n in range(ORDER - 1)] + [4 * ORDER - 4, 4 * ORDER - 3]
MAX_GRAMS = 4_000_000
#: Without a broadcast: counts of a kind that are broadcast still, and rows of a chunk.
FEW_GRAMS, CHUNK_ROWS = 100_000, 1000
FIT_ROWS = 5000
DISCOUNT, CONCENTRATION = 0.75, 2.0
#: Words of a passage, and the difference from which a word is clearly of the toxic class.
PASSAGE, CLEAR, FIGURES = 16, 1.5, 6
THRESHOLD = 0.7
#: Scores of so many words are kept at once in a Python worker.
MEMO_WORDS, LOOKUP_WORDS = 300_000, 30_000
START, END = 1, 2


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character: an array [order, character]; and each character's word.
    An n-gram reaches no further back than its word's start mark; hashes of longer ones then equal the longest's."""
    text = "".join(w + "\x02" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = mix(chars + ODD)
    out = np.empty((ORDER, len(chars)), np.uint64)
    out[0] = coded
    for n in range(1, ORDER):
        back = np.concatenate([np.zeros(min(n, len(chars)), np.uint64), coded[: max(0, len(chars) - n)]])
        back = np.where(place == n - 1, np.uint64(START), back)
        out[n] = np.where(place >= n - 1, mix(out[n - 1] * ODD + back + np.uint64(n)), out[n - 1])
    return out, of


def contexts(words: list[str]) -> np.ndarray:
    """Hashes of the contexts of each character's n-grams: [order, character], the first being empty."""
    shifted, of = ngrams(words)
    first = np.concatenate([[True], of[1:] != of[:-1]])
    out = np.zeros_like(shifted)
    for n in range(1, ORDER):
        before = np.concatenate([np.zeros(1, np.uint64), shifted[n - 1][:-1]])
        out[n] = np.where(first, np.uint64(START), before)
    return out


def key(hashes: np.ndarray, n: int) -> np.ndarray:
    return mix(hashes + np.uint64(n))


@lean
def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic (null: unlabelled) → word and how many texts of either class have it: counts of this partition, combined."""
    from collections import Counter

    counts = [Counter(), Counter(), Counter()]

    def rows() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys() | counts[2].keys())
        c0, c1 = (pa.array([c[w] for w in words], pa.int64()) for c in counts[:2])
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), c0, c1], ["word", "c0", "c1"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[2 if toxic is None else toxic].update(set(tokens(text.as_py())))
        if sum(map(len, counts)) > MEMO_WORDS:
            yield rows()
            for c in counts:
                c.clear()
    yield rows()


@lean
def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, c0, c1 (summed over the corpus) → kind, gram, head, n: counts of n-grams with their contexts."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        grams, of = ngrams(words)
        heads = contexts(words)
        per_class = [batch.column(k).to_numpy().astype(float)[of] for k in (1, 2)]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for n in range(ORDER):
            values, first, index = np.unique(key(grams[n], n), return_index=True, return_inverse=True)
            above = key(heads[n][first], n)
            for c in (2,) if n < ORDER - 1 else (0, 1):
                total = np.bincount(index, None if c == 2 else per_class[c], len(values)).astype(np.int64)
                some = np.flatnonzero(total)
                for column, x in zip(out, (np.full(len(some), 4 * n + c, np.int32), values[some].view(np.int64), above[some].view(np.int64), total[some])):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["kind", "gram", "head", "n"])


class Index:
    """Sorted different 64-bit keys, found by their first bits: a bucket has one key on average."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; of those that aren't there, the place after the last."""
        at = self.starts[(keys >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.keys[at] < keys)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < keys[behind]]
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)


class Table:
    """Values by key; zeros for keys that aren't there."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        self.index = Index(keys[order])
        self.columns = [np.append(x[order].astype(np.float32), np.float32(0)) for x in columns]

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        at = self.index.find(keys)
        return [x[at].astype(float) for x in self.columns]


def log_ratios(found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], weights: list[float], own: int | None) -> np.ndarray:
    """log P(toxic) - log P(ordinary) of n-grams.  found: by kind, their counts, and sums and numbers of different
    n-grams of their contexts; own: a class with one text too many."""
    p = np.full(len(found[KINDS[0]][0]), 1 / 256)
    for kind in KINDS[:-2]:
        count, total, kinds = found[kind]
        p = np.where(total > 0, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.where(total > 0, total, 1), p)
    logs = []
    for c, weight in enumerate(weights):
        count, total, kinds = found[KINDS[-2 + c]]
        total = np.maximum(total - int(own == c), 0)
        count = np.clip(count - int(own == c), 0, total)
        freed = np.minimum(DISCOUNT * kinds, total)
        q = (np.maximum(count - DISCOUNT, 0) * weight + (CONCENTRATION + freed * weight) * p) / (total * weight + CONCENTRATION)
        logs.append(np.log(np.maximum(q, 1e-12)))
    return logs[1] - logs[0]


class Model:
    """Log-likelihood differences of words, from count tables or, where there are none, from values in the memo."""

    def __init__(self, tables: dict[int, tuple[Table, Table]] | None, weights: list[float], curve: tuple | None = None, grams: DataFrame | None = None, sizes: dict[int, int] | None = None):
        """tables: kind → counts by n-gram, and sums and numbers of different n-grams by context, if few enough;
        grams and sizes (driver only): all counts as rows, and how many there are by kind."""
        self.tables, self.weights, self.curve, self.grams, self.sizes = tables, weights, curve, grams, sizes
        self.memo: dict[int | None, dict[str, float]] = {}

    def differences(self, words: list[str], own: int | None = None) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) for each word; own: a class with one text too many."""
        grams, of = ngrams(words)
        # All that is known of a character hangs on its longest n-gram, which has the shorter ones in it.
        _, first, index = np.unique(grams[-1], return_index=True, return_inverse=True)
        grams, heads, found = grams[:, first], contexts(words)[:, first], {}
        for kind in KINDS:
            n = kind // 4
            by_gram, by_head = self.tables[kind]
            found[kind] = (*by_gram.of(key(grams[n], n)), *by_head.of(key(heads[n], n)))
        return np.bincount(of, log_ratios(found, self.weights, own)[index], len(words))

    def of(self, words: list[str], own: int | None = None) -> np.ndarray:
        memo = self.memo.setdefault(own, {})
        new = list(set(words) - memo.keys())
        if new:
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = list(set(words))
            memo.update(zip(new, self.differences(new, own).tolist()))
        return np.fromiter(map(memo.__getitem__, words), float, len(words))

    def figures(self, texts: list[str | None], own: int | None = None) -> np.ndarray:
        """A row of figures for each text. Words are looked up for so many texts together that arrays are long."""
        out, first = np.zeros((len(texts), FIGURES)), 0
        while first < len(texts):
            lists, held = [], 0
            while first + len(lists) < len(texts) and held < LOOKUP_WORDS:
                lists.append(tokens(texts[first + len(lists)]))
                held += len(lists[-1])
            every = self.of([w for words in lists for w in words], own)
            at = 0
            for k, words in enumerate(lists, first):
                if words:
                    out[k] = self._figures(every[at : at + len(words)])
                    at += len(words)
            first += len(lists)
        return out

    @staticmethod
    def _figures(d: np.ndarray) -> tuple:
        sums = np.concatenate([[0.0], np.cumsum(d)])
        mean = sums[-1] / len(d)
        passage = (sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE if len(d) > PASSAGE else mean
        # Words of equal difference are nearly always the same word.
        top = np.unique(d)[::-1][:3]
        second, third = (top[k] if k < len(top) else min(top[-1], 0.0) for k in (1, 2))
        return mean, passage, second, third, np.log1p(np.maximum(d - CLEAR, 0).sum()), np.log(len(d))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        if self.tables is None and self.grams is not None:
            rows = scores(self.grams.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), self).collect()
            return np.array([r["score"] for r in sorted(rows)])
        weights, bias, mean, scale = self.curve
        return 1 / (1 + np.exp(-np.clip(bias + ((self.figures(texts) - mean) / scale) @ weights, -500, 500)))


def gather(documents: DataFrame, labels: DataFrame, max_grams: int = MAX_GRAMS) -> Model:
    """documents: doc_id, text; labels: doc_id, toxic (one row a doc_id, to learn from)."""
    rows = documents.select("doc_id", "text").join(labels, "doc_id", "left").select("text", "toxic")
    words = rows.mapInArrow(count_words, "word string, c0 bigint, c1 bigint").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    grams = words.mapInArrow(count_ngrams, "kind int, gram bigint, head bigint, n bigint").groupBy("kind", "gram", "head").agg(F.sum("n").alias("n"))
    grams = saved(grams, "ngrams")
    counted = {r["kind"]: r for r in grams.groupBy("kind").agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("n")).collect()}
    totals = [float(counted[k]["n"]) if k in counted else 1.0 for k in KINDS[-2:]]
    sizes = {k: counted[k]["grams"] if k in counted else 0 for k in KINDS}
    model = Model(None, [min(totals) / x for x in totals], None, grams, sizes)
    if sum(sizes.values()) <= max_grams:
        model.tables = {}
        for kind in KINDS:
            some = grams.where(F.col("kind") == kind)
            by_gram, by_head = some.select("gram", "n").toArrow(), of_contexts(some).toArrow()
            model.tables[kind] = tuple(Table(*(c.to_numpy() for c in t.columns)) for t in (by_gram, by_head))
    return model


def of_contexts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("head").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))


@lean
def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, text → chunk, word: the different words of a batch's chunks."""
    for batch in batches:
        found = {(c, w) for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(tokens(text))}
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], ["chunk", "word"])


@lean
def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word → a row for each character: word, longest (n-gram), grams and heads (the keys by order)."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        grams, of = ngrams(words)
        keys = [np.stack([key(x[n], n) for n in range(ORDER)], 1).view(np.int64).ravel() for x in (grams, contexts(words))]
        lists = [pa.ListArray.from_arrays(np.arange(0, len(k) + 1, ORDER, dtype=np.int32), k) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).take(pa.array(of)), pa.array(grams[-1].view(np.int64)), *lists], ["word", "longest", "grams", "heads"])


def word_values(words: DataFrame, model: Model) -> DataFrame:
    """word → word, v (differences with no own class, with 0 and with 1), by joins with the counts."""
    weights = model.weights
    chars = saved(words.mapInArrow(grams_of, "word string, longest bigint, grams array<bigint>, heads array<bigint>"), "chars")
    rows = chars.groupBy("longest").agg(F.first("grams").alias("grams"), F.first("heads").alias("heads"))
    for kind in KINDS:
        some = model.grams.where(F.col("kind") == kind)
        by_gram = some.select(F.col("gram").alias("key"), F.col("n").alias(f"n{kind}"))
        by_head = of_contexts(some).toDF("key", f"total{kind}", f"kinds{kind}")
        for keys, table_ in (("grams", by_gram), ("heads", by_head)):
            rows = rows.withColumn("key", F.col(keys)[kind // 4]).join(broadcast_if(table_, model.sizes[kind], FEW_GRAMS), "key", "left").drop("key")
    names = [f"{x}{kind}" for kind in KINDS for x in ("n", "total", "kinds")]

    @lean
    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy().astype(float) for c in batch.columns[1:]]
            found = {kind: tuple(columns[3 * k : 3 * k + 3]) for k, kind in enumerate(KINDS)}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(log_ratios(found, weights, own)) for own in (None, 0, 1))], ["longest", "v", "v0", "v1"])

    rows = rows.select("longest", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in names))
    values = rows.mapInArrow(ratios, "longest bigint, v double, v0 double, v1 double")
    return chars.select("word", "longest").join(values, "longest").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("v", "v0", "v1")))


def log_loss_fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised figures, classes weighed alike, slightly regularised."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.0] + [1e-3] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[1:], w[0], mean, scale


def shared_model(spark, model: Model):
    """A broadcast handle; gather() bounds the size of the tables in it."""
    return spark.sparkContext.broadcast((model.tables, model.weights, model.curve))


def judge(documents: DataFrame, model: Model, handle, run: Callable[[Model, pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """run on all rows of documents, in batches, with a model that knows their texts' words."""
    if model.tables is not None:

        @lean
        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(*handle.value)
            for batch in pieces(batches):
                yield run(own, batch)

        return documents.mapInArrow(stream, schema)

    def chunk(rows: pa.Table, words: pa.Table) -> pa.Table:
        own = Model(*handle.value)
        names = words["word"].to_pylist()
        own.memo = {c: dict(zip(names, words[v].to_pylist())) for c, v in ((None, "v"), (0, "v0"), (1, "v1"))}
        return pa.Table.from_batches([run(own, b) for b in pieces(rows.to_batches())])

    of = F.pmod(F.xxhash64("text", *(["doc_id"] if "doc_id" in documents.columns else [])), F.lit(max(1, documents.count() // CHUNK_ROWS)))
    words = saved(documents.select(of.alias("chunk"), "text").mapInArrow(words_of, "chunk bigint, word string").distinct(), "words")
    words = words.join(word_values(words.select("word").distinct(), model), "word")
    return documents.groupBy(of).cogroup(words.groupBy("chunk")).applyInArrow(chunk, schema)


def score_texts(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, text → doc_id, score."""
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])


def measure_texts(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    """text, toxic → figures, toxic."""
    pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    texts = [[t for t, own in pairs if own == c] for c in (0, 1)]
    figures = [row for c in (0, 1) for row in model.figures(texts[c], c).tolist()]
    return pa.RecordBatch.from_arrays([pa.array(figures, pa.list_(pa.float64())), pa.array([c for c in (0, 1) for _ in texts[c]], pa.int32())], ["figures", "toxic"])


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_grams: int = MAX_GRAMS) -> Model:
    """documents: doc_id, text; labels: doc_id, toxic of rows to learn from."""
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = saved(labels.where("toxic in (0, 1)"), "labels")
    model = gather(documents, labels, max_grams)
    # At most 2 * fit_rows labels, so their broadcast is bounded.
    some = [labels.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for c in (0, 1)]
    some = saved(some[0].unionByName(some[1]), "fit")
    handle = shared_model(spark, model)
    rows = documents.join(F.broadcast(some), "doc_id").select("text", "toxic")
    got = judge(rows, model, handle, measure_texts, "figures array<double>, toxic int").toPandas()
    y = got["toxic"].to_numpy()
    if 0 < y.sum() < len(y):
        model.curve = log_loss_fit(np.stack(got["figures"].to_numpy()), y)
    handle.destroy()
    return model


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    handle = shared_model(documents.sparkSession, model)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return judge(rows, model, handle, score_texts, "doc_id bigint, score double")


def reject(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    handle, at = shared_model(documents.sparkSession, model), documents.columns.index("text")

    def run(own: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(own.scores(batch.column(at).to_pylist()) < threshold))

    return judge(documents, model, handle, run, documents.schema)


def held_out(doc_id: str = "doc_id"):
    """A third of all ids, which nothing is learned from; a null id isn't held out, but has no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels.where(~held_out()).select("doc_id", "toxic"))
    out = scores(documents, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
