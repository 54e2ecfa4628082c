"""Removal of word windows that an earlier document has too, by level-wise doubling of the length.

Levels are lengths that double from ``first`` up to the full one (25 and 50 words by default; of an odd length the half
is rounded up).  At a level below the last, windows of full length are judged by their anchors: of every window that is
still alive, the smallest hash of the windows of the level's length within.  An anchor that is in no second document
goes, with all windows that have it; what is left is looked at in twice the length, until the full length is reached or
nothing is alive.  Windows of full length are equal if their two 64-bit hashes agree (the window's and its last
anchor's), and each is held against the smallest doc_id that has it.

Equal texts are compared once, by their smallest doc_id; their other copies follow from that.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; a null doc_id is neither earlier nor
later than any other, so such rows lose nothing and take nothing; rows of one doc_id don't count against each other;
repeated rows give repeated result rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, sliding_min, spans
from .common import broadcast_if, lean, salted_join, saved, table
from .textwords import WordHashes, windows

WORD = re.compile(r"[^ \t-\r]+")
LENGTH = 50
#: So many documents (16 bytes each) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
NOTHING = hashlib.sha256(b"").hexdigest()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def text_id(text: str | None) -> bytes:
    return xxhash.xxh128_digest((text or "").encode("utf-8", "surrogatepass"))


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def level_sizes(length: int, first: int) -> list[int]:
    """Lengths of the levels: the full one, halved (and rounded up) while that is first at least."""
    out = [length]
    while -(-out[0] // 2) >= max(1, first) and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out if len(out) > 1 else [length, length]


def first_level(length: int, half: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text → doc_id, text_id, n_words, whole (digest of all words), anchors."""
        memo = WordHashes()
        for batch in batches:
            ids, counts, whole, found = [], [], [], []
            for text in batch.column(1):
                words = words_of(text := text.as_py())
                ids.append(text_id(text))
                counts.append(len(words))
                whole.append(digest(words))
                found.append(np.unique(anchors(windows(memo.of(words), half), length - half + 1)[1]).view(np.int64) if len(words) >= length else [])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(whole), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_id", "n_words", "whole", "anchors"])

    return run, "doc_id bigint, text_id binary, n_words bigint, whole string, anchors array<bigint>"


def alive_starts(hashed: np.ndarray, length: int, sizes: list[int], kept: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of full length whose anchors of all earlier levels are kept, and all anchors of the last of them."""
    alive = np.ones(len(hashed) - length + 1, bool)
    for size, some in zip(sizes, kept):
        least = sliding_min(windows(hashed, size), length - size + 1)
        alive &= np.isin(least, some)
    return np.flatnonzero(alive), least


def next_level(length: int, sizes: list[int], size: int):
    """sizes: of the levels so far; size: of this one."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text_id, kept (anchors of the levels so far), text → doc_id, text_id, kept, anchors of this level."""
        memo = WordHashes()
        for batch in batches:
            found, fit = [], []
            for key, kept, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                fit.append(text_id(text := text.as_py()) == key)
                hashed = memo.of(words_of(text)) if fit[-1] else None
                if hashed is None:
                    found.append([])
                    continue
                at, _ = alive_starts(hashed, length, sizes, [np.array(k, np.int64).view(np.uint64) for k in kept])
                found.append(np.unique(sliding_min(windows(hashed, size), length - size + 1)[at]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_id", "kept", "anchors"]).filter(pa.array(fit, pa.bool_()))

    return run, "doc_id bigint, text_id binary, kept array<array<bigint>>, anchors array<bigint>"


def last_level(length: int, sizes: list[int]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text_id, kept, text → the hash, last anchor and place of each window of full length that is alive."""
        memo = WordHashes()
        for batch in batches:
            for first, key, kept, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if text_id(text := text.as_py()) != key:
                    continue
                hashed = memo.of(words_of(text))
                at, least = alive_starts(hashed, length, sizes, [np.array(k, np.int64).view(np.uint64) for k in kept])
                columns = [pa.array([key] * len(at), pa.binary()), pa.array(np.full(len(at), first)), *(pa.array(x[at].view(np.int64)) for x in (windows(hashed, length), least)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["text_id", "first_id", "hash", "anchor", "place"])

    return run, "text_id binary, first_id bigint, hash bigint, anchor bigint, place int"


def cut_words(length: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text_id, starts, text → text_id, n_removed, kept (the text's words that are left, joined by one space)."""
        for batch in batches:
            keys, removed, kept = [], [], []
            for key, starts, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if text_id(text := text.as_py()) != key:
                    continue
                words, left, at = words_of(text), [], 0
                for a, b in zip(*spans(np.sort(starts.values.to_numpy()), length)):
                    left += words[at:a]
                    at = b
                left += words[at:]
                keys.append(key)
                removed.append(len(words) - len(left))
                kept.append(" ".join(left))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["text_id", "n_removed", "kept"])

    return run, "text_id binary, n_removed bigint, kept string"


def fetch(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted rows (doc_id and more): only those rows' texts are shuffled, if their number allows it."""
    ids = saved(wanted.select("doc_id").distinct(), "ids")
    some = broadcast_if(ids, ids.count(), BROADCAST_IDS)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(some, "doc_id", "left_semi").join(wanted, "doc_id")


def survivors(each: DataFrame, kept: bool) -> DataFrame:
    """each: doc_id, text_id, anchors (and kept, those of earlier levels).  Texts with anchors that a second document
    has: doc_id, text_id, kept with those anchors appended."""
    flat = each.select("text_id", "doc_id", F.explode("anchors").alias("anchor"))
    again = flat.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor", "n")
    alive = salted_join(flat, saved(again, "again"), "anchor", "text_id").groupBy("text_id", "doc_id").agg(F.collect_list("anchor").alias("anchors"))
    if kept:
        return saved(alive.join(each.select("text_id", "kept"), "text_id").select("doc_id", "text_id", F.concat("kept", F.array("anchors")).alias("kept")), "alive")
    return saved(alive.select("doc_id", "text_id", F.array("anchors").alias("kept")), "alive")


def repeated_windows(documents: DataFrame, length: int = LENGTH, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """documents: doc_id, text.  Returns (rows, starts): rows has doc_id, text_id, n_words, whole and first_id for every
    row, starts has text_id and the places of windows of an earlier document, for the first row of each text."""
    sizes = level_sizes(length, -(-length // 2) if first is None else first)
    run, schema = first_level(length, sizes[0])
    level = saved(documents.select("doc_id", "text").mapInArrow(run, schema), "level1")
    texts = saved(level.groupBy("text_id").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors")), "texts")
    rows = salted_join(level.drop("anchors"), texts.select("text_id", "first_id", "n"), "text_id", "doc_id")
    alive = survivors(texts.where("first_id is not null and size(anchors) > 0").select("text_id", F.col("first_id").alias("doc_id"), "anchors"), False)
    for k in range(1, len(sizes) - 1):
        if alive.isEmpty():
            break
        run, schema = next_level(length, sizes[:k], sizes[k])
        each = fetch(documents, alive).select("doc_id", "text_id", "kept", "text").mapInArrow(run, schema)
        alive = survivors(saved(each.dropDuplicates(["text_id"]), f"level{k + 1}"), True)
    run, schema = last_level(length, sizes[:-1])
    full = saved(fetch(documents, alive).select("doc_id", "text_id", "kept", "text").mapInArrow(run, schema).withColumn("window", F.struct("hash", "anchor")).drop("hash", "anchor"), "full")
    least = full.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("a"), F.max("first_id").alias("b")).where("a < b")
    later = salted_join(full, saved(least.select("window", "n", "a"), "least"), "window", "text_id").where("a < first_id").groupBy("text_id").agg(F.collect_set("place").alias("starts"))
    starts = saved(later.join(alive, "text_id").select("doc_id", "text_id", "starts"), "starts")
    return rows, starts


def remove_repeats(documents: DataFrame, length: int = LENGTH, first: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, whole (digest of all words), kept (words left, joined by one space; null if none is
    removed, or if the row is a later copy, of which nothing is kept unless it is shorter than a window)."""
    rows, starts = repeated_windows(documents, length, first)
    run, schema = cut_words(length)
    cut = saved(fetch(documents, starts).select("text_id", "starts", "text").mapInArrow(run, schema).dropDuplicates(["text_id"]), "cut")
    later = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= length), F.lit(False))
    known = F.col("doc_id").isNotNull()
    done = rows.join(cut, "text_id", "left")
    return done.select(
        "doc_id", "n_words", F.when(later, F.col("n_words")).when(known, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        "whole", F.when(later, F.lit("")).when(known, F.col("kept")).alias("kept"),
    )


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.when(F.col("kept").isNull(), F.col("whole")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
hit AS (SELECT DISTINCT r, i FROM win JOIN low USING (h) WHERE first < doc_id),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY r),
kept AS (SELECT r, len(ps) AS n, sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ')) AS s FROM d JOIN gone USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(s, sha256(array_to_string(w, ' '))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
