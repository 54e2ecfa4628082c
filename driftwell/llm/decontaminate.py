"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``size`` consecutive words of a benchmark item (an item of fewer words is one window).  For exact
containment the necessary prefix of a window, once its words are ordered by rarity in the corpus, is its rarest
word; so only places where a document has that word are looked at.  Each place fixes where the window would have to
lie (positional bound), which must be inside the document (length bound), and then its words are compared exactly.

Cases: null and empty texts have no words and are never hit; an item without words or without an item_id takes no
part; items with equal texts count each by their id; repeated document rows give repeated result rows; empty tables
give no rows or no hits; further columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, saved, table, text_or_empty

#: Everything below U+0080 but digits and letters parts words.
DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows that are broadcast (about 150 bytes each).  Of more, only their rarest words' keys are, up to the second limit;
#: the places of those words, with the words around them, then meet the windows by a shuffle.
BLOCK_WINDOWS, BROADCAST_KEYS = 100_000, 4_000_000


def words(text: Column) -> Column:
    """The words of a text, in their own case."""
    return F.array_remove(F.split(text, DELIMITERS), "")


def key_of(word: Column) -> Column:
    """A join key that is equal for words equal without regard to case; what it finds is compared exactly."""
    return F.xxhash64(F.lower(word))


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """One row per distinct window: ``window`` (its lower-case words joined by a space), ``n`` words, ``items``."""
    low = F.translate(text_or_empty(), UPPER, LOWER)
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(low).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("w"))
    named = cut.select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("n"))
    return named.groupBy("window", "n").agg(F.collect_set("item_id").alias("items"))


def rarest_words(windows: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds to each window the key and offset of the word that the documents have least often."""
    parts = windows.select("window", F.posexplode(F.split("window", " ")).alias("off", "word")).select("window", "off", key_of(F.col("word")).alias("key"))
    vocabulary = saved(parts.select("key").distinct(), "benchmark-words")
    #: The vocabulary has at most size rows of 8 bytes a window; beyond the limit Spark joins by shuffle.
    known = vocabulary if vocabulary.count() > 8 * BLOCK_WINDOWS else F.broadcast(vocabulary)
    seen = documents.select(F.explode(words(text_or_empty())).alias("word")).select(key_of(F.col("word")).alias("key"))
    counts = seen.join(known, "key").groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    ranked = parts.join(counts, "key", "left").select("window", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "key", "off").alias("rank"))
    best = ranked.groupBy("window").agg(F.min("rank").alias("rank"))
    return windows.join(best, "window").select("window", "n", "items", F.col("rank.key").alias("key"), F.col("rank.off").alias("off"))


def find_windows(documents: DataFrame, windows: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """For each (doc_id, text) of documents: how often the row occurs, its words, and all places where a window occurs.

    documents: doc_id, text.  Returns doc_id, text_key, copies, n_words, hits array<struct<start, n, items>>, one row
    per distinct (doc_id, text).  Documents are read once, however many windows there are.
    """
    windows = windows.withColumnRenamed("n", "len")
    #: An empty word ends every document; its key leads to a window of no words, which so gives the document's own row.
    end = windows.sparkSession.range(1).select(F.lit("").alias("window"), F.lit(0).alias("len"), F.array().cast("array<bigint>").alias("items"), key_of(F.lit("")).alias("key"), F.lit(0).alias("off"))
    text = text_or_empty()
    base = documents.select("doc_id", F.sha2(text, 256).alias("text_key"), words(text).alias("w"))
    at = base.select("doc_id", "text_key", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word")).withColumn("key", key_of(F.col("word")))
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_w"))
    if windows.count() <= block_windows:
        place = at.withColumn("n_w", F.size("w")).withColumn("from", F.lit(0)).join(F.broadcast(windows.unionByName(end)), "key")
    else:
        keys = saved(windows.select("key").distinct(), "benchmark-keys")
        reach = saved(windows.agg(F.max("off").alias("before"), F.max("len").alias("len")), "benchmark-reach").first()
        low = F.greatest(F.col("pos") - reach["before"], F.lit(0))
        near = at.where("word <> ''").join(broadcast_if(keys, keys.count(), BROADCAST_KEYS), "key")
        near = near.select("doc_id", "text_key", "pos", "key", F.size("w").alias("n_w"), low.alias("from"), F.slice("w", low + 1, reach["before"] + reach["len"]).alias("w"))
        own = at.where("word = ''").withColumn("n_w", F.size("w")).withColumn("from", F.lit(0)).select("doc_id", "text_key", "pos", "key", "n_w", "from", F.array().cast("array<string>").alias("w"))
        place = near.join(windows, "key").unionByName(own.join(F.broadcast(end), "key"))
    same = F.translate(F.array_join(F.slice("w", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.col("len")), " "), UPPER, LOWER) == F.col("window")
    found = place.where(inside).where(same).select("doc_id", "text_key", "len", start.alias("start"), "items")
    real = F.col("len") > 0
    return found.groupBy("doc_id", "text_key").agg(
        F.count(F.when(~real, 1)).alias("copies"),
        F.max(F.when(~real, F.col("start"))).alias("n_words"),
        F.collect_set(F.when(real, F.struct("start", F.col("len").alias("n"), "items"))).alias("hits"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 8, min_items: int = 2) -> DataFrame:
    """One row per document row: doc_id, text_key (SHA-256 of the text), n_words, hits, n_hit (words inside a hit),
    item_ids (sorted as strings), n_items, contaminated (n_items >= min_items)."""
    windows = saved(rarest_words(benchmark_windows(benchmark, size), documents), "benchmark-windows")
    found = find_windows(documents, windows)
    #: Places by start; each adds what reaches beyond all places before it.
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("s"), (h["start"] + h["n"]).alias("e"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["s"], a["to"]))).alias("n"), F.greatest(a["to"], s["e"]).alias("to")),
    )
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda h: h["items"])), lambda i: i.cast("string"))))
    rows = found.withColumn("n_hit", covered["n"].cast("long")).withColumn("item_ids", items).withColumn("n_items", F.size("item_ids").cast("long"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    return rows.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), "hits", "n_hit", "item_ids", "n_items", (F.col("n_items") >= min_items).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = 8, min_items: int = 1) -> DataFrame:
    """The rows, with all columns, in which windows of fewer than min_items items occur."""
    found = decontaminate(documents, benchmark, size, min_items).where("contaminated")
    bad = saved(found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct(), "contaminated")
    some = broadcast_if(bad, bad.count(), BLOCK_WINDOWS)
    # Rows as structs, so that no column of theirs clashes with one of these.
    packed = documents.select(F.struct("*").alias("row"))
    return packed.join(some, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.sha2(text_or_empty("row.text"), 256) == F.col("key")), "left_anti").select("row.*")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w, row_number() OVER () AS r FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, d.i, d.n, item_id FROM dwin d JOIN win USING (n, win)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
