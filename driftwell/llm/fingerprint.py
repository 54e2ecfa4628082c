"""Merkle fingerprints of documents, in DataFrame operations only.

The tree: a text is parted into paragraphs (lines), and consecutive paragraphs into sections.  A section ends at an
empty line and after a paragraph whose own digest says so (one in eight), so an edit moves only the section ends near
it.  Paragraph digests are SHA-256 of the whole line, a section's is SHA-256 of its paragraphs' digests, the root's that
of its sections' digests.  Below a paragraph hang all its runs of four words, which
grade how much two differing paragraphs share.

Cases: a null text is the empty text, whose tree is one section of one empty paragraph; equal texts have equal trees;
a text with no words has one phrase and leaf, itself; a paragraph of fewer than four words has one leaf; equal and null doc_ids are ordered by text, null ids after all others in
descending order; repeated rows follow one another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import block_of, cuts_of
from .common import table, text_or_empty

#: A paragraph ends its section if its digest's first hexadecimal digit is one of these.
SECTION_ENDS = ("0", "1")
#: Blocks of consecutive ids at most: their borders are broadcast (24 bytes each).
MAX_BLOCKS = 50_000
LEAF_WORDS = 4


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def paragraph_digests(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.struct(F.sha2(p, 256).alias("digest"), (F.length(p) == 0).alias("empty")))


def section_digests(nodes: Column) -> Column:
    """Digests of runs of paragraphs; nodes: array<struct<digest, empty>>.  The digests are written in one string, with
    a bar after each section's last one, and that string is parted at the bars."""
    ends = F.transform(nodes, lambda n: F.when(n["empty"] | F.substring(n["digest"], 1, 1).isin(*SECTION_ENDS), F.concat(n["digest"], F.lit("|"))).otherwise(n["digest"]))
    return F.transform(F.split(F.array_join(ends, ""), r"\|"), lambda s: F.sha2(s, 256))


def leaves(text: Column) -> Column:
    """Distinct hashes of all runs of four words within a paragraph, however far from its start."""

    # Words become a lambda's variable, else they would be cut out anew for each run.
    worded = F.filter(F.transform(paragraphs(text), lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != "")), lambda words: F.size(words) > 0)
    runs = F.flatten(F.transform(worded, lambda words: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - LEAF_WORDS + 1, F.lit(1))), lambda k: F.xxhash64(F.slice(words, k, LEAF_WORDS)))))
    return F.when(F.size(runs) > 0, F.array_distinct(runs)).otherwise(F.array(F.xxhash64(text)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct values, neither of them empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds <prefix>nodes, <prefix>sections and <prefix>root."""
    df = df.withColumn(f"{prefix}nodes", paragraph_digests(F.col(text)))
    df = df.withColumn(f"{prefix}sections", section_digests(F.col(f"{prefix}nodes")))
    return df.withColumn(f"{prefix}root", F.sha2(F.array_join(f"{prefix}sections", ""), 256))


def differing(a: Column, b: Column) -> Column:
    """Zero-based positions of digests in a that b doesn't have: where edits lie."""
    return F.filter(F.transform(a, lambda x, i: F.when(~F.array_contains(b, x), i)), lambda i: i.isNotNull())


def fingerprints(documents: DataFrame) -> DataFrame:
    """documents: doc_id, text.  One row per row: doc_id, root, sections and paragraphs (arrays of digests), leaves (array of hashes; their
    likeness() is that of the texts)."""
    tree = with_tree(documents.select("doc_id", text_or_empty().alias("text")), "text", "")
    return tree.select("doc_id", "root", "sections", F.transform("nodes", lambda n: n["digest"]).alias("paragraphs"), leaves(F.col("text")).alias("leaves"))


def with_next(documents: DataFrame, per_block: int = 4096) -> DataFrame:
    """Adds next_text, the text of the next row by descending doc_id (after the last: of the first).

    Rows are dealt to blocks of consecutive ids, found by percentiles, and each block is ordered for itself.  Each
    block also gets the first rows of the following one, as ghosts which only serve as successors; so no task holds
    more than a block, and nothing but block borders is ever gathered.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ids = rows.select("doc_id")
    cuts = cuts_of(ids, "doc_id", min(MAX_BLOCKS, max(1, ids.count() // per_block)))
    # Ids descend, so blocks do; rows without an id come after all others.
    rows = rows.withColumn("block", F.coalesce(block_of(F.col("doc_id"), cuts), F.lit(-1)))
    ordered = rows.select("block", "doc_id").groupBy("block").agg(F.max("doc_id").alias("top"))
    edge = ordered.withColumn("to", F.coalesce(F.lag("block", -1).over(Window.orderBy("block")), F.min("block").over(Window.partitionBy(F.lit(0)))))
    # The row after the last of block "to" is the first of this block; blocks descend, so "to" is the next higher one,
    # or the lowest for the highest block, whose first row follows the very last.
    firsts = rows.join(F.broadcast(edge.withColumnRenamed("block", "of")), (F.col("block") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    top = Window.partitionBy("of").orderBy("text")
    ghosts = firsts.withColumn("k", F.row_number().over(top)).where("k = 1").select("doc_id", "text", F.col("to").alias("block"), F.lit(1).alias("ghost"))
    every = rows.select("doc_id", "text", "block", F.lit(0).alias("ghost")).unionByName(ghosts)
    w = Window.partitionBy("block").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return every.withColumn("next_text", F.lead("text").over(w)).where("ghost = 0").select("doc_id", "text", "next_text")


def compare_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text (its last floor(n/2) code points replaced by the next document's
    first as many) and their likeness; also which paragraphs of the text the edit touched."""
    rows = with_next(documents).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(n_chars / 2) as int))"))
    rows = rows.withColumn("edited", F.when(half > 0, edited).otherwise(F.col("text")))
    rows = with_tree(with_tree(rows, "text", ""), "edited", "edited_")
    for name, text in (("p", "text"), ("edited_p", "edited"), ("next_p", "next_text")):
        rows = rows.withColumn(name, leaves(F.col(text)))
    digests = lambda nodes: F.transform(nodes, lambda n: n["digest"])
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
        F.when(F.col("root") == F.col("edited_root"), F.lit(1.0)).otherwise(likeness(F.col("p"), F.col("edited_p"))).alias("near_edited"),
        F.when(F.col("text") == F.col("next_text"), F.lit(1.0)).otherwise(likeness(F.col("p"), F.col("next_p"))).alias("near_next"),
        F.size("sections").cast("long").alias("n_sections"), F.size("nodes").cast("long").alias("n_paragraphs"),
        F.size(differing(digests("nodes"), digests("edited_nodes"))).cast("long").alias("n_differing"),
    )


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, count(*) OVER () AS n FROM documents),
e AS (SELECT a.doc_id, a.text, b.text AS nxt, length(a.text) AS n_chars, left(a.text, CAST(length(a.text) - length(a.text) // 2 AS BIGINT)) || left(b.text, CAST(length(a.text) // 2 AS BIGINT)) AS edited FROM d a JOIN d b ON b.r = a.r % a.n + 1),
x AS (SELECT *, list_transform(string_split(text, chr(10)), lambda p: sha256(p) || CASE WHEN p = '' OR sha256(p)[1] IN ('0', '1') THEN '|' ELSE '' END) AS n1,
    list_transform(string_split(edited, chr(10)), lambda p: sha256(p) || CASE WHEN p = '' OR sha256(p)[1] IN ('0', '1') THEN '|' ELSE '' END) AS n2,
    list_distinct(flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')), lambda w: len(w) > 0), lambda w: list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda k: array_to_string(w[k:k + 3], ' '))))) AS p1,
    list_distinct(flatten(list_transform(list_filter(list_transform(string_split(edited, chr(10)), lambda p: regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')), lambda w: len(w) > 0), lambda w: list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda k: array_to_string(w[k:k + 3], ' '))))) AS p2,
    list_distinct(flatten(list_transform(list_filter(list_transform(string_split(nxt, chr(10)), lambda p: regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')), lambda w: len(w) > 0), lambda w: list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda k: array_to_string(w[k:k + 3], ' '))))) AS p3 FROM e),
y AS (SELECT * EXCLUDE (p1, p2, p3), CASE WHEN len(p1) = 0 THEN [text] ELSE p1 END AS p1, CASE WHEN len(p2) = 0 THEN [edited] ELSE p2 END AS p2, CASE WHEN len(p3) = 0 THEN [nxt] ELSE p3 END AS p3,
    list_transform(string_split(array_to_string(n1, ''), '|'), lambda s: sha256(s)) AS s1, list_transform(string_split(array_to_string(n2, ''), '|'), lambda s: sha256(s)) AS s2 FROM x)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(s1, '')) AS fingerprint, sha256(array_to_string(s2, '')) AS edited_fingerprint,
    CASE WHEN text = edited THEN 1.0::DOUBLE ELSE len(list_intersect(p1, p2))::DOUBLE / (len(p1) + len(p2) - len(list_intersect(p1, p2))) END AS near_edited,
    CASE WHEN text = nxt THEN 1.0::DOUBLE ELSE len(list_intersect(p1, p3))::DOUBLE / (len(p1) + len(p3) - len(list_intersect(p1, p3))) END AS near_next,
    len(s1) AS n_sections, len(n1) AS n_paragraphs, len(list_filter(n1, lambda a: NOT list_contains(n2, a))) AS n_differing FROM y
"""
