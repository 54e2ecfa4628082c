"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern (the set of their sources);
only patterns and their total sizes reach the driver.  The flow network has an edge from each pattern to each of its
sources, a capacity of one pattern size for every repetition (at most ``repeats``) at a convex cost (the k-th repetition
costs k), and each source's target as its demand.  The cheapest flow that meets the most demand says how many words of
a pattern go to each source.  Within a pattern the whole repetitions are taken by every document, and the rest by the
documents that come first in a seeded order, until the pattern's flow is reached; so a pattern misses its flow by less
than one document.

The driver holds patterns, not documents, and all of them with all their sources, however many they are; a search for a
path goes over sources, not patterns.  With more than ``max_patterns`` of them their flows go back to the documents by a
shuffle in place of a broadcast.

Cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are never
taken; equal rows stand next to each other in the seeded order; a table without words has targets of 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, saved, table, text_or_empty

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 20260
#: Patterns whose flows are broadcast at most.
MAX_PATTERNS = 4096


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; none above repeats times its size, the excess being shared again by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > repeats * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(repeats * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in over]
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], demands: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """patterns: (sources, size).  Words of each pattern that go to each source: as much of the demands as can be met,
    at least cost, the k-th repetition of a word costing k.  Successive cheapest paths over levels of repetition."""
    flow: list[dict[int, int]] = [{} for _ in patterns]
    need = list(demands)
    used = [0] * len(patterns)
    by_source: dict[int, list[int]] = {}
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            by_source.setdefault(s, []).append(p)
    # Patterns that serve s and could serve t instead, by s and t.
    arcs: dict[int, dict[int, dict[int, None]]] = {s: {} for s in by_source}

    def add(p: int, s: int, amount: int) -> None:
        before = flow[p].get(s, 0)
        flow[p][s] = before + amount
        if (before > 0) == (before + amount > 0):
            return
        for t in patterns[p][0]:
            if t != s:
                if before == 0:
                    arcs[s].setdefault(t, {})[p] = None
                else:
                    del arcs[s][t][p]
                    if not arcs[s][t]:
                        del arcs[s][t]

    for level in range(1, repeats + 1):
        room = [level * size - used[p] for p, (_, size) in enumerate(patterns)]
        # All open edges of a level cost alike, so a cheapest path is a shortest one. First those of one edge: pattern
        # with room → source in need.
        for p, (sources, _) in enumerate(patterns):
            for s in sources:
                if (amount := min(need[s], room[p])) > 0:
                    add(p, s, amount)
                    need[s], room[p], used[p] = need[s] - amount, room[p] - amount, used[p] + amount
        # Then longer ones: pattern with room → source (→ pattern that serves it → other source)* → source in need.
        roomy = {s: [p for p in of if room[p] > 0] for s, of in by_source.items()}
        while any(need):
            for of in roomy.values():
                while of and room[of[-1]] == 0:
                    of.pop()
            came: dict[int, int | None] = {s: None for s, of in roomy.items() if of}
            queue, end = deque(came), None
            while queue and end is None:
                s = queue.popleft()
                for t in arcs[s]:
                    if t not in came:
                        came[t] = s
                        if need[t] > 0:
                            end = t
                            break
                        queue.append(t)
            if end is None:
                break
            path = [end]
            while (before := came[path[-1]]) is not None:
                path.append(before)
            path.reverse()
            first, through = roomy[path[0]][-1], [next(iter(arcs[s][t])) for s, t in zip(path, path[1:])]
            amount = min(need[end], room[first], *(flow[p][s] for p, s in zip(through, path)))
            add(first, path[0], amount)
            for p, s, t in zip(through, path, path[1:]):
                add(p, s, -amount)
                add(p, t, amount)
            need[end], room[first], used[first] = need[end] - amount, room[first] - amount, used[first] + amount
    return flow


def mix(documents: DataFrame, sources: Column | None = None, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """documents: doc_id, text, source (or sources, an array of names).  One row per document: doc_id, text, size,
    pattern (its sources), copies, taken (copies * size).  Sources' targets and sizes: see plan()."""
    rows, _, _ = plan(documents, sources, weights, repeats, seed, max_patterns)
    return rows


def plan(documents: DataFrame, sources: Column | None = None, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with copies and taken, sources with size and target, patterns with flow)."""
    spark = documents.sparkSession
    names = F.array("source") if sources is None else F.array_sort(F.array_distinct(sources))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("-")), text_or_empty()))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), n_words(text_or_empty()).alias("size"), F.transform(names, lambda s: s.cast("string")).alias("pattern"), order.alias("h"))
    rows = saved(rows.withColumn("part", F.substring("h", 1, 3)), "sizes")
    grouped = rows.groupBy("pattern").agg(F.sum("size").alias("size")).orderBy("pattern").collect()
    # Code points order as UTF-8 does; Python compares strings by code point. Nulls come last.
    known = sorted({s for r in grouped for s in r["pattern"]}, key=lambda s: (s is None, s or ""))
    number = {s: k for k, s in enumerate(known)}
    sizes = [0] * len(known)
    for r in grouped:
        for s in r["pattern"]:
            sizes[number[s]] += r["size"]
    by_weight = [weights[k % len(weights)] for k in range(len(known))]
    wanted = targets(sizes, by_weight, repeats)
    demands = [int(t) for t in wanted]
    flows = min_cost_flow([(tuple(number[s] for s in r["pattern"]), r["size"]) for r in grouped], demands, repeats)
    quotas = [(r["pattern"], r["size"], sum(f.values())) for r, f in zip(grouped, flows)]
    quota = spark.createDataFrame(quotas, "pattern array<string>, pattern_size bigint, flow bigint")
    listed = spark.createDataFrame(list(zip(known, sizes, wanted)), "source string, source_size bigint, target double")
    # Everyone takes whole repetitions; the rest goes by seeded order. Of its 4,096 parts (three hexadecimal digits) the
    # first are taken as a whole, until it ends within one part of a pattern, which is small.
    quota = quota.withColumn("base", F.when(F.col("pattern_size") > 0, F.floor(F.col("flow") / F.col("pattern_size"))).otherwise(0).cast("long"))
    quota = quota.withColumn("rest", F.col("flow") - F.col("base") * F.col("pattern_size"))
    parts = rows.groupBy("pattern", "part").agg(F.sum("size").alias("part_size"))
    w = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(w), F.lit(0))).join(broadcast_if(quota, len(quotas), max_patterns), "pattern")
    parts = parts.select("pattern", "part", "base", "before", "rest", "part_size")
    placed = rows.join(parts, ["pattern", "part"])
    inside = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("part_size") > F.col("rest"))
    whole = placed.where(~inside).select("doc_id", "size", "pattern", (F.col("base") + F.when(F.col("before") + F.col("part_size") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    v = Window.partitionBy("pattern", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = placed.where(inside).withColumn("run", F.col("before") + F.coalesce(F.sum("size").over(v), F.lit(0)))
    # The document over which the quota ends is taken if that comes nearer to it.
    split = split.select("doc_id", "size", "pattern", (F.col("base") + F.when(F.col("run") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    out = whole.unionByName(split).withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")), listed, quota


def op5_mix(spark, sf_dir: str) -> DataFrame:
    rows, sources, _ = plan(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("source", F.col("pattern")[0])
    named = broadcast_if(sources.withColumnRenamed("source", "name"), sources.count(), MAX_PATTERNS)
    return rows.join(named, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('20260|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM d GROUP BY source),
l AS (SELECT list(source_size ORDER BY k) AS ss, list([5e0, 2e0, 1e0][(k - 1) % 3 + 1] ORDER BY k) AS ws FROM s),
r AS (SELECT 0 AS step, CAST(list_sum(ss) AS DOUBLE) AS lft, CAST(range(1, len(ss) + 1) AS BIGINT[]) AS opn, list_transform(ss, lambda x: 0e0) AS outs FROM l
    UNION ALL SELECT step + 1, CASE WHEN len(ov) > 0 THEN lft - list_sum(list_transform(ov, lambda i: 3e0 * ss[i])) ELSE 0e0 END, CASE WHEN len(ov) > 0 THEN list_filter(opn, lambda i: NOT list_contains(ov, i)) ELSE []::BIGINT[] END,
        list_transform(CAST(range(1, len(ss) + 1) AS BIGINT[]), lambda i: CASE WHEN list_contains(ov, i) THEN 3e0 * ss[i] WHEN len(ov) = 0 AND list_contains(opn, i) THEN lft * ws[i] / tot ELSE outs[i] END)
    FROM (SELECT r.*, ss, ws, list_sum(list_transform(opn, lambda i: ws[i])) AS tot, list_filter(opn, lambda i: lft * ws[i] / list_sum(list_transform(opn, lambda j: ws[j])) > 3e0 * ss[i]) AS ov FROM r, l WHERE len(opn) > 0)),
t AS (SELECT source, source_size, (SELECT outs FROM r ORDER BY step DESC LIMIT 1)[k] AS target FROM s),
q AS (SELECT *, least(CAST(floor(target) AS BIGINT), 3 * source_size) AS flow FROM t),
p AS (SELECT d.doc_id, d.size, source_size, target, CASE WHEN source_size > 0 THEN flow // source_size ELSE 0 END AS base, CASE WHEN source_size > 0 THEN flow % source_size ELSE 0 END AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN size > 0 THEN (base + (run + size / 2e0 <= rest)::INTEGER) * size ELSE 0 END AS BIGINT) AS taken FROM p
"""
