from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, duck, rows_of
from pyspark.sql import functions as F

from driftwell.llm import anchors, components, decontaminate, fingerprint, mixing, neardup, registry, revisits, runindex, substrings, textwords, tokencount, toolcalls, toxicity
from driftwell.llm.common import table

from .conftest import clashing, edge_documents, prose


@pytest.mark.parametrize("where", ["small", "edge", "nothing"])
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(same, request, name, where):
    same(registry.QUERIES[name], registry.SQL[name], SMALL if where == "small" else request.getfixturevalue(where))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_and_edge_run(spark, edge, nothing, name):
    query = registry.QUERIES[name]
    assert query(spark, nothing).count() == 0
    assert query(spark, edge).count() > 0


def by_id(df, *names):
    return rows_of(df.toPandas(), list(names))


def test_clashing_columns(spark, edge):
    docs = table(spark, edge, "documents")
    wide = clashing(docs)
    bench = table(spark, edge, "benchmark")
    pairs = [
        (lambda d: fingerprint.compare_edits(d), ("doc_id", "fingerprint", "near_next")),
        (lambda d: neardup.near_duplicates(d), ("doc_id", "class_id")),
        (lambda d: mixing.mix(d), ("doc_id", "size", "taken")),
        (lambda d: substrings.remove_repeats(d), ("doc_id", "n_removed")),
        (lambda d: decontaminate.decontaminate(d, clashing(bench)), ("doc_id", "n_hit")),
        (lambda d: runindex.remove_matches(d), ("doc_id", "kept_sha256")),
        (lambda d: tokencount.count_tokens(d, tokencount.vocabulary("word_bpe_49k.json")), ("doc_id", "n_tokens")),
    ]
    for run, names in pairs:
        assert by_id(run(wide), *names) == by_id(run(docs), *names)
    assert set(neardup.keep_first(wide).columns) == set(wide.columns) == set(runindex.cut_documents(wide).columns)
    assert decontaminate.drop_contaminated(wide, bench).columns == wide.columns
    for cut in (neardup.keep_first, runindex.cut_documents, lambda d: decontaminate.drop_contaminated(d, bench)):
        assert sorted(map(repr, cut(wide).select(docs.columns).collect())) == sorted(map(repr, cut(docs).collect()))
    extra = {c: F.lit("clash") for c in ("url_key", "answer", "tie", "part", "source", "outcome", "conv_key", "level", "wrong", "result_turn", "lacks")}
    records = revisits.archive(table(spark, edge, "pages"))
    assert by_id(revisits.resolve(records.withColumns(extra)), "record_id", "outcome", "source_id") == by_id(revisits.resolve(records), "record_id", "outcome", "source_id")
    calls, results = toolcalls.calls_of(table(spark, edge, "conversations"))
    link = lambda c, r: by_id(toolcalls.link(c, r, toolcalls.SCHEMAS), "conv_id", "turn", "status", "json")
    assert link(calls.withColumns(extra), results.withColumns(extra)) == link(calls, results)


# ---- shared parts ----------------------------------------------------------------------------------------------------
def test_windows_and_anchors():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 6, 400).astype(np.uint64)
    for size in (1, 2, 3, 5, 8, 13, 50):
        got = textwords.windows(h, size)
        want = [tuple(h[k : k + size]) for k in range(len(h) - size + 1)]
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))
        assert anchors.sliding_min(h, size).tolist() == [min(h[k : k + size]) for k in range(len(h) - size + 1)]
    data = rng.integers(0, 3, 300).astype(np.uint8)
    runs = anchors.run_hashes(data, 7)
    assert len(set(zip(runs.tolist(), [data[k : k + 7].tobytes() for k in range(294)]))) == len({data[k : k + 7].tobytes() for k in range(294)})
    least, places = anchors.anchors(runs, 9)
    assert set(least.tolist()) == set(places.tolist())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(5, 5)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            label[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label}


# ---- 1 ---------------------------------------------------------------------------------------------------------------
def test_merkle_locates_edits(spark):
    text = "\n".join(f"paragraph {k} has some words of its own number {k * k}" for k in range(40))
    other = text.replace("paragraph 20 has", "paragraph 20 had")
    rows = fingerprint.fingerprints(spark.createDataFrame([(1, text), (2, other), (3, text)], "doc_id long, text string")).orderBy("doc_id").collect()
    a, b, c = rows
    assert a["root"] == c["root"] != b["root"]
    assert [k for k, (x, y) in enumerate(zip(a["paragraphs"], b["paragraphs"])) if x != y] == [20]
    assert 0 < len(set(a["sections"]) - set(b["sections"])) < len(a["sections"])


def test_one_inserted_word_keeps_likeness(spark):
    rng = random.Random(4)
    text = "\n".join(prose(rng, n) for n in (103, 2, 60))
    put_in = ["x " + text, "\n".join("x " + p for p in text.split("\n")), text.replace(" ", " x ", 1), prose(rng, 165)]
    rows = fingerprint.fingerprints(spark.createDataFrame(list(enumerate([text, *put_in, None, " \n"])), "doc_id int, text string"))
    of = {r["doc_id"]: set(r["leaves"]) for r in rows.collect()}
    like = [len(of[0] & of[k]) / len(of[0] | of[k]) for k in range(1, 5)]
    assert min(like[:3]) > 0.94 and like[3] == 0 and len(of[0]) == 100 + 1 + 57 and len(of[5]) == len(of[6]) == 1
    pair = spark.createDataFrame([(2, text), (1, put_in[1])], "doc_id int, text string")
    assert {r["doc_id"]: r["near_next"] for r in fingerprint.compare_edits(pair).collect()} == {1: like[1], 2: like[1]}


def test_next_in_many_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3000), f"t{rng.randrange(50)}") for _ in range(900)] + [(None, "n1"), (None, "n0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(((*r, ordered[(k + 1) % len(ordered)][1]) for k, r in enumerate(ordered)), key=repr)
    for per_block in (10, 100, 5000):
        assert sorted(map(tuple, fingerprint.with_next(df, per_block).collect()), key=repr) == want


# ---- 2 ---------------------------------------------------------------------------------------------------------------
def test_revisits(spark):
    m = {"A": "2", "Content-Length": "5"}
    rows = [
        (1, "http://x.org/p", "response", 10, 200, '"e"', None, "d1", m),
        (2, "http://x.org/p", "response", 20, 200, None, "mon", "d2", m),
        (3, "https://www.x.org/p/", "revisit", 15, 304, 'W/"e"', None, None, {"A": "9", "content-length": "0"}),
        (4, "http://x.org/p", "revisit", 10, 304, '"e"', None, None, None),
        (5, "http://x.org/p", "revisit", 25, 304, '"e"', "mon", None, None),
        (6, "http://x.org/p", "revisit", 26, 304, None, "tue", None, None),
        (7, "http://x.org/p", "revisit", 27, 304, None, None, None, None),
        (8, "http://x.org/p", "revisit", 28, 304, None, None, "d2", None),
        (9, None, "revisit", 28, 304, None, None, None, None),
        (9, None, "revisit", 28, 304, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, kind string, at long, status int, etag string, last_modified string, digest string, headers map<string,string>")
    for hot in (1, 1000):
        got = revisits.resolve(df, hot).orderBy("record_id").collect()
        assert [(r["record_id"], r["outcome"], r["source_id"]) for r in got] == [(3, "resolved", 1), (4, "no_earlier_response", None), (5, "resolved", 2), (6, "validator_mismatch", None), (7, "no_validator", None), (8, "resolved", 2), (9, "bad_record", None), (9, "bad_record", None)]
        assert got[0]["headers"] == {"a": "9", "content-length": "5"} and got[2]["headers"] == {"a": "2", "content-length": "5"}


def test_only_full_responses_are_sources(spark):
    """Parts, redirects and server errors aren't; of equal times and ids the largest validators count, in any order of rows."""
    schema = "record_id long, url string, kind string, at long, status int, etag string, last_modified string, digest string, headers map<string,string>"
    row = lambda i, kind, at, status, etag: (i, "http://x.example/a", kind, at, status, etag, None, None, {"k": etag or "-"})
    rows = [row(1, "response", 1, 200, "a"), row(2, "response", 2, 206, "b"), row(3, "response", 3, 503, "b"), row(4, "response", 4, 302, "b"), row(5, "request", 5, 200, "b"), row(6, None, 5, 200, "b"), row(7, "revisit", 9, 304, "a")]
    rows += [row(10, "response", 20, None, "y"), row(10, "response", 20, 203, "z"), row(11, "revisit", 21, 304, "z")]
    for order in (rows, rows[::-1]):
        for hot in (100, 1):
            got = {r["record_id"]: (r["outcome"], r["source_id"], r["status"]) for r in revisits.resolve(spark.createDataFrame(order, schema), hot).collect()}
            assert got == {7: ("resolved", 1, 200), 11: ("resolved", 10, 203)}


# ---- 3 ---------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="session")
def toxic_corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(1200):
        words = prose(rng, rng.randrange(40, 120), 600).split()
        bad = k % 10 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zorkish", "zorkling", "zorkful", "blegh", "zorkness"]) if k % 20 else "zork" + rng.choice("abcdefgh") + rng.choice("aeiou")
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_held_out(spark, toxic_corpus):
    docs, labels, truth = toxic_corpus
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    held = [k for k in truth if k % 3 == 1]
    assert sum((got[k] >= 0.7) == truth[k] for k in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    assert model.scores([None, "", "zorkish zorkling you zorkful"])[2] > 0.9
    kept = toxicity.reject(clashing(docs), model)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, s in got.items() if s < 0.7}


def test_kneser_ney_by_hand(spark):
    """Counts against plain dictionaries of strings (few enough that no slots meet)."""
    docs = spark.createDataFrame([(1, "ab abc"), (2, "abd b"), (3, "abc"), (4, "q ab")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.gather(docs, labels)
    words = {1: Counter(["ab", "abc"]), 0: Counter(["abd", "b", "abc"])}
    shared = Counter()
    n = toxicity.ORDER
    pad = lambda w: "\x01" + w + "\x02"
    for w in {"ab", "abc", "abd", "b", "q"}:
        s = pad(w)
        for k in range(1, len(s)):
            for o in range(1, n):
                shared[s[max(0, k - o + 1) : k + 1], o] += 1

    def lower(s, k):
        p = 1 / 256
        for o in range(1, n):
            a = max(0, k - o + 1)
            gram, head = s[a : k + 1], s[a:k]
            peers = {g: c for (g, oo), c in shared.items() if oo == o and g[:-1] == head and (g[0] == "\x01") == (gram[0] == "\x01") and len(g) == len(gram)}
            total = sum(peers.values())
            if total:
                p = (max(peers.get(gram, 0) - 0.75, 0) + 0.75 * len(peers) * p) / total
        return p

    sizes = {c: sum(v * (len(w) + 1) for w, v in words[c].items()) for c in words}
    weight = {c: min(sizes.values()) / sizes[c] for c in words}

    def word(w, c):
        s, out = pad(w), 0.0
        for k in range(1, len(s)):
            a = max(0, k - n + 1)
            head, seen = s[a:k], Counter()
            for v, times in words[c].items():
                t = pad(v)
                for j in range(1, len(t)):
                    b = max(0, j - n + 1)
                    if t[b:j] == head:
                        seen[t[j]] += times
            total = sum(seen.values())
            freed = min(0.75 * len(seen), total)
            out += np.log((max(seen[s[k]] - 0.75, 0) * weight[c] + (2.0 + freed * weight[c]) * lower(s, k)) / (total * weight[c] + 2.0))
        return out

    some = ["ab", "abc", "abd", "b", "q", "abcd"]
    assert np.allclose(model.differences(some), [word(w, 1) - word(w, 0) for w in some], atol=1e-5)


def test_score_by_brute_force(spark, toxic_corpus):
    """Figures word by word, and the curve as the least of its loss."""
    docs, labels = toxic_corpus[0], toxic_corpus[1]
    model = toxicity.train(docs, labels)
    weights, bias, mean, scale = model.curve

    known_words = {}

    def figures(text, own=None):
        words = textwords.tokens(text)
        if not words:
            return [0.0] * 6
        for w in words:
            if (w, own) not in known_words:
                known_words[w, own] = float(model.differences([w], own)[0])
        d = [known_words[w, own] for w in words]
        passages = [sum(d[k : k + 16]) / 16 for k in range(len(d) - 15)] if len(d) > 16 else [sum(d) / len(d)]
        top = sorted(set(d), reverse=True)
        top += [min(top[-1], 0.0)] * 2
        return [sum(d) / len(d), max(passages), top[1], top[2], math.log(1 + sum(max(x - 1.5, 0) for x in d)), math.log(len(d))]

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    for k in list(texts)[:60]:
        z = (np.array(figures(texts[k])) - mean) / scale
        assert abs(got[k] - 1 / (1 + np.exp(-np.clip(bias + z @ weights, -500, 500)))) < 1e-5
    known = {r["doc_id"]: r["toxic"] for r in labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect() if r["doc_id"] in texts and r["toxic"] is not None}
    x, y = np.array([figures(texts[k], c) for k, c in known.items()]), np.array(list(known.values()))
    assert np.allclose(mean, x.mean(0), atol=1e-5) and np.allclose(scale, np.maximum(x.std(0), 1e-6), atol=1e-5)
    z, w = (x - mean) / scale, np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    miss = w * (y - 1 / (1 + np.exp(-(bias + z @ weights))))
    assert abs(miss.sum()) < 1e-5 and np.allclose(z.T @ miss, 1e-3 * weights, atol=1e-5)


def test_counts_are_of_one_ngram_each(spark):
    """More n-grams than 18 bits tell apart: as many counts as n-grams, with each its own."""
    rng = random.Random(6)
    words = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(30_000)}
    model = toxicity.gather(spark.createDataFrame([(1, " ".join(sorted(words)))], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    want = Counter(s[max(0, k - 5) : k + 1] for w in words for s in [f"\x01{w}\x02"] for k in range(1, len(s)))
    assert model.sizes[toxicity.KINDS[-1]] == len(want) > 2**18
    some = sorted(words)[:500]
    grams, _ = toxicity.ngrams(some)
    got = model.tables[toxicity.KINDS[-1]][0].of(toxicity.key(grams[-1], toxicity.ORDER - 1))[0]
    assert got.tolist() == [want[s[max(0, k - 5) : k + 1]] for w in some for s in [f"\x01{w}\x02"] for k in range(1, len(s))]


def test_toxicity_by_joins_as_by_broadcast(spark, toxic_corpus):
    docs, labels, _ = toxic_corpus
    docs = docs.limit(150).unionByName(spark.createDataFrame([(None, "zorkish"), (7000, None), (7001, ""), (7001, "unseen wörds")], docs.schema))
    some = labels.where("doc_id % 3 <> 1")
    few, many = toxicity.train(docs, some), toxicity.train(docs, some, max_grams=0)
    assert few.tables is not None and many.tables is None
    of = lambda model: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.scores(docs, model).collect()))
    a, b = of(few), of(many)
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-4) and len({x[2] for x in a}) > 100
    texts = ["zorkish you", None, "another"]
    assert np.allclose(few.scores(texts), many.scores(texts), atol=1e-4)
    assert toxicity.reject(clashing(docs), many).count() == sum(x[2] < 0.7 for x in b)


def test_toxicity_without_labels(spark, toxic_corpus):
    docs, labels, _ = toxic_corpus
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert set(model.scores(["a", None]).tolist()) == {0.0}


def test_labels_of_the_held_out_third_do_not_matter(spark, edge, tmp_path):
    a = by_id(toxicity.op3_toxicity(spark, edge), "doc_id", "held_out", "score", "predicted")
    for name in ("documents", "benchmark"):
        table(spark, edge, name).write.parquet(f"{tmp_path}/{name}.parquet")
    labels = table(spark, edge, "labels").withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    b = by_id(toxicity.op3_toxicity(spark, str(tmp_path)), "doc_id", "held_out", "score", "predicted")
    assert a == b


# ---- 4 ---------------------------------------------------------------------------------------------------------------
def classes_by_brute_force(rows):
    sets = {k: neardup.weighted(textwords.WordHashes().of(textwords.tokens(t))) if textwords.tokens(t) else None for k, (_, t) in enumerate(rows)}
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] is not None and sets[b] is not None and find(a) != find(b) and neardup.similarity(sets[a], sets[b]) >= 0.8:
            label[find(b)] = find(a)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    return [(rows[k][0], min((x for x in members[find(k)] if x is not None), default=None)) for k in range(len(rows))]


def near_corpus():
    rng = random.Random(5)
    rows = []
    for family in range(12):
        words = prose(rng, rng.randrange(30, 250)).split()
        for _ in range(rng.randrange(1, 12)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(copy) // 22))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                words = copy  # chains: neighbours are alike, ends needn't be
    return rows


@pytest.mark.parametrize("corpus", ["families", "edge"])
def test_near_duplicates_by_brute_force(spark, corpus):
    rows = near_corpus() if corpus == "families" else [(r[0], r[1]) for r in edge_documents()]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == sorted(classes_by_brute_force(rows), key=repr)


def test_repeated_lines_hide_no_copy(spark):
    """Pairs whose distinct shingles agree, but not their weights: found by the signatures without weights."""
    rng, rows = random.Random(8), []
    for k in range(60):
        words = prose(rng, 90).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[10:40] * 40))]
    sets = [neardup.weighted(textwords.WordHashes().of(textwords.tokens(t))) for _, t in rows[:2]]
    signed = neardup.probminhash(sets)
    assert (signed[0] == signed[1]).mean() < neardup.THRESHOLD - neardup.MARGIN and neardup.similarity(*sets) > 0.9
    heavy, plain = neardup.unweighted(sets, signed)
    assert heavy.tolist() == [1] and (plain[0] == plain[1]).mean() > 0.85 and (plain[0] == signed[0]).all()
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k in range(120)}


def test_all_links_without_leaders(spark, monkeypatch):
    """Blocks alone (small ones) find what leaders miss."""
    monkeypatch.setattr(neardup, "PROBES", 2)
    monkeypatch.setattr(neardup, "TARGETS", 3)
    rows = near_corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted(classes_by_brute_force(rows))


def test_probminhash_estimates():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        n = 200
        common = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        make = lambda: np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common)).astype(np.uint64)]))
        a, b = make(), make()
        wa, wb = (1 + np.log(1 + (x % np.uint64(4)).astype(float)) for x in (a, b))
        s = neardup.probminhash([(a, wa), (b, wb)], 1536)
        inter, x, y = np.intersect1d(a, b), dict(zip(a, wa)), dict(zip(b, wb))
        union = set(x) | set(y)
        exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in union) for i in inter)
        assert abs((s[0] == s[1]).mean() - exact) < 0.06
        assert abs(neardup.similarity((a, wa), (b, wb)) - max(exact, len(inter) / len(union))) < 1e-9
    one = neardup.probminhash([(np.array([7], np.uint64), np.array([2.0]))])
    assert (one == 7).all()


def test_keep_first(spark):
    rows = edge_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = neardup.keep_first(df).collect()
    by_class = Counter(c for _, c in classes_by_brute_force([(r[0], r[1]) for r in rows]))
    assert len({(r["doc_id"], r["text"]) for r in kept}) == len(kept) or all(not textwords.tokens(r["text"]) for r in kept if kept.count(r) > 1)
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} >= {c for c in by_class if c is not None}


# ---- 5 ---------------------------------------------------------------------------------------------------------------
def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 1]) == [0.0, 0.0]
    # Each round's excess is shared again, until none is above its limit.
    assert mixing.targets([1, 2, 97], [5, 2, 1]) == [3.0, 6.0, 91.0]


def test_min_cost_flow():
    # One pattern in both sources, one in each; the shared one must go where it is needed.
    flow = mixing.min_cost_flow([((0,), 10), ((0, 1), 10), ((1,), 2)], [10, 12])
    assert [sum(f.values()) for f in flow] == [10, 10, 2] and flow[1].get(0, 0) == 0
    # Repetitions are spread evenly before any third one is used.
    flow = mixing.min_cost_flow([((0,), 10), ((0, 1), 10), ((1,), 10)], [30, 10])
    assert [sum(f.values()) for f in flow] in ([20, 10, 10], [10, 20, 10], [20, 12, 8]) or sum(max(0, sum(f.values()) - 10) for f in flow) == 10
    assert sum(sum(f.values()) for f in mixing.min_cost_flow([((0,), 5)], [100])) == 15


def test_mix_is_seeded_and_near(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, sources, _ = mixing.plan(df)
    got = out.collect()
    assert by_id(mixing.mix(df.repartition(5)), "doc_id", "taken") == by_id(out, "doc_id", "taken")
    for s in sources.collect():
        taken = sum(r["taken"] for r in got if r["pattern"][0] == s["source"])
        assert abs(taken - s["target"]) <= 60 and s["target"] <= 3 * s["source_size"]
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got) and len(got) == 1500


def test_mix_overlapping(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, 20), [["a"], ["b"], ["a", "b"], ["c", "a"]][k % 4]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    for most in (2, 100):
        out, sources, quota = mixing.plan(df, F.col("sources"), max_patterns=most)
        assert out.count() == 400 and abs(out.agg(F.sum("taken")).first()[0] - quota.agg(F.sum("flow")).first()[0]) <= 20 * 4


def test_mix_keeps_all_memberships(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 20), [["a"], ["b"], ["a", "b"], ["c", "a"]][k % 4]) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    (few, listed, _), (many, as_listed, _) = (mixing.plan(df, F.col("sources"), max_patterns=most) for most in (2, 100))
    assert by_id(few, "doc_id", "pattern", "taken") == by_id(many, "doc_id", "pattern", "taken")
    assert {r["source"] for r in listed.collect()} == {r["source"] for r in as_listed.collect()} == {"a", "b", "c"}


def test_flow_over_many_patterns():
    rng = random.Random(3)
    patterns = [(tuple(s for s in range(13) if mask >> s & 1), rng.randrange(1, 50)) for mask in range(1, 2**13)]
    demands = [rng.randrange(1, 20_000) for _ in range(13)]
    flow = mixing.min_cost_flow(patterns, demands)
    assert [sum(f.get(s, 0) for f in flow) for s in range(13)] == demands
    assert all(set(f) <= set(of) and min(f.values(), default=0) >= 0 and sum(f.values()) <= size for f, (of, size) in zip(flow, patterns))


# ---- 6 ---------------------------------------------------------------------------------------------------------------
def test_substrings_keeps_words(spark):
    rng = random.Random(9)
    passage = prose(rng, 70)
    rows = [(5, f"a {passage} b"), (3, f"c {passage} d"), (9, passage), (7, prose(rng, 49))]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5]["kept"] == "a b" and got[9]["kept"] == "" and got[3]["kept"] is None and got[7]["n_removed"] == 0


def test_windows_carry_their_anchors():
    text = prose(random.Random(5), 80)
    run, schema = substrings.last_level(50, [25])
    hashed = textwords.WordHashes().of(substrings.words_of(text))
    want = substrings.sliding_min(substrings.windows(hashed, 25), 26).view(np.int64)
    batch = pa.RecordBatch.from_pydict({"doc_id": [2], "text_id": [substrings.text_id(text)], "kept": [[want.tolist()]], "text": [text]})
    got = next(run(iter([batch])))
    assert got["anchor"].to_pylist() == want.tolist() and len(want) == 31 and "anchor bigint" in schema


def removed_words(rows, length):
    words = [(i, substrings.words_of(t)) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            least[x] = min(i, least.get(x, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("first", [None, 1, 2, 3, 100])
def test_levels_change_nothing(spark, first, monkeypatch):
    """However many levels, and with hot keys spread, the result is that of brute force."""
    monkeypatch.setattr("driftwell.llm.common.HOT_ROWS", 3)
    rng = random.Random(21)
    shared = rng.choices("abcd", k=40)
    rows = [(k, " ".join(rng.choices("abcde", k=rng.randrange(12)) + shared[rng.randrange(25) :][: rng.randrange(15)] + rng.choices("abc", k=rng.randrange(9)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(df, 9, first).collect()
    want = {i: (n, gone, kept) for i, n, gone, kept in removed_words(rows, 9)}
    assert sum(gone for _, gone, _ in want.values()) > 50
    for r in got:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (n, gone) and (gone == 0 or r["kept"] == kept)


def test_survivors_of_levels(spark, monkeypatch):
    """Half-length repeats live on level 1 only; each level looks at what the one before left, and stops without any."""
    assert substrings.level_sizes(50, 25) == [25, 50] and substrings.level_sizes(50, 12) == [13, 25, 50] and substrings.level_sizes(50, 1)[0] == 1
    rng = random.Random(3)
    half, most, whole = ([f"{c}{k}" for k in range(n)] for c, n in (("h", 14), ("m", 26), ("w", 60)))
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(2 * k + j, " ".join(fill(60) + part + fill(60))) for k, part in enumerate((half, most, whole)) for j in (0, 1)]
    seen = []
    real = substrings.survivors

    def spy(each, kept):
        out = real(each, kept)
        seen.append({r["doc_id"] for r in out.collect()})
        return out

    monkeypatch.setattr(substrings, "survivors", spy)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, 13).collect()}
    assert {4, 5} <= seen[1] <= seen[0] and got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 60}
    seen.clear()
    substrings.remove_repeats(spark.createDataFrame([(k, " ".join(fill(80))) for k in range(4)], "doc_id long, text string"), 50, 13).collect()
    assert seen == [set()]


# ---- 7 ---------------------------------------------------------------------------------------------------------------
def test_tokens_as_the_library(spark, edge):
    from tokenizers import Tokenizer

    path = tokencount.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, edge, "documents").collect()]
    want = sorted(((i, len(library.encode(t or "", add_special_tokens=False))) for i, t in rows), key=repr)
    df = table(spark, edge, "documents")
    for chunk, overlap in ((32_768, 512), (120, 8), (50, 1)):
        got = tokencount.count_tokens(df, path, chunk=chunk, overlap=overlap).collect()
        assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == want
    slow = tokencount.WordCounter(path)
    slow.by_words = False
    for i, t in rows:
        if t:
            assert tokencount.count_in_chunks(t, slow.pieces, 100, 4) == len(library.encode(t, add_special_tokens=False))


def test_simple_characters_are_simple():
    from tokenizers import Tokenizer

    path = tokencount.vocabulary("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), tokencount.WordCounter(path)
    chars = [chr(c) for c in range(1, 0x250) if tokencount.SIMPLE.fullmatch(chr(c))]
    rng = random.Random(6)
    texts = ["".join(rng.choices(chars, k=80)) for _ in range(400)] + ["".join(rng.choices("a' strevmld019\n", k=60)) for _ in range(200)]
    assert all(counter.simple(t) for t in texts)
    assert [counter.whole(t) for t in texts] == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


# ---- 8 ---------------------------------------------------------------------------------------------------------------
def test_blocks_of_windows(spark, edge):
    docs, bench = table(spark, edge, "documents"), table(spark, edge, "benchmark")
    w = decontaminate.rarest_words(decontaminate.benchmark_windows(bench, 8), docs).cache()
    pick = lambda df: sorted(((r["doc_id"], r["n_words"], r["copies"], sorted((h["start"], h["n"]) for h in r["hits"])) for r in df.collect()), key=repr)
    assert pick(decontaminate.find_windows(docs, w, 7)) == pick(decontaminate.find_windows(docs, w))


# ---- 9 ---------------------------------------------------------------------------------------------------------------
def test_only_strings_alike_are_indexed(monkeypatch):
    """Strings that no other can equal don't reach the index; marks are at their places in the whole context."""
    unit, indexed = runindex.Unit("bytes", 8, 4, False), []
    real = runindex.joined
    monkeypatch.setattr(runindex, "joined", lambda contexts: indexed.append([c.tobytes() for c in contexts]) or real(contexts))
    rows = [(1, b"a", b"0123abcdefghijkl4567", False), (1, b"b", b"98abcdefghijklmn", False), (1, b"c", b"abcdefgXhijklmnopqr", False)]
    rows += [(2, b"d", b"ABCDEFGHIJKLMNOP", True), (2, b"e", b"ABCDEFGHIJ", True), (3, b"f", b"zyxwvutsrq", False), (3, b"g", b"zyxwvutXrq", False)]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.bool_()))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.binary())], ["anchor", "same", "context", "twice", "owner"])
    run, _ = runindex.mark(unit)
    found = {r["same"]: (r["lo"], r["hi"]) for b in run(iter([batch])) for r in b.to_pylist()}
    assert found == {b"a": ([4], [9]), b"b": ([2], [7])}
    assert indexed == [[b"abcdefghijkl", b"abcdefghijkl"]]


def test_suffix_array_and_statistics():
    rng = random.Random(3)
    for trial in range(60):
        contexts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 5))]
        if trial % 3 == 0:
            contexts = [c * 3 for c in contexts] + contexts
        symbols, starts = runindex.joined([np.frombuffer(c, np.uint8) for c in contexts])
        s = symbols.tolist()
        assert runindex.suffix_array(symbols).tolist() == sorted(range(len(s)), key=lambda k: s[k:])

        def agree(i, j, s=s):
            k = 0
            while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            return k

        best, runs = runindex.matching_statistics(symbols)
        assert best.tolist() == [max([agree(i, j) for j in range(len(s)) if j != i], default=0) for i in range(len(s))]
        assert runs <= len(s)
        # With owners: only what another owner has over the length counts.
        of = [rng.randrange(3) for _ in contexts]
        owner = np.repeat([of], np.diff(np.append(starts, len(s))), axis=1)
        length = rng.randint(1, 6)
        best, _ = runindex.matching_statistics(symbols, owner, length)
        own = owner[0].tolist()
        assert (best >= length).tolist() == [any(agree(i, j) >= length and own[i] != own[j] for j in range(len(s)) if j != i) for i in range(len(s))]


@pytest.mark.parametrize("hot", [1, 200, 1 << 19])
def test_matches_by_brute_force(spark, hot):
    rng = random.Random(7)
    shared = "".join(rng.choices("abé", k=40))
    rows = [(k, "".join(rng.choices("abé", k=rng.randrange(10))) + shared[rng.randrange(9) : 30 + rng.randrange(10)] + "".join(rng.choices("abcé", k=25))) for k in range(25)]
    rows += [(50, "ab" * 40), (51, "abcd" * 3), (None, shared), (52, None)]
    length = 20
    got = runindex.remove_matches(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), runindex.Unit("bytes", length, 6, False), hot).collect()
    data = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == sorted(want, key=repr)


def shared_words(rows, length):
    """Brute force: words kept and how many are covered, by windows that another row has too."""
    words = [(t or "").replace("\t", " ").replace("\n", " ").split(" ") for _, t in rows]
    words = [[w for w in x if w] for x in words]
    where = {}
    for r, x in enumerate(words):
        for k in range(len(x) - length + 1):
            where.setdefault(tuple(x[k : k + length]), set()).add(r)
    out = []
    for r, x in enumerate(words):
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if len(where[tuple(x[k : k + length])]) > 1:
                gone[k : k + length] = [True] * length
        out.append((rows[r][0], sum(gone), [w for w, g in zip(x, gone) if not g]))
    return out


@pytest.mark.parametrize("hot", [1, 60, 1 << 19])
def test_shared_passages_by_brute_force(spark, hot, monkeypatch):
    """Passages of words, spaced otherwise in each text; what only one text repeats stays."""
    monkeypatch.setattr("driftwell.llm.common.HOT_ROWS", 5)
    rng = random.Random(9)
    gap = lambda words: "".join(w + rng.choice([" ", "  ", "\n", " \t"]) for w in words)
    shared = [rng.choice("abcé") for _ in range(60)]
    rows = [(k, gap(rng.choices("abcdé", k=rng.randrange(8))) + gap(shared[rng.randrange(30) :][: rng.randrange(5, 40)]) + gap(rng.choices("abcd", k=20))) for k in range(40)]
    rows += [(50, "x y z " * 20), (51, "ü"), (None, gap(shared)), (52, None), (53, ""), (54, " \n"), (55, "same text of seven words and more"), (56, "same text of seven words and more"), (57, "a b"), (58, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    unit = runindex.Unit("words", 6, 2, True)
    want = shared_words(rows, 6)
    got = runindex.remove_matches(df, unit, hot).collect()
    assert sorted(((r["doc_id"], r["n_removed"]) for r in got), key=repr) == sorted(((i, n) for i, n, _ in want), key=repr)
    assert sum(n for *_, n in ((0, n) for _, n, _ in want)) > 100 and ("x y z " * 20) in [t for _, t in rows if t]
    also = runindex.remove_matches(df, runindex.Unit("bytes", 20, 6, False), hot, also=unit).collect()
    assert sorted(((r["doc_id"], r["n_also"]) for r in also), key=repr) == sorted(((i, n) for i, n, _ in want), key=repr)
    cut = {r["doc_id"]: r["text"] for r in runindex.cut_documents(df, unit).collect()}
    assert len(cut) == len(rows)
    assert all((cut[i] or "").split() == kept for i, _, kept in want)
    assert all(cut[i] == t for (i, t), (_, n, _) in zip(rows, want) if n == 0)


# ---- 10 --------------------------------------------------------------------------------------------------------------
def call(conv, turn, id_, name="t", arguments='{"a": 1}', needs=()):
    return (conv, turn, 0, id_, name, arguments, list(needs))


def test_tool_calls(spark):
    schema = {"t": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
    calls = [
        call(1, 0, "x", arguments='{"a" : 1}'), call(1, 0, "y", needs=["x"]), call(1, 3, "z", needs=["late"]), call(1, 5, "late", needs=["y"]),
        call(1, 6, "c1", needs=["c2"]), call(1, 7, "c2", needs=["c1"]), call(1, 8, "gone", needs=["nowhere"]), call(1, 9, "quiet"),
        call(1, 10, "bad", arguments='{"a": -1, "b": 2}'), call(1, 11, "worse", arguments="{"), call(1, 12, "who", name="unknown"), call(1, 13, None),
        call(1, 14, "x"), call(None, 0, "x"), call(2, None, "x", arguments=None), call(1, 15, "twin"), call(1, 15, "twin"), call(1, 16, "nan", arguments='{"a": NaN}'),
    ]
    results = [(1, k, i, f"r{k}") for k, i in enumerate(["x", "y", "z", "late", "c1", "c2", "gone", "bad", "worse", "who", "twin", "nan"])] + [(1, 50, "x", "again"), (1, 51, "lost", "r"), (1, 52, None, "r"), (None, 1, "x", None)]
    c = spark.createDataFrame(calls, "conv_id long, turn long, place int, call_id string, name string, arguments string, needs array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, result string")
    got = toolcalls.link(c, r, schema).collect()
    said = Counter((x["conv_id"], x["call_id"], x["status"]) for x in got)
    assert said == Counter({
        (1, "x", "ok"): 1, (1, "y", "ok"): 1, (1, "z", "ok"): 1, (1, "late", "ok"): 1, (1, "c1", "cycle"): 1, (1, "c2", "cycle"): 1, (1, "gone", "missing_dependency"): 1,
        (1, "quiet", "missing_result"): 1, (1, "bad", "invalid_arguments"): 1, (1, "worse", "invalid_json"): 1, (1, "who", "unknown_tool"): 1, (1, None, "no_id"): 2,
        (1, "x", "duplicate_call"): 1, (None, "x", "ok"): 1, (2, "x", "invalid_json"): 1, (1, "twin", "ok"): 1, (1, "twin", "duplicate_call"): 1, (1, "nan", "invalid_json"): 1,
        (1, "x", "duplicate_result"): 1, (1, "lost", "orphan_result"): 1,
    })
    level = {x["call_id"]: x["level"] for x in got if x["status"] == "ok" and x["conv_id"] == 1}
    assert level["x"] < level["y"] < level["late"] < level["z"]
    one = next(x for x in got if x["call_id"] == "x" and x["status"] == "ok" and x["conv_id"] == 1)
    assert one["json"] == '{"after":[],"arguments":{"a":1},"id":"x","name":"t","result":"r0"}'


def test_tool_calls_of_any_json(spark):
    """Huge integers, halves of surrogate pairs, infinite and deeply nested values end in a status, not in an error."""
    schema = {"t": {"type": "object", "properties": {"a": {"type": ["integer", "string"]}}, "additionalProperties": False}}
    texts = ['{"a": %s}' % ("1" * 400), '{"a": "\\ud800"}', '{"\\udfff": 1}', '{"a": 1e999}', '{"a": 2.0}', '{"a": 2.5}', '{"a": %s}' % ("1" * 5000), '{"a": ' + "[" * 100_000 + "]" * 100_000 + "}", "[]", "null", '"\\ud83d\\ude00"', '{"a": -0.0, "a": 3}', "", "\ufeff{}"]
    c = spark.createDataFrame([call(1, k, f"c{k}", arguments=t) for k, t in enumerate(texts)], "conv_id long, turn long, place int, call_id string, name string, arguments string, needs array<string>")
    r = spark.createDataFrame([(1, k, f"c{k}", "r") for k in range(len(texts))], "conv_id long, turn long, call_id string, result string")
    got = {x["turn"]: x for x in toolcalls.link(c, r, schema).collect()}
    said = [got[k]["status"] for k in range(len(texts))]
    assert said == ["ok", "ok", "invalid_arguments", "invalid_json", "ok", "invalid_arguments", "invalid_json", "invalid_json", "invalid_arguments", "invalid_arguments", "invalid_arguments", "ok", "invalid_json", "invalid_json"]
    assert got[1]["arguments"] == '{"a":"\\ud800"}' and json.loads(got[1]["json"])["arguments"] == {"a": "\ud800"} and "\U0001f600" in got[10]["arguments"]


@pytest.mark.parametrize("group", [1, 5, 50_000])
def test_levels_by_brute_force(spark, group):
    rng = random.Random(group)
    rows = []
    for conv in range(6):
        n = rng.randrange(1, 9)
        rows += [(str(conv), f"c{k}", rng.randrange(6), [f"c{rng.randrange(n + 1)}" for _ in range(rng.randrange(3))]) for k in range(n)]
    want = {}
    for conv in {r[0] for r in rows}:
        mine = {c: (start, [x for x in needs if any(q[0] == conv and q[1] == x for q in rows)]) for k, c, start, needs in rows if k == conv}

        def level(c, path=(), mine=mine):
            if c in path:
                return None
            above = [level(x, (*path, c)) for x in mine[c][1]]
            return None if None in above else max([mine[c][0], *(x + 1 for x in above)])

        want |= {(conv, c): level(c) for c in mine}
    df = spark.createDataFrame(rows, "conv_key string, call_id string, start long, needs array<string>")
    got = {(r["conv_key"], r["call_id"]): (r["level"], r["cycle"]) for r in toolcalls.levels(df, group).collect()}
    assert got == {k: (v, v is None) for k, v in want.items()}


def test_long_chain_of_calls(spark):
    """5,000 calls, each needing the next: one pass, not a job a call."""
    n = 5000
    df = spark.createDataFrame([("1", f"c{k}", k, [f"c{k + 1}"]) for k in range(n)], "conv_key string, call_id string, start long, needs array<string>")
    got = {r["call_id"]: r["level"] for r in toolcalls.levels(df).collect()}
    assert got == {f"c{k}": 2 * (n - 1) - k for k in range(n)}


def test_tool_calls_by_brute_force(spark, edge):
    rows = [tuple(r) for r in table(spark, edge, "conversations").collect()]
    got = toolcalls.op10_tool_calls(spark, edge).collect()
    calls = Counter((c, t) for c, t, role, _ in rows if role in ("user", "system"))
    results = Counter((c, t) for c, t, role, _ in rows if role == "assistant")
    linked = [r for r in got if r["status"] not in ("orphan_result", "duplicate_result", "no_id", "duplicate_call", "other_role")]
    assert {(r["conv_id"], r["turn"]) for r in linked} == {k for k in calls if k[1] is not None}
    for r in linked:
        answered = (r["conv_id"], r["turn"] + 1) in results
        assert (r["result_turn"] == r["turn"] + 1) == answered
        value = json.loads(r["json"])
        assert value["id"] == f"call-{r['turn']}" and r["json"] == toolcalls.canonical(value)
    others = sum(role not in ("user", "system", "assistant") for *_, role, _ in rows)
    assert len(got) == others + sum(calls.values()) + sum(n - (1 if (c, t - 1) in calls else 0) for (c, t), n in results.items())


def test_json_schema():
    e = toolcalls.errors
    assert e(1, {"type": "integer"}) == [] and e(True, {"type": "integer"}) and e(1.0, {"type": "integer"}) == [] and e("a", {"enum": ["b"]})
    assert e([1, "x"], {"type": "array", "items": {"type": "number"}, "maxItems": 1}) == ["$: too many", "$[1]: not number"]
    assert e("abc", {"minLength": 4}) and e("abc", {"pattern": "^b"}) and not e(None, {"type": ["null", "string"]})


def test_nothing_else_imports_llm():
    from pathlib import Path

    root = Path(toolcalls.__file__).parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"driftwell\.llm|from \.+llm|import llm", path.read_text()), path
    assert duck(SMALL) is not None


def test_messages_of_other_roles_have_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "tool", "c"), (1, 3, None, "d"), (1, 3, None, "d"), (None, None, "tool", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = toolcalls.op10_tool_calls(spark, str(tmp_path)).collect()
    other = sorted(((r["conv_id"], r["turn"], r["name"], r["result"]) for r in got if r["status"] == "other_role"), key=repr)
    assert other == sorted(((c, t, role, text) for c, t, role, text in rows[2:]), key=repr) and len(got) == 5
