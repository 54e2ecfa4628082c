from __future__ import annotations

import random
import re
from collections import Counter

from conftest import SMALL, duck, rows_of

import corpus_pipeline as pipeline
from driftwell.llm import mixing, substrings, textwords, toxicity
from driftwell.llm.common import saved, table

from .conftest import clashing
from .test_operators import classes_by_brute_force, shared_words


def chain(spark, docs, where):
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = saved(stage(spark, docs, where), name)
        out.append(docs)
    return out


def check(spark, where, steps):
    """Each stage against brute force over its own input."""
    docs, clean, unique, cut, fit, mixed = steps
    for df in steps[1:5]:
        assert set(df.columns) == set(docs.columns)
    text_of = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    # 1: what is left scores below the threshold, what is gone doesn't (scores: test_score_by_brute_force).
    model = toxicity.train(docs, table(spark, where, "labels").where(~toxicity.held_out()).select("doc_id", "toxic"))
    bad = toxicity.scores(docs, model).where("score >= 0.7").count()
    assert docs.count() - bad == clean.count()
    # 2: one of each class, and every row without words.
    rows = text_of(clean)
    worded = Counter(c for (_, t), (_, c) in zip(rows, classes_by_brute_force(rows)) if textwords.tokens(t))
    kept = text_of(unique)
    ids = [i for i, t in kept if textwords.tokens(t)]
    # Two texts of one doc_id may be in different classes, which then have the same id.
    assert set(ids) == set(worded) and len(ids) == len({(i, t) for i, t in kept if textwords.tokens(t)})
    assert Counter(r for r in kept if not textwords.tokens(r[1])) == Counter(r for r in rows if not textwords.tokens(r[1]))
    # 3: passages of 50 words that other documents have are gone, and nothing else.
    want = Counter((i, " ".join(words), n == 0) for i, n, words in shared_words(kept, 50))
    now = text_of(cut)
    before = Counter(kept)
    assert Counter((i, " ".join(substrings.words_of(t)), before[i, t] > 0) for i, t in now) == want
    # 4: no window of the benchmark is left, and only documents with one are gone.
    plain = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    items = [plain(r["text"]) for r in table(spark, where, "benchmark").where("item_id is not null").collect()]
    windows = {tuple(w[k : k + 8]) for w in items if w for k in range(max(1, len(w) - 7))}
    sizes = {len(w) for w in windows}
    held = lambda t: any(tuple(w[k : k + n]) in windows for w in [plain(t)] for n in sizes for k in range(len(w) - n + 1))
    assert Counter(text_of(fit)) == Counter((i, t) for i, t in now if not held(t))
    # 5: as the mix's SQL has it, over what is left.
    if fit.count():
        fit.select("doc_id", "text", "source").coalesce(1).write.mode("overwrite").parquet(f"{where_of(spark)}/mixed/documents.parquet")
        sql = duck(f"{where_of(spark)}/mixed").sql(mixing.OP5_SQL).df()
        names = ["doc_id", "size", "source_size", "target", "taken"]
        assert rows_of(mixed.select(*names).toPandas(), names) == rows_of(sql, names)


def where_of(spark) -> str:
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file:")


def test_small(spark):
    steps = chain(spark, table(spark, SMALL, "documents"), SMALL)
    check(spark, SMALL, steps)
    assert pipeline.run(spark, SMALL).exceptAll(steps[-1]).count() == 0
    assert 0 < steps[-1].count() < steps[0].count()


def test_edge_and_clashing_columns(spark, edge):
    docs = clashing(table(spark, edge, "documents"))
    check(spark, edge, chain(spark, docs, edge))


def test_empty(spark, nothing):
    assert chain(spark, table(spark, nothing, "documents"), nothing)[-1].count() == 0


def test_planted(spark, tmp_path):
    """Copies, near copies, shared passages, benchmark passages and toxic texts go; clean ones stay as they are."""
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(n))
    rows = [[k, text(150)] for k in range(300)]
    for k in range(0, 300, 6):
        words = rows[k][1].split()
        for _ in range(5):
            words[rng.randrange(len(words))] = "zorkish"
        rows[k][1] = " ".join(words)
    rows[1][1] = rows[5][1]
    near = rows[5][1].split()
    near[75] = "changed"
    rows[7][1] = " ".join(near)
    passage, item = text(80), text(20)
    rows[8][1] += " " + passage
    rows[9][1] = passage + " " + rows[9][1]
    rows[10][1] += " " + item
    # A passage of 51 short words, in fewer than 400 bytes and spaced otherwise.
    short = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 6))) for _ in range(51)]
    rows[13][1] += "\n" + " ".join(short)
    rows[14][1] += " " + "\n".join(short) + " " + text(9)
    rows[15][1] += (" " + " ".join(text(60).split()[:55])) * 2  # repeated in one text alone
    assert len(" ".join(short)) < 400
    df = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = chain(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    toxic = {k for k in range(0, 300, 6)}
    assert ids[1] == ids[0] - toxic
    assert ids[2] == ids[1] - {5, 7}
    assert ids[3] == ids[2] and ids[4] == ids[3] - {10}
    texts = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    assert passage not in texts[8] and passage not in texts[9] and len(texts[8]) > 600
    assert not {*short} & {*texts[13].split(), *texts[14].split()} - {w for k in (13, 14) for w in rows[k][1].split()[:150]}
    assert all(texts[k] == rows[k][1] for k in ids[3] - {8, 9, 13, 14})
