from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_documents() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, shared passages, odd characters."""
    rng = random.Random(11)
    base, passage, other = prose(rng, 300), prose(rng, 120), prose(rng, 90)
    texts = [None, "", " ", "\n\n", "one", "one two three four", base, base, base.replace("w1", "v1", 2), base.upper()]
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(4)] + [passage, f"{passage} {passage}"]
    texts += ["ab" * 600, "äöü ß é " * 100, "\U0001f600" * 300 + "x", "áȩ Iİi " * 50, "line\n" * 200, "\x00\x1c\x85 tab\tend", "<|endoftext|> it's 12 we'll " * 20]
    texts += [prose(rng, 6000) + " " + other, other + "\n" + prose(rng, 50), prose(rng, 30) + " " + other]
    texts += [prose(rng, rng.randrange(5, 200)) for _ in range(20)]
    rows = [(k, t, None if k % 7 == 3 else "en", None if k % 5 == 4 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[6], rows[10], (None, base, None, None, None), (None, None, None, None, None), (12, "another text of the same id", "en", "s1", 27), (2**40, other, "en", "s9", len(other))]
    return rows


def write(where: Path, name: str, rows: list[tuple], schema: pa.Schema) -> None:
    where.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema), where / f"{name}.parquet")


BENCH = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
TALK = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def tables(where: Path, docs: list[tuple]) -> str:
    write(where, "documents", docs, DOCS)
    texts = [t for _, t, *_ in docs if t]
    words = [t.split() for t in texts if len(t.split()) > 40]
    items = [(k, " ".join(w[5:35])) for k, w in enumerate(words[:6])] + [(90, "one"), (91, "ONE, two"), (92, None), (93, ""), (None, "one two three"), (94, " ".join(words[0][5:35]) if words else "x"), (94, "one")]
    write(where, "benchmark", items if docs else [], BENCH)
    write(where, "labels", [(d[0], 1, int(k % 4 == 0)) for k, d in enumerate(docs)] + [(0, None, 1), (1, None, None)] if docs else [], LABELS)
    urls = ["http://A.example.com:80/x/?utm_source=q&b=2&a=1#f", "https://www.a.example.com/x?a=1&b=2", "b.example.com", None, "", "https://u@c.example.com/p//", "c.example.com/p?ref=1"]
    write(where, "pages", [(k, urls[k % 7], None if k % 9 == 4 else "<p>" * (k % 6)) for k in range(40)] + [(3, urls[0], "x"), (3, urls[0], "x")][:0] if docs else [], PAGES)
    talk = [(c, t, ("system", "user", "assistant")[0 if t == 0 and c % 2 else 1 + (t + c) % 2], None if t == 5 else f"text {c} {t}" + "ü" * (3000 if t == 6 else 0)) for c in range(5) for t in range(8)]
    write(where, "conversations", talk + [talk[3], (None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, None, "user", "z"), (2, 30, "assistant", "late"), (2, 31, None, "who")] if docs else [], TALK)
    return str(where)


@pytest.fixture(scope="session")
def edge(tmp_path_factory) -> str:
    return tables(tmp_path_factory.mktemp("edge"), edge_documents())


@pytest.fixture(scope="session")
def nothing(tmp_path_factory) -> str:
    return tables(tmp_path_factory.mktemp("nothing"), [])


#: Names that operators use inside, as columns of the input.
CLASH = ["text_id", "text_key", "block", "node", "first_id", "size", "pattern", "h", "w", "pos", "word", "key", "label", "score", "hits", "start", "n", "anchor", "ghost", "label_", "band", "__id", "__key", "__kept", "__node", "__first", "__hot", "__salt", "id", "row", "node", "kept", "copies", "runs", "id2", "k", "n0", "first", "times", "call_id", "url_key", "at", "part", "source_id"]


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASH})
