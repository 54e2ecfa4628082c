"""Token counts of whole texts, huge ones in overlapping chunks that are spliced at stable boundaries.

A text longer than CHUNK characters is encoded in chunks which overlap by some characters.  Encoding a chunk gives its
tokens' offsets.  Two neighbouring chunks are spliced at a boundary that both have: an offset in their overlap where a
token ends, the next character is white space, and the same tokens come before it in the overlap, in both chunks, back
to another such boundary.  White space parts words for the tokenizer before any merge, so what is left of a boundary
doesn't depend on what is right of it; the shared tokens show that neither chunk still feels its own edge.  If no
such boundary exists the overlap is widened, twofold each time, up to the whole rest of the text.

Words recur, so for texts of simple characters (printable ASCII, tab and line ends, Latin letters to U+024F but capital
I with a dot) the words are split as the vocabulary's rules do and each distinct word is given to the library once.
For such characters the normaliser only lower-cases.  All other texts go through the library as they are, and so do those
in which a special token's string begins.  Both ways are compared in the tests.

Cases: null and empty texts have no tokens; texts of white space neither; repeated rows give repeated result rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table

CHUNK, OVERLAP = 32_768, 512
LIMIT = 2048
MEMO_WORDS = 200_000
SIMPLE = regex.compile(r"[\t\n\r\x20-\x7e¡-įı-ɏ]*")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: (start, end, tokens) of each piece of a chunk: with the library a piece is a token, with the memo a word.
Pieces = list[tuple[int, int, int]]


class WordCounter:
    """Counts by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}
        #: The memo's rules are those of this kind of file; others always go through the library.
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_words = kinds == ["NFC", "Replace", "Lowercase"] and splits == [PIECE.pattern, None]
        self.special = [x["content"] for x in spec.get("added_tokens", [])]

    def simple(self, text: str) -> bool:
        return self.by_words and SIMPLE.fullmatch(text) is not None and not any(x in text for x in self.special)

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if new:
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo.clear()
                new = list(dict.fromkeys(words))
            self.memo.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))

    def whole(self, text: str) -> int:
        if self.simple(text):
            words = PIECE.findall(text.lower())
            self.learn(words)
            return sum(map(self.memo.__getitem__, words))
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def pieces(self, text: str) -> Pieces:
        if self.simple(text):
            found = [(m.start(), m.end(), m.group()) for m in PIECE.finditer(text.lower())]
            self.learn([w for _, _, w in found])
            return [(a, b, self.memo[w]) for a, b, w in found]
        return [(a, b, 1) for a, b in self.tokenizer.encode(text, add_special_tokens=False).offsets]


def boundaries(text: str, base: int, pieces: Pieces, lo: int, hi: int) -> dict[int, int]:
    """Offsets in [lo, hi) of the whole text where a piece ends before white space → index of the next piece."""
    return {base + b: k + 1 for k, (_, b, _) in enumerate(pieces) if lo <= base + b < hi and base + b < len(text) and text[base + b].isspace()}


def splice(text: str, at: int, left: Pieces, begin: int, right: Pieces, end: int) -> tuple[int, int] | None:
    """left: pieces of a chunk that starts at ``at`` and ends at ``end``; right: of one that starts at ``begin``.
    The index in left up to which and in right from which pieces are taken, if both agree between two boundaries."""
    ours, theirs = boundaries(text, at, left, begin, end), boundaries(text, begin, right, begin, end)
    common = sorted(ours.keys() & theirs.keys())
    for a, b in zip(reversed(common[:-1]), reversed(common[1:])):
        one = [(x + at, y + at, n) for x, y, n in left[ours[a] : ours[b]]]
        two = [(x + begin, y + begin, n) for x, y, n in right[theirs[a] : theirs[b]]]
        if one == two:
            return ours[b], theirs[b]
    return None


def count_in_chunks(text: str, encode: Callable[[str], Pieces], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, of which only a chunk is encoded at once."""
    at, end = 0, min(chunk, len(text))
    pieces, skip, total = encode(text[:end]), 0, 0
    while end < len(text):
        width = overlap
        while True:
            begin = max(0, end - width)
            if begin <= at:
                # No boundary in the whole chunk: it is put together with the next one.
                end = min(len(text), end + max(chunk, end - at))
                pieces, total = encode(text[at:end]), total
                break
            stop = min(len(text), begin + max(chunk, 2 * width))
            following = encode(text[begin:stop])
            cut = splice(text, at, pieces, begin, following, end)
            if cut and cut[0] >= skip:
                total += sum(n for _, _, n in pieces[skip : cut[0]])
                at, end, pieces, skip = begin, stop, following, cut[1]
                break
            width *= 2
    return total + sum(n for _, _, n in pieces[skip:])


def count(path: str, chunk: int, overlap: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text → doc_id, n_bytes, n_tokens."""
        counter = WordCounter(path)
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                counts.append(counter.whole(text) if len(text) <= chunk else count_in_chunks(text, counter.pieces, chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """documents: doc_id, text; path: the vocabulary file, which every executor must see."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count(path, chunk, overlap), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary(name: str) -> str:
    import importlib.util
    import sys

    if importlib.util.find_spec("public_tokenizers") is None:
        # The package lies in a folder of another name where it isn't installed.
        spec = importlib.util.spec_from_file_location("public_tokenizers", "/opt/tokenizers/__init__.py")
        sys.modules["public_tokenizers"] = module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
