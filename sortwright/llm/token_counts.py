"""Token counts of a byte-level BPE without token ids per document.

1. Texts are cut into pre-tokens, and the corpus's distinct pre-tokens are counted
   (partial counts a task, then a shuffle).
2. Each distinct pre-token goes through the library once; the table keeps its number
   of pieces.
3. The frequencies of a document's pre-tokens meet that table: the most frequent
   ones (at most ``head_words``) by a broadcast dictionary, the others by an equi-join.
   None of these is frequent, so no key is hot. The products are summed.

Defined cases: null counts as empty; empty text has no tokens; strings of
special tokens inside texts are one token each, the library's default; repeated
rows are counted alike.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwright.llm.common import head_cut, materialize, slices

# fixed value: the pre-token pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# the same for texts of ASCII, Latin letters and common punctuation, where the classes of ``re`` agree with the
# pattern's; 0x1C-0x1F, 0x85 and number signs such as superscripts are outside
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


OUTSIDE = re.compile(r"[^\x00-\x1b\x20-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]").search


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself
    where it is printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceCounter:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("the vocabulary isn't a plain byte-level BPE; its pre-tokens can't be counted one by one")
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.cut_any = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.model = self.tokenizer.model

    def cut(self, text: str) -> list[str]:
        return self.cut_any(text) if OUTSIDE(text) else PLAIN(text)

    def pieces(self, pretoken: str) -> int:
        return len(self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.letters)))

    def pretokens(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the text's pre-tokens, and its special tokens."""
        if self.special is None or not self.special.search(text):
            return Counter(self.cut(text)), 0
        parts = self.special.split(text)
        return Counter(x for p in parts for x in self.cut(p)), len(parts) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def pretoken_table(docs: DataFrame, path: str, flush_words: int = 400_000) -> DataFrame:
    """``word, n, pieces`` for each distinct pre-token of ``docs``'s texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, total = counter(path), Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            words = list(total)
            for lo in range(0, len(words), 50_000):
                part = words[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[x] for x in part], pa.int64())], names=["word", "n"])
            total.clear()

        for b in slices(batches, 0):
            for t in b.column(0).to_pylist():
                if t:
                    total.update(cut.pretokens(t)[0])
                    if len(total) > flush_words:
                        yield from emit()
        yield from emit()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path).pieces
        for b in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(pieces, b.column(0).to_pylist()), pa.int32())], names=["word", "n", "pieces"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counts.mapInArrow(measure, "word string, n long, pieces int"), "pretokens")


def token_counts(docs: DataFrame, path: str, limit: int = 512, head_words: int = 1 << 17) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``; ``path`` is the vocabulary
    file, which every worker can read."""
    table = pretoken_table(docs, path)
    least = head_cut(table, head_words)
    # at most head_words rows
    head = docs.sparkSession.sparkContext.broadcast({r["word"]: r["pieces"] for r in table.filter(F.col("n") >= least).select("word", "pieces").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known, next_id = counter(path), head.value, TaskContext.get().partitionId() << 40
        for b in slices(batches):
            n, words, times, ends = [], [], [], [0]
            for t in b.column(1).to_pylist():
                freq, here = cut.pretokens(t) if t else ({}, 0)
                for x, k in freq.items():
                    p = known.get(x)
                    if p is None:
                        words.append(x)
                        times.append(k)
                    else:
                        here += p * k
                n.append(here)
                ends.append(len(words))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array(words, pa.string()), pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(range(next_id, next_id + b.num_rows), pa.int64()), b.column(0), b.column(2), pa.array(n, pa.int64()), *lists], names=["row", "doc_id", "n_bytes", "n", "words", "times"])
            next_id += b.num_rows

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    found = materialize(rows.mapInArrow(run, "row long, doc_id long, n_bytes long, n long, words array<string>, times array<long>"), "frequencies")
    tails = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # each pre-token has one row, so the hashed side of a task is as small as its partition; nothing is sorted
    more = tails.join(table.filter(F.col("n") < least).select("word", "pieces").hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = F.col("n") + F.coalesce("more", F.lit(0))
    return found.drop("words", "times").join(more, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
