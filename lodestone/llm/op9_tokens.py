"""Operator 9: token counts by a count-only Viterbi search.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and its piece count and
no path.  Ties are those of the tokenizer: matches are tried from the
earliest start on and only a strictly better score replaces one, and a
character that no one-character piece covers may be unknown at the least score
less ten; runs of unknown characters count as their UTF-8 bytes.  Texts part at
spaces, which become the mark U+2581 before the next piece, so a piece's
count is found once for each distinct chunk and kept in a bounded cache.

Defined results: null and empty texts have no tokens; repeated rows get equal
counts; a null doc_id passes; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARK = "▁"
PENALTY = 10.0
CACHE = 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, by id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter(dict):
    """Chunk -> number of tokens."""

    def __init__(self, vocab: list[tuple[str, float]]):
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, s in dict(vocab).items():
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - PENALTY

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self.search(chunk)
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def search(self, chunk: str) -> int:
        n = len(chunk)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(chunk):
            ends[end].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for i, matches in enumerate(ends):
            best, pieces, alone = None, 0, False
            # longest first: the earliest start, as the tokenizer fills places from the left
            for size, s in sorted(matches, reverse=True):
                total = s + score[i + 1 - size]
                if best is None or total > best:
                    best, pieces = total, count[i + 1 - size] + 1
                alone |= size == 1
            if not alone:
                total = self.unknown + score[i]
                if best is None or total > best:
                    best, pieces = total, count[i] + len(chunk[i].encode("utf-8", "surrogatepass"))
            score[i + 1], count[i + 1] = best, pieces
        return count[n]

    def text(self, t: str | None) -> int:
        if not t:
            return 0
        if MARK in t:
            t = t.replace(" ", MARK)
            return sum(self[c] for c in re.findall(f"{MARK}[^{MARK}]*", t if t[0] == MARK else MARK + t))
        parts = t.split(" ")
        return sum(map(self.__getitem__, [MARK + p for p in (parts if parts[0] else parts[1:])]))


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every text by the pieces and scores in `path`, taken as a unigram vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        c = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_tokens": [c.text(t) for t in b["text"].to_pylist()]}, schema=_OUT)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
