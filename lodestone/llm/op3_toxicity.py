"""Operator 3: toxicity categories by a classifier chain.

Categories are predicted one after another by linear models over the words of a
text; each later model also gets the log-odds of the categories before it.
For training these are out-of-fold predictions, so a later model sees earlier
outputs as wrong as they will be on new texts; for prediction the models fitted
on all folds supply them.  Word features are present or absent, weighted by
their log-count ratio in the training folds, and stem only from words in
`min_df` training texts or more.

The chain is fitted on at most `sample` rows of labelled documents (those first by a hash
of doc_id) and, of each text, on at most `longest` different words (those of least hash); all documents are then
scored from their whole texts.

Defined results: a null or empty text has no words and gets the chain's
prior, unflagged; null labels count as absent rows; repeated rows get equal scores; with
no labelled row, or one class only, scores are the share of that class;
an empty table gives an empty result; clashing extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import NOT_LETTERS, Words, mix

SAMPLE = 8_000
LONGEST = 20_000  # different words of a text in training
MIN_DF = 4
FOLDS = 5
CHAIN = ("low_quality", "toxic")
U = np.uint64


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, word hash), distinct and sorted by document."""
    w = Words(texts, lower=True, space=NOT_LETTERS)
    order = np.lexsort((w.hash, w.doc))
    doc, h = w.doc[order], w.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


class Linear:
    """Logistic regression over log-count-ratio features and dense extras."""

    def __init__(self, doc: np.ndarray, col: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 150):
        pos, neg = (np.bincount(col[y[doc] == v], minlength=width) for v in (1, 0))
        p, q = (pos + 0.5) / (max(1, y.sum()) + 1), (neg + 0.5) / (max(1, (1 - y).sum()) + 1)
        self.ratio = np.log(p / q)
        value = self.ratio[col]
        self.mean, self.scale = (extra.mean(0), np.maximum(extra.std(0), 0.5)) if extra.size else (np.zeros(extra.shape[1]), np.ones(extra.shape[1]))
        e = self._standard(extra)
        share = (y.sum() + 0.5) / (n + 1)
        bias = float(np.log(share / (1 - share)))
        w, v = np.zeros(width), np.zeros(extra.shape[1])
        if not 0 < y.sum() < n:
            self.w, self.v, self.bias = w, v, bias
            return
        # full-batch Adam; the loss is convex
        state = [np.zeros(width), np.zeros(len(v)), 0.0], [np.zeros(width), np.zeros(len(v)), 0.0]
        for t in range(1, rounds + 1):
            z = np.bincount(doc, w[col] * value, n) + e @ v + bias
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            grads = [np.bincount(col, g[doc] * value, width) / n + l2 * w / n, e.T @ g / n, g.mean()]
            params = [w, v, bias]
            for i, gr in enumerate(grads):
                state[0][i] = 0.9 * state[0][i] + 0.1 * gr
                state[1][i] = 0.99 * state[1][i] + 0.01 * gr * gr
                params[i] = params[i] - 0.1 * (state[0][i] / (1 - 0.9**t)) / (np.sqrt(state[1][i] / (1 - 0.99**t)) + 1e-8)
            w, v, bias = params
        self.w, self.v, self.bias = w, v, float(bias)

    def _standard(self, extra: np.ndarray) -> np.ndarray:
        return np.clip((extra - self.mean) / self.scale, -4, 4)

    def logit(self, doc: np.ndarray, col: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
        return np.clip(np.bincount(doc, (self.w * self.ratio)[col], n) + self._standard(extra) @ self.v + self.bias, -30, 30)


class Chain:
    def __init__(self, doc: np.ndarray, h: np.ndarray, n: int, labels: np.ndarray, names: tuple[str, ...] = CHAIN, min_df: int = MIN_DF, folds: int = FOLDS):
        self.names = names
        seen, count = np.unique(h, return_counts=True)
        self.words = seen[count >= min(min_df, max(1, n // 10))]
        doc, col = self._columns(doc, h)
        fold = np.arange(n) % folds
        extra = np.zeros((n, 0))
        self.models, self.cuts, self.out_of_fold = [], [], []
        for j in range(labels.shape[1]):
            y = labels[:, j].astype(np.float64)
            out = np.zeros(n)
            for f in range(folds):
                train, test = fold != f, fold == f
                if not train.any() or not test.any():
                    continue
                at = np.cumsum(train) - 1
                m = Linear(at[doc[train[doc]]], col[train[doc]], int(train.sum()), len(self.words), extra[train], y[train])
                at = np.cumsum(test) - 1
                out[test] = m.logit(at[doc[test[doc]]], col[test[doc]], int(test.sum()), extra[test])
            self.models.append(Linear(doc, col, n, len(self.words), extra, y))
            self.cuts.append(self._cut(out, y))
            self.out_of_fold.append(out)
            extra = np.concatenate((extra, out[:, None]), 1)

    def _columns(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return doc[:0], doc[:0]
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ok = self.words[at] == h
        return doc[ok], at[ok]

    @staticmethod
    def _cut(logit: np.ndarray, y: np.ndarray) -> float:
        """The log-odds from which a category is flagged: the best F1 out of fold, midway between neighbours."""
        if not 0 < y.sum() < len(y):
            return np.inf
        order = np.argsort(-logit, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
        i = int(np.argmax(f1))
        return float((logit[order[i]] + logit[order[min(i + 1, len(y) - 1)]]) / 2)

    def predict(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, flags), a column for each category."""
        n = len(texts)
        doc, col = self._columns(*features(texts))
        extra = np.zeros((n, 0))
        some = np.bincount(doc, minlength=n) > 0
        flags = []
        for m, c in zip(self.models, self.cuts):
            z = m.logit(doc, col, n, extra)
            extra = np.concatenate((extra, z[:, None]), 1)
            flags.append((z >= c) & some)
        return 1 / (1 + np.exp(-extra)), np.stack(flags, 1)


_ROW = "h bigint, low_quality int, toxic int, words binary"


def _read(longest: int):
    def read(batches):
        for b in batches:
            texts = b["text"].cast(pa.large_binary()).to_pylist()
            doc, h = features(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            words = [h[a : min(z, a + longest)].tobytes() for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_pydict({"h": b["h"], "low_quality": b["low_quality"], "toxic": b["toxic"], "words": words}, schema=pa.schema([("h", pa.int64()), ("low_quality", pa.int32()), ("toxic", pa.int32()), ("words", pa.binary())]))

    return read


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Chain:
    """labels: doc_id, quality, toxic (0 or 1); a document of quality 0 is of low quality."""
    few = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (1 - F.col("quality")).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of three numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", F.xxhash64("doc_id", "text").alias("h"), "low_quality", "toxic")
    # doc_ids may stand on several rows, so what the join gives is bounded too
    got = sorted(rows.mapInArrow(_read(longest), _ROW).orderBy("h").limit(sample).collect(), key=lambda r: (r.h, bytes(r.words)))
    words = [np.frombuffer(r.words, U) for r in got]
    doc = np.repeat(np.arange(len(got)), [len(w) for w in words])
    return Chain(doc, np.concatenate([*words, np.empty(0, U)]), len(got), np.array([[r.low_quality, r.toxic] for r in got], np.int64).reshape(-1, 2))


_OUT = pa.schema([("doc_id", pa.int64()), ("p_low_quality", pa.float64()), ("p_toxic", pa.float64()), ("low_quality", pa.bool_()), ("toxic", pa.bool_())])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, low_quality, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for b in batches:
            texts = b["text"].cast(pa.large_binary()).to_pylist()
            size = np.cumsum([len(t or b"") for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 8_000_000)))
                p, flag = shared.value.predict(texts[at:to])
                yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"][at:to], "p_low_quality": p[:, 0], "p_toxic": p[:, 1], "low_quality": flag[:, 0], "toxic": flag[:, 1]}, schema=_OUT)
                at = to

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, p_low_quality double, p_toxic double, low_quality boolean, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
