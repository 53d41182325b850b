"""Operator 6: language of each word by a linear-chain conditional random field.

A word's emission scores are sums of learned weights over hashed features: byte
n-grams of the lower-cased word between boundary marks (those at a mark are
its affixes) and the whole word (the lexicon).  Transitions between words are
learned too, on code-switched sequences spliced from documents of different
languages.  Forward-backward gives each word's marginals; a document's
language has the largest mean marginal, which is its score.

The model is fitted on a bounded sample, at most `sample` documents a language
(different texts, those first by a hash of the text) of at most `longest` characters; every
prediction reads the whole text.

Defined results: a null text, or one without letters, is `und` with score 0; ties
between languages go to the first by code point; repeated rows get equal
results; without any labelled document everything is `und`; an empty table
gives an empty result; extra columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, table
from .words import NOT_LETTERS, Words, mix

SAMPLE = 400
LONGEST = 20_000
DIMS = 1 << 18
SLICE_BYTES = 6_000_000
U = np.uint64


class Distinct:
    """The distinct words of a batch and their hashed features."""

    def __init__(self, w: Words):
        self.hash, first, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        start, size = w.start[first], w.end[first] - w.start[first]
        # each word between the marks ^ and $
        total = size + 2
        begin = np.concatenate(([0], np.cumsum(total)))[:-1]
        b = np.zeros(int(total.sum()), np.uint8)
        at = np.arange(len(b)) - np.repeat(begin, total)
        b[begin], b[begin + total - 1] = ord("^"), ord("$")
        inner = (at > 0) & (at < np.repeat(total, total) - 1)
        b[inner] = np.frombuffer(w.data, np.uint8)[(np.repeat(start, total) + at - 1)[inner]]
        word = np.repeat(np.arange(len(size)), total)
        code = np.zeros(len(b), U)
        #: (word, feature) in the order of words: the lexicon, then the n-grams of each length
        self.parts = [(np.arange(len(size), dtype=np.int32), (self.hash % U(DIMS)).astype(np.int32))]
        for n in range(1, 5):
            code = code[: len(b) - n + 1] * U(257) + b[n - 1 :] + U(1)
            if n > 1:
                same = word[: len(code)] == word[n - 1 :]
                self.parts.append((word[: len(code)][same].astype(np.int32), (mix(code[same] + U(n)) % U(DIMS)).astype(np.int32)))
        self.n = 1 + sum(np.maximum(total - n + 1, 0) for n in range(2, 5))

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.hash), weights.shape[1]), weights.dtype)
        for word, feature in self.parts:
            if len(word):
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                out[word[first]] += np.add.reduceat(weights[feature], first, axis=0)
        return out / np.sqrt(self.n)[:, None].astype(weights.dtype)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All features in the order of words, and where each word's begin."""
        owner = np.concatenate([w for w, _ in self.parts])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([f for _, f in self.parts])[order], np.searchsorted(owner[order], np.arange(len(self.hash)))


def words_of(texts: list[str | None]) -> Words:
    return Words([(t or "").lower().encode("utf-8", "replace") for t in texts], space=NOT_LETTERS)


def forward_backward(e: np.ndarray, a: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Marginals of many sequences at once; e: exponentiated emissions, sequence i is e[offset[i]:offset[i+1]]."""
    length = np.diff(offset)
    order = np.argsort(-length, kind="stable")
    start, size = offset[:-1][order], length[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size[0]) + 1 if len(size) else 1))
    alpha = np.empty_like(e)
    x = None
    for t, n in enumerate(alive.tolist()):
        i = start[:n] + t
        x = e[i] if x is None else (x[:n] @ a) * e[i]
        x = x / x.sum(1, keepdims=True)
        alpha[i] = x
    b = np.ones((len(size), e.shape[1]), e.dtype)
    steps = alive.tolist()
    for t in range(len(steps) - 1, -1, -1):
        n = steps[t]
        i = start[:n] + t
        if t + 1 < len(steps) and steps[t + 1]:
            m = steps[t + 1]
            y = (b[:m] * e[start[:m] + t + 1]) @ a.T
            b[:m] = y / y.sum(1, keepdims=True)
        g = alpha[i] * b[:n]
        alpha[i] = g / g.sum(1, keepdims=True)
    return alpha


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.weights, self.transitions = langs, weights, transitions

    def marginals(self, w: Words) -> np.ndarray:
        d = Distinct(w)
        e = d.emissions(self.weights)
        e = np.exp(np.clip(e - e.max(1, keepdims=True), -30, 0)).astype(np.float32)[d.of]
        return forward_backward(e, np.exp(self.transitions - self.transitions.max()).astype(np.float32) + np.float32(1e-9), w.offset)


def fit(texts: list[str], labels: list[str], sequences: int = 4000, length: int = 32, epochs: int = 6, rate: float = 0.5, seed: int = 0) -> Model:
    """Stochastic gradient (Adagrad) on the conditional likelihood of spliced sequences."""
    langs = sorted(set(labels), key=lambda s: s.encode())
    k = len(langs)
    w = words_of(texts)
    y = np.array([langs.index(v) for v in labels])
    d = Distinct(w)
    feature, offset = d.rows()
    rng = np.random.default_rng(seed)
    docs = [np.flatnonzero((y == j) & (w.count > 0)) for j in range(k)]
    docs_of = [j for j in range(k) if len(docs[j])]
    weights, transitions = np.zeros((DIMS, k)), np.eye(k)
    if not docs_of:
        return Model(langs, weights.astype(np.float32), transitions)
    seq, lab = np.zeros((sequences, length), np.int64), np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            j = docs_of[rng.integers(len(docs_of))]
            doc = docs[j][rng.integers(len(docs[j]))]
            n = int(min(length - at, w.count[doc], rng.integers(6, length + 1)))
            a = int(w.offset[doc] + rng.integers(0, w.count[doc] - n + 1))
            seq[s, at : at + n], lab[s, at : at + n] = d.of[a : a + n], j
            at += n
    root = np.sqrt(d.n)
    seen, seen_t = np.full((DIMS, k), 1e-6), np.full((k, k), 1e-6)
    one = np.eye(k)
    for _ in range(epochs):
        for idx in np.array_split(rng.permutation(sequences), max(1, sequences // 128)):
            s, t = seq[idx], lab[idx]
            used, back = np.unique(s, return_inverse=True)
            back = back.reshape(s.shape)
            take = np.repeat(offset[used] - np.concatenate(([0], np.cumsum(d.n[used])[:-1])), d.n[used]) + np.arange(d.n[used].sum())
            f, own = feature[take], np.repeat(np.arange(len(used)), d.n[used])
            cut = np.searchsorted(own, np.arange(len(used)))
            e = (np.add.reduceat(weights[f], cut, axis=0) / root[used][:, None])[back]
            e = np.exp(e - e.max(2, keepdims=True))
            a = np.exp(transitions - transitions.max())
            n = s.shape[1]
            alpha, beta = np.empty_like(e), np.ones_like(e)
            for i in range(n):
                x = e[:, i] if not i else (alpha[:, i - 1] @ a) * e[:, i]
                alpha[:, i] = x / x.sum(1, keepdims=True)
            for i in range(n - 2, -1, -1):
                x = (beta[:, i + 1] * e[:, i + 1]) @ a.T
                beta[:, i] = x / x.sum(1, keepdims=True)
            g = alpha * beta
            g /= g.sum(2, keepdims=True)
            pair = alpha[:, :-1, :, None] * a * (beta * e)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            real = np.zeros((k, k))
            np.add.at(real, (t[:, :-1].ravel(), t[:, 1:].ravel()), 1)
            gt = (pair.sum((0, 1)) - real) / len(idx)
            delta = (g - one[t]).reshape(-1, k)
            by = np.zeros((len(used), k))
            np.add.at(by, back.ravel(), delta)
            by = by / root[used][:, None] / len(idx)
            unique, to = np.unique(f, return_inverse=True)
            gw = np.stack([np.bincount(to, by[own, j], len(unique)) for j in range(k)], 1) + 1e-5 * weights[unique]
            seen[unique] += gw * gw
            weights[unique] -= rate * gw / np.sqrt(seen[unique])
            seen_t += gt * gt
            transitions -= 0.1 * gt / np.sqrt(seen_t)
    return Model(langs, weights.astype(np.float32), transitions)


def train(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fit on at most `sample` different texts (text, lang) a language, those first by a hash of the text."""
    h = F.xxhash64("text")
    pool = docs.filter(F.col("lang").isNotNull() & (F.length("text").between(1, longest))).select("text", "lang", h.alias("h"))
    # hashes spread evenly, so the number of different ones tells below which value some four times the sample lie; copies share a hash and count once
    many = pool.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("m"))
    below = many.select(F.col("lang").alias("_lang"), F.expr(f"CASE WHEN m <= {4 * sample} THEN {2**63 - 1} ELSE cast(-9223372036854775808D + 18446744073709551616D * {4 * sample} / m AS bigint) END").alias("_below"))
    # one row a language, as the model itself has
    near = pool.join(F.broadcast(below), F.expr("lang = _lang AND h <= _below")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= sample)
    rows = sorted((r.lang, r.text) for r in few.select("text", "lang").toLocalIterator())
    return fit([t for _, t in rows], [v for v, _ in rows])


_RUN = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))


def predict(docs: DataFrame, model: Model, spans: bool = False, clear: bool = False) -> DataFrame:
    """`docs` with lang_pred and score and, on request, the runs of words of one language and `clear`, the mean over words of the best marginal."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

    run = ArrayType(StructType([StructField("lang", StringType()), StructField("words", LongType())]))
    out = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())] + [StructField("runs", run)] * spans + [StructField("clear", DoubleType())] * clear)
    schema = to_arrow_schema(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: list[str | None]):
        m = shared.value
        pred, score, runs, sure = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts), [0.0] * len(texts)
        w = words_of(texts)
        if not m.langs or not len(w.hash):
            return pred, score, runs, sure
        g = m.marginals(w)
        total = np.concatenate((np.zeros((1, g.shape[1])), np.cumsum(g, axis=0, dtype=np.float64)))
        mean = (total[w.offset[1:]] - total[w.offset[:-1]]) / np.maximum(w.count, 1)[:, None]
        best = mean.argmax(1)
        word = g.argmax(1)
        most = np.concatenate(([0.0], np.cumsum(g.max(1), dtype=np.float64)))
        most = (most[w.offset[1:]] - most[w.offset[:-1]]) / np.maximum(w.count, 1)
        for d in np.flatnonzero(w.count).tolist():
            t = texts[d]
            if any(c.isalpha() for c in t):
                pred[d], score[d] = m.langs[best[d]], float(min(1.0, max(0.0, mean[d, best[d]])))
                sure[d] = float(min(1.0, max(0.0, most[d])))
                if spans:
                    x = word[w.offset[d] : w.offset[d + 1]]
                    cut = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x))
                    runs[d] = [{"lang": m.langs[x[a]], "words": int(b - a)} for a, b in zip(cut, cut[1:])]
        return pred, score, runs, sure

    def go(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            size = np.cumsum([len(t or "") for t in texts])
            parts, at = [], 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES)))
                parts.append(label(texts[at:to]))
                give_back()
                at = to
            pred, score, runs, sure = ([x for p in parts for x in p[i]] for i in range(4))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())] + [pa.array(runs, _RUN)] * spans + [pa.array(sure, pa.float64())] * clear, schema=schema)

    return docs.mapInArrow(go, out)


def held_out():
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """Rejects documents whose language is `und` or whose words are recognised below `least` in the mean, each in whatever language; a null lang is filled in."""
    rest = [c for c in docs.columns if c != "text"]
    kept = predict(docs.select("text", F.struct(*rest).alias("rest")), train(docs.select("text", "lang")), clear=True).filter((F.col("lang_pred") != "und") & (F.col("clear") >= least))
    columns = {c: F.col("rest")[c] for c in rest} | {"text": F.col("text"), "lang": F.coalesce("rest.lang", "lang_pred")}
    return kept.select(*(columns[c].alias(c) for c in docs.columns))
