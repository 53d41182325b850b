"""Operator 4: substring dedup with suffix automata of reference shards.

A window is `k` consecutive words of one document; every word covered by a
window whose words also start in a document with a smaller doc_id goes.

1. Anchors.  A window's anchor is the least hash of its 5-word grams, so equal
   windows have equal anchors.  A census finds anchors of two or more
   documents; other windows cannot repeat and go no further.
2. Reference shards.  Runs of windows with one anchor are dealt out by anchor,
   each distinct run once per chunk with its least document, so all places of
   a window meet in one shard of bounded size.  A phrase that many documents share is the anchor of
   windows in ever new contexts; windows of such a hot anchor are dealt by their own hash
   instead, each alone, so the phrase does not send them all to one task.
3. A shard streams its runs, least document first, through the suffix automaton
   of the runs before them: matching statistics of `k` or more words give the
   windows known from a smaller document, then the run extends the automaton.
   A repeated run is streamed once.
4. Each chunk gets a bit mask per run back and cuts the maximal spans.

An automaton of the whole reference corpus cannot be broadcast, since it
grows with the corpus; each shard's automaton lives in the one task to
which all text that can match it is sent instead.  Words enter it as 64-bit hashes.

Defined results: null and empty texts have no words; a null doc_id counts as
the largest; rows of one doc_id are one document for the comparison; ties and
exact copies lose all windows but in the least doc_id; an empty table gives
an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .census import MISSING, SENT, chunks, code, count_documents, read_replies, send, sent_table, texts_of
from .common import lean, lean_pair, materialise, table
from .words import Words

GRAM = 5
RUN = 32  # windows in one run, at most
HOT = 64  # chunks; windows of an anchor in more are dealt by their own hash
SHARD_BYTES = 2_000_000
U = np.uint64


class Automaton:
    """Suffix automaton over word codes; each state keeps the first document that reached it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, codes: list[int], doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in codes:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new, p = len(nxt), last
            nxt.append({})
            length.append(length[last] + 1)
            first.append(doc)
            link.append(0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def known(self, codes: list[int], doc: int, k: int) -> int:
        """Bit i: the k codes from i on stand in a document before `doc`."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = matched = mask = 0
        for i, c in enumerate(codes):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= k:
                matched = k
                while length[link[state]] >= k:
                    state = link[state]
                if first[state] < doc:
                    mask |= 1 << (i - k + 1)
        return mask


class Chunk:
    """Windows of a chunk's documents with their anchors."""

    def __init__(self, t: pa.Table, k: int):
        self.k = k
        self.ids = np.asarray(t["doc_id"].fill_null(MISSING).to_numpy(), np.int64)
        self.words = w = Words(texts_of(t))
        g, _ = w.grams(GRAM)
        h, inside = w.grams(k)
        n = len(h)
        least = g[:n].copy() if n else h
        for j in range(1, k - GRAM + 1):
            np.minimum(least, g[j : j + n], out=least)
        self.at = np.flatnonzero(inside)  # first word of each window
        self.hash, self.anchor, self.doc = h[inside], least[inside], self.ids[w.doc[self.at]]
        order = np.argsort(self.anchor, kind="stable")
        self.distinct, start, self.of = np.unique(self.anchor, return_index=True, return_inverse=True)
        a, d = self.anchor[order], self.doc[order]
        cut = np.searchsorted(a, self.distinct)
        self.several = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut) if n and len(cut) else np.zeros(0, bool)

    def runs(self, replies: dict[int, bytes], buckets: int):
        """Runs of repeated anchors: (first window, windows, content hash, what it is dealt by) of each."""
        reply = read_replies(replies, self.distinct, buckets)
        i = np.flatnonzero((reply > 1)[self.of])
        if not len(i):
            return i, i, i.astype(U), i.astype(U)
        # a chunk counts once or, with several documents, twice
        hot = (reply > code(2 * HOT))[self.of[i]]
        new = np.ones(len(i), bool)
        new[1:] = (self.at[i[1:]] != self.at[i[:-1]] + 1) | (self.anchor[i[1:]] != self.anchor[i[:-1]]) | (self.doc[i[1:]] != self.doc[i[:-1]]) | (self.words.doc[self.at[i[1:]]] != self.words.doc[self.at[i[:-1]]]) | hot[1:]
        group = np.cumsum(new) - 1
        place = np.arange(len(i)) - np.flatnonzero(new)[group]
        head = np.flatnonzero(new | (place % RUN == 0))
        n = np.diff(np.append(head, len(i)))
        place = np.arange(len(i)) - np.repeat(head, n)
        content = np.add.reduceat((self.hash[i] ^ U(0x9E3779B97F4A7C15)) * (U(2) * place.astype(U) + U(1)), head) + n.astype(U)
        return i[head], n, content, np.where(hot[head], self.hash[i[head]], self.anchor[i[head]])


_RUNS = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("codes", pa.binary()), ("lengths", pa.binary()), ("docs", pa.binary()), ("groups", pa.binary())])
RUNS = "chunk bigint, shard bigint, codes binary, lengths binary, docs binary, groups binary"


def _distinct_runs(c: Chunk, replies: dict[int, bytes], buckets: int, shards: int):
    """Runs in the order of (shard, content, document) with their groups, and the first of each (shard, content)."""
    head, n, content, group = c.runs(replies, buckets)
    shard = ((group >> U(20)) % U(shards)).astype(np.int64)
    order = np.lexsort((c.doc[head], content, shard))
    head, n, content, shard, group = head[order], n[order], content[order], shard[order], group[order]
    first = np.ones(len(head), bool)
    first[1:] = (content[1:] != content[:-1]) | (shard[1:] != shard[:-1])
    return head, n, shard, group, first


def _ask(k: int, buckets: int):
    def ask(t: pa.Table) -> pa.Table:
        return sent_table(send(t["chunk"][0].as_py(), (c := Chunk(t, k)).distinct, 1 + c.several, buckets))

    return ask


def _replies(t: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: d for b, d, k in zip(t["bucket"].to_pylist(), t["data"].to_pylist(), t["kind"].to_pylist()) if k == kind}


def _send_runs(k: int, buckets: int, shards: int):
    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RUNS.empty_table()
        c = Chunk(left, k)
        head, n, shard, group, first = _distinct_runs(c, _replies(right, 0), buckets, shards)
        head, n, shard, group = head[first], n[first], shard[first], group[first]
        words = n + k - 1
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        rows: dict[str, list] = {f.name: [] for f in _RUNS}
        for a, b in zip(cut, np.append(cut[1:], len(shard))):
            m = words[a:b]
            at = np.repeat(c.at[head[a:b]] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            rows["codes"].append(c.words.hash[at].tobytes())
            rows["lengths"].append(m.astype(np.uint8).tobytes())
            rows["docs"].append(c.doc[head[a:b]].tobytes())
            rows["groups"].append(group[a:b].tobytes())
        rows["chunk"], rows["shard"] = [left["chunk"][0].as_py()] * len(cut), shard[cut].tolist()
        return pa.table(rows, schema=_RUNS)

    return go


_MASKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])


def _stream(k: int):
    def stream(t: pa.Table) -> pa.Table:
        codes, length, doc, group = [], [], [], []
        for x in t.to_pylist():
            codes.append(np.frombuffer(x["codes"], U))
            length.append(np.frombuffer(x["lengths"], np.uint8))
            doc.append(np.frombuffer(x["docs"], np.int64))
            group.append(np.frombuffer(x["groups"], U))
        each = [len(x) for x in length]
        codes, length, doc, group = (np.concatenate(x) for x in (codes, length, doc, group))
        end = np.cumsum(length.astype(np.int64))
        mask = np.zeros(len(length), np.uint32)
        # the automaton is of one anchor's runs, or of one window of a hot anchor: others share no window with them
        order = np.lexsort((doc, group))
        _, n = np.unique(group[order], return_counts=True)
        at = 0
        for m in n.tolist():
            own = order[at : at + m].tolist()
            at += m
            if doc[own[0]] == doc[own[-1]]:
                continue
            automaton, seen = Automaton(), {}
            for i in own:
                x = codes[end[i] - length[i] : end[i]]
                key, d = x.tobytes(), int(doc[i])
                whole = (1 << (len(x) - k + 1)) - 1
                before = seen.get(key)
                if before is None:
                    listed = x.tolist()
                    got = automaton.known(listed, d, k)
                    if got != whole:
                        automaton.add(listed, d)
                    seen[key] = (d, got)
                else:
                    got = whole if before[0] < d else before[1]
                mask[i] = got
        to = np.cumsum([0, *each])
        return pa.table({"chunk": t["chunk"], "bucket": t["shard"], "data": [mask[a:b].tobytes() for a, b in zip(to, to[1:])]}, schema=_MASKS)

    return stream


def _cut(k: int, buckets: int, shards: int, schema: pa.Schema):
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        c = Chunk(left, k)
        w = c.words
        head, n, shard, _, first = _distinct_runs(c, _replies(right, 0), buckets, shards)
        got = _replies(right, 1)
        masks = np.frombuffer(b"".join(got[i] for i in sorted(got)), np.uint32)
        cls = np.cumsum(first) - 1
        # beyond the least document of a run in this chunk, all of its windows are known
        mine = np.where(c.doc[head] == c.doc[head[first]][cls], masks[cls], np.uint32(0xFFFFFFFF)) if len(head) else masks
        edge = np.zeros(len(w.hash) + 1, np.int32)
        for j in range(int(n.max()) if len(n) else 0):
            hit = (n > j) & ((mine >> np.uint32(j)) & np.uint32(1) == 1)
            at = c.at[head[hit]] + j
            np.add.at(edge, at, 1)
            np.add.at(edge, at + k, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.offset[:-1], len(gone))) if len(w.count) else w.count
        removed = np.where(w.count > 0, removed, 0)
        kept, spans = [], []
        s, e, data = w.start.tolist(), w.end.tolist(), w.data
        for d in range(len(w.count)):
            a, b = int(w.offset[d]), int(w.offset[d + 1])
            if removed[d]:
                g = gone[a:b]
                kept.append(b" ".join([data[s[i] : e[i]] for i in (np.flatnonzero(~g) + a).tolist()]))
                flip = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"start": int(x), "words": int(y - x)} for x, y in zip(flip[::2], flip[1::2])])
            else:
                kept.append(b" ".join(data[s[a] : e[b - 1]].split()) if b > a else b"")
                spans.append([])
        out = left.drop_columns(["chunk"])
        extra = {"n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, schema.field("spans").type)}
        for name, col in extra.items():
            out = out.append_column(name, col)
        return out.cast(schema)

    return cut


def substring_dedup(docs: DataFrame, k: int = 13) -> DataFrame:
    """`docs` (doc_id, text, rest struct if present) with n_words, n_removed, kept (kept words joined by a space), spans (in words)."""
    if k < GRAM or k + RUN > 255:
        raise ValueError("k must be between 5 and 223")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    dealt, parts, buckets = chunks(docs)
    replies = materialise(count_documents(dealt.groupBy("chunk").applyInArrow(lean(_ask(k, buckets)), SENT)).withColumn("kind", F.lit(0)))
    shards = max(4, buckets * 4_000_000 // SHARD_BYTES)
    runs = dealt.groupBy("chunk").cogroup(replies.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(lean_pair(_send_runs(k, buckets, shards)), RUNS)
    masks = runs.groupBy("shard").applyInArrow(lean(_stream(k)), SENT).withColumn("kind", F.lit(1))
    span = StructType([StructField("start", LongType()), StructField("words", LongType())])
    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType()), StructField("spans", ArrayType(span))])
    both = replies.unionByName(masks).repartition(parts, "chunk")
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(lean_pair(_cut(k, buckets, shards, to_arrow_schema(schema))), schema)


def without_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """`docs` with repeated passages cut from the texts and n_chars renewed; texts without any stay as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = substring_dedup(docs.select("doc_id", "text", F.struct(*rest).alias("rest")) if rest else docs.select("doc_id", "text"), k)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    columns = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col("rest")[c] for c in rest}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(columns[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS owner FROM g GROUP BY win HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f USING (win) WHERE f.owner < g.doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE [x FOR x, i IN ws IF NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
