"""Operator 8: exact n-gram Jaccard join with token-combination prefixes.

Shingles are ordered rarest first (census of documents, then hash).  A document
indexes, from a prefix extended by one, its rare shingles alone and its
frequent shingles in combinations of two: two sets with the wanted overlap
share at least two shingles of the extended prefixes, so either the rarer of
them is indexed alone or both are frequent and their combination is indexed.
Shingles found in one set only are never indexed.  Documents with equal
sets form one class and are joined once.  Classes that share a key form a
candidate group (components over one link to the least class of each key).

A group of up to a block is verified at once, by a matrix product of its sets,
which emits a spanning forest and never the pairs.  In a larger group the sets that share their least
key under a random order meet, in blocks, and the roots of the forests meet again under
another order, level by level, so a group of near copies costs about one pass
however large it is.  What is left are keys whose classes lie in components that
are still apart: only classes that share such a key and could resemble each other by their sizes
are verified, key by key, in blocks.  So a group that hangs together by chance keys never meets as a whole.

Defined results: null and wordless texts have no shingles and component_id =
doc_id; repeated rows are equal sets and share a component; links are kept between
sets, so rows that share a doc_id or have none are linked by their texts only; a null
doc_id counts as the largest; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .census import MISSING, SENT, chunks, code, count_documents, read_replies, send, sent_table, texts_of
from .common import WORD, components, free_name, lean, lean_pair, materialise, table
from .words import Words, mix

FREQUENT = 100  # documents; shingles in more are indexed by combinations
MOST_FREQUENT = 48  # frequent shingles in one prefix; beyond, they are indexed alone as well
BLOCK = 512  # classes
BLOCK_BYTES = 16_000_000
LEVELS = 3  # orders of the keys by which the sets of a large group meet
U = np.uint64


def shingle_sets(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash), distinct and sorted; a text of fewer than n words is one shingle."""
    w = Words(texts, lower=True)
    h, inside = w.grams(n)
    doc, hashes = [w.doc[: len(h)][inside]], [h[inside]]
    for k in range(1, n):
        short = np.flatnonzero(w.count == k)
        if len(short):
            g, _ = w.grams(k)
            doc.append(short)
            hashes.append(mix(g[w.offset[short]] + U(k)))
    doc, hashes = np.concatenate(doc), np.concatenate(hashes)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


class Chunk:
    """The sets of a chunk's documents, by class of equal sets."""

    def __init__(self, t: pa.Table, n: int):
        self.ids = np.asarray(t["doc_id"].fill_null(MISSING).to_numpy(), np.int64)
        doc, self.hashes = shingle_sets(texts_of(t), n)
        self.offset = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        self.size = np.diff(self.offset)
        total = [np.concatenate(([U(0)], np.cumsum(mix(self.hashes * U(m))))) for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        digest = [mix(x[self.offset[1:]] - x[self.offset[:-1]] + self.size.astype(U)) for x in total]
        self.digest = np.stack(digest, 1).view(np.int64)
        some = np.flatnonzero(self.size)
        order = some[np.lexsort((self.ids[some], self.digest[some, 1], self.digest[some, 0]))]
        first = np.ones(len(order), bool)
        first[1:] = (self.digest[order[1:]] != self.digest[order[:-1]]).any(1)
        self.classes = order[first]  # the least document of each
        keep = np.zeros(len(self.ids), bool)
        keep[self.classes] = True
        mine = self.hashes[keep[doc]]
        self.distinct, self.local = np.unique(mine, return_counts=True)


def _ask(n: int, buckets: int):
    def ask(t: pa.Table) -> pa.Table:
        return sent_table(send(t["chunk"][0].as_py(), (c := Chunk(t, n)).distinct, c.local, buckets))

    return ask


def index_keys(hashes: np.ndarray, seen: np.ndarray, unique: np.ndarray, size: int, percent: int) -> list[int]:
    """Keys of one set: hashes and their census, with those that stand in this set only."""
    least = -(-size * percent // 100)
    if least < 2:  # a set of one shingle resembles none but its equals
        return []
    order = np.lexsort((hashes, seen))[: size - least + 2]
    order = order[~unique[order]]
    common = seen[order] > code(FREQUENT)
    keys = [hashes[order[~common]]]
    f = hashes[order[common]]
    if len(f) <= MOST_FREQUENT:
        a, b = np.triu_indices(len(f), 1)
        keys.append(mix(f[a] * U(3) + mix(f[b])))
    return np.concatenate(keys).view(np.int64).tolist()


_FOUND = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("keys", pa.list_(pa.int64())), ("alone", pa.list_(pa.int64())), ("wide", pa.bool_()), ("cells", pa.list_(pa.int64())), ("tokens", pa.binary())])
FOUND = "doc_id bigint, n bigint, c1 bigint, c2 bigint, h bigint, g bigint, keys array<bigint>, alone array<bigint>, wide boolean, cells array<bigint>, tokens binary"


def _index(n: int, buckets: int, percent: int):
    def index(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _FOUND.empty_table()
        c = Chunk(left, n)
        seen = read_replies(dict(zip(right["bucket"].to_pylist(), right["data"].to_pylist())), c.distinct, buckets)
        at = np.searchsorted(c.distinct, c.hashes)
        at = np.minimum(at, max(0, len(c.distinct) - 1))
        seen_all, unique_all = seen[at], seen[at] == 1
        left_over = np.concatenate(([0], np.cumsum(~unique_all)))
        rows = {f.name: [] for f in _FOUND}
        rows["doc_id"], rows["n"] = c.ids.tolist(), c.size.tolist()
        rows["c1"], rows["c2"] = c.digest[:, 0].tolist(), c.digest[:, 1].tolist()
        rows["h"], rows["g"] = left["h"].to_pylist(), left["g"].to_pylist()
        for k in ("keys", "alone", "wide", "cells", "tokens"):
            rows[k] = [None] * len(c.ids)
        for d in c.classes.tolist():
            a, b = c.offset[d], c.offset[d + 1]
            if (left_over[b] - left_over[a]) * 100 < percent * (b - a):
                continue  # fewer shared shingles than any link needs
            h, s, u = c.hashes[a:b], seen_all[a:b], unique_all[a:b]
            keys = index_keys(h, s, u, b - a, percent)
            order = np.lexsort((h, s))[: (b - a) - -(-(b - a) * percent // 100) + 2]
            f = order[(s[order] > code(FREQUENT)) & ~u[order]]
            if keys or len(f):
                rows["keys"][d], rows["tokens"][d] = keys, h[~u].tobytes()
                rows["alone"][d], rows["wide"][d] = h[f].view(np.int64).tolist(), len(f) > MOST_FREQUENT
                all_keys = np.concatenate((np.array(keys, np.int64).view(U), h[f]))
                rows["cells"][d] = [int(mix(all_keys + U(j)).min().view(np.int64)) for j in range(LEVELS)]
        return pa.table(rows, schema=_FOUND)

    return index


def _intersections(tokens: list[np.ndarray], rows: slice, cols: slice) -> np.ndarray:
    """Sizes of the pairwise intersections of two ranges of the sets, by slices of the vocabulary."""
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    flat = np.concatenate(tokens)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    at = np.where(n[at] > 1, (np.cumsum(n > 1) - 1)[at], -1)
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)
    width = 4096
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, (lo, lo + width))
        m = np.zeros((len(tokens), width), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        total += m[rows] @ m[cols].T
    return total


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
EDGE = "a bigint, b bigint"


def _verify(percent: int):
    """Links of a block, or between two (`second` tells them apart), as a spanning forest: each node to the least of its tree."""

    def verify(t: pa.Table) -> pa.Table:
        second = np.asarray(t["second"].to_numpy())
        order = np.lexsort((t["node"].to_numpy(), second))
        node, size, raw = np.asarray(t["node"].to_numpy())[order], np.asarray(t["n"].to_numpy())[order], t["tokens"].to_pylist()
        tokens = [np.frombuffer(raw[i], U) for i in order]
        n, first = len(node), int((~second).sum())
        rows, cols = (slice(0, first), slice(first, n)) if 0 < first < n else (slice(0, n), slice(0, n))
        both = _intersections(tokens, rows, cols)
        linked = 100 * both >= percent * (size[rows][:, None] + size[cols][None, :] - both)
        i, j = np.nonzero(linked)
        rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")
        label, by_rank = np.arange(n), np.argsort(rank, kind="stable")
        i, j = rank[i + rows.start], rank[j + cols.start]
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(label != np.arange(n))
        return pa.table({"a": node[by_rank[some]], "b": node[by_rank[label[some]]]}, schema=_EDGE)

    return verify


def _blocks(block: int):
    """Blocks that the rows of a group need."""
    return F.expr(f"cast(ceil(greatest(count(*) / {block}, sum(octet_length(tokens)) / {BLOCK_BYTES})) as int)")


def _inside(level: DataFrame, percent: int, block: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups of several blocks, links found inside blocks)."""
    # written out, so that their size is known when Spark chooses the join: small, it leaves the sets where they are
    large = materialise(level.groupBy("grp").agg(_blocks(block).alias("blocks")).filter("blocks > 1").select("grp", F.lit(True).alias("large")))
    cell = F.when(F.col("large"), F.col("cells")[salt % LEVELS])
    rows = level.join(large, "grp", "left").withColumn("cell", cell)
    crowded = materialise(rows.filter("large").select("grp", "cell", "tokens").groupBy("grp", "cell").agg(_blocks(block).alias("blocks")).filter("blocks > 1"))
    placed = rows.join(crowded.withColumnsRenamed({"grp": "_grp", "cell": "_cell"}), F.expr("grp = _grp AND cell = _cell"), "left")
    number = F.pmod(F.xxhash64("node", F.lit(salt)), F.coalesce("blocks", F.lit(1)))
    # dealt by block too: rows that a join left dealt by group would pass as grouped, with a whole group in one task
    dealt = placed.select("grp", F.coalesce("cell", F.lit(0)).alias("cell"), number.alias("block"), F.lit(False).alias("second"), "node", "n", "tokens").repartition("grp", "cell", "block")
    return rows.filter("large").select(*level.columns), materialise(dealt.groupBy("grp", "cell", "block").applyInArrow(lean(_verify(percent)), EDGE))


def _between(apart: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components (`comp`) of the classes (grp, node, comp, n, tokens) of a key (`grp`).

    Components of half a block or more have blocks of their own, which never meet each other; smaller ones share blocks
    with those of about their size.  Blocks whose sizes rule out the wanted resemblance do not meet.
    """
    own = apart.groupBy("grp", "comp").agg(F.expr(f"count(*) * 2 >= {block} OR sum(octet_length(tokens)) * 2 >= {BLOCK_BYTES}").alias("own")).filter("own")
    # small tables, written out so that joins with them leave the sets where they are
    own = materialise(own)
    rows = apart.join(own, ["grp", "comp"], "left").fillna(False, ["own"])
    rows = rows.withColumn("unit", F.when(F.col("own"), F.col("comp")).otherwise(F.floor(F.ln("n") / float(np.log(100 / min(percent, 99))))))
    units = rows.groupBy("grp", "own", "unit").agg(_blocks(block).alias("parts"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    others = units.select("grp", *(F.col(c).alias(f"other_{c}") for c in ("own", "unit", "parts", "lo", "hi")))
    pairs = units.join(others, "grp").filter(f"NOT (own AND other_own AND unit = other_unit) AND 100 * least(hi, other_hi) >= {percent} * greatest(lo, other_lo)")
    pairs = materialise(pairs.drop("lo", "hi", "other_lo", "other_hi"))
    rows = rows.join(pairs, ["grp", "own", "unit"]).withColumn("part", F.pmod(F.when(F.col("own"), F.xxhash64("node")).otherwise(F.xxhash64("comp")), F.col("parts")).cast("int"))
    rows = rows.withColumn("other_part", F.explode(F.expr("sequence(0, other_parts - 1)")))
    rows = rows.withColumn("mine", F.struct("own", "unit", "part")).withColumn("other", F.expr("named_struct('own', other_own, 'unit', other_unit, 'part', other_part)"))
    sided = rows.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), "node", "n", "tokens").repartition("grp", "i", "j")
    return sided.groupBy("grp", "i", "j").applyInArrow(lean(_verify(percent)), EDGE)


def _entries(indexed: DataFrame, *carry: str) -> DataFrame:
    """(key, c1, wide, carry) of classes; a key counts where a class of it is wide; carry: columns that depend on c1."""
    single = indexed.select("c1", *carry, F.explode("keys").alias("key"), F.lit(True).alias("wide"))
    # frequent shingles alone link only where one side has too many of them for combinations
    alone = indexed.select("c1", *carry, F.explode("alone").alias("key"), "wide")
    return single.unionByName(alone).groupBy("key", "c1", *carry).agg(F.max("wide").alias("wide"))


def verified_components(classes: DataFrame, indexed: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, comp) over all links between `classes` (grp, node, n, cells, tokens) of one group; indexed: (c1, keys, alone, wide) of each node."""
    several, links = _inside(classes, percent, block, 0)
    several = materialise(several)
    level, salt = several, 0
    while True:
        # the roots of the forests stand for their trees
        roots = materialise(level.join(links.select(F.col("a").alias("node")), "node", "left_anti").select(*classes.columns))
        left = roots.count()
        if not left or (salt >= LEVELS - 1 and left * 2 > before):
            break
        before, salt = left, salt + 1
        level, more = _inside(roots, percent, block, salt)
        links = links.unionByName(more)
    known = components(links)
    if not salt:
        return known
    labelled = materialise(several.join(known, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "n", "tokens"))
    # a class meets its component once, before its keys are listed
    entries = _entries(indexed.join(labelled.select(F.col("node").alias("c1"), "comp"), "c1"), "comp")
    open_keys = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("wide").alias("wide")).filter("lo <> hi AND wide").select("key")
    apart = entries.join(open_keys, "key").select(F.col("key").alias("grp"), F.col("c1").alias("node")).join(labelled, "node")
    more = materialise(_between(materialise(apart), percent, block))
    return components(links.unionByName(more))


def _hashes() -> list:
    """Two hashes that tell texts apart."""
    return [F.xxhash64("text").alias("h"), F.xxhash64(F.lit("g"), "text").alias("g")]


def _joined(docs: DataFrame, n: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their set, c1 and c2; for each set its component `comp` and its first row: doc_id, h, g)."""
    dealt, parts, buckets = chunks(docs.select("doc_id", "text", *_hashes()))
    replies = count_documents(dealt.groupBy("chunk").applyInArrow(lean(_ask(n, buckets)), SENT)).repartition(parts, "chunk")
    found = materialise(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lean_pair(_index(n, buckets, percent)), FOUND))
    indexed = found.filter("tokens IS NOT NULL")
    entries = _entries(indexed)
    pivots = entries.groupBy("key").agg(F.min("c1").alias("b"), F.count("*").alias("m"), F.max("wide").alias("wide")).filter("m > 1 AND wide").select("key", "b")
    groups = components(entries.select("key", F.col("c1").alias("a")).join(pivots, "key").select("a", "b"))
    classes = indexed.join(groups.select(F.col("node").alias("c1"), F.col("comp").alias("grp")), "c1").groupBy("grp", "c1", "c2").agg(F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("tokens").alias("tokens"))
    comp = verified_components(materialise(classes.select("grp", F.col("c1").alias("node"), "n", "cells", "tokens")), indexed, percent, block)
    sets = found.filter("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "h", "g")).alias("first"))
    return found, sets.join(comp.withColumnRenamed("node", "c1"), "c1", "left").select("c1", "c2", "first", F.coalesce("comp", "c1").alias("comp"))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    found, sets = _joined(docs, n, percent, block)
    sets = materialise(sets)
    named = sets.join(sets.groupBy("comp").agg(F.min("first.doc_id").alias("least")), "comp").select("c1", "c2", "least")
    doc = F.expr(f"nullif(doc_id, {MISSING})")
    full = found.filter("n > 0").select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2"])
    return full.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.expr(f"nullif(least, {MISSING})").alias("component_id")).unionByName(
        found.filter("n = 0").select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), doc.alias("component_id"))
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents that stay: one row of each component, that of the least doc_id; texts without words resemble none and stay."""
    _, sets = _joined(docs, 5, 80, BLOCK)
    i, h, g, n = names = [free_name(docs, c) for c in ("_id", "_h", "_g", "_n")]
    first = sets.groupBy("comp").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(i), F.col("first.h").alias(h), F.col("first.g").alias(g))
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = docs.filter(words).withColumns(dict(zip(names, (F.coalesce("doc_id", F.lit(MISSING)), *_hashes()))))
    # rows of one doc_id and text differ in other columns at most
    same = Window.partitionBy(i, h, g).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    one = keyed.join(first, [i, h, g], "left_semi").withColumn(n, F.row_number().over(same)).filter(F.col(n) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*columns).unionByName(docs.filter(~words).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


#: Links by a self-join of the shingles, components by the transitive closure of the links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)]) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""
