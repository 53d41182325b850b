"""Operator 1: nearest neighbours by vantage-point trees per shard.

Largest inner product becomes least Euclidean distance when each vector gets
one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and queries a
zero there.  Tasks cut their vectors into shards of bounded size, build a tree
for each, and write shards with their trees to the shared folder, once.  A shard is searched with a block of
queries at once: a branch is left out
for the queries whose triangle bound, times `factor`, exceeds the distance of
their k-th best so far.  A factor of one is exact search; a larger one prunes more.
The first bounds come from a bounded sample of vectors.

Equal vectors are one class with its k + 1 least ids and the rows of each, which
suffice for every answer, so thousands of copies cost one entry.  An id in one
class takes one entry of its query's k + 1 (by score, then id) however many rows bear it; a query whose
id stands in several classes is searched on its own and never meets its own rows.
Queries go in blocks of bounded size, broadcast one after another and let go; a block reads the written shards.

Defined results: vectors that are null, zero, hold null or non-finite components
or have another length than most, or a null vec_id, take no part, as queries or candidates;
repeated vec_ids are separate rows, and a query leaves out every row of its own
id; fewer candidates than k give fewer rows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARD = 8192
SHARD_BYTES = 16_000_000
LEAF = 64
QUERIES = 32768
SEEDS = 2048
FACTOR = 1.0
LAST = np.iinfo(np.int64).max


class Tree:
    """Vantage-point tree over the rows of `x`; nodes are (vantage, inside, outside, bounds) or arrays of rows."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x = x
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        x = self.x[rows]
        tries = self.rng.choice(len(rows), min(4, len(rows)), replace=False)
        far = [np.linalg.norm(x - x[i], axis=1) for i in tries]
        best = int(np.argmax([d.std() for d in far]))
        d, v = far[best], rows[tries[best]]
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        a, b = order[:half], order[half:]
        return v, self._build(rows[a]), self._build(rows[b]), ((d[a].min(), d[a].max()), (d[b].min(), d[b].max()))


class Search:
    """The best k of each query, over any number of trees."""

    def __init__(self, q: np.ndarray, top: float, k: int, factor: float, own: np.ndarray | None = None, has_own: np.ndarray | None = None):
        """own: the id whose classes a query leaves out, where has_own."""
        self.q, self.k, self.factor, self.own = q, k, factor, own
        self.has_own = np.zeros(len(q), bool) if has_own is None else has_own
        self.square = (q * q).sum(1) + top * top
        self.score = np.full((len(q), k), -np.inf)
        self.row = np.full((len(q), k), -1, np.int64)
        self.id = np.full((len(q), k), LAST)  # the least id of each class that is not the query's own
        self.bound = np.full(len(q), np.inf)  # distance of the k-th best

    def distance(self, score: np.ndarray, who: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[who].reshape(-1, *[1] * (score.ndim - 1)) - 2 * score, 0))

    def leave_out(self, s: np.ndarray, who: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores without the classes of a query's own id alone, and the least other id of each class; ids: the two least of each class, or LAST."""
        least = np.broadcast_to(ids[:, 0], s.shape)
        mine = np.flatnonzero(self.has_own[who])
        if len(mine):
            least = least.copy()
            own = self.own[who[mine]][:, None] == ids[:, 0]
            least[mine] = np.where(own, ids[:, 1], least[mine])
            s[mine] = np.where(own & (ids[:, 1] == LAST), -np.inf, s[mine])
        return s, least

    @staticmethod
    def two_least(vectors: np.ndarray) -> np.ndarray:
        """Ids by row, where the caller has none."""
        return np.stack((np.arange(len(vectors)), np.full(len(vectors), LAST)), 1)

    def seed(self, x: np.ndarray, ids: np.ndarray) -> None:
        """Bounds from a sample; its rows are found again in their shards."""
        if len(x) >= self.k:
            for a in range(0, len(self.q), 4096):
                who = np.arange(a, min(a + 4096, len(self.q)))
                kth = np.partition(self.leave_out(self.q[who] @ x.T, who, ids)[0], len(x) - self.k, axis=1)[:, len(x) - self.k]
                self.bound[who] = self.distance(kth, who)

    def run(self, root, vectors: np.ndarray, base: int, ids: np.ndarray | None = None) -> None:
        """root: of the tree; vectors: the tree's rows without the added coordinate; base: number of the first; ids: the two least of each."""
        self.ids = self.two_least(vectors) + [base, 0] if ids is None else ids
        stack = [(root, np.arange(len(self.q)))]
        while stack:
            node, who = stack.pop()
            if isinstance(node, tuple) and len(who):
                v, inside, outside, bounds = node
                d = self.distance(self.q[who] @ vectors[v], who)
                some = []
                for child, (lo, hi) in zip((inside, outside), bounds):
                    gap = np.maximum(np.maximum(d - hi, lo - d), 0)
                    near = gap * self.factor <= self.bound[who] * (1 + 1e-9) + 1e-7 * np.sqrt(self.square[who])
                    some.append((float(gap.sum()), child, who[near]))
                some.sort(key=lambda s: -s[0])  # the nearer child is popped first
                stack += [s[1:] for s in some]
            elif len(who):
                self._leaf(node, who, vectors, base)

    def _leaf(self, rows: np.ndarray, who: np.ndarray, vectors: np.ndarray, base: int) -> None:
        for a in range(0, len(who), 8192):
            w = who[a : a + 8192]
            s, least = self.leave_out(self.q[w] @ vectors[rows].T, w, self.ids[rows])
            better = s.max(1) >= self.score[w, -1]
            w, s, least = w[better], s[better], least[better]
            if not len(w):
                continue
            score = np.concatenate((self.score[w], s), 1)
            least = np.concatenate((self.id[w], least), 1)
            row = np.concatenate((self.row[w], np.where(s > -np.inf, rows + base, -1)), 1)
            best = np.lexsort((least, -score), axis=1)[:, : self.k]
            self.score[w], self.row[w], self.id[w] = (np.take_along_axis(x, best, 1) for x in (score, row, least))
            full = self.row[w, -1] >= 0
            self.bound[w[full]] = np.minimum(self.bound[w[full]], self.distance(self.score[w[full], -1], w[full]))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _two_least(ids) -> np.ndarray:
    """The two least ids of each class, LAST for none, of lists of ids in order."""
    return np.array([(*i[:2], LAST, LAST)[:2] for i in ids], np.int64).reshape(-1, 2)


_HIT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("own", pa.int64()), ("hits", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("rows", pa.int64())])))])
HIT = "a bigint, b bigint, own bigint, hits array<struct<score:double,vec_id:bigint,rows:bigint>>"


def _builder(top: float):
    """Shards of (ids, embedding) rows, each with its tree, pickled for `_searcher`."""

    def build(batches):
        x, ids = [], []

        def shard() -> pa.RecordBatch:
            v = np.concatenate(x)
            root = Tree(np.concatenate((v, np.sqrt(np.maximum(top * top - (v * v).sum(1), 0))[:, None]), 1)).root
            made = pickle.dumps((root, v, [[(e["vec_id"], e["rows"]) for e in i] for i in ids]), 5)
            x.clear()
            ids.clear()
            return pa.RecordBatch.from_pydict({"shard": pa.array([made], pa.binary())})

        for b in batches:
            v, of = _matrix(b["embedding"]), b["ids"].to_pylist()
            most = max(LEAF, min(SHARD, SHARD_BYTES // (8 * v.shape[1])))
            for a in range(0, len(v), most):
                if len(ids) + len(v[a : a + most]) > most:
                    yield shard()
                x.append(v[a : a + most])
                ids.extend(of[a : a + most])
        if ids:
            yield shard()

    return build


def _searcher(shared, k: int, factor: float):
    def run(batches):
        qa, qb, own, q, top, seeds, least = shared.value
        has_own = np.array([i is not None for i in own], bool)
        found = Search(q, top, k, factor, np.array([i or 0 for i in own], np.int64), has_own)
        found.seed(seeds, least)
        ids: list[list[tuple[int, int]]] = []
        for b in batches:
            for s in b["shard"]:
                root, x, of = pickle.loads(s.as_buffer())
                found.run(root, x, len(ids), _two_least([i for i, _ in o] for o in of))
                ids += of
        if not ids:
            return
        for lo in range(0, len(q), 1000):
            hits = []
            for s, r, o in zip(found.score[lo : lo + 1000].tolist(), found.row[lo : lo + 1000].tolist(), own[lo : lo + 1000]):
                each = sorted((-x, i, n) for x, j in zip(s, r) if j >= 0 for i, n in ids[j] if i != o)[:k]
                hits.append([{"score": -x, "vec_id": i, "rows": n} for x, i, n in each])
            yield pa.RecordBatch.from_pydict({"a": qa[lo : lo + 1000], "b": qb[lo : lo + 1000], "own": own[lo : lo + 1000], "hits": hits}, schema=_HIT)

    return run


def nearest(vectors: DataFrame, is_query: str, k: int = 20, factor: float = FACTOR, block: int = QUERIES) -> DataFrame:
    """(vec_id, embedding): query_id, rank, vec_id, score of the k nearest of each row that `is_query` holds for."""
    spark = vectors.sparkSession
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable)
    most = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if most is None:
        return empty
    v = v.filter(F.size("embedding") == most.d).withColumn("a", F.xxhash64("embedding")).withColumn("b", F.xxhash64(F.lit("vp"), "embedding"))
    entries = v.groupBy("a", "b", "vec_id").agg(F.count("*").alias("rows"), F.first("embedding").alias("embedding"))
    order = Window.partitionBy("a", "b").orderBy("vec_id")
    few = entries.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    classes = materialise(few.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("vec_id", "rows"))).alias("ids"), F.first("embedding").alias("embedding")))
    # the k + 1 least entries of a class suffice, since a query leaves out one of them at most
    asked = v.filter(is_query).select("vec_id", "a", "b")
    several = entries.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").count().filter("count > 1").select("vec_id", F.col("vec_id").alias("own"))
    asked = materialise(asked.join(several, "vec_id", "left"))
    queries = materialise(classes.join(asked.select("a", "b", "own").distinct(), ["a", "b"]).select("a", "b", "own", "embedding"))
    count, n = queries.count(), classes.count()
    if not count:
        return empty
    top = classes.agg(F.sqrt(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] * (1 + 1e-12)
    sample = classes.orderBy("a", "b").limit(SEEDS).select("embedding", F.expr("slice(ids.vec_id, 1, 2)").alias("least")).collect()
    seeds, least = np.array([r.embedding for r in sample], np.float64), _two_least(r.least for r in sample)
    blocks = -(-count // block)
    dealt = classes.repartition(max(1, min(-(-n // LEAF), max(spark.sparkContext.defaultParallelism, -(-n // (4 * SHARD))))))
    shards = materialise(dealt.select("ids", "embedding").mapInArrow(_builder(top), "shard binary"))
    hits = None
    for i in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("b", "a", "own"), F.lit(blocks)) == i).toArrow()
        shared = spark.sparkContext.broadcast((rows["a"].to_numpy(), rows["b"].to_numpy(), rows["own"].to_pylist(), _matrix(rows["embedding"]), top, seeds, least))
        part = shards.mapInArrow(_searcher(shared, k + 1, factor), HIT)
        part = part.groupBy("a", "b", "own").agg(F.slice(F.sort_array(F.transform(F.flatten(F.collect_list("hits")), lambda h: F.struct((-h["score"]).alias("s"), h["vec_id"].alias("vec_id"), h["rows"].alias("rows")))), 1, k + 1).alias("hits"))
        if blocks > 1:
            part = materialise(part)
            shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    met = asked.alias("q").join(hits.alias("h"), F.expr("q.a = h.a AND q.b = h.b AND q.own <=> h.own")).select("vec_id", "hits")
    others = F.flatten(F.transform(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), lambda h: F.array_repeat(h, F.least(h["rows"], F.lit(k)).cast("int"))))
    each = met.select(F.col("vec_id").alias("query_id"), F.slice(others, 1, k).alias("h"))
    return each.select("query_id", F.posexplode("h").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
