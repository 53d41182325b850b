"""Session helpers shared by the operators: tables, durable intermediates, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


LARGE_GROUP = 1_000_000  # bytes
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers outlive their tasks and would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`f` of a group; after a large one no freed memory stays with the worker."""

    def go(t: pa.Table) -> pa.Table:
        out = f(t)
        if t.nbytes > LARGE_GROUP:
            give_back()
        return out

    return go


def lean_pair(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """`lean` for cogroups."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        if left.nbytes > LARGE_GROUP:
            give_back()
        return out

    return go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir.  Only a local session without one (tests) gets a temporary folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's setting to remove a query's shuffle files when it ends, and not when the driver next collects garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    path, conf = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_TIDY, None)
    conf.set(_TIDY, "true")  # what was written needs its shuffles no more
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_TIDY) if before is None else conf.set(_TIDY, before)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: computed once, lineage cut, safe to lose executors.

    The table stays as long as the returned frame may be read, which is until the session's folder is cleared.
    """
    return _written(df)[1]


def _forget(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    while any(c.lower() == name.lower() for c in df.columns):
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _with_least(pairs: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """(a, b) with m of `least` (a, m, n: number of a's pairs).

    Nodes of more than `hot` pairs meet their least value by broadcast, so a hub's pairs stay
    where they are; there are at most 2 * pairs / hot of these, which the caller bounds.
    """
    hubs = F.broadcast(least.filter(F.col("n") > hot).select(F.col("a").alias("hub"), F.col("m").alias("hub_m")))
    marked = pairs.join(hubs, F.col("a") == F.col("hub"), "left")
    others = marked.filter("hub IS NULL").select("a", "b").join(least.filter(F.col("n") <= hot).select("a", "m"), "a")
    return others.select("a", "b", "m").unionByName(marked.filter("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")))


HUBS = 100_000  # nodes that may be broadcast
HUB = 64  # pairs of a node, below which it is no hub


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs as (node, comp), comp the smallest node id.

    Alternates large-star and small-star contraction, which needs a logarithmic
    number of rounds; each round is written out, so no lineage builds up and
    nothing is gathered on the driver but a checksum.  The minimum of a
    neighbourhood is a partial aggregate, and a hub's pairs are never sent to one task.
    """
    spark = edges.sparkSession
    path, e = _written(edges.filter("a <> b").select("a", "b").distinct())
    before, size = None, e.count()
    for _ in range(max_rounds):
        hot = max(HUB, 4 * size // HUBS)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        # large star: every larger neighbour of `a` points to the least of a's neighbourhood
        large = _with_least(both, low, hot).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours and `a` itself point to the least of them
        between, down = _written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())  # keeps plans small
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(down, least, hot).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        last = path
        path, e = _written(small)
        _forget(spark, last)
        _forget(spark, between)
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before, size = now, now[0]
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
