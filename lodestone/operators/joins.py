"""Inner equi-joins with the output counted first, and their provenance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions.kinds import kind, text
from .predicates import column


@dataclass(frozen=True)
class Table:
    """A frame with its name and the joins that made it: (table, key, its key) of each."""

    df: DataFrame
    name: str = "data"
    joins: tuple[tuple[str, str, str], ...] = ()
    base: Table | None = None
    skipped: tuple[str, ...] = field(default=(), compare=False)

    def undo(self) -> Table:
        return self.base or self


def guess_keys(a: DataFrame, b: DataFrame) -> tuple[str, str] | None:
    """The first pair of equal names, whatever their case, of columns that are not nested."""
    other = {f.name.lower(): f.name for f in reversed(b.schema.fields) if kind(f.dataType) != "nested"}
    return next(((f.name, other[f.name.lower()]) for f in a.schema.fields if kind(f.dataType) != "nested" and f.name.lower() in other), None)


def _keys(a: DataFrame, b: DataFrame, ka: str, kb: str) -> tuple[Column, Column]:
    ta, tb = a.schema[ka].dataType, b.schema[kb].dataType
    ca, cb = column(ka), column(kb)
    if kind(ta) == kind(tb) and kind(ta) != "nested" and (kind(ta) != "temporal" or ta == tb):
        return ca, cb
    return text(ca, ta, full_binary=True), text(cb, tb, full_binary=True)


def estimate_rows(a: DataFrame, b: DataFrame, ka: str, kb: str) -> int:
    """The exact number of rows of the join, from key counts alone."""
    x, y = _keys(a, b, ka, kb)
    na = a.groupBy(x.alias("k")).agg(F.count("*").alias("na"))
    nb = b.groupBy(y.alias("k")).agg(F.count("*").alias("nb"))
    return int(na.join(nb, "k").agg(F.sum(F.col("na").cast("decimal(38,0)") * F.col("nb"))).first()[0] or 0)


def joined_names(a: DataFrame, b: DataFrame, kb: str) -> list[tuple[str, str]]:
    """(B's column, its name in the result) of all but the key."""
    taken = set(a.columns)
    return [(c, f"b_{c}" if c in taken else c) for c in b.columns if c != kb]


def join(a: Table, b: Table, ka: str, kb: str, max_rows: int | None = None) -> Table:
    """All of A's columns, then B's but its key; NULL keys never match.  Spark picks the build side and filters the other at run time."""
    for t, k in ((a, ka), (b, kb)):
        if k not in t.df.columns:
            raise Refusal("no such column", f"{t.name} has no column {k}")
    if max_rows is not None and (n := estimate_rows(a.df, b.df, ka, kb)) > max_rows:
        width = len(a.df.columns) + len(b.df.columns) - 1
        raise Refusal("join size", f"the join would make {n:,} rows of {width} columns; the limit is {max_rows:,}")
    x, y = _keys(a.df, b.df, ka, kb)
    names = joined_names(a.df, b.df, kb)
    left = a.df.select("*", x.alias("_key"))
    right = b.df.select(*(column(c).alias(n) for c, n in names), y.alias("_key"))
    out = left.join(right, "_key").select(*(column(c) for c in a.df.columns), *(column(n) for _, n in names))
    return Table(out, a.name, (*a.joins, (b.name, ka, kb)), a.base or a)
