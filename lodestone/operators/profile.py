"""Column profiles: one row a column.

One wide aggregate finds counts, ranges and, for text, a sketch of the distinct count; one pass
over bin numbers the histograms of 24 bins; one over (column, value) pairs the distinct counts and
top values of text.  Every pass aggregates before it shuffles.  Text columns of far more values than
the distinct count goes to (CROWDED) are not shuffled value by value: a sketch names the values that can stand in
more than one row of 4,097, and these alone are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import kind, number, text
from .predicates import column

BINS = 24
TOP = 30
DISTINCT_CAP = 4096
CROWDED = 50 * DISTINCT_CAP  # distinct values by the sketch
TRACKED = 20_000  # values that the sketch of frequent values keeps
SCHEMA = (
    "column string, kind string, n bigint, nulls bigint, trues bigint, falses bigint, count bigint, non_finite bigint, min double, max double, mean double, min_text string, max_text string, "
    "hist array<bigint>, distinct bigint, distinct_capped boolean, top array<struct<value:string,count:bigint>>, min_len bigint, max_len bigint, mean_len double, empties bigint"
)

NAMES = ["column", "kind", "n", "nulls", "trues", "falses", "count", "non_finite", "min", "max", "mean", "min_text", "max_text", "hist", "distinct", "distinct_capped", "top", "min_len", "max_len", "mean_len", "empties"]


def finite(c: Column, t: T.DataType) -> Column:
    x = number(c, t)
    return F.when(F.abs(x) < float("inf"), x)


def bin_of(x: Column, lo: float, hi: float) -> Column:
    """Bin 0..23 between two finite bounds; all in 0 where they are equal."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    # least() passes over NULLs
    return F.when(x.isNotNull(), F.least(F.lit(BINS - 1), F.floor((x - lo) / F.lit(hi - lo) * BINS).cast("int")))


def bounds(df: DataFrame, name: str) -> tuple[float, float] | None:
    x = finite(column(name), df.schema[name].dataType)
    r = df.agg(F.min(x), F.max(x)).first()
    return None if r[0] is None else (r[0], r[1])


def histogram(df: DataFrame, name: str) -> DataFrame:
    """(bin, n, lo, hi): rows and extreme values of each bin that has any."""
    b = bounds(df, name)
    x = finite(column(name), df.schema[name].dataType)
    lo, hi = b or (0.0, 0.0)
    return df.filter(x.isNotNull()).groupBy(bin_of(x, lo, hi).alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def bin_bounds(df: DataFrame, name: str, k: int) -> tuple[object, object] | None:
    """The least and greatest value in bin k, for a BETWEEN that selects exactly its rows."""
    b = bounds(df, name)
    if b is None:
        return None
    c = column(name)
    x = finite(c, df.schema[name].dataType)
    r = df.filter(bin_of(x, *b) == k).agg(F.min(c), F.max(c)).first()
    return None if r[0] is None else (r[0], r[1])


def top_values(df: DataFrame, name: str, k: int = TOP) -> DataFrame:
    return df.filter(column(name).isNotNull()).groupBy(column(name).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def profile(df: DataFrame) -> DataFrame:
    fields = {f"c{i}": f for i, f in enumerate(df.schema.fields)}
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, f in fields.items():
        c, t = column(f.name), f.dataType
        aggs.append(F.count(c).alias(f"{k}_n"))
        if kind(t) == "bool":
            aggs += [F.count_if(c).alias(f"{k}_t"), F.count_if(~c).alias(f"{k}_f")]
        elif kind(t) in ("number", "temporal"):
            x = finite(c, t)
            only = F.when(x.isNotNull(), c)
            aggs += [F.count(x).alias(f"{k}_c"), F.min(x).alias(f"{k}_lo"), F.max(x).alias(f"{k}_hi"), F.avg(x).alias(f"{k}_m"), text(F.min(only), t).alias(f"{k}_lt"), text(F.max(only), t).alias(f"{k}_ht")]
        else:
            size = F.length(c) if kind(t) in ("string", "binary") else F.lit(1) if isinstance(t, T.StructType) else F.size(c)
            size = F.when(c.isNotNull(), size)
            aggs += [F.min(size).alias(f"{k}_s"), F.max(size).alias(f"{k}_l"), F.avg(size).alias(f"{k}_a"), F.count_if(size == 0).alias(f"{k}_e")]
            if kind(t) == "string":
                aggs.append(F.approx_count_distinct(c).alias(f"{k}_d"))
    r = df.agg(*aggs).first()  # one row
    hist: dict[str, list[int]] = {}
    bins = []
    for i, (k, f) in enumerate(fields.items()):
        if kind(f.dataType) in ("number", "temporal"):
            hist[k] = [0] * BINS
            if r[f"{k}_lo"] is not None:
                bins.append(bin_of(finite(column(f.name), f.dataType), r[f"{k}_lo"], r[f"{k}_hi"]) + i * BINS)
    if bins:
        for x in df.select(F.explode(F.array(*bins)).alias("b")).filter("b IS NOT NULL").groupBy("b").count().collect():  # 24 rows a column
            hist[f"c{x.b // BINS}"][x.b % BINS] = x["count"]
    strings = [k for k, f in fields.items() if kind(f.dataType) == "string"]
    crowded = [k for k in strings if r[f"{k}_d"] > CROWDED]
    tops = _text_values(df, {k: fields[k].name for k in strings if k not in crowded}) | _frequent(df, {k: fields[k].name for k in crowded})
    rows = []
    for k, f in fields.items():
        d = dict.fromkeys(NAMES)
        d |= {"column": f.name, "kind": kind(f.dataType), "n": r["n"], "nulls": r["n"] - r[f"{k}_n"]}
        if kind(f.dataType) == "bool":
            d |= {"trues": r[f"{k}_t"], "falses": r[f"{k}_f"]}
        elif k in hist:
            d |= {"count": r[f"{k}_c"], "non_finite": r[f"{k}_n"] - r[f"{k}_c"], "min": r[f"{k}_lo"], "max": r[f"{k}_hi"], "mean": r[f"{k}_m"], "min_text": r[f"{k}_lt"], "max_text": r[f"{k}_ht"], "hist": hist[k]}
        else:
            d |= {"count": r[f"{k}_n"], "min_len": r[f"{k}_s"], "max_len": r[f"{k}_l"], "mean_len": r[f"{k}_a"], "empties": r[f"{k}_e"]}
            if k in tops:
                n, top = tops[k]
                d |= {"distinct": min(n, DISTINCT_CAP + 1), "distinct_capped": n > DISTINCT_CAP, "top": top}
        rows.append(tuple(d.values()))
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _text_values(df: DataFrame, names: dict[str, str]) -> dict[str, tuple[int, list]]:
    """Number of distinct values and the thirty most frequent ones of text columns, in one query."""
    tops: dict[str, tuple[int, list]] = {k: (0, []) for k in names}
    if not names:
        return tops
    values = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), column(n).cast("string").alias("v")) for k, n in names.items()))).alias("p")).filter("p.v IS NOT NULL")
    counts = values.groupBy("p.k", "p.v").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "v"))).filter(F.col("r") <= TOP)
    # counting n, not rows, keeps both sides' exchange the same, so it is computed once
    number = counts.groupBy("k").agg(F.count("n").alias("n")).select("k", F.lit(None).cast("string").alias("v"), "n", F.lit(0).alias("r"))
    for x in sorted(ranked.unionByName(number).collect(), key=lambda x: (x.k, x.r)):  # thirty-one rows a column
        if x.r:
            tops[x.k][1].append((x.v, x.n))
        else:
            tops[x.k] = (x.n, [])
    return tops


def _frequent(df: DataFrame, names: dict[str, str]) -> dict[str, tuple[int, list]]:
    """For columns of very many values: beyond the cap, and exact counts of those that stand in more than one row of DISTINCT_CAP + 1."""
    if not names:
        return {}
    sketch = df.agg(*(F.expr(f"approx_top_k({_quoted(n)}, {DISTINCT_CAP}, {TRACKED})").alias(k) for k, n in names.items())).first()
    out: dict[str, tuple[int, list]] = {k: (DISTINCT_CAP + 1, []) for k in names}
    seen = {k: [x["item"] for x in sketch[k] if x["item"] is not None] for k in names}
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.when(column(n).isin(seen[k]), column(n).cast("string")).alias("v")) for k, n in names.items() if seen[k]))
    if any(seen.values()):
        for x in df.select(F.explode(pairs).alias("p")).filter("p.v IS NOT NULL").groupBy("p.k", "p.v").agg(F.count("*").alias("n")).orderBy("k", F.desc("n"), "v").collect():
            if len(out[x.k][1]) < TOP:
                out[x.k][1].append((x.v, x.n))
    return out


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Profiles:
    """Profiles of a table by WHERE clause and column, each found once."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.known: dict[tuple, dict[str, tuple]] = {}

    def get(self, filters: tuple = (), columns: list[str] | None = None) -> DataFrame:
        """Rows of `profile` for the columns over the rows that meet the clauses."""
        from .predicates import compile_where

        have = self.known.setdefault(filters, {})
        wanted = columns or self.df.columns
        new = [c for c in wanted if c not in have]
        if new:
            where, _ = compile_where(filters, self.df.schema)
            rows = self.df if where is None else self.df.filter(where)
            have |= {r.column: tuple(r) for r in profile(rows.select(*(column(c) for c in new))).collect()}
        return self.df.sparkSession.createDataFrame([have[c] for c in wanted], SCHEMA)
