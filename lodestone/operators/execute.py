"""A QuerySpec over a DataFrame: rows, groups, grouping sets or a pivot; then order and limit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions.kinds import number, sort_key, text
from ..plans.spec import Filter, Metric, QuerySpec, Sort
from .metrics import QUANTILES, metric
from .predicates import column, compile_where
from .quantiles import exact_quantiles

CUBE_COLUMNS = 8
PIVOT_VALUES = 50


@dataclass(frozen=True)
class Result:
    df: DataFrame
    skipped: tuple[tuple[Filter, str], ...] = ()  # clauses that were left out, with the reason
    covers: str = "all rows"


def order_by(df: DataFrame, sorts: tuple[Sort, ...], tie: str | None = None) -> DataFrame:
    """Missing values, NaN among them, come last in either direction; `tie` makes the order total."""
    keys = [(k.desc_nulls_last() if s.descending else k.asc_nulls_last()) for s in sorts for k in [sort_key(column(s.column), df.schema[s.column].dataType)]]
    return df.orderBy(*keys, *([column(tie).asc()] if tie and tie in df.columns else [])) if keys or tie else df


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of an ordered frame."""
    return df.offset(number * size).limit(size)


def grouping_sets(n: int, mode: str) -> list[tuple[int, ...]]:
    """Which of n group columns each set keeps: rollup by prefixes, longest first; cube by all subsets."""
    if mode == "rollup":
        return [tuple(range(k)) for k in range(n, -1, -1)]
    if mode == "cube" and n <= CUBE_COLUMNS:
        subsets = [tuple(i for i in range(n) if bits >> i & 1) for bits in range(2**n)]
        return sorted(subsets, key=lambda s: (-len(s), s))
    return [tuple(range(n))]


def _grouped(df: DataFrame, keys: list[str], mode: str):
    cols = [column(k) for k in keys]
    if mode == "rollup":
        return df.rollup(*cols)
    if mode == "cube" and len(keys) <= CUBE_COLUMNS:
        return df.cube(*cols)
    return df.groupBy(*cols)


def modes(df: DataFrame, keys: list[str], sets: list[tuple[int, ...]], m: Metric, order_key: str | None) -> DataFrame:
    """`_k0`.., `_gid` and, as `_v`, the most frequent value of m.column.

    Ties go to the value seen first by `order_key`, or else to the least.  Values are
    counted once for the finest groups, and grouping sets add those counts up, so no
    group's values meet in one buffer and the rows are read once.
    """
    t = df.schema[m.column].dataType
    value = column(m.column)
    seen = F.min(column(order_key)) if order_key else F.min(text(value, t))
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.filter(value.isNotNull()).groupBy(*(column(k).alias(n) for k, n in zip(keys, names)), value.alias("_v")).agg(F.count("*").alias("_n"), seen.alias("_at"))
    if sets == [tuple(range(len(keys)))]:
        counts = counts.withColumn("_gid", F.lit(0).cast("long"))
    else:
        listed = [[*(F.col(names[i]) for i in s), F.col("_v")] for s in sets]
        counts = counts.groupingSets(listed, *map(F.col, (*names, "_v"))).agg(F.sum("_n").alias("_n"), F.min("_at").alias("_at"), F.shiftright(F.grouping_id().cast("long"), 1).alias("_gid"))
    return counts.groupBy(*names, "_gid").agg(F.min_by("_v", F.struct((-F.col("_n")).alias("n"), "_at")).alias("_v"))


def _points(m: Metric) -> list[float]:
    return [0.25, 0.75] if m.kind == "IQR" else [QUANTILES[m.kind]]


def _quantile(m: Metric, q: Column, points: list[float]) -> Column:
    at = [q[points.index(p)] for p in _points(m)]
    return at[1] - at[0] if m.kind == "IQR" else at[0]


def _measured(df: DataFrame, keys: list[str], ms: tuple[Metric, ...], mode: str, order_key: str | None) -> DataFrame:
    """`_k0`.. (the keys) and `_m0`.. (the metrics): names of its own, so that no alias can clash with a key or another alias.

    What merges by partial aggregates is found in one pass; quantiles of one column
    together, by counting bins (`quantiles`); MODE by counting values.
    """
    plain = df.select(*(column(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(column(c) for c in df.columns)) if keys else df
    names = [f"_k{i}" for i in range(len(keys))]
    sets = grouping_sets(len(keys), mode)
    several = len(sets) > 1
    gid = F.grouping_id().cast("long") if several else F.max(F.lit(0)).cast("long")
    exprs = [metric(m, df.schema).alias(f"_m{i}") for i, m in enumerate(ms) if m.kind not in ("MODE", "IQR", *QUANTILES)]
    out, frames = None, []
    columns: dict[str, list[int]] = {}
    for i, m in enumerate(ms):
        if m.kind in ("IQR", *QUANTILES):
            columns.setdefault(m.column, []).append(i)
        elif m.kind == "MODE":
            frames.append(modes(df, keys, sets, m, order_key).withColumnRenamed("_v", f"_m{i}"))
    for c, at in columns.items():
        points = sorted({p for i in at for p in _points(ms[i])})
        q, complete = exact_quantiles(df, keys, number(column(c), df.schema[c].dataType), points, sets)
        q = q.select(*names, "_gid", *(_quantile(ms[i], F.col("q"), points).alias(f"_m{i}") for i in at))
        if complete and not exprs and out is None:
            out = q  # every group is there already
        else:
            frames.append(q)
    if out is None:
        out = (_grouped(plain, names, mode) if keys else plain.groupBy()).agg(*exprs, gid.alias("_gid"))
    for other in frames:
        cond = F.coalesce(out["_gid"], F.lit(0)) == other["_gid"]
        for n in names:
            cond = cond & out[n].eqNullSafe(other[n])
        out = out.join(other, cond, "left").drop(other["_gid"], *(other[n] for n in names))
    return out.select(*names, *(f"_m{i}" for i in range(len(ms))))


def aggregate(df: DataFrame, q: QuerySpec) -> DataFrame:
    """Group columns in their order, then metrics; without metrics, the distinct groups."""
    keys = list(dict.fromkeys(q.group_by))
    mode = q.group_mode if len(grouping_sets(len(keys), q.group_mode)) > 1 else "flat"
    if not q.metrics:
        plain = df.select(*(column(k) for k in keys))
        return plain.distinct() if mode == "flat" else _grouped(plain, keys, mode).agg(F.grouping_id().alias("_gid")).drop("_gid")
    return _measured(df, keys, q.metrics, mode, q.order_key)


def pivot_values(df: DataFrame, c: str, order_key: str | None, most: int = PIVOT_VALUES) -> tuple[list, bool]:
    """(values of the pivot column as text, first seen first; whether more are left over).  One row a value, `most` + 1 at most, reaches the driver."""
    t = df.schema[c].dataType
    seen = F.min(column(order_key)) if order_key else F.min(text(column(c), t))
    rows = df.groupBy(F.coalesce(text(column(c), t), F.lit("(null)")).alias("v")).agg(seen.alias("at")).orderBy(F.col("at").asc_nulls_last(), "v").limit(most + 1).collect()
    return [r.v for r in rows[:most]], len(rows) > most


def pivot(df: DataFrame, q: QuerySpec) -> tuple[DataFrame, list[str]]:
    """(frame of `_k0`.. and the pivoted columns `_p0`.., their names).

    The last group column's values become columns; values beyond the cap are one
    column `(other)`, aggregated from their rows.  Groups are aggregated before they are turned, so
    every metric works, and a table of any width compiles.
    """
    if not q.group_by:
        raise Refusal("pivot needs a column", "PIVOT needs a group column")
    *dims, c = dict.fromkeys(q.group_by)
    values, more = pivot_values(df, c, q.order_key)
    label = F.coalesce(text(column(c), df.schema[c].dataType), F.lit("(null)"))
    shown = [*values, *["(other)"] * more]
    place = F.array_position(F.array(*map(F.lit, values)), label) if values else F.lit(0).cast("long")
    ms = q.metrics or (Metric("COUNT_ALL", None, c),)
    # the place of the value stands for it, one beyond the last for all others
    rows = df.withColumn("_place", F.when(place > 0, place - 1).otherwise(len(values)).cast("int"))
    long = _measured(rows, [*dims, "_place"], ms, "flat", q.order_key)
    at = f"_k{len(dims)}"
    cells = F.struct(*(F.col(f"_m{i}") for i in range(len(ms))))
    wide = long.groupBy(*(f"_k{i}" for i in range(len(dims)))).agg(F.map_from_entries(F.collect_list(F.struct(F.col(at), cells))).alias("_cells"))
    cell = [(v, m, F.element_at("_cells", F.lit(j))[f"_m{i}"]) for j, v in enumerate(shown) for i, m in enumerate(ms)]
    names = [v if len(ms) == 1 else f"{v} · {m.name}" for v, m, _ in cell]
    return wide.select(*(f"_k{i}" for i in range(len(dims))), *(x.alias(f"_p{i}") for i, (_, _, x) in enumerate(cell))), names


def _sort_columns(q: QuerySpec, keys: list[str], metrics: list[tuple[str, str | None]]) -> tuple[Sort, ...]:
    """Order keys as internal columns: an alias or metric name, a group column, or the first metric on that column."""
    out = []
    for s in q.sort:
        named = [f"_m{i}" for i, (name, _) in enumerate(metrics) if name == s.column]
        grouped = [f"_k{i}" for i, k in enumerate(keys) if k == s.column]
        over = [f"_m{i}" for i, (_, c) in enumerate(metrics) if c == s.column]
        found = named + grouped + over
        if not found:
            raise Refusal("order by", f"cannot order by {s.column}: it is not in the result")
        out.append(replace(s, column=found[0]))
    return tuple(out)


def _grouped_result(rows: DataFrame, q: QuerySpec) -> DataFrame:
    keys = list(dict.fromkeys(q.group_by))
    if q.group_mode == "pivot":
        wide, names = pivot(rows, q)
        keys = keys[:-1]
        sorts = _sort_columns(q, keys, [])
        out = order_by(wide, sorts) if sorts else wide
        out = out.limit(q.limit) if q.limit is not None else out
        return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *(F.col(f"_p{i}").alias(n) for i, n in enumerate(names)))
    out = aggregate(rows, q)
    if not q.metrics:
        out = out.select(*(column(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    sorts = _sort_columns(q, keys, [(m.name, m.column) for m in q.metrics])
    out = order_by(out, sorts) if sorts else out
    out = out.limit(q.limit) if q.limit is not None else out
    return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *(F.col(f"_m{i}").alias(m.name) for i, m in enumerate(q.metrics)))


def execute(df: DataFrame, q: QuerySpec) -> Result:
    where, skipped = compile_where(q.filters, df.schema)
    rows = df.filter(where) if where is not None else df
    if q.aggregates:
        return Result(_grouped_result(rows, q), tuple(skipped))
    unknown = [c for c in q.select if c not in df.columns]
    if unknown:
        raise Refusal("no such column", f"no column {unknown[0]}")
    out = order_by(rows, q.sort, q.order_key) if q.sort else rows
    out = out.limit(q.limit) if q.limit is not None else out
    return Result(out.select(*(column(c) for c in q.select)) if q.select else out, tuple(skipped))
