"""Exact interpolated quantiles without holding a group's values in one buffer.

One pass counts rows per group and bin, aggregated before the shuffle; running sums
over a group's bins show which bins hold the wanted ranks.  A second pass counts
the distinct values of those bins alone, and running sums over them find the
two neighbours to interpolate between.  Grouping sets add up the counts of the
finest groups, so ROLLUP and CUBE read the rows as often as a flat GROUP BY.

Up to CELLS counts are added up on the driver, over bins of equal ratio that need no look at the data.
Beyond, for many groups or values crowded in one bin, bins lie between the knots of
a sketch, fine where values are dense and at both tails, and the same sums are
windows: small groups are sorted side by side, and a group of any size puts only its few
wanted bins into a sort.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import column

KNOTS = [0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]
SAMPLE = 0.02  # of the values, for the knots
ACCURACY = 1000
CELLS = 200_000
OCTAVE = 256  # bins of equal ratio to a factor of two
LISTED = 5_000  # bins in one filter
LARGEST = 1.7976931348623157e308


def _ratio_bin() -> str:
    """The bin of x by its logarithm, never falling with x, without a look at the data."""
    place = f"cast(floor(log2(abs(x)) * {OCTAVE}) as int) + {1200 * OCTAVE}"
    return f"CASE WHEN x IS NULL THEN NULL WHEN x = 0 THEN 0 WHEN x > {LARGEST!r}D THEN {2400 * OCTAVE} WHEN x < -{LARGEST!r}D THEN -{2400 * OCTAVE} WHEN x > 0 THEN {place} ELSE -({place}) END"


def _bins(rows: int) -> int:
    """Bins between two knots: some hundred rows to a bin of a small table, at most 4096."""
    return int(min(4096, max(256, rows // 1_000_000)))


def _bin(knots: list[float] | None, bins: int) -> str:
    """The bin of x, never falling with x; infinities have bins of their own."""
    if not knots:
        return "CASE WHEN x < 0 THEN -1 ELSE 0 END"
    cases = []
    for i, (lo, hi) in enumerate(zip(knots, knots[1:])):
        # halves, so that no difference overflows
        width = hi / 2 - lo / 2
        place = f"least({bins - 1}, greatest(0, cast(floor((x / 2 - {lo / 2!r}D) / {width!r}D * {bins}) as int))) + {i * bins}" if width > 0 else str(i * bins)
        cases.append((f"WHEN x < {hi!r}D THEN {place}", place))
    last = len(cases) * bins
    return f"CASE WHEN x > {LARGEST!r}D THEN {last} WHEN x < -{LARGEST!r}D THEN -1 " + " ".join(c for c, _ in cases[:-1]) + f" ELSE {cases[-1][1]} END"


def _ranks(n, p: float):
    """(rank below, its share of the step) of a quantile of n values."""
    at = (n - 1) * p
    return math.floor(at), at - math.floor(at)


def _groups(rows, sets: list[tuple[int, ...]], width: int) -> dict:
    """(_gid, repr of the kept keys) -> (keys, its (place, count) pairs in order); a row: keys, place, count; no place, no pair."""
    out: dict = {}
    for s in sets:
        gid = sum(1 << (width - 1 - i) for i in range(width) if i not in s)
        for r in rows:
            keys = tuple(r[i] if i in s else None for i in range(width))
            counts = out.setdefault((gid, repr(keys)), (keys, {}))[1]
            if r[width] is not None:
                counts[r[width]] = counts.get(r[width], 0) + r[width + 1]
    return {g: (keys, sorted(c.items())) for g, (keys, c) in out.items()}


def _on_driver(rows: DataFrame, names: list[str], ps: list[float], sets: list[tuple[int, ...]]) -> list[tuple] | None:
    """Rows (keys, _gid, q) of all groups, or None where there are too many counts."""
    k = len(names)
    binned = rows.withColumn("bin", F.expr(_ratio_bin()))
    cells = binned.groupBy(*names, "bin").agg(F.count("*").alias("m")).limit(CELLS + 1).collect()
    if len(cells) * len(sets) > CELLS:
        return None
    groups = _groups(cells, sets, k)
    wanted: set[int] = set()
    looked: dict = {}
    for g, (_, pairs) in groups.items():
        upto = np.cumsum([m for _, m in pairs])
        for p in ps if pairs else ():
            r, _ = _ranks(int(upto[-1]), p)
            for rank in (r, min(r + 1, int(upto[-1]) - 1)):
                i = int(np.searchsorted(upto, rank, "right"))
                wanted.add(pairs[i][0])
                looked[g, rank] = (pairs[i][0], rank - (int(upto[i - 1]) if i else 0))
    if len(wanted) > LISTED:
        return None
    values = binned.filter(F.col("bin").isin(sorted(wanted))).groupBy(*names, "bin", "x").agg(F.count("*").alias("m")).limit(CELLS + 1).collect() if wanted else []
    if len(values) * len(sets) > CELLS:
        return None
    exact = {}
    for g, (_, pairs) in _groups([(*r[:k], (r[k], r[k + 1]), r[k + 2]) for r in values], sets, k).items():
        exact[g] = (np.array([b for (b, _), _ in pairs]), [x for (_, x), _ in pairs], np.cumsum([m for _, m in pairs]))

    def value(g, rank: int) -> float:
        b, inside = looked[g, rank]
        bins, x, upto = exact[g]
        first = int(np.searchsorted(bins, b))
        return x[int(np.searchsorted(upto, inside + (int(upto[first - 1]) if first else 0), "right"))]

    out = []
    for g, (keys, pairs) in groups.items():
        n, q = sum(m for _, m in pairs), []
        for p in ps if n else ():
            r, part = _ranks(n, p)
            a = value(g, r)
            q.append(float(a + part * (value(g, min(r + 1, n - 1)) - a) if part > 0 else a))
        out.append((*keys, g[0], q or [None] * len(ps)))
    return out


def _by_windows(binned: DataFrame, names: list[str], ps: list[float], sets: list[tuple[int, ...]]) -> DataFrame:
    def by_sets(counts: DataFrame, *more: str) -> DataFrame:
        """Counts `m` per (names, more) added up for every grouping set, with `_gid`."""
        if sets == [tuple(range(len(names)))]:
            return counts.withColumn("_gid", F.lit(0).cast("long"))
        listed = [[*(F.col(names[i]) for i in s), *map(F.col, more)] for s in sets]
        return counts.groupingSets(listed, *map(F.col, (*names, *more))).agg(F.sum("m").alias("m"), F.shiftright(F.grouping_id().cast("long"), len(more)).alias("_gid"))

    group = ["_gid", *names]
    cells = by_sets(binned.groupBy(*names, "bin").agg(F.count("*").alias("m")), "bin")
    in_group = Window.partitionBy(*group)
    upto = in_group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("upto", F.sum("m").over(upto)).withColumn("n", F.sum("m").over(in_group)).withColumn("before", F.expr("upto - m"))

    def holds(p: float, j: int) -> str:
        return f"(before <= floor((n - 1) * {p!r}D) + {j} AND floor((n - 1) * {p!r}D) + {j} < upto)"

    wanted = cells.filter(" OR ".join(holds(p, j) for p in ps for j in (0, 1))).select(*(F.col(c).alias(f"{c}_") for c in group), F.col("bin").alias("bin_"), "before", "n")
    # one row a bin at most, whatever the number of groups
    some = F.broadcast(wanted.select("bin_").distinct())
    few = binned.join(some, F.col("bin") == F.col("bin_"), "left_semi").groupBy(*names, "bin", "x").agg(F.count("*").alias("m"))
    on = F.expr(" AND ".join(["bin = bin_", *(f"{c} <=> {c}_" for c in group)]))
    run = Window.partitionBy(*group, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = by_sets(few, "bin", "x").join(wanted, on).withColumn("upto", F.col("before") + F.sum("m").over(run)).withColumn("before", F.expr("upto - m"))
    found = []
    for p in ps:
        a, b = (f"max(CASE WHEN {holds(p, j)} THEN x END)" for j in (0, 1))
        part = f"max((n - 1) * {p!r}D - floor((n - 1) * {p!r}D))"
        found.append(f"{a} + CASE WHEN {part} > 0 THEN {part} * ({b} - {a}) ELSE 0D END")
    return values.groupBy(*group).agg(F.expr(f"array({', '.join(found)})").alias("q")).select(*names, "_gid", "q")


def exact_quantiles(df: DataFrame, keys: list[str], x: Column, ps: list[float], sets: list[tuple[int, ...]] | None = None, on_driver: bool = True) -> tuple[DataFrame, bool]:
    """One row a group: `_k0`.. (the keys), `_gid` (bits of the keys that a set leaves out), `q` (an array of doubles, one for each of ps); and whether groups without any value are among them.

    sets: the grouping sets, as the numbers of the keys that each keeps; by default one of all keys.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    sets = [tuple(range(len(keys)))] if sets is None else sets
    rows = df.select(*(column(k).alias(n) for k, n in zip(keys, names)), x.alias("x"))
    got = _on_driver(rows, names, ps, sets) if on_driver else None
    if got is not None:
        schema = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names] + [T.StructField("_gid", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))])
        # CELLS rows at most
        return F.broadcast(df.sparkSession.createDataFrame(got, schema)), bool(got)
    v = rows.filter("x IS NOT NULL")
    inside = F.when(F.abs("x") <= LARGEST, F.col("x"))
    # the bins only have to be even: any knots give exact results
    seen = v.select(inside.alias("x"), F.when(F.rand(7) < SAMPLE, inside).alias("few"))
    r = seen.agg(F.min("x"), F.percentile_approx("few", KNOTS, ACCURACY), F.max("x"), F.count(F.lit(1))).first()
    return _by_windows(v.withColumn("bin", F.expr(_bin(None if r[0] is None else [r[0], *(r[1] or []), r[2]], _bins(r[3])))), names, ps, sets), False
