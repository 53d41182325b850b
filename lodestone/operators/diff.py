"""Two tables compared: schemas, footer statistics, and rows by key."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refusal
from ..functions.kinds import kind, text
from .predicates import column

#: Names that look like keys, tried first: a fixed pattern.
LIKELY_KEY = re.compile(r"(^|[_.])(id|key|pk|uuid|guid)$", re.I)


@dataclass(frozen=True)
class SchemaDiff:
    added: tuple[str, ...]
    removed: tuple[str, ...]
    retyped: tuple[tuple[str, str, str], ...]
    renamed: tuple[tuple[str, str], ...]
    common: tuple[str, ...]


def schema_diff(a: T.StructType, b: T.StructType) -> SchemaDiff:
    """A removed and an added column are a rename when each is the only one of its type."""
    ta, tb = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (a, b))
    gone, new = [n for n in ta if n not in tb], [n for n in tb if n not in ta]
    renamed = []
    for g in list(gone):
        same_a, same_b = [x for x in gone if ta[x] == ta[g]], [x for x in new if tb[x] == ta[g]]
        if len(same_a) == len(same_b) == 1:
            renamed.append((g, same_b[0]))
    gone = [g for g in gone if g not in dict(renamed)]
    new = [n for n in new if n not in [y for _, y in renamed]]
    retyped = tuple((n, ta[n], tb[n]) for n in ta if n in tb and ta[n] != tb[n])
    return SchemaDiff(tuple(new), tuple(gone), retyped, tuple(renamed), tuple(n for n in ta if n in tb))


def suggest_key(a: DataFrame, b: DataFrame) -> str | None:
    """A column that is unique and never NULL on both sides; names that look like keys first.  One aggregate a side."""
    names = [f.name for f in a.schema.fields if f.name in b.columns and kind(f.dataType) != "nested"]
    names.sort(key=lambda n: not LIKELY_KEY.search(n))
    if not names:
        return None

    def unique(df: DataFrame) -> set[str]:
        # candidates are cut down with sketches before anything is counted exactly
        r = df.agg(F.count("*").alias("n"), *(F.count(column(c)).alias(f"n{i}") for i, c in enumerate(names)), *(F.approx_count_distinct(column(c), 0.02).alias(f"d{i}") for i, c in enumerate(names))).first()
        return {c for i, c in enumerate(names) if r[f"n{i}"] == r["n"] and r[f"d{i}"] >= 0.9 * r["n"]}

    def exact(df: DataFrame, c: str) -> bool:
        return df.groupBy(column(c)).count().filter("count > 1").isEmpty()

    likely = unique(a) & unique(b)
    return next((c for c in names if c in likely and exact(a, c) and exact(b, c)), None)


@dataclass(frozen=True)
class RowDiff:
    """Both tables by key, in one frame: `na` and `nb` rows, `a` and `b` (their columns), `changed` (names of the columns that differ)."""

    rows: DataFrame
    keys: tuple[str, ...]
    columns: tuple[str, ...]

    @property
    def only_a(self) -> DataFrame:
        return self.rows.filter("nb = 0").select("a.*")

    @property
    def only_b(self) -> DataFrame:
        return self.rows.filter("na = 0").select("b.*")

    @property
    def matched(self) -> DataFrame:
        """Keys and `changed`."""
        return self.rows.filter("na > 0 AND nb > 0").select(*(F.col("a").getField(k).alias(k) for k in self.keys), "changed")

    @property
    def changed(self) -> DataFrame:
        return self.matched.filter(F.size("changed") > 0)

    def counts(self) -> DataFrame:
        """only_a, only_b, changed, same."""
        both = F.expr("na > 0 AND nb > 0")
        return self.rows.agg(F.count_if(F.expr("nb = 0")).alias("only_a"), F.count_if(F.expr("na = 0")).alias("only_b"), F.count_if(both & (F.size("changed") > 0)).alias("changed"), F.count_if(both & (F.size("changed") == 0)).alias("same"))

    def per_column(self) -> DataFrame:
        """(column, n): rows in which each compared column differs, none left out."""
        n = self.matched.agg(*(F.count_if(F.array_contains("changed", c)).alias(f"c{i}") for i, c in enumerate(self.columns)))
        if not self.columns:
            return self.matched.sparkSession.createDataFrame([], "column string, n bigint")
        return n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n")) for i, c in enumerate(self.columns)))).alias("x")).select("x.*")


def row_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> RowDiff:
    """Rows matched by key, NULL keys equal to NULL, NaN equal to NaN, numbers by value whatever their width.

    Both tables are put together and grouped by key, so each is shuffled once; the check for repeated keys groups the keys alone.
    """
    if not keys:
        raise Refusal("no key", "choose a key to compare rows by")
    for side, df in (("A", a), ("B", b)):
        for k in keys:
            if k not in df.columns:
                raise Refusal("key missing", f"{k} is not a column of {side}")
    types = [(a.schema[k].dataType, b.schema[k].dataType) for k in keys]

    def side(df: DataFrame, i: int) -> DataFrame:
        """Keys, `a` and `b`, of which the other side's is NULL."""
        as_text = [kind(x) != kind(y) for x, y in types]
        ks = [(text(column(k), df.schema[k].dataType, full_binary=True) if t else column(k)).alias(f"_k{j}") for j, (k, t) in enumerate(zip(keys, as_text))]
        row = F.struct(*(column(c) for c in df.columns))
        other = F.lit(None).cast((b if i == 0 else a).schema)
        return df.select(*ks, *((row.alias("a"), other.alias("b")) if i == 0 else (other.alias("a"), row.alias("b"))))

    both = side(a, 0).unionByName(side(b, 1))
    by_key = both.groupBy(*(f"_k{j}" for j in range(len(keys))))
    repeated = by_key.agg(F.count("a").alias("na"), F.count("b").alias("nb")).agg(*(f(F.when(F.col(c) > 1, F.col(c))).alias(f"{n}_{c}") for c in ("na", "nb") for n, f in (("keys", F.count), ("rows", F.sum)))).first()
    for name, c in (("A", "na"), ("B", "nb")):
        if repeated[f"keys_{c}"]:
            raise Refusal("key repeated", f"in {name}, {repeated[f'keys_{c}']:,} keys stand for {repeated[f'rows_{c}']:,} rows")
    shared = [c for c in a.columns if c in b.columns and c not in keys]

    def cell(s: str, df: DataFrame, c: str):
        x = F.col(s).getField(c)
        return F.to_json(x, {"ignoreNullFields": "false"}) if isinstance(df.schema[c].dataType, T.MapType) else x

    differs = [F.when(~cell("a", a, c).eqNullSafe(cell("b", b, c)), F.lit(c)) for c in shared]
    changed = F.array_compact(F.array(*differs)) if differs else F.array().cast("array<string>")
    rows = by_key.agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    return RowDiff(rows.select("na", "nb", "a", "b", changed.alias("changed")), tuple(keys), tuple(shared))
