"""What a scan will read and what an answer covers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import parse_bool, parse_number, parse_temporal
from ..sources.footer import order_key
from .spec import Filter, QuerySpec, or_groups


def _operands(value: object) -> dict[str, str | None]:
    """The order key of a literal as a column of each kind reads it; None where it is no literal of the kind."""
    if value is None or value == "":
        return dict.fromkeys(("number", "float", "temporal", "string", "bool"))
    n = parse_number(value)
    return {"number": order_key(n), "float": None if n is None else order_key(float(n)), "temporal": order_key(parse_temporal(value)), "string": str(value), "bool": order_key(parse_bool(value))}


def _may_match(f: Filter):
    """Whether a row group's statistics leave room for the clause; unknown statistics, and clauses that cannot be used, always do."""
    lo, hi, n, nulls = F.col("min_key"), F.col("max_key"), F.col("group_rows"), F.col("nulls")
    if f.op == "IS NULL":
        return nulls.isNull() | (nulls > 0)
    some = nulls.isNull() | (nulls < n)
    if f.op == "IS NOT NULL" or f.op == "LIKE":
        return some
    room = None
    least, most = _operands(f.value), _operands(f.upper if f.op == "BETWEEN" and f.upper not in (None, "") else f.value)
    for k, v in least.items():
        up = most[k]
        if v is None or up is None:
            continue
        v, up = F.lit(v), F.lit(up)
        one = {"=": (lo <= v) & (hi >= v), "<>": (lo != v) | (hi != v), "<": lo < v, "<=": lo <= v, ">": hi > v, ">=": hi >= v, "BETWEEN": (lo <= up) & (hi >= v)}[f.op]
        if k == "string" and f.op == "<>":
            one = F.lit(True)  # a text's range may have been shortened
        room = F.when(F.col("kind") == k, one) if room is None else room.when(F.col("kind") == k, one)
    if room is None:
        return some
    return some & (lo.isNull() | hi.isNull() | F.coalesce(room, F.lit(True)))


def partition_chunks(chunks: DataFrame) -> DataFrame:
    """A column chunk for each Hive key in a path: one value, the same for the whole row group."""
    from ..sources.table import HIVE_NULL

    groups = chunks.filter("row_group IS NOT NULL").groupBy("path", "row_group").agg(F.first("group_rows").alias("group_rows"))
    parts = F.filter(F.split("path", "/"), lambda p: p.contains("="))
    each = groups.select("*", F.explode(parts).alias("p")).select("*", F.split_part("p", F.lit("="), F.lit(1)).alias("column"), F.url_decode(F.expr("substr(p, locate('=', p) + 1)")).alias("value"))
    missing = F.col("value") == HIVE_NULL
    kinds = each.filter(~missing).groupBy("column").agg(F.when(F.bool_and(F.col("value").rlike(r"^-?\d+$")), "number").when(F.bool_and(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$")), "temporal").otherwise("string").alias("kind"))
    whole = F.abs(F.col("value").try_cast("decimal(38,0)")).cast("string")
    number = F.when(whole == "0", "4").when(F.col("value").startswith("-"), None).otherwise(F.concat(F.lit("6"), F.lpad((F.length(whole) + 50_000).cast("string"), 6, "0"), F.regexp_replace(whole, "0+$", "")))
    key = F.when(F.col("kind") == "number", number).when(F.col("kind") == "temporal", F.concat("value", F.lit(" 00:00:00.000000"))).otherwise(F.col("value"))
    key = F.when(~missing, key)
    return each.join(F.broadcast(kinds), "column", "left").select("path", "row_group", "group_rows", "column", "kind", key.alias("min_key"), key.alias("max_key"), F.when(missing, F.col("group_rows")).otherwise(0).alias("nulls"))


def _flags(chunks: DataFrame, q: QuerySpec) -> DataFrame:
    """(path, row_group, keep, in_hive): whether a group may hold rows, and whether it may by its Hive keys alone."""
    whole = chunks.filter("row_group IS NOT NULL")
    sides = or_groups(q.filters)
    if not sides:
        return whole.select("path", "row_group").distinct().select("*", F.lit(True).alias("keep"), F.lit(True).alias("in_hive"))
    facts = ["path", "row_group", "group_rows", "column", "kind", "min_key", "max_key", "nulls"]
    both = whole.select(*facts, F.lit(False).alias("hive")).unionByName(partition_chunks(chunks).select(*facts, F.lit(True).alias("hive")))
    flags = []
    for i, g in enumerate(sides):
        for j, f in enumerate(g):
            mine = F.col("column") == f.column
            flags.append(F.coalesce(F.bool_and(F.when(mine, _may_match(f))), F.lit(True)).alias(f"g{i}_{j}"))
            flags.append(F.coalesce(F.bool_and(F.when(mine & F.col("hive"), _may_match(f))), F.lit(True)).alias(f"h{i}_{j}"))
    keep, in_hive = (F.expr(" OR ".join("(" + " AND ".join(f"{x}{i}_{j}" for j in range(len(g))) + ")" for i, g in enumerate(sides))) for x in "gh")
    return both.groupBy("path", "row_group").agg(*flags).select("path", "row_group", keep.alias("keep"), in_hive.alias("in_hive"))


def kept_groups(chunks: DataFrame, q: QuerySpec) -> DataFrame:
    """(path, row_group) of the row groups that may hold rows that meet the clauses."""
    return _flags(chunks, q).filter("keep").select("path", "row_group")


def plan_report(chunks: DataFrame, q: QuerySpec) -> DataFrame:
    """One row: row groups and bytes in all and kept, and how many groups statistics or Hive keys exclude, each column's in the order of its kind."""
    whole = chunks.filter("row_group IS NOT NULL")
    groups = whole.groupBy("path", "row_group").agg(F.sum("compressed").alias("bytes"))
    wanted = set(q.select) | {f.column for f in q.filters} | set(q.group_by) | {m.column for m in q.metrics if m.column} | {s.column for s in q.sort}
    needed = whole.filter(F.col("column").isin(*wanted)) if wanted else whole
    need = needed.groupBy("path", "row_group").agg(F.sum("compressed").alias("needed"))
    g = groups.join(_flags(chunks, q), ["path", "row_group"]).join(need, ["path", "row_group"], "left")
    return g.agg(
        F.count("*").alias("groups"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep") & F.col("in_hive")).alias("by_statistics"), F.count_if(~F.col("in_hive")).alias("by_partition"),
        F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(F.col("keep"), F.col("needed"))), F.lit(0)).alias("kept_bytes"),
    )


def scope(q: QuerySpec, skipped: tuple = (), files_skipped: tuple[str, ...] = ()) -> str:
    """What an answer covers, in a sentence."""
    said = "all rows" if not q.filters else f"rows that meet {len(q.filters) - len(skipped)} of {len(q.filters)} clauses"
    if q.limit is not None:
        said += f", the first {q.limit:,}"
    if skipped:
        said += "; left out: " + ", ".join(f"{f.column} {f.op} ({why})" for f, why in skipped)
    if files_skipped:
        said += f"; {len(files_skipped)} unreadable files are missing"
    return said


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside can be stopped with `cancel`."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    return spark.interruptTag(tag)
