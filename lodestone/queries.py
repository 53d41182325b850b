"""One query for each operator of the engine, over the star schema, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.kinds import flatten_leaves, text
from .operators import diff, joins, profile
from .operators.execute import execute, order_by, page
from .operators.joins import Table
from .plans.report import plan_report
from .plans.spec import Filter, Metric, QuerySpec, Sort, scope_to
from .plans.sql import parse_sql, write_sql
from .sources import export, footer
from .sources.export import json_line, lines
from .sources.table import open_table
from .streaming.incremental import read_stream, running_aggregate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return open_table(spark, f"{sf_dir}/{name}.parquet", name, check=False).df


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def ask(df: DataFrame, sql: str, order_key: str | None = None) -> DataFrame:
    from dataclasses import replace

    return execute(df, replace(parse_sql(sql, df.schema).query, order_key=order_key)).df


def register(name: str, oracle: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def sql(name: str, table: str, statement: str, oracle: str, prepare: tuple[str, ...] = ("*",), order_key: str | None = None, digits: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ask(load(spark, sf_dir, table).selectExpr(*prepare), statement, order_key)
        return out if digits is None else rounded(out, digits)

    register(name, oracle)(run)


# filters
LINE = "l_orderkey, l_linenumber, l_quantity"
for key, test in {"eq": "l_linenumber = 3", "ne": "l_linenumber <> 3", "lt": "l_quantity < 5", "le": "l_quantity <= 5", "gt": "l_quantity > 45.5", "ge": "l_quantity >= 45", "between": "l_quantity BETWEEN 10 AND 12"}.items():
    sql(f"filter_{key}", "lineitem", f"SELECT {LINE} FROM lineitem WHERE {test}", f"SELECT {LINE} FROM lineitem WHERE {test}")
NULLABLE = ("l_orderkey", "nullif(l_linenumber, 3) AS ln")
sql("filter_null", "lineitem", "SELECT l_orderkey, ln FROM lineitem WHERE ln IS NULL", "SELECT l_orderkey, nullif(l_linenumber, 3) AS ln FROM lineitem WHERE l_linenumber = 3", NULLABLE)
sql("filter_notnull", "lineitem", "SELECT l_orderkey, ln FROM lineitem WHERE ln IS NOT NULL", "SELECT l_orderkey, l_linenumber AS ln FROM lineitem WHERE l_linenumber <> 3", NULLABLE)
sql("filter_ne_null", "lineitem", "SELECT l_orderkey, ln FROM lineitem WHERE ln <> 1", "SELECT l_orderkey, l_linenumber AS ln FROM lineitem WHERE l_linenumber NOT IN (1, 3)", NULLABLE)
sql("filter_like", "orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%URG%'", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'urg')")
sql("filter_like_number", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey LIKE '%77%'", "SELECT o_orderkey, o_custkey FROM orders WHERE contains(o_custkey::VARCHAR, '77')")
sql("filter_dnf", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 OR o_orderpriority = '1-URGENT'", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT'")
sql("filter_temporal", "lineitem", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1997-02-01 12:00'", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-02-01 12:00:00'")
sql("filter_bool_text", "lineitem", "SELECT l_orderkey, big FROM lineitem WHERE big = true", "SELECT l_orderkey, true AS big FROM lineitem WHERE l_quantity > 25", ("l_orderkey", "l_quantity > 25 AS big"))
sql("filter_date", "lineitem", "SELECT l_orderkey, d FROM lineitem WHERE d BETWEEN '1996-03-01' AND '1996-03-05'", "SELECT l_orderkey, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-03-05'", ("l_orderkey", "CAST(l_shipdate AS DATE) AS d"))
sql("filter_decimal", "orders", "SELECT o_orderkey, p FROM orders WHERE p > 250000.5", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS p FROM orders WHERE CAST(o_totalprice AS DECIMAL(12,2)) > 250000.5", ("o_orderkey", "CAST(o_totalprice AS DECIMAL(12,2)) AS p"))
sql("filter_fraction_on_int", "part", "SELECT p_partkey, p_size FROM part WHERE p_size > 48.5", "SELECT p_partkey, p_size FROM part WHERE p_size > 48.5")

# projection, order, limit
sql("project_subset", "orders", "SELECT o_orderdate, o_orderkey FROM orders", "SELECT o_orderdate, o_orderkey FROM orders")
sql("topk_tiebreak", "orders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_orderkey DESC LIMIT 50", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_orderkey DESC LIMIT 50")


@register("sort_nulls_last_desc", "SELECT o_orderkey, c, row_number() OVER (ORDER BY c DESC NULLS LAST, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS c FROM orders)")
def _nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its place: sorted partitions follow one another, so a row's place is its number in them."""
    df = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS c")
    ordered = order_by(df, (Sort("c", True),), "o_orderkey").withColumn("id", F.monotonically_increasing_id())
    part, at = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit(2**33 - 1))
    sizes = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    # one row a partition
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ordered.join(F.broadcast(before), part == F.col("p")).select("o_orderkey", "c", (F.col("before") + at + 1).alias("place"))


@register("page_2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(order_by(load(spark, sf_dir, "orders"), (Sort("o_totalprice", True),), "o_orderkey"), 2, 100).select("o_orderkey", "o_totalprice")


# metrics
X = "l_extendedprice"
METRIC_SQL = {
    "count": (f"COUNT({X})",) * 2, "count_all": ("COUNT(*)",) * 2, "count_distinct": ("COUNT(DISTINCT l_partkey)",) * 2, "sum": (f"SUM({X})",) * 2, "avg": (f"AVG({X})",) * 2, "min": (f"MIN({X})",) * 2, "max": ("MAX(l_shipdate)",) * 2,
    "std": (f"STDDEV_SAMP({X})",) * 2, "stdp": (f"STDDEV_POP({X})",) * 2, "var": ("VAR_SAMP(l_quantity)",) * 2, "cv": (f"STDDEV_SAMP({X}) / ABS(AVG({X}))",) * 2, "range": (f"MAX({X}) - MIN({X})",) * 2,
    "med": (f"MEDIAN({X})",) * 2, "p90": (f"QUANTILE_CONT({X}, 0.9)",) * 2, "p95": (f"QUANTILE_CONT({X}, 0.95)",) * 2, "p99": (f"QUANTILE_CONT({X}, 0.99)",) * 2, "iqr": (f"QUANTILE_CONT({X}, 0.75) - QUANTILE_CONT({X}, 0.25)",) * 2,
}
for key, (mine, theirs) in METRIC_SQL.items():
    exact = key in ("count", "count_all", "count_distinct", "max")
    sql(f"agg_{key}", "lineitem", f"SELECT l_returnflag, {mine} AS v FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {theirs if exact else f'round({theirs}, 4)'} AS v FROM lineitem GROUP BY l_returnflag", digits=None if exact else 4)
sql("agg_many_groups", "lineitem", "SELECT l_orderkey, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, COUNT(*) AS n, round(SUM(l_quantity), 4) AS q FROM lineitem GROUP BY 1", digits=4)
sql("agg_quantiles_many_groups", "lineitem", f"SELECT l_partkey, MEDIAN({X}) AS m, QUANTILE_CONT({X}, 0.95) AS v FROM lineitem GROUP BY l_partkey", f"SELECT l_partkey, round(MEDIAN({X}), 4) AS m, round(QUANTILE_CONT({X}, 0.95), 4) AS v FROM lineitem GROUP BY 1", digits=4)
sql("agg_nulls", "lineitem", "SELECT l_returnflag, COUNT(*) - COUNT(ln) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) - COUNT(nullif(l_linenumber, 3)) AS v FROM lineitem GROUP BY l_returnflag", ("l_returnflag", "nullif(l_linenumber, 3) AS ln"))
sql("agg_mode_firstseen", "orders", "SELECT o_orderstatus, MODE(o_custkey) AS v FROM orders GROUP BY o_orderstatus",
    "WITH c AS (SELECT o_orderstatus, o_custkey, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, k) AS r FROM c) SELECT o_orderstatus, o_custkey AS v FROM r WHERE r = 1", order_key="o_orderkey")
sql("agg_mode_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, MODE(o_custkey) AS v, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)",
    """WITH g AS (SELECT o_orderstatus, o_orderpriority, o_custkey, o_orderkey, 0 AS s FROM orders UNION ALL SELECT o_orderstatus, NULL, o_custkey, o_orderkey, 1 FROM orders UNION ALL SELECT NULL, NULL, o_custkey, o_orderkey, 2 FROM orders),
    c AS (SELECT s, o_orderstatus, o_orderpriority, o_custkey, count(*) AS n, min(o_orderkey) AS k FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s, o_orderstatus, o_orderpriority ORDER BY n DESC, k) AS r, sum(n) OVER (PARTITION BY s, o_orderstatus, o_orderpriority)::BIGINT AS total FROM c)
    SELECT o_orderstatus, o_orderpriority, o_custkey AS v, total AS n FROM r WHERE r = 1""", order_key="o_orderkey")  # fmt: skip
sql("agg_global", "lineitem", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MEDIAN(l_tax) AS m FROM lineitem WHERE l_discount > 0.05", "SELECT COUNT(*) AS n, round(SUM(l_quantity), 4) AS q, round(MEDIAN(l_tax), 4) AS m FROM lineitem WHERE l_discount > 0.05", digits=4)
sql("distinct_groupby", "lineitem", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("agg_two_keys_filtered", "lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_shipdate >= '1995-01-01' GROUP BY l_returnflag, l_linestatus ORDER BY n DESC LIMIT 3",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 4) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2 ORDER BY n DESC LIMIT 3", digits=4)
sql("agg_bool_and_time", "lineitem", "SELECT l_returnflag, AVG(big) AS b, MAX(l_shipdate) - MIN(l_shipdate) AS r FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(avg((l_quantity > 25)::INT), 4) AS b, round((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 1000, 4) AS r FROM lineitem GROUP BY 1", ("l_returnflag", "l_shipdate", "l_quantity > 25 AS big"), digits=4)
sql("agg_null_group", "lineitem", "SELECT ln, COUNT(*) AS n FROM lineitem GROUP BY ln", "SELECT nullif(l_linenumber, 3) AS ln, COUNT(*) AS n FROM lineitem GROUP BY 1", NULLABLE)

# grouping sets
AGGS = "COUNT(*) AS n, SUM(l_quantity) AS q"
AGGS_DUCK = "COUNT(*) AS n, round(SUM(l_quantity), 4) AS q"
for mode in ("ROLLUP", "CUBE"):
    for n, cols in (2, "l_returnflag, l_linestatus"), (3, "l_returnflag, l_linestatus, l_linenumber"):
        sql(f"{mode.lower()}_{n}", "lineitem", f"SELECT {cols}, {AGGS} FROM lineitem GROUP BY {mode}({cols})", f"SELECT {cols}, {AGGS_DUCK} FROM lineitem GROUP BY {mode}({cols})", digits=4)
SPREAD = {k: v for k, (v, _) in METRIC_SQL.items() if k in ("sum", "avg", "std", "stdp", "cv", "range", "med", "p90", "p95", "p99", "iqr")}
sql("rollup_spread", "lineitem", "SELECT l_returnflag, l_linestatus, " + ", ".join(f"{v} AS m_{k}" for k, v in SPREAD.items()) + " FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round({v}, 4) AS m_{k}" for k, v in SPREAD.items()) + " FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", digits=4)

# pivot
sql("pivot_sum", "lineitem", "SELECT SUM(l_quantity) FROM lineitem GROUP BY PIVOT(l_linestatus, l_returnflag)",
    "SELECT l_linestatus, " + ", ".join(f"round(sum(l_quantity) FILTER (WHERE l_returnflag = '{v}'), 4) AS \"{v}\"" for v in "ANR") + " FROM lineitem GROUP BY 1", digits=4)
sql("pivot_default_count", "part", "SELECT p_brand FROM part GROUP BY PIVOT(p_brand, kind)", "SELECT p_brand, nullif(count(*) FILTER (WHERE p_size < 25), 0) AS small, nullif(count(*) FILTER (WHERE p_size > 25), 0) AS large, nullif(count(*) FILTER (WHERE p_size = 25), 0) AS \"(null)\" FROM part GROUP BY 1",
    ("p_brand", "CASE WHEN p_size < 25 THEN 'small' WHEN p_size > 25 THEN 'large' END AS kind"))
sql("pivot_multi_metric", "lineitem", "SELECT COUNT(*) AS n, AVG(l_tax) AS t FROM lineitem GROUP BY PIVOT(l_returnflag, l_linestatus)",
    "SELECT l_returnflag, " + ", ".join(f"nullif(count(*) FILTER (WHERE l_linestatus = '{v}'), 0) AS \"{v} · n\", round(avg(l_tax) FILTER (WHERE l_linestatus = '{v}'), 4) AS \"{v} · t\"" for v in "FO") + " FROM lineitem GROUP BY 1", digits=4)


@register("pivot_other", """WITH f AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1), t AS (SELECT p_name FROM f ORDER BY k, p_name LIMIT 50)
    SELECT p_type, CASE WHEN p_name IN (SELECT p_name FROM t) THEN p_name ELSE '(other)' END AS label, round(stddev_samp(p_retailprice), 4) AS v FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def _pivot_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QuerySpec(group_by=("p_type", "p_name"), group_mode="pivot", metrics=(Metric("STD", "p_retailprice"),), order_key="p_partkey")
    wide = execute(load(spark, sf_dir, "part"), q).df
    names = [c for c in wide.columns if c != "p_type"]
    long = wide.unpivot(["p_type"], [F.col(f"`{c}`") for c in names], "label", "v")
    return rounded(long.filter("v IS NOT NULL"))


@register("sql_roundtrip_exec", "SELECT l_returnflag, round(MEDIAN(l_tax), 4) AS m, COUNT(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_quantity > 10 AND l_shipdate >= TIMESTAMP '1995-06-01' OR l_returnflag = 'R' GROUP BY 1")
def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "lineitem")
    q = parse_sql("select l_returnflag, median(l_tax) m, count(distinct l_suppkey) as s from x where (l_quantity > 10 and l_shipdate >= '1995-06-01') or l_returnflag = 'R' group by l_returnflag", df.schema).query
    return rounded(ask(df, write_sql(q, df.schema)))


# joins
@register("join_inner_lookup", "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return joins.join(Table(docs, "documents"), Table(load(spark, sf_dir, "labels"), "labels"), "doc_id", "doc_id").df


@register("join_chain3", "SELECT n.n_name, count(*) AS n, round(sum(o.o_totalprice), 4) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.join(Table(load(spark, sf_dir, "orders"), "orders"), Table(load(spark, sf_dir, "customer"), "customer"), "o_custkey", "c_custkey")
    t = joins.join(t, Table(load(spark, sf_dir, "nation"), "nation"), "c_nationkey", "n_nationkey")
    return rounded(ask(t.df, "SELECT n_name, COUNT(*) AS n, SUM(o_totalprice) AS total FROM t GROUP BY n_name"))


@register("join_many_to_many", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey")
def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(Table(load(spark, sf_dir, "customer"), "customer"), Table(load(spark, sf_dir, "supplier"), "supplier"), "c_nationkey", "s_nationkey").df.select("c_custkey", "s_suppkey")


@register("join_dup_names_b_prefix", "SELECT a.o_orderkey, a.o_totalprice, b.o_totalprice AS b_o_totalprice FROM orders a JOIN orders b USING (o_orderkey)")
def _dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return joins.join(Table(a, "orders"), Table(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "again"), "o_orderkey", "o_orderkey").df


@register("join_null_keys", "SELECT a.n_nationkey, a.k, b.n_name AS b_n_name FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS k, n_name FROM nation) a JOIN (SELECT nullif(n_regionkey, 1) AS r, n_name FROM nation) b ON a.k = b.r")
def _nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "nation").selectExpr("n_nationkey", "nullif(n_regionkey, 1) AS k", "n_name")
    return joins.join(Table(a, "a"), Table(a.selectExpr("k AS r", "n_name"), "b"), "k", "r").df.select("n_nationkey", "k", "b_n_name")


@register("join_text_key", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def _text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS STRING) AS r_regionkey", "r_name")
    return joins.join(Table(load(spark, sf_dir, "nation"), "n"), Table(r, "r"), "n_regionkey", "r_regionkey").df.select("n_name", "r_name")


@register("join_estimate", "SELECT count(*) AS n_rows FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey")
def _estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = joins.estimate_rows(load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier"), "c_nationkey", "s_nationkey")
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n_rows"))


# profiles
@register("profile_number", "SELECT count(*) AS n, round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi, round(avg(l_extendedprice), 4) AS mean FROM lineitem")
def _profile_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.profile(load(spark, sf_dir, "lineitem").select("l_extendedprice")).selectExpr("count AS n", "min AS lo", "max AS hi", "mean"))


@register("profile_string", "SELECT count(DISTINCT event_type) AS d, min(length(event_type)) AS lo, max(length(event_type)) AS hi, round(avg(length(event_type)), 4) AS mean FROM events")
def _profile_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.profile(load(spark, sf_dir, "events").select("event_type")).selectExpr("distinct AS d", "min_len AS lo", "max_len AS hi", "mean_len AS mean"))


@register("profile_temporal", "SELECT count(ts) AS n, strftime(min(ts), '%Y-%m-%d %H') AS lo, strftime(max(ts), '%Y-%m-%d %H') AS hi FROM events")
def _profile_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(load(spark, sf_dir, "events").select("ts")).selectExpr("count AS n", "left(min_text, 13) AS lo", "left(max_text, 13) AS hi")


@register("profile_bool_derived", "SELECT count(*) FILTER (WHERE l_quantity > 25) AS t, count(*) FILTER (WHERE l_quantity <= 25) AS f, 0::BIGINT AS nulls FROM lineitem")
def _profile_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(load(spark, sf_dir, "lineitem").selectExpr("l_quantity > 25 AS b")).selectExpr("trues AS t", "falses AS f", "nulls")


@register("profile_hist24", "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(23, floor((l_extendedprice - lo) / (hi - lo) * 24))::INT AS bin, count(*) AS n FROM lineitem, b GROUP BY 1")
def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(load(spark, sf_dir, "lineitem"), "l_extendedprice").select("bin", "n")


@register("profile_top30", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 30")
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(load(spark, sf_dir, "part"), "p_name")


def _profile_sql(name: str, kind: str) -> str:
    if kind == "string":
        return f"SELECT '{name}' AS \"column\", count(*) AS n, count(*) - count({name}) AS nulls, count({name}) AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, count(DISTINCT {name}) AS \"distinct\", (SELECT string_agg(v || '=' || c, ',') FROM (SELECT {name} AS v, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, v LIMIT 30)) AS top FROM lineitem"
    x = f"epoch_us({name}) / 1000" if kind == "temporal" else name
    return f"SELECT '{name}', count(*), count(*) - count({name}), count({name}), round(min({x}), 4)::DOUBLE, round(max({x}), 4)::DOUBLE, round(avg({x}), 2)::DOUBLE, NULL::BIGINT, NULL FROM lineitem"


LINEITEM = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "temporal"} | {f"l_{c}": "number" for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax")}


@register("profile_all_columns", " UNION ALL ".join(_profile_sql(*x) for x in LINEITEM.items()))
def _profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(load(spark, sf_dir, "lineitem"))
    top = F.when(F.col("top").isNotNull(), F.array_join(F.transform("top", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), ","))
    return p.select("column", "n", "nulls", "count", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("mean", 2).alias("mean"), "distinct", top.alias("top"))


# diff
PERTURBED = ("o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS o_orderkey", "o_custkey", "o_totalprice + CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS o_totalprice", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus")
PERTURBED_SQL = "SELECT " + ", ".join(PERTURBED) + " FROM orders"


def _orders_diff(spark: SparkSession, sf_dir: str) -> diff.RowDiff:
    a = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return diff.row_diff(a, a.selectExpr(*PERTURBED), ["o_orderkey"])


register("diff_only_a", "SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0")(lambda s, d: _orders_diff(s, d).only_a.select("o_orderkey"))
register("diff_only_b", "SELECT o_orderkey + 100000000 AS o_orderkey FROM orders WHERE o_orderkey % 50 = 0")(lambda s, d: _orders_diff(s, d).only_b.select("o_orderkey"))
register("diff_changed", "SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0 AND (o_orderkey % 10 = 1 OR o_orderkey % 7 = 0)")(lambda s, d: _orders_diff(s, d).changed.select("o_orderkey"))
register("diff_percol", f"WITH b AS ({PERTURBED_SQL}), m AS (SELECT a.o_custkey IS DISTINCT FROM b.o_custkey AS x, a.o_totalprice IS DISTINCT FROM b.o_totalprice AS y, a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS z FROM orders a JOIN b USING (o_orderkey)) SELECT 'o_custkey' AS \"column\", count(*) FILTER (WHERE x) AS n FROM m UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE y) FROM m UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE z) FROM m")(lambda s, d: _orders_diff(s, d).per_column())
register("diff_counts", f"WITH b AS ({PERTURBED_SQL}), j AS (SELECT a.o_orderkey AS x, b.o_orderkey AS y, (a.o_custkey, a.o_totalprice, a.o_orderstatus) IS DISTINCT FROM (b.o_custkey, b.o_totalprice, b.o_orderstatus) AS c FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey) SELECT count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b, count(*) FILTER (WHERE c AND x IS NOT NULL AND y IS NOT NULL) AS changed, count(*) FILTER (WHERE NOT c) AS same FROM j")(lambda s, d: _orders_diff(s, d).counts())


@register("diff_schema", """SELECT 'added' AS what, 'flag' AS columns UNION ALL SELECT 'removed', '' UNION ALL SELECT 'retyped', 'o_custkey' UNION ALL SELECT 'renamed', 'o_orderstatus>status' UNION ALL SELECT 'common', (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = 'orders' AND column_name <> 'o_orderstatus')""")
def _schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "orders")
    d = diff.schema_diff(a.schema, a.selectExpr("o_orderkey", "CAST(o_custkey AS INT) AS o_custkey", "o_orderstatus AS status", "o_totalprice", "o_orderdate", "o_orderpriority", "true AS flag").schema)
    return spark.createDataFrame([("added", list(d.added)), ("removed", list(d.removed)), ("retyped", [x[0] for x in d.retyped]), ("renamed", [f"{x}>{y}" for x, y in d.renamed]), ("common", list(d.common))], "what string, columns array<string>").select("what", F.array_join("columns", ",").alias("columns"))


# footer statistics must say of each column what the rows say
FACTS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _facts(c: str, table: str = "orders") -> str:
    return f"SELECT '{c}' AS \"column\", min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, (count(*) - count({c}))::BIGINT AS nulls FROM {table}"


@register("diff_statistics", f"SELECT a.\"column\", a.min AS min_a, b.min AS min_b, a.max AS max_a, b.max AS max_b, a.nulls AS nulls_a, b.nulls AS nulls_b FROM ({' UNION ALL '.join(map(_facts, FACTS))}) a JOIN ({' UNION ALL '.join(map(_facts, FACTS))}) b USING (\"column\")")
def _diff_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = footer.column_chunks(spark, f"{sf_dir}/orders.parquet")
    return footer.column_diff(chunks, chunks).filter(F.col("column").isin(*FACTS)).select("column", *(f"{n}_{s}" for n in ("min", "max", "nulls") for s in "ab"))


@register("diff_shape", " UNION ALL ".join(f"SELECT '{s}' AS side, 1::BIGINT AS files, count(*) AS rows, (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{t}') AS columns FROM {t}" for s, t in (("A", "orders"), ("B", "lineitem"))))
def _diff_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer.shape_diff(footer.column_chunks(spark, f"{sf_dir}/orders.parquet"), footer.column_chunks(spark, f"{sf_dir}/lineitem.parquet")).select("side", "files", "rows", "columns")


register("suggest_key", "SELECT CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'o_orderkey' END AS key FROM orders")(lambda s, d: s.createDataFrame([(diff.suggest_key(load(s, d, "orders"), load(s, d, "orders")),)], "key string"))


# scope, nested values, metadata, exports
@register("scope_bin_between", "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT count(*) AS n FROM lineitem, b WHERE least(23, floor((l_extendedprice - lo) / (hi - lo) * 24)) = 3")
def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "lineitem")
    lo, hi = profile.bin_bounds(df, "l_extendedprice", 3)
    q = scope_to(QuerySpec(metrics=(Metric("COUNT_ALL", None, "n"),)), Filter("l_extendedprice", "BETWEEN", repr(lo), repr(hi)))
    return execute(df, q).df


@register("nested_list_size", "SELECT vec_id, len(embedding)::INT AS size FROM embeddings")
def _list_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("size"))


@register("nested_leaves", "SELECT n_nationkey, n_name AS \"s.name\", n_regionkey AS \"s.region\" FROM nation")
def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_leaves(load(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("s")))


@register("nested_json", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS j FROM nation")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    df = load(spark, sf_dir, "nation").select("n_nationkey", s.alias("s"))
    return df.select("n_nationkey", text(F.col("s"), df.schema["s"].dataType).alias("j"))


@register("text_timestamp", "SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0*$', '') AS t FROM events WHERE extract(second FROM ts) % 10 <> 0 AND epoch_us(ts) % 1000000 <> 0 UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events WHERE epoch_us(ts) % 1000000 = 0 UNION ALL SELECT event_id, rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') FROM events WHERE extract(second FROM ts) % 10 = 0 AND epoch_us(ts) % 1000000 <> 0")
def _text_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events")
    return df.select("event_id", text(F.col("ts"), df.schema["ts"].dataType).alias("t"))


@register("export_json_lines", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region")
def _export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "region").select(json_line(load(spark, sf_dir, "region")).alias("line"))


@register("export_markdown", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation UNION ALL SELECT '| n_nationkey | n_name | n_regionkey |' UNION ALL SELECT '| ---: | --- | ---: |'")
def _export_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x.rstrip("\n"),) for x in lines(load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "md")], "line string")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
register("footer_files", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{t}') AS columns FROM {t}" for t in TABLES if t != "embeddings"))(
    # a table is a file or a folder of files; a list is one leaf, but its path is longer
    lambda s, d: footer.tables(footer.column_chunks(s, d), footer.listed_root(s, d)).filter(F.col("name").isin([f"{t}.parquet" for t in TABLES if t != "embeddings"])).select(F.regexp_replace("name", r"\.parquet$", "").alias("name"), "rows", "columns")
)
register("footer_row_groups", "SELECT count(*) AS rows FROM lineitem")(lambda s, d: footer.row_groups(footer.column_chunks(s, f"{d}/lineitem.parquet")).agg(F.sum("rows").alias("rows")))
register("footer_columns", " UNION ALL ".join(_facts(c, "lineitem") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")))(
    lambda s, d: footer.columns(footer.column_chunks(s, f"{d}/lineitem.parquet")).filter("exact AND nulls_known").select("column", "min", "max", "nulls").filter(F.col("column").isin("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))
)
register("footer_key_values", None)(lambda s, d: footer.key_values(footer.column_chunks(s, f"{d}/lineitem.parquet")))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether footers exclude the table for clauses on each kind of column."""
    chunks = footer.column_chunks(spark, f"{sf_dir}/lineitem.parquet")
    out = None
    for f in PLANNED:
        kept = plan_report(chunks, QuerySpec(("l_orderkey",), (f,))).select(F.lit(f"{f.column} {f.op} {f.value}").alias("clause"), (F.col("kept") > 0).alias("kept"))
        out = kept if out is None else out.unionByName(kept)
    return out


PLANNED = (Filter("l_quantity", ">", "60"), Filter("l_quantity", "<", "1.5"), Filter("l_shipdate", "<", "1980-01-01"), Filter("l_shipdate", ">=", "1995-01-01"), Filter("l_returnflag", "=", "Z"), Filter("l_returnflag", ">=", "R"), Filter("l_orderkey", "<", "0"))
register("plan_report", " UNION ALL ".join(f"SELECT '{f.column} {f.op} {f.value}' AS clause, count(*) FILTER (WHERE {f.column} {f.op} " + {"l_shipdate": "TIMESTAMP "}.get(f.column, "") + (f"'{f.value}'" if f.column in ("l_shipdate", "l_returnflag") else str(f.value)) + ") > 0 AS kept FROM lineitem" for f in PLANNED))(_plans)


# folders and exports, written from the tables first
def _folder(spark: SparkSession, parts: dict[str, DataFrame]) -> str:
    """A new folder with a Parquet file for each name."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestone-")
    root = f"{base}/folder-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (name, df) in enumerate(parts.items()):
        made = f"{base}/part-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(made)
        to = path(f"{root}/{name}")
        fs.mkdirs(to.getParent())
        file = next(x.getPath() for x in fs.listStatus(path(made)) if x.getPath().getName().startswith("part-"))
        fs.rename(file, to)
        fs.delete(path(made), True)
    return root


ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register("folder_any_suffix", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 3 THEN o_totalprice END AS o_totalprice FROM orders")
def _any_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested folders, any spelling of a suffix, a file that lacks a column."""
    o = load(spark, sf_dir, "orders").select(*ORDERS)
    names = ["a.parquet", "B.PQ", "sub/c.Parquet", "sub/deep/d.PARQ"]
    parts = {n: o.filter(F.col("o_orderkey") % 4 == i) for i, n in enumerate(names)}
    parts["sub/deep/d.PARQ"] = parts["sub/deep/d.PARQ"].drop("o_totalprice")
    return open_table(spark, _folder(spark, parts)).df.select(*ORDERS)


@register("folder_hive", "SELECT o_orderkey % 3 AS third, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1, 2")
def _hive(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(*ORDERS)
    statuses = [r[0] for r in o.select("o_orderstatus").distinct().collect()]  # a few
    parts = {f"third={i}/status={v}/part.parquet": o.filter((F.col("o_orderkey") % 3 == i) & (F.col("o_orderstatus") == v)).drop("o_orderstatus") for i in range(3) for v in statuses}
    df = open_table(spark, _folder(spark, parts)).df
    return rounded(ask(df, "SELECT third, status, COUNT(*) AS n, SUM(o_totalprice) AS total FROM o WHERE third <> 1 GROUP BY third, status"))


@register("folder_uneven_keys", "SELECT CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey % 3 END AS third, o_orderkey, o_custkey FROM orders")
def _uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    names = ["third=0/a.parquet", "third=1/sub/b.parquet", "c.parquet"]
    return open_table(spark, _folder(spark, {n: o.filter(F.col("o_orderkey") % 3 == i) for i, n in enumerate(names)})).df


@register("stream_mergeable", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 4) AS total, round(stddev_samp(o_totalprice), 4) AS spread, max(o_orderkey) AS last FROM orders GROUP BY 1")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable metrics over files that arrive one a batch."""
    import uuid

    o = load(spark, sf_dir, "orders").select(*ORDERS)
    root = _folder(spark, {f"{i}.parquet": o.filter(F.col("o_orderkey") % 3 == i) for i in range(3)})
    q = QuerySpec(group_by=("o_orderstatus",), metrics=(Metric("COUNT_ALL", None, "n"), Metric("SUM", "o_totalprice", "total"), Metric("STD", "o_totalprice", "spread"), Metric("MAX", "o_orderkey", "last")))
    name = f"stream_{uuid.uuid4().hex}"
    running = running_aggregate(read_stream(spark, root, o.schema), q)
    running.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(name))


for kind in ("csv", "tsv"):

    @register(f"export_{kind}", "SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'a\"b,' || chr(9) || o_orderstatus END AS note, o_totalprice::DECIMAL(18, 2)::VARCHAR AS price FROM orders")
    def _export(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
        """Written and read back as text."""
        df = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit('a"b,\t'), "o_orderstatus")).alias("note"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
        path = _folder(spark, {"x.parquet": spark.range(1)}) + f"/{kind}"
        export.write(df, path, kind)
        return spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').option("quote", '"').csv(path)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = open_table(spark, f"{sf_dir}/lineitem.parquet")
    return rounded(ask(t.df, "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price, QUANTILE_CONT(l_extendedprice, 0.9) AS p90 FROM lineitem WHERE l_shipdate >= '1995-01-01' GROUP BY ROLLUP(l_returnflag, l_linestatus)"))


register("flagship", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 4) AS sum_qty, round(AVG(l_extendedprice), 4) AS avg_price, round(QUANTILE_CONT(l_extendedprice, 0.9), 4) AS p90 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ROLLUP(l_returnflag, l_linestatus)")(flagship)
