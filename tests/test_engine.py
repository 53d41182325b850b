"""Semantics that the star schema cannot show: NULL and NaN, texts, refusals, folders, invariants."""

import datetime as dt
import decimal
import itertools
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import Refusal, SqlError
from lodestone.functions.kinds import flatten_leaves, nearest_name, number_text, parse_number, parse_temporal, text
from lodestone.operators import diff, joins, profile
from lodestone.operators.execute import execute, order_by
from lodestone.operators.joins import Table
from lodestone.operators.predicates import compile_where
from lodestone.plans.report import cancellable, plan_report, scope
from lodestone.plans.spec import METRICS, Filter, Metric, QuerySpec, Sort, display_order, scope_to, toggle_sort
from lodestone.plans.sql import parse_sql, write_sql
from lodestone.sources import export, footer
from lodestone.sources.table import HIVE_NULL, Catalogue, open_table
from lodestone.streaming.incremental import read_stream, running_aggregate

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, 1.0, "a", True, dt.datetime(2024, 1, 1)), (2, NAN, "B%", False, dt.datetime(2024, 1, 2, 3, 4, 5, 600)), (3, None, None, None, None), (4, INF, "", True, dt.datetime(2024, 2, 1)), (5, -0.0, "é", False, dt.datetime(1969, 12, 31, 23, 59, 59, 1)), (6, -INF, "a", True, dt.datetime(2024, 1, 1))]
    return spark.createDataFrame(rows, "id long, x double, s string, b boolean, t timestamp_ntz")


def ids(df, *filters):
    return sorted(r.id for r in execute(df, QuerySpec(filters=filters)).df.collect())


def test_null_and_nan_never_match(odd):
    assert ids(odd, Filter("x", "<>", "7")) == [1, 4, 5, 6]
    assert ids(odd, Filter("x", ">", "0")) == [1, 4] and ids(odd, Filter("x", ">=", "-5")) == [1, 4, 5]
    assert ids(odd, Filter("x", "IS NULL")) == [3] and 2 in ids(odd, Filter("x", "IS NOT NULL"))
    assert ids(odd, Filter("x", "BETWEEN", "-1", "1")) == [1, 5] and ids(odd, Filter("x", "BETWEEN", "1", "")) == [1]
    assert ids(odd, Filter("s", "=", "")) == [4] and ids(odd, Filter("s", "LIKE", "b%")) == [2] and ids(odd, Filter("s", "<>", "a")) == [2, 4, 5]
    assert ids(odd, Filter("b", "=", "yes")) == [1, 4, 6] and ids(odd, Filter("t", "LIKE", "01-02")) == [2]
    assert ids(odd, Filter("t", "=", "2024-01-02T03:04:05.0006Z")) == [2] and ids(odd, Filter("t", "<", "0")) == [5]
    assert ids(odd, Filter("id", "<>", "2.5")) == [1, 2, 3, 4, 5, 6] and ids(odd, Filter("id", ">", "2.5"), Filter("id", "<=", "4.5")) == [3, 4] and ids(odd, Filter("id", "=", "12abc")) == []


def test_unusable_clauses_are_left_out_and_named(odd):
    fs = (Filter("x", "=", None), Filter("nope", "=", "1"), Filter("x", "=", "Infinity"), Filter("id", "=", "1"), Filter("id", "=", None, link="OR"), Filter("id", "=", "2"))
    where, skipped = compile_where(fs, odd.schema)
    assert [w for _, w in skipped] == ["empty", "missing", "invalid", "empty"]
    assert sorted(r.id for r in odd.filter(where).collect()) == [1, 2]
    assert "2 of 6" in scope(QuerySpec(filters=fs), tuple(skipped))


def test_missing_last_in_both_directions(odd):
    for down, first in ((False, [6, 5, 1, 4]), (True, [4, 1, 5, 6])):
        got = [r.id for r in order_by(odd, (Sort("x", down),), "id").collect()]
        assert got[:4] == first and set(got[4:]) == {2, 3}


def test_metrics_skip_nan(odd):
    ms = tuple(Metric(k, None if k == "COUNT_ALL" else "x", k.lower()) for k in METRICS if k != "MODE")
    r = execute(odd.filter("id NOT IN (4, 6)"), QuerySpec(metrics=ms)).df.first()
    d = r.asDict()
    assert (d["count"], d["count_all"], d["count_distinct"], d["nulls"]) == (3, 4, 3, 1)
    assert (d["sum"], d["avg"], d["min"], d["max"], d["range"], d["med"]) == (1.0, 0.5, 0.0, 1.0, 1.0, 0.5)


def test_golden_spreads(spark):
    def one(values, *kinds):
        r = execute(spark.createDataFrame([(float(v),) for v in values], "x double"), QuerySpec(metrics=tuple(Metric(k, "x", k) for k in kinds))).df.first()
        return [r[k] for k in kinds]

    assert one([2, 4, 4, 4, 5, 5, 7, 9], "STD", "STDP", "VAR", "CV") == pytest.approx([2.138089935299395, 2, 4.571428571428571, 0.427617987059879])
    assert one([1e9 + i for i in (1, 2, 3, 4)], "STD") == pytest.approx([1.2909944487358056])
    assert one([5], "STDP", "STD", "RANGE", "CV") == [0, None, 0, None] and one([1, -1], "CV") == [None]
    assert one(range(1, 11), "MED", "P90", "IQR", "RANGE") == pytest.approx([5.5, 9.1, 4.5, 9])


def test_mode_and_text_metrics(spark):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate([("x", "b"), ("x", "a"), ("x", "a"), ("x", "b"), (None, "c"), (None, None)])], "i int, g string, v string")
    q = QuerySpec(group_by=("g",), metrics=(Metric("MODE", "v"), Metric("SUM", "v"), Metric("COUNT_ALL")), order_key="i")
    assert {tuple(r) for r in execute(df, q).df.collect()} == {("x", "b", None, 4), (None, "c", None, 2)}
    assert execute(df.filter("i < 0"), QuerySpec(metrics=(Metric("MODE", "v"), Metric("COUNT_ALL")))).df.collect()[0][1] == 0


def test_partitions_do_not_matter(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(4), None if rng.random() < 0.1 else rng.expovariate(1) * 100, rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, g1 string, g2 int, x double, y int")
    for mode in ("flat", "rollup", "cube"):
        q = QuerySpec(group_by=("g1", "g2"), group_mode=mode, metrics=tuple(Metric(k, None if k == "COUNT_ALL" else "x", k) for k in METRICS if k != "MODE") + (Metric("MODE", "y", "MODE"),), order_key="i")
        got = [sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in execute(df.repartition(n), q).df.collect()), key=repr) for n in (1, 4, 17)]
        assert got[0] == got[1] == got[2] and len(got[0]) == {"flat": 12, "rollup": 16, "cube": 20}[mode]


def test_quantiles_are_exact(spark):
    import numpy as np

    from lodestone.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(3)
    tails = np.concatenate((rng.normal(size=3000), [1e300, -1e300, 1.7e308, 1e-300]))
    for values in (rng.normal(size=5000), np.repeat([1.0, 2.0], [4000, 1000]), np.array([5.0]), np.round(rng.exponential(size=3000), 1), tails, np.exp(rng.normal(size=4000) * 30), np.array([np.inf, 1.0, np.inf, -np.inf, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        points = [0.0, 0.25, 0.5, 0.99, 1.0]
        for on_driver in (True, False):
            got = exact_quantiles(df, [], F.col("x"), points, on_driver=on_driver)[0].first().q
            for g, w in zip(got, np.quantile(values, points)):
                assert g == pytest.approx(w, rel=1e-12) or not np.isfinite(w)


def test_quantiles_of_sets(spark, monkeypatch):
    """Every grouping set against numpy, on the driver and by windows."""
    import numpy as np

    from lodestone.operators import quantiles

    rng = np.random.default_rng(4)
    data = [(i, "big" if i % 10 else f"g{i % 7}", i % 3, float(v)) for i, v in enumerate(rng.lognormal(size=30000))]
    df = spark.createDataFrame(data, "i int, g string, h int, x double")
    q = QuerySpec(group_by=("g", "h"), group_mode="cube", metrics=(Metric("P99", "x", "p"), Metric("IQR", "x", "r")))
    for cells in (200_000, 40):
        monkeypatch.setattr(quantiles, "CELLS", cells)
        for r in execute(df, q).df.collect():
            x = [d[3] for d in data if r.g in (None, d[1]) and r.h in (None, d[2])]
            assert (r.p, r.r) == pytest.approx((np.quantile(x, 0.99), np.quantile(x, 0.75) - np.quantile(x, 0.25)))


def test_names_that_clash(spark):
    df = spark.createDataFrame([("a", "g", 1), ("a", "x", 2), ("b", "g", 4)], "g string, c string, v int")
    same = execute(df, QuerySpec(group_by=("g",), metrics=(Metric("SUM", "v", "g"),), sort=(Sort("g", True),))).df
    assert same.columns == ["g", "g"] and [tuple(r) for r in same.collect()] == [("b", 4.0), ("a", 3.0)]
    wide = execute(df, QuerySpec(group_by=("g", "c"), group_mode="pivot", metrics=(Metric("SUM", "v"),), sort=(Sort("g"),))).df
    assert wide.columns == ["g", "g", "x"] and [tuple(r) for r in wide.collect()] == [("a", 1.0, 2.0), ("b", 4.0, None)]


def test_pivot_of_mode(spark):
    df = spark.createDataFrame([(0, "a", "p", 5), (1, "a", "p", 7), (2, "a", "p", 7), (3, "a", "q", 1), (4, "b", "q", 9), (5, "b", "q", 2)], "i int, g string, c string, v int")
    q = QuerySpec(group_by=("g", "c"), group_mode="pivot", metrics=(Metric("MODE", "v", "m"), Metric("COUNT", "v", "n")), order_key="i", sort=(Sort("g"),))
    out = execute(df, q).df
    assert out.columns == ["g", "p · m", "p · n", "q · m", "q · n"]
    assert [tuple(r) for r in out.collect()] == [("a", 7, 3, 1, 1), ("b", None, None, 9, 2)]


def test_pivot_names_and_other(spark):
    df = spark.createDataFrame([(i, i % 60, i) for i in range(120)] + [(999, None, 5)], "i int, c int, v int")
    q = QuerySpec(group_by=("c",), group_mode="pivot", metrics=(Metric("COUNT", "v"),), order_key="i")
    cols = execute(df, q).df.columns
    assert cols[:3] == ["0", "1", "2"] and len(cols) == 51 and cols[-1] == "(other)"
    assert execute(df.filter("i >= 999 OR i < 2"), q).df.columns == ["0", "1", "(null)"]
    two = execute(df.filter("i < 1"), QuerySpec(group_by=("i", "c"), group_mode="pivot", metrics=(Metric("SUM", "v"), Metric("MAX", "v", "top")))).df
    assert two.columns == ["i", "0 · SUM(v)", "0 · top"]
    base = [(c, float(c)) for c in range(60)]
    spread = execute(spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(base)], "i int, c int, v double"), QuerySpec(group_by=("c",), group_mode="pivot", metrics=(Metric("STD", "v"),), order_key="i")).df.first()
    assert spread["(other)"] == pytest.approx(3.0276503540974917)


def test_number_text(spark):
    want = {1.0: "1", 0.1: "0.1", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1.5e-7: "1.5e-7", -2.5: "-2.5", 12345678.9: "12345678.9", 1e7: "10000000", -0.0: "0", 100.0: "100", 1.7976931348623157e308: "1.7976931348623157e+308", INF: "Infinity", -INF: "-Infinity", 0.00123: "0.00123"}
    df = spark.createDataFrame([(k,) for k in want], "x double").select("x", number_text(F.col("x")).alias("t"))
    assert {r.x: r.t for r in df.collect()} == want
    assert spark.createDataFrame([(NAN,)], "x double").select(number_text(F.col("x"))).first()[0] == "NaN"


def test_canonical_text(spark, odd):
    df = spark.createDataFrame([(bytearray(range(30)), dt.datetime(2024, 1, 1, 10, 20, 30), [1, None], {"a": 1}, decimal.Decimal("1.50"), dt.date(2024, 5, 6))], "b binary, t timestamp, l array<int>, m map<string,int>, d decimal(9,2), y date")
    got = df.select(*(text(F.col(f.name), f.dataType) for f in df.schema)).first()
    assert tuple(got) == (bytes(range(24)).hex() + "…", "2024-01-01 10:20:30Z", "[1,null]", '{"a":1}', "1.50", "2024-05-06")
    assert [r[0] for r in odd.orderBy("id").select(text(F.col("t"), T.TimestampNTZType())).collect()][:2] == ["2024-01-01 00:00:00", "2024-01-02 03:04:05.0006"]
    nested = spark.createDataFrame([((("x", 1), [("n", [1])], {"k": 2}),)], "s struct<a:struct<b:string,c:int>,p:array<struct<q:string,r:array<int>>>,m:map<string,int>>")
    assert flatten_leaves(nested).columns == ["s.a.b", "s.a.c", "s.p.q", "s.p.r", "s.m.key", "s.m.value"]


def test_literals():
    assert parse_number("12abc") == 12 and parse_number("x") is None and parse_number("1e400") is None and parse_number("-.5") == decimal.Decimal("-0.5")
    assert parse_temporal("2024-02-30") is None and parse_temporal("1000") == dt.datetime(1970, 1, 1, 0, 0, 1)
    assert nearest_name("pirce", ["price", "name"]) == "price" and nearest_name("zzzz", ["price"]) is None


@pytest.fixture(scope="module")
def schema(spark):
    return spark.createDataFrame([], "id long, name string, price double, day date, ok boolean, `odd name` string, tags array<string>").schema


REFUSED = {
    "unknown column": "SELECT nmae FROM t", "join": "SELECT * FROM t INNER JOIN u ON id = u.id", "or inside and": "SELECT * FROM t WHERE id = 1 AND (id = 2 OR id = 3)", "not": "SELECT * FROM t WHERE NOT id = 1", "having": "SELECT name, COUNT(*) FROM t GROUP BY name HAVING COUNT(*) > 1",
    "distinct": "SELECT DISTINCT name FROM t", "offset": "SELECT * FROM t LIMIT 5 OFFSET 2", "union": "SELECT * FROM t UNION SELECT * FROM t", "alias": "SELECT name AS n FROM t", "null comparison": "SELECT * FROM t WHERE name = NULL", "limit": "SELECT * FROM t LIMIT 0",
    "unknown function": "SELECT UPPER(name) FROM t", "literal type": "SELECT * FROM t WHERE id = 'x'", "order by": "SELECT name, COUNT(*) FROM t GROUP BY name ORDER BY price", "star": "SELECT *, COUNT(*) FROM t", "ungrouped column": "SELECT name, id, COUNT(*) FROM t GROUP BY name", "character": "SELECT # FROM t",
    "syntax": "SELECT id FROM t WHERE id", "expression": "SELECT MAX(id) - MIN(price) FROM t",
}


@pytest.mark.parametrize("reason", sorted(REFUSED))
def test_refusals(schema, reason):
    with pytest.raises(SqlError) as e:
        parse_sql(REFUSED[reason], schema)
    assert e.value.reason == reason and 0 <= e.value.at <= len(REFUSED[reason])


def test_more_refusals_and_warnings(schema):
    for s in ("SELECT * FROM t WHERE name NOT LIKE '%x%'", "SELECT * FROM t WHERE id NOT BETWEEN 1 AND 2"):
        with pytest.raises(SqlError) as e:
            parse_sql(s, schema)
        assert e.value.reason == "not"
    with pytest.raises(SqlError, match="did you mean name"):
        parse_sql("SELECT nmae FROM t", schema)
    assert parse_sql("SELECT * FROM t WHERE name LIKE 'a_b'", schema).warnings and parse_sql("SELECT SUM(name) FROM t", schema).warnings and parse_sql("SELECT COUNT(*) FROM t GROUP BY name", schema).warnings
    assert parse_sql("select ID from t -- c\n where /* x */ (NAME = 'it''s' and id = -1) or day between '2024-01-01' and '2024-02-01';", schema).query == QuerySpec(("id",), (Filter("name", "=", "it's"), Filter("id", "=", "-1"), Filter("day", "BETWEEN", "2024-01-01", "2024-02-01", "OR")))


def test_writer_and_parser_are_inverse(schema):
    metrics = [Metric(k, None if k == "COUNT_ALL" else "price", a) for k in METRICS for a in (None, "a b")]
    specs = [QuerySpec(("id", "odd name"), (Filter("name", "LIKE", "x'y"), Filter("ok", "=", "true"), Filter("price", "BETWEEN", "1", "2.5", "OR"), Filter("tags", "IS NOT NULL")), sort=(Sort("id", True), Sort("odd name")), limit=7), QuerySpec()]
    specs += [QuerySpec(group_by=("name", "day"), group_mode=m, metrics=(Metric("SUM", "price"), x), sort=(Sort(x.name, True), Sort("name"))) for x in metrics for m in ("flat", "rollup", "cube") if x.name != "SUM(price)"]
    specs += [QuerySpec(group_by=("name", "ok"), group_mode="pivot", metrics=(Metric("AVG", "price"),))]
    for q in specs:
        sql = write_sql(q, schema)
        assert parse_sql(sql, schema).query == q, sql
    joins_ = (("u", "id", "uid"),)
    assert parse_sql(write_sql(QuerySpec(), schema, "t", joins_), schema, joins_).query == QuerySpec()


def test_scope_and_toggles(spark):
    q = toggle_sort(QuerySpec(), "a")
    assert q.sort == (Sort("a"),) and toggle_sort(q, "a").sort == (Sort("a", True),) and toggle_sort(toggle_sort(q, "a"), "a").sort == ()
    assert toggle_sort(q, "b", add=True).sort == (Sort("a"), Sort("b"))
    q = scope_to(QuerySpec(filters=(Filter("a", ">", 1), Filter("b", "=", 2), Filter("a", "<", 0, link="OR"))), Filter("a", "BETWEEN", 3, 4))
    assert q.filters == (Filter("b", "=", 2), Filter("a", "BETWEEN", 3, 4), Filter("a", "BETWEEN", 3, 4, "OR"))
    assert display_order(["a", "b", "c"], pinned=("c",), hidden=("b",)) == ["c", "a"]
    df = spark.createDataFrame([(math.exp(i / 37),) for i in range(500)], "x double")
    counts = {r.bin: r.n for r in profile.histogram(df, "x").collect()}
    for k in (0, 3, 23):
        lo, hi = profile.bin_bounds(df, "x", k)
        assert execute(df, scope_to(QuerySpec(), Filter("x", "BETWEEN", repr(lo), repr(hi)))).df.count() == counts[k]


def test_profile(spark, odd):
    p = {r.column: r for r in profile.profile(odd).collect()}
    assert (p["x"]["count"], p["x"]["nulls"], p["x"]["min"], p["x"]["max"]) == (2, 1, 0.0, 1.0)
    assert p["x"]["non_finite"] == 3 and sum(p["x"]["hist"]) == 2 and p["b"]["trues"] == 3 and p["s"]["top"][0]["value"] == "a" and p["s"]["distinct"] == 4 and p["s"]["empties"] == 1
    nested = profile.profile(spark.createDataFrame([([1, 2],), ([],), (None,)], "l array<int>")).first()
    assert (nested["min_len"], nested["max_len"], nested["empties"], nested["nulls"]) == (0, 2, 1, 1)
    assert profile.profile(odd.limit(0)).count() == 5


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x", NAN), (2, "y", 1.0), (None, "z", 2.0)], "k int, v string, f double"), spark.createDataFrame([("1", "p"), ("x", "q"), (None, "r")], "K string, v string")
    assert joins.guess_keys(a, b) == ("k", "K")
    t = joins.join(Table(a, "a"), Table(b, "b"), "k", "K")
    assert t.df.columns == ["k", "v", "f", "b_v"] and [tuple(r)[3] for r in t.df.collect()] == ["p"] and t.joins == (("b", "k", "K"),) and t.undo().df is a
    assert joins.join(Table(a, "a"), Table(a, "c"), "f", "f").df.count() == 3
    many = spark.range(2000).selectExpr("id % 2 AS k")
    assert joins.estimate_rows(many, many, "k", "k") == 2_000_000
    with pytest.raises(Refusal, match="2,000,000 rows"):
        joins.join(Table(many), Table(many), "k", "k", max_rows=1_000_000)


def test_diff(spark):
    a = spark.createDataFrame([(i, f"n{i}", float(i), i) for i in range(100)], "id long, name string, score double, qty int")
    b = a.selectExpr("id", "name AS label", "CASE WHEN id % 10 = 0 THEN score + 1000 ELSE score END AS score", "CAST(qty AS LONG) AS qty", "'x' AS extra", "true AS flag")
    d = diff.schema_diff(a.schema, b.drop("extra").schema)
    assert d.renamed == (("name", "label"),) and d.added == ("flag",) and d.retyped == (("qty", "int", "bigint"),)
    r = diff.row_diff(a, b, ["id"])
    assert tuple(r.counts().first()) == (0, 0, 10, 90) and {x.column: x.n for x in r.per_column().collect()} == {"score": 10, "qty": 0}
    self = diff.row_diff(a, a, ["id"])
    assert tuple(self.counts().first()) == (0, 0, 0, 100)
    assert diff.suggest_key(a, b) == "id"
    one = spark.createDataFrame([(None, NAN), (1, None)], "k int, v double")
    assert tuple(diff.row_diff(one, one, ["k"]).counts().first()) == (0, 0, 0, 2)
    for keys, reason in (([], "no key"), (["nope"], "key missing"), (["v"], "key repeated")):
        with pytest.raises(Refusal) as e:
            diff.row_diff(one.union(one), one, keys)
        assert e.value.reason == reason


def put(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_folders(spark, tmp_path):
    for y, m in itertools.product((2023, 2024), ("01", "02")):
        put(tmp_path / f"hive/year={y}/month={m}/part-0.parquet", id=[1, 2, 3], name=["a", "b", None])
    (tmp_path / "hive/_SUCCESS").touch()
    put(tmp_path / "hive/year=2023/month=01/.hidden.parquet", other=[1])
    t = open_table(spark, str(tmp_path / "hive"))
    assert t.df.columns == ["year", "month", "id", "name"] and t.df.count() == 12 and execute(t.df, QuerySpec(filters=(Filter("year", "=", "2024"), Filter("month", "=", "1")))).df.count() == 3
    put(tmp_path / "ragged/one.parquet", a=[1, 2], b=["p", "q"])
    put(tmp_path / "ragged/two.parquet", a=[4, 5])
    put(tmp_path / "ragged/three.parquet", a=[6], b=["z"], c=[9.5])
    (tmp_path / "ragged/bad.parquet").write_bytes(b"not parquet at all")
    t = open_table(spark, str(tmp_path / "ragged"))
    assert sorted(map(tuple, t.df.select("a", "b", "c").collect())) == [(1, "p", None), (2, "q", None), (4, None, None), (5, None, None), (6, "z", 9.5)]
    assert len(t.skipped) == 1 and t.skipped[0].endswith("bad.parquet")
    put(tmp_path / "conflict/int.parquet", a=[1])
    put(tmp_path / "conflict/str.parquet", a=["x"])
    # nested folders and any spelling of a suffix; keys of folders that disagree come from the paths
    for i, n in enumerate(("c.parquet", "d.PQ", "f.Parquet", "g.pArQ", "sub/e.parquet", "sub/deep/h.PARQUET")):
        put(tmp_path / "mixed" / n, id=list(range(10 * i, 10 * i + 10)))
    t = open_table(spark, str(tmp_path / "mixed"))
    assert t.df.agg(F.count("*"), F.count_distinct("id")).first()[:2] == (60, 60) and not t.skipped
    assert footer.files(footer.column_chunks(spark, str(tmp_path / "mixed"))).agg(F.sum("rows")).first()[0] == 60
    put(tmp_path / "uneven/year=2023/day=2023-01-05/a.parquet", id=[1])
    put(tmp_path / "uneven/year=2024/b.PARQ", id=[2])
    put(tmp_path / f"uneven/year={HIVE_NULL}/sub/c.parquet", id=[3], x=[0.5])
    put(tmp_path / "uneven/d.parquet", id=[4])
    t = open_table(spark, str(tmp_path / "uneven"))
    assert t.df.columns == ["year", "day", "id", "x"] and t.df.schema["year"].dataType == T.IntegerType()
    assert sorted(map(tuple, t.df.collect()), key=lambda r: r[2]) == [(2023, dt.date(2023, 1, 5), 1, None), (2024, None, 2, None), (None, None, 3, 0.5), (None, None, 4, None)]
    r = plan_report(footer.column_chunks(spark, str(tmp_path / "hive")), QuerySpec(filters=(Filter("year", "=", "2024"), Filter("id", ">", "2")))).first()
    assert (r.groups, r.kept, r.by_partition, r.by_statistics) == (4, 2, 2, 0)
    with pytest.raises(Refusal, match="int.parquet.*str.parquet"):
        open_table(spark, str(tmp_path / "conflict"))
    with pytest.raises(Refusal, match="no readable"):
        (tmp_path / "none").mkdir()
        open_table(spark, str(tmp_path / "none"))
    c = Catalogue(spark)
    c.open(str(tmp_path / "hive"), "shop")
    assert spark.sql("SELECT count(*) FROM shop").first()[0] == 12 and len(c.tree(str(tmp_path / "ragged"))) == 4


def test_types_spark_cannot_read_and_text_sniffing(spark, tmp_path):
    import numpy as np

    values = np.array([1.5, -2.0, 0.0, 6e-8, np.inf], np.float16)
    table = pa.table({"h": pa.array(values, pa.float16()), "raw": pa.array([b"plain text", b"", None, "é".encode(), b"x"]), "bin": pa.array([b"\xff\x00", b"\x01", None, b"", b"z"])})
    pq.write_table(table, tmp_path / "odd.parquet")
    df = open_table(spark, str(tmp_path / "odd.parquet")).df
    rows = df.collect()
    assert [r.h for r in rows] == [float(v) for v in values] and rows[3].raw == "é" and isinstance(rows[0].bin, (bytes, bytearray))


def test_files_beyond_the_reader_go_through_arrow(spark, tmp_path):
    t = pa.table({"id": [1, 2, 3], "ms": pa.array([1500, None, 0], pa.time32("ms")), "ns": pa.array([1_000_000_123, 0, None], pa.timestamp("ns")), "x": [0.5, 1.5, None]})
    (tmp_path / "k=a").mkdir()
    pq.write_table(t, tmp_path / "k=a/one.parquet", compression="brotli", row_group_size=2, use_dictionary=False, column_encoding={"x": "BYTE_STREAM_SPLIT"})
    pq.write_table(pa.table({"id": [4]}), tmp_path / "k=a/two.parquet", compression="brotli")
    rows = sorted(open_table(spark, str(tmp_path)).df.collect(), key=lambda r: r.id)
    # a row group a task, and only what is asked for
    df = open_table(spark, str(tmp_path), columns=["id"], where=QuerySpec(filters=(Filter("id", "<", "3"),))).df
    assert df.columns == ["id"] and df.rdd.getNumPartitions() == 1 and sorted(r.id for r in df.collect()) == [1, 2]
    pq.write_table(pa.table({"id": list(range(400))}), tmp_path / "forty.parquet", compression="brotli", row_group_size=10)
    df = open_table(spark, str(tmp_path / "forty.parquet")).df
    assert sorted(r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) == [10] * 40
    assert [(r.k, r.id, r.ms, r.x) for r in rows] == [("a", 1, "00:00:01.500", 0.5), ("a", 2, None, 1.5), ("a", 3, "00:00:00.000", None), ("a", 4, None, None)]
    assert rows[0].ns == dt.datetime(1970, 1, 1, 0, 0, 1)


def test_footers_and_plan(spark, tmp_path):
    pq.write_table(pa.table({"id": list(range(1000)), "s": [f"s{i:04d}" for i in range(1000)]}), tmp_path / "a.parquet", row_group_size=100)
    chunks = footer.column_chunks(spark, str(tmp_path / "a.parquet"))
    assert footer.row_groups(chunks).count() == 10
    col = {r.column: r for r in footer.columns(chunks).collect()}
    assert (col["id"]["min"], col["id"]["max"], col["id"]["nulls"], col["s"]["max"]) == ("0", "999", 0, "s0999")
    r = plan_report(chunks, QuerySpec(("id",), (Filter("id", "BETWEEN", "250", "310"),))).first()
    assert (r.groups, r.kept) == (10, 2) and r.kept_bytes < r.bytes / 5
    either = QuerySpec(("id",), (Filter("id", "<", "50"), Filter("id", ">=", "950", link="OR"), Filter("s", "LIKE", "x")))
    assert plan_report(chunks, either).first().kept == 2
    assert footer.shape(chunks).first().rows == 1000
    kinds = {"d": [decimal.Decimal(i) / 1 - 500 for i in range(1000)], "day": [dt.date(1994, 1, 1) + dt.timedelta(days=i) for i in range(1000)], "at": [dt.datetime(1994, 1, 1) + dt.timedelta(days=i) for i in range(1000)], "x": [i / 10 for i in range(1000)], "s": [f"s{i:04d}" for i in range(1000)]}
    pq.write_table(pa.table({**kinds, "d": pa.array(kinds["d"], pa.decimal128(30, 2))}), tmp_path / "kinds.parquet", row_group_size=200)
    chunks = footer.column_chunks(spark, str(tmp_path / "kinds.parquet"))
    col = {r.column: r for r in footer.columns(chunks).collect()}
    assert (col["d"]["min"], col["d"]["max"]) == ("-500.00", "499.00") and (col["day"]["min"], col["day"]["max"]) == ("1994-01-01", "1996-09-26")
    for f in (Filter("at", "<", "1995-01-01"), Filter("day", ">=", "1995-06-01"), Filter("day", "BETWEEN", "1994-01-05", "1994-01-06"), Filter("s", "=", "s0450"), Filter("s", "<", "s02"), Filter("d", "<", "-100.5"), Filter("d", ">", "99.5"), Filter("x", "=", "0.1"), Filter("x", ">", "79.95")):
        df = spark.read.parquet(str(tmp_path / "kinds.parquet"))
        want = {i // 200 for i, ok in enumerate(r[0] for r in df.select(compile_where((f,), df.schema)[0]).collect()) if ok}
        assert plan_report(chunks, QuerySpec(filters=(f,))).first().kept == len(want), f
    plan = execute(spark.read.parquet(str(tmp_path / "a.parquet")), QuerySpec(("s",), (Filter("id", ">", "990"),))).df._jdf.queryExecution().toString()
    assert "GreaterThan(id,990)" in plan and "PushedFilters" in plan


def test_footers_by_table(spark, tmp_path):
    put(tmp_path / "one.parquet", a=[1, 2], b=[1, 2])
    for i, n in enumerate(("many.parquet/part-0.parquet", "many.parquet/sub/deep/part-0.PARQ", "plain/part-0.parquet", "gaps.parquet/part-0.parquet")):
        put(tmp_path / n, a=list(range(10 + i)), **{f"c{i}": list(range(10 + i))})
    pq.write_table(pa.table({"a": pa.array([], pa.int64())}), tmp_path / "many.parquet/empty.parquet")
    pq.write_table(pa.table({"a": range(7)}), tmp_path / "many.parquet/groups.parquet", row_group_size=2)
    (tmp_path / "gaps.parquet/bad.parquet").write_bytes(b"not parquet at all")
    got = {r.name: (r.files, r.unreadable, r.rows, r.columns) for r in footer.tables(footer.column_chunks(spark, str(tmp_path)), footer.listed_root(spark, str(tmp_path))).collect()}
    assert got == {"one.parquet": (1, 0, 2, 2), "many.parquet": (4, 0, 28, 3), "plain": (1, 0, 12, 2), "gaps.parquet": (2, 1, None, None)}
    # a root that is a file
    one = footer.tables(footer.column_chunks(spark, str(tmp_path / "one.parquet")), footer.listed_root(spark, str(tmp_path / "one.parquet"))).first()
    assert (one["name"], one.files, one.rows) == ("one.parquet", 1, 2)


def test_footers_where_only_spark_reads(spark, tmp_path):
    put(tmp_path / "a.parquet", id=list(range(50)), s=[f"s{i}" for i in range(50)])
    put(tmp_path / "b.parquet/k=x%3Ay/part 0#?.parquet", id=[1], x=[0.5])
    pq.write_table(pa.table({"id": list(range(1000))}), tmp_path / "b.parquet/groups.parquet", row_group_size=100)
    for n, content in {"short": b"PAR1", "text": b"not parquet at all", "mark": b"PAR1" + b"\xff" * 8 + b"PAR1"}.items():
        (tmp_path / f"{n}.parquet").write_bytes(content)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.footers.link./in", f"file://{tmp_path}")

    def read(path):
        root = footer.listed_root(spark, path)
        chunks = footer.column_chunks(spark, path)
        listed = [r.asDict() | {"path": r.path[len(root) :], "problem": r.problem is None} for r in chunks.collect()]
        return sorted(listed, key=repr), sorted(map(tuple, footer.tables(chunks, root).collect()))

    here, there = read(str(tmp_path)), read("viewfs://footers/in")
    assert here == there
    assert [(n, rows) for n, _, _, _, rows, _ in there[1]] == [("a.parquet", 50), ("b.parquet", 1001), ("mark.parquet", None), ("short.parquet", None), ("text.parquet", None)]
    assert open_table(spark, "viewfs://footers/in/b.parquet").df.agg(F.count("*"), F.count("x")).first()[:2] == (1001, 1)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc', 1.0, decimal.Decimal("2.50"), True, None, [1]), (2**60, None, NAN, None, None, dt.date(2024, 1, 2), None)], "n long, s string, x double, d decimal(9,2), b boolean, y date, l array<int>").coalesce(1)
    csv = "".join(export.lines(df, "csv"))
    assert csv.splitlines()[0] == "n,s,x,d,b,y,l" and '"a,""b""\nc",1,2.50,true,,[1]' in csv and csv.rstrip("\n").endswith(f"{2**60},,NaN,,,2024-01-02,")
    import json

    out = json.loads("".join(export.lines(df, "json")))
    assert out[0] == {"n": 1, "s": 'a,"b"\nc', "x": 1, "d": "2.50", "b": True, "y": None, "l": [1]} and out[1]["n"] == str(2**60) and out[1]["x"] is None
    md = "".join(export.lines(df, "md"))
    assert md.splitlines()[1].startswith("| ---: | --- | ---:") and "c | 1 |" in md and "<br>" in md
    export.save(df, str(tmp_path / export.file_name("t", "tsv", "filtered")), "tsv")
    assert (tmp_path / "t-filtered.tsv").exists()
    export.write(df, str(tmp_path / "parts"), "csv")
    assert spark.read.csv(str(tmp_path / "parts"), header=True, multiLine=True, escape='"').count() == 2
    assert export.inspect(df, {"n": 1}, "l") == "[ 1 ]" and "00000000  61 62" in export.hex_dump(b"ab")
    with pytest.raises(Refusal):
        list(export.lines(df, "xlsx"))


def test_stream_keeps_metrics_up_to_date(spark, tmp_path):
    for i in range(3):
        put(tmp_path / f"in/{i}.parquet", g=["a", "b"], x=[float(i), 10.0])
    stream = read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = QuerySpec(group_by=("g",), metrics=(Metric("SUM", "x", "s"), Metric("COUNT_ALL", None, "n"), Metric("STD", "x", "d")))
    w = running_aggregate(stream, q).writeStream.outputMode("complete").format("memory").queryName("kept").start()
    w.processAllAvailable()
    w.stop()
    assert {(r.g, r.s, r.n) for r in spark.table("kept").collect()} == {("a", 3.0, 3), ("b", 30.0, 3)}
    with pytest.raises(Refusal):
        running_aggregate(stream, QuerySpec(metrics=(Metric("MED", "x"),)))


def test_cancellable(spark):
    with cancellable(spark, "lodestone-test"):
        assert spark.range(3).count() == 3
