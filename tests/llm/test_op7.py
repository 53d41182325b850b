import duckdb

from lodestone.llm import op7_mix as op7

DOCS = "doc_id long, text string, source string, weight string, size string"


def test_equals_sql(spark, sf):
    got = {r.doc_id: r for r in op7.query(spark, sf).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(op7.ORACLE).fetchall()
    assert len(want) == len(got)
    for d, source, size, source_size, target, taken in want:
        r = got[d]
        assert (r.source, r.size, r.source_size, r.taken) == (source, size, source_size, taken)
        assert abs(r.target - target) < 1e-6


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in names if s not in capped)
        level = (total - sum(3 * sizes[s] for s in capped)) / free if free else 0
        over = {s for s in names if s not in capped and level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_edges_and_targets(spark):
    rows = [(i, "word " * (i % 17), ["b", "a", None, "c", "d", ""][i % 6] if i % 40 else "tiny", "x", "y") for i in range(2000)]
    rows += [(None, None, "b", "", ""), (7, "one two", "void", "", ""), (7, "one two", "void", "", ""), (3, None, "nothing", "", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = op7.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = water_fill(sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.copies <= 3 for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - want[s]) <= max([r.size for r in mine]) / 2 + 1e-9
    assert sorted(map(tuple, op7.mix(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert op7.mix(df.limit(0)).count() == 0


def test_unequal_weights_change_inclusion(spark):
    rows = [(i, "s", 10, 3.0 if i % 2 else 1.0) for i in range(4000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    goals = spark.createDataFrame([("s", 40000, 12000.0)], "source string, source_size long, target double")
    got = op7.pareto_mix(sized, goals).collect()
    heavy = sum(r.copies for r in got if r.doc_id % 2)
    light = sum(r.copies for r in got if not r.doc_id % 2)
    assert abs((heavy + light) * 10 - 12000) <= 5 and 2.4 < heavy / light < 3.6
