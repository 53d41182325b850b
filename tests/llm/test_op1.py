import numpy as np

from lodestone.llm import op1_vptree as op1

ROWS = "vec_id long, embedding array<float>, score string"


def brute(ids, x, step, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % step == 0:
            s = x @ q
            best = sorted((-v, j) for v, j in zip(s, ids) if j != i)[:k]
            out[i] = [j for _, j in best]
    return out


def run(df, **kw):
    out = {}
    for r in op1.nearest(df, "vec_id % 20 = 0", **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def recall(got, want):
    return np.mean([len(set(got.get(i, [])) & set(w)) / len(w) for i, w in want.items()])


def test_recall_and_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, 20)
    assert recall(run(df), want) == 1
    assert recall(run(df, factor=1.5), want) > 0.5
    assert run(df, block=7) == run(df)
    at = dict(zip(ids, x))
    for r in op1.query(spark, sf).collect():
        assert abs(r.score - float(at[r.query_id] @ at[r.vec_id])) < 1e-9


def test_pruning_is_exact_at_one_and_does_prune():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(40, 8)) * 4
    x = c[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 0.2
    q, top = x[:100], float(np.sqrt((x * x).sum(1).max()))
    lifted = np.concatenate((x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]), 1)
    s = op1.Search(q, top, 10, 1.0)
    seen = [0]
    leaf = s._leaf
    s._leaf = lambda rows, who, *a: (seen.__setitem__(0, seen[0] + len(rows) * len(who)), leaf(rows, who, *a))
    s.run(op1.Tree(lifted).root, x, 0)
    assert np.allclose(np.sort(s.score, 1), np.sort(np.sort(q @ x.T, 1)[:, -10:], 1))
    assert seen[0] < 0.7 * 6000 * 100


def test_edges(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(200)]
    good += [(i, [1.0, 0.0, 0.0, 2.0]) for i in range(300, 400)]
    bad = [(1000, None), (1020, [0.0] * 4), (1040, [float("nan"), 1.0, 1.0, 1.0]), (1060, [None, 1.0, 1.0, 1.0]), (1080, [float("inf"), 1.0, 1.0, 1.0]), (1100, [9.0]), (1120, [])]
    df = spark.createDataFrame([(*r, "") for r in good + bad], ROWS)
    ids, x = [i for i, _ in good], np.array([np.float32(v) for _, v in good], np.float64)
    assert run(df) == brute(ids, x, 20)
    assert run(df.filter("vec_id >= 1000 AND vec_id <> 1100")) == {} and run(df.limit(0)) == {}
    assert run(df.filter("vec_id IN (0, 3)")) == {0: [3]}


def test_rows_of_a_querys_own_id_take_no_place(spark):
    """All rows doubled, one query id on 30 equal rows, one on 30 different rows, and a null vec_id among the candidates."""
    rng = np.random.default_rng(4)
    near = rng.normal(size=8)
    rows = [(i, rng.normal(size=8)) for i in range(1, 120)] * 2
    rows += [(200, near)] * 30 + [(220, near + rng.normal(size=8) * 0.01) for _ in range(30)] + [(201, near), (220, near)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "") for i, v in rows + [(None, v) for _, v in rows[-40:]]], ROWS)
    want, x = [], np.array([v for _, v in rows])
    for i, v in rows:
        if i % 20 == 0:
            best = sorted((-round(float(s), 6), j) for s, (j, _) in zip(x @ np.array(v), rows) if j != i)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    for block in (5, 32768):
        got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in op1.nearest(df, "vec_id % 20 = 0", block=block).collect()]
        assert sorted(got) == sorted(want)


def test_ties_at_the_cut_go_to_the_smaller_ids(spark):
    """Small integer vectors, most of whose scores tie, some ids on several rows."""
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-1, 2, 7)]) for i in rng.permutation(3000)]
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [(i, [float(x) for x in rng.permutation([1, 1, 0, 0, -1, 0, 1])]) for i in (40, 80, 41, 40, 80, 2000) for _ in range(6)]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    want = []
    for i, v in rows:
        if i % 20 == 0:
            s = x @ np.array(v)
            best = np.lexsort((ids, -s))
            best = best[ids[best] != i][:20]
            want += [(i, n + 1, int(ids[j]), float(s[j])) for n, j in enumerate(best)]
    got = [tuple(r) for r in op1.nearest(spark.createDataFrame([(i, v, "") for i, v in rows], ROWS), "vec_id % 20 = 0").collect()]
    assert sorted(got) == sorted(want)
