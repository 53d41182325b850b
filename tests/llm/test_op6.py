import numpy as np

from lodestone.llm import op6_language as op6

DOCS = "doc_id long, text string, lang string, score double"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    e, a = rng.random((9, 3)) + 0.1, rng.random((3, 3)) + 0.1
    got = op6.forward_backward(e.copy(), a, np.array([0, 4, 4, 5, 9]))
    import itertools

    for lo, hi in ((0, 4), (4, 5), (5, 9)):
        want = np.zeros((hi - lo, 3))
        for p in itertools.product(range(3), repeat=hi - lo):
            v = np.prod([e[lo + i, s] for i, s in enumerate(p)]) * np.prod([a[x, y] for x, y in zip(p, p[1:])])
            for i, s in enumerate(p):
                want[i, s] += v
        assert np.allclose(got[lo:hi], want / want.sum(1, keepdims=True))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in op6.query(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_words_and_edges(spark):
    a = [" ".join(f"ka{i % 7}ru".replace(str(i % 7), "abcdefg"[i % 7]) for i in range(s, s + 30)) for s in range(40)]
    b = [" ".join(f"zo{'hijklmn'[i % 7]}ñe" for i in range(s, s + 30)) for s in range(40)]
    train = spark.createDataFrame([(i, t, v, 0.0) for i, (t, v) in enumerate([(t, "aa") for t in a] + [(t, "bb") for t in b] + [("kaaru", None)])], DOCS)
    model = op6.train(train)
    mixed = a[0] + " " + b[0]
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 -- !"), (5, "— …"), (6, b[1]), (6, b[1]), (7, a[2] * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in op6.predict(df, model, spans=True).collect()}
    assert [(x.lang, x.words) for x in got[1].runs] == [("aa", 30), ("bb", 30)]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 5))
    assert got[6].lang_pred == "bb" and got[7].lang_pred == "aa" and got[7].score > 0.9
    assert op6.predict(df.limit(0), model).count() == 0
    none = op6.train(train.filter("lang IS NULL"))
    assert {r.lang_pred for r in op6.predict(df, none).collect()} == {"und"}
    full = train.withColumn("source", op6.F.lit("s"))
    kept = op6.known_language(full.unionByName(spark.createDataFrame([(99, "12", None, 0.0, "s")], full.schema)))
    assert kept.columns == full.columns and kept.filter("doc_id = 99").count() == 0 and kept.count() == 81


def test_sample_counts_different_texts(spark, monkeypatch):
    rows = [(i % 5 if i < 500 else i, f"same{i % 5}" if i < 500 else f"text {i}", "aa", 0.0) for i in range(520)]
    monkeypatch.setattr(op6, "fit", lambda texts, labels: list(zip(labels, texts)))
    got = op6.train(spark.createDataFrame(rows, DOCS), sample=25)
    assert got == sorted({("aa", t) for _, t, _, _ in rows})
    assert len(op6.train(spark.createDataFrame(rows, DOCS), sample=10)) == 10


def test_even_mixes_of_languages_stay(spark):
    words = {v: [f"{v}{c}{v[::-1]}" for c in "bdfhkmp"] for v in ("ka", "zo", "ñe", "qui")}
    text = lambda v, s: " ".join(words[v][(s + 3 * i) % 7] for i in range(20))
    rows = [(i, text(v, i), v, 0.0) for i in range(30) for v in words]
    rows += [(900, " ".join(text(v, 1) for v in words), "ka", 0.0), (901, " ".join(text(v, 2) for v in words), None, 0.0), (902, "12 34", "ka", 0.0)]
    kept = {r.doc_id for r in op6.known_language(spark.createDataFrame(rows, DOCS)).collect()}
    assert {900, 901} <= kept and 902 not in kept and len(kept) == 32
