import numpy as np

from lodestone.llm import op3_toxicity as op3


def f1(pred, real):
    hit = sum(p and r for p, r in zip(pred, real))
    return 2 * hit / max(1, sum(pred) + sum(real))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = op3.train(docs, labels.filter("doc_id % 4 <> 1"))
    test = labels.filter("doc_id % 4 = 1").select("doc_id", op3.F.col("toxic").alias("is_toxic"), "quality")
    rows = op3.score(docs, chain).join(test, "doc_id").collect()
    assert len(rows) > 500
    print("toxic f1", f1([r.toxic for r in rows], [r.is_toxic for r in rows]), "low quality f1", f1([r.low_quality for r in rows], [not r.quality for r in rows]))
    assert f1([r.toxic for r in rows], [r.is_toxic for r in rows]) > 0.9


def test_chain_passes_earlier_categories_on_and_uses_out_of_fold():
    rng = np.random.default_rng(0)
    n = 2000
    first = rng.random(n) < 0.4
    doc, h = [], []
    for i in range(n):
        words = set(rng.integers(100, 140, 6).tolist()) | ({1} if first[i] else set())
        doc += [i] * len(words)
        h += sorted(words)
    c = op3.Chain(np.array(doc), np.array(h, np.uint64), n, np.stack((first, first), 1).astype(int))
    assert len(c.models[1].v) == 1 and c.models[1].v[0] > 0
    noise = rng.random(n) < 0.5
    c = op3.Chain(np.arange(n), np.arange(n).astype(np.uint64), n, np.stack((noise, noise), 1).astype(int), min_df=1)
    assert abs(np.corrcoef(c.out_of_fold[0], noise)[0, 1]) < 0.15  # in fold, one word a text would tell all


def test_edges(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 3 == 0 else "fine day ") + f"w{i % 5}", 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (102, "nice idiot " * 30000, 1), (102, "nice idiot " * 30000, 1), (None, "idiot", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = op3.score(docs, op3.train(docs, labels)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].toxic == (i % 3 == 0) for i in range(60))
    assert not by[100].toxic and not by[101].toxic and by[102].toxic and by[None].toxic and not any(r.low_quality for r in got)
    none = op3.train(docs, labels.limit(0))
    assert {r.toxic for r in op3.score(docs, none).collect()} == {False}
    assert op3.score(docs.limit(0), none).count() == 0
