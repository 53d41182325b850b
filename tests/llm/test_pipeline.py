import corpus_pipeline
from lodestone.llm.common import materialise

from .test_op4 import brute as brute_passages
from .test_op8 import brute as brute_groups


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, sf))
        seen[name] = (docs.collect(), after.collect())
        if name != "packing":
            assert after.columns == columns
        docs = after
    before, after = seen["language"]
    assert len(after) >= 0.97 * len(before) and {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = seen["near_duplicates"]
    groups = brute_groups([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, c) in groups.items() if c == d)
    before, after = seen["passages"]
    gone = brute_passages([(r.doc_id, r.text) for r in before])
    text = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert (r.text == text[r.doc_id]) if gone[r.doc_id][1] == 0 else len(r.text.split()) == gone[r.doc_id][0] - gone[r.doc_id][1]
        assert r.n_chars == len(r.text)
    before, after = seen["mixture"]
    words = sum(len(r.text.split()) for r in before)
    assert 0.9 * words < sum(len(r.text.split()) for r in after) < 1.1 * words
    before, after = seen["packing"]
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in after}) == len(after) >= len(before)


def test_run_and_empty(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edges_of_every_stage(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like the stages' own."""
    five, six = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, five, "en", "x", 7), (1, five, "en", "x", 7), (None, five, None, None, None), (2, None, "en", "x", 1), (3, "", None, "y", 2), (None, None, None, None, None), (4, six, "de", None, 3), (5, "long " * 60000 + five, "de", "y", 4), (6, six + " tail", "en", "x", 5)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    extra = {"row": 1, "copy": 2, "_h": 3, "_id": 4, "rest": 5, "size": 6, "h": 7, "kept": 8, "target": 9}
    docs = materialise(spark.createDataFrame(rows, kinds).selectExpr("*", *(f"{v} AS {k}" for k, v in extra.items())))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        if name == "packing":
            assert sorted({r.doc_id for r in got}, key=repr) == [1, 2, 3, 4, 5, 6, None] and sum(r.start == 0 for r in got) == len(rows)
            continue
        assert out.columns == docs.columns and all(tuple(r[c] for c in extra) == tuple(extra.values()) for r in got)
        texts = sorted((r.text for r in got), key=repr)
        if name == "language":
            assert None not in texts and "" not in texts
        if name == "near_duplicates":
            assert texts.count(five) == 1 and texts.count(None) == 2 and sum(t in (six, six + " tail") for t in texts if t) == 1
        if name == "passages":
            assert len(got) == len(rows) and texts.count(five) == 2 and texts.count(None) == 2 and [r.text for r in got if r.doc_id is None and r.text is not None] == [""]
        if name == "mixture":
            assert None not in texts and "" not in texts
        assert stage(spark, docs.limit(0), "").count() == 0


def test_mixture_takes_each_row_for_itself(spark):
    from pyspark.sql import functions as F

    from lodestone.llm import op7_mix

    rows = [(7, "a b c d", "s"), (7, "a b c d", "s"), (7, "e f g h", "s"), (8, "i j", "t"), (9, "k l m", "u")]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1))
    want = op7_mix.mix(docs).filter("size > 0").groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    got = corpus_pipeline.mixture(spark, docs, "").groupBy("doc_id", "source").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
