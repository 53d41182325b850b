import hashlib
import unicodedata

from lodestone.llm import op10_fingerprint as op10

DOCS = "doc_id long, text string, form string, h string"


def canonical(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(nxt)))
    return out


def run(df, spark, monkeypatch):
    monkeypatch.setattr(op10, "table", lambda *_: df)
    return op10.query(spark, "").collect()


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op10.query(spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == expected(rows)
    forms = {d: canonical(t) for d, t in rows}
    assert len({r.fingerprint for r in got}) == len(set(forms.values()))


def test_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "ab"), (4, " AB "), (5, "Straße ﬁn x"), (6, "STRASSE  fin x\n"), (7, "été 𝒳"), (8, "été x"), (9, "long " * 20000), (10, "𝄞" * 7)]
    got = {r.doc_id: r for r in run(spark.createDataFrame([(d, t, "", "") for d, t in rows], DOCS), spark, monkeypatch)}
    assert {d: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for d, r in got.items()} == expected(rows)
    assert got[1].fingerprint == got[2].fingerprint and got[3].fingerprint == got[4].fingerprint != got[5].fingerprint == got[6].fingerprint
    assert got[7].fingerprint == got[8].fingerprint
    same = spark.createDataFrame([(1, "x", "", ""), (1, "x", "", ""), (None, "y", "", "")], DOCS)
    assert len(run(same, spark, monkeypatch)) == 3
    assert run(same.limit(0), spark, monkeypatch) == []


def test_equal_hashes_of_unlike_forms_part(spark):
    rows = spark.createDataFrame([(1, 5, "p"), (2, 5, "q"), (3, 6, "p")], "doc_id long, x long, form string")
    from pyspark.sql import functions as F

    rows = rows.select("doc_id", F.struct(F.col("x").alias("a"), F.col("x").alias("b")).alias("h"), "form", F.sha2("form", 256).alias("sha"))
    got = op10.digest_names(rows, op10.unlike_buckets(rows), {"fingerprint": ("h", "sha")}).collect()
    assert len({r.fingerprint for r in got}) == 3 and all(("-" in r.fingerprint) == (r.doc_id < 3) for r in got)


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from lodestone.llm.common import materialise

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}

    before = files()
    made = materialise(spark.range(1000).groupBy((op10.F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and made.count() == 7
