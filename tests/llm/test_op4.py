import hashlib

import duckdb

from lodestone.llm import op4_substring as op4
from lodestone.llm.common import table
from lodestone.llm.op4_substring import Automaton

DOCS = "doc_id long, text string, chunk string, kept string"


def brute(rows, k=13):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    owner = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            owner[g] = min(owner.get(g, d), d)
    out = {}
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if owner[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def run(df):
    from pyspark.sql import functions as F

    done = op4.substring_dedup(df.select("doc_id", "text"))
    return {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha")).collect()}


def test_matches_brute_force_and_sql(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op4.query(spark, sf).collect()} == want
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.sql(op4.ORACLE).fetchall()} == want


def test_edges(spark):
    line = " ".join(f"t{i}" for i in range(20))
    rows = [(5, line), (3, line), (4, "x " + line + " y"), (1, None), (2, ""), (6, "same " * 300), (7, "same " * 40), (8, line + "\n" + line), (9, "short text"), (10, "a b " * 14), (11, "  a b " * 14)]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], DOCS)
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == {}
    back = {r.doc_id: r for r in op4.without_repeats(df).collect()}
    assert back[3].text == line and back[5].text == "" and back[4].text == "x y" and back[1].text is None and back[8].text == ""
    odd = spark.createDataFrame([(None, line, "", ""), (1, line, "", ""), (1, line, "", "")], DOCS)
    assert sorted((str(r.doc_id), r.n_removed) for r in op4.substring_dedup(odd.select("doc_id", "text")).collect()) == [("1", 0), ("1", 0), ("None", 20)]


def test_automaton_against_substrings():
    import random

    rng = random.Random(3)
    for _ in range(100):
        a, seen = Automaton(), []
        for d in range(12):
            s = [rng.randrange(3) for _ in range(rng.randrange(3, 20))]
            got = a.known(s, d, 4)
            want = sum(1 << i for i in range(len(s) - 3) if any(t[j : j + 4] == s[i : i + 4] for t in seen for j in range(len(t) - 3)))
            assert got == want
            a.add(s, d)
            seen.append(s)


def test_a_phrase_in_ever_new_contexts_is_not_dealt_to_one_shard(spark):
    """A five-word phrase of a very low hash is the anchor of windows in 10,000 contexts: dealt apart, and nothing else changes."""
    import random

    import numpy as np
    import pyarrow as pa

    from lodestone.llm import census
    from lodestone.llm.words import Words

    random.seed(2)
    phrases = [[f"{a}{j}" for j in range(5)] for a in range(3000)]
    low = min(phrases, key=lambda p: int(Words([" ".join(p).encode()]).grams(5)[0][0]))
    rows = [(d, " ".join([f"l{d}x{i}" for i in range(12)] + low + [f"r{d}x{i}" for i in range(12)])) for d in range(10_000)]
    t = pa.table({"doc_id": [d for d, _ in rows], "text": [x for _, x in rows], "chunk": [0] * len(rows)})
    c = op4.Chunk(t, 13)
    anchor = int(Words([" ".join(low).encode()]).grams(5)[0][0])
    assert (c.anchor == anchor).sum() > 60_000
    replies = np.where(c.distinct == anchor, census.code(20_000), census.code(1)).astype(np.uint8)
    b = census.bucket_of(c.distinct, 4)
    head, n, shard, group, _ = op4._distinct_runs(c, {i: replies[b == i].tobytes() for i in range(4)}, 4, 64)
    share = np.bincount(shard, minlength=64)
    assert (n == 1).all() and len(head) > 60_000 and share.max() < 1.2 * np.median(share)


def test_hot_anchors_give_the_same_rows(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, op4.substring_dedup(docs).select("doc_id", "n_removed", "kept").collect()))
    monkeypatch.setattr(op4, "HOT", 1)
    assert sorted(map(tuple, op4.substring_dedup(docs).select("doc_id", "n_removed", "kept").collect())) == want
