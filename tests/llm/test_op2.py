import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import op2_packing as op2
from lodestone.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts):
    tk = Tokenizer.from_file(PATH)
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(texts)
    for d, t in texts.items():
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(op2.cut(len(ids), 2048))]
        assert all(r.length == 2048 for r in got[1:])
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in rows)
    return len(seqs), -(-total // 2048)


def test_table(spark, sf):
    rows = op2.query(spark, sf).collect()
    n, least = check(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    assert n <= least * 1.03 + 1


def test_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "<|endoftext|> x", 5: "ඞ\U0001f600 \x1c\x85 　 z", 6: "a"}
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id long, text string, length int, offset int")
    check(op2.packed(df).collect(), texts)
    assert op2.packed(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.offset for r in op2.packed(twice).collect()) == [0, 2, 4, 6]


def test_plan_holds_everything_and_is_tight():
    rng = np.random.default_rng(5)
    for hist in (rng.integers(0, 900, 2049), np.bincount((rng.lognormal(6, 1, 20000).astype(int) % 2048) + 1, minlength=2049), np.bincount([1], minlength=2049), np.bincount([1365] * 5000, minlength=2049), np.zeros(2049, int)):
        hist[0] = 0
        used, seqs = np.zeros(2049, np.int64), 0
        for m, parts in op2.plan(hist):
            assert sum(n * k for n, k in parts) <= 2048
            seqs += m
            for n, k in parts:
                used[n] += m * k
        assert (used == hist).all()
        least = max(-(-int((hist * np.arange(2049)).sum()) // 2048), int(hist[1025:].sum()))
        assert seqs <= least * 1.02 + 1


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.random((20, 30)), np.maximum(rng.normal(size=30), 0)
        assert np.linalg.norm(a @ op2.nnls(a, a @ x) - a @ x) < 1e-6


def test_fast_ids_equal_the_library():
    e = encoder(PATH)
    tk = Tokenizer.from_file(PATH)
    for t in ("Étê aux  deux\n\n\tmots ß… “x” 12'll", "don't stop", "x" * 50 + "   "):
        assert e.ids(t).tolist() == tk.encode(t, add_special_tokens=False).ids
