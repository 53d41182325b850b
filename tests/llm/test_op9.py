import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from lodestone.llm import op9_tokens as op9

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocab, unk=0):
    t = Tokenizer(models.Unigram(vocab, unk_id=unk, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_table_equals_the_library(spark, sf):
    t = library(op9.vocabulary(PATH))
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in rows}
    assert {r.doc_id: r.n_tokens for r in op9.query(spark, sf).collect()} == want


def test_ties_and_unknown_characters():
    vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -3.0), ("aab", -5.0), ("ab", -4.0), ("▁aa", -3.0)]
    t, c = library(vocab), op9.Counter(vocab)
    rng = random.Random(4)
    for _ in range(2000):
        x = "".join(rng.choice("aaab b▁é\n") for _ in range(rng.randrange(0, 14)))
        assert c.text(x) == len(t.encode(x, add_special_tokens=False).ids), x


def test_edges(spark):
    t = library(op9.vocabulary(PATH))
    texts = {1: None, 2: "", 3: " ", 4: "  a  b ", 5: "x" * 5000 + " y\nz", 6: "日本語 😀 été", 7: "<s> </s>", 8: "word " * 20000}
    df = spark.createDataFrame([(d, x, 9) for d, x in texts.items()], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in op9.token_counts(df).collect()} == {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in texts.items()}
    assert op9.token_counts(df.limit(0)).count() == 0
