import hashlib

from lodestone.llm import op5_chat as op5

TURNS = "conv_id long, turn long, role string, text string, block string"


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, ts in by.items():
        ts.sort(key=lambda v: (v[0], v[1].encode(), v[2].encode()))
        loss = "".join(x for _, r, x in ts if r == "assistant")
        turns = "".join(f"{r}\n{x}\n" for _, r, x in ts)
        out[c] = (len(ts), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digest(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", op5.TRICKY), (-7, 1, "assistant", op5.TRICKY)]
    assert digest(op5.query(spark, sf)) == expected(rows)


ROWS = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2 == 0], f"turn {i} " * (i % 40 + 1)) for i in range(700)]
ROWS += [(2, 0, "system", "alone"), (3, 0, None, None), (3, None, "assistant", ""), (4, 5, "assistant", "x" + "␛<|im_end|>\n␛␛<␛/s>"), (4, 6, "a\nb␛␤<s>", "<|im_start|>user\nhi<|im_end|>\n\n")]
ROWS += [(5, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "assistant", "same"), (6, 0, "assistant", "word " * 5000), (6, 1, "assistant", "end"), (None, 0, "assistant", "no id"), (7, 0, "system", "word " * 3000), (7, 1, "assistant", "hello")]


def test_edges_read_back(spark):
    df = spark.createDataFrame([(*r, "") for r in ROWS], TURNS)
    for size in ((2048, 256, 2), (120, 40, 3), (30, 8, 1), (2048, 256, 2, "pieces"), (60, 20, 2, "pieces")):
        assert digest(op5.read_back(op5.windows(df, *size))) == expected(ROWS)
    assert op5.windows(df.limit(0)).count() == 0


def test_windows_keep_budget_history_and_mask(spark):
    df = spark.createDataFrame([(*r, "") for r in ROWS if r[0] == 1], TURNS)
    budget, history = 400, 120
    got = op5.windows(df, budget, history, 2, "pieces").orderBy("span").collect()
    assert len(got) > 20
    import re

    def cost(x):
        return len(re.findall(r"[^\W\d_]{1,4}|\d{1,3}|[^\s\w]|\s", x)) + op5.MARKS

    targets = []
    for i, w in enumerate(got):
        assert op5.CONTROL and w.formatted.count(op5.START) == w.formatted.count(op5.END)
        turns = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", w.formatted, re.S)
        assert turns[0] == ("system", "turn 0 ")
        assert sum(cost(x) for _, x in turns) <= budget
        assert w.repeats <= 3 and (i == 0 or w.repeats >= 1)
        targets += [w.formatted[r.start : r.start + r.length] for r in w.loss]
    assert targets == [x for _, _, r, x in ROWS[:700] if r == "assistant"]
    assert any(w.repeats == 3 for w in got)


def test_windows_in_bytes_bound_any_byte_level_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(*r, "") for r in ROWS if r[0] in (1, 4)], TURNS)
    got = op5.windows(df, 1500, 300, 2).collect()
    assert len(got) > 10
    for w in got:
        assert len(enc.encode(w.formatted, add_special_tokens=False).ids) <= len(w.formatted.encode()) <= 1500


def test_windows_beyond_the_budget(spark):
    """Only a single large turn, or a large system turn, makes a window exceed the budget, and by no more."""
    df = spark.createDataFrame([(*r, "") for r in ROWS if r[0] in (6, 7)] + [(7, i, "user", "x" * 30, "") for i in range(2, 40)], TURNS)
    budget, history = 400, 100
    for w in op5.windows(df, budget, history, 2).collect():
        turns = w.formatted.split(op5.END + "\n")[:-1]
        sizes = [len(x.encode()) + len(op5.END) + 1 for x in turns]
        system = sizes[0] if w.conv_id == 7 else 0
        span = sizes[w.repeats :]
        assert sum(sizes[bool(system) : w.repeats]) <= history or not w.repeats
        assert len(span) == 1 or sum(span) <= max(budget // 4, budget - history - system) or w.formatted.startswith(op5.START + "system")
    assert {r.conv_id: r.n_turns for r in op5.read_back(op5.windows(df, budget, history, 2)).collect()} == {6: 2, 7: 40}
