"""Operator 5 (native): chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans: the running total is laid
over strides of `budget - history - system` tokens; turns wholly inside a stride
form a span and a turn across a border is one of its own, so a span fits its
stride unless a single turn does not.  Each window is the system turn, the
last turns before the span within the history budget, and the span.  A turn counts as the UTF-8 bytes of its formatted text, so
a window within the budget has at most that many tokens by any byte-level
tokenizer, even one that knows no marker; `count="pieces"` estimates tokens instead (pieces of up to four
letters or three digits, marks and spaces), closer but without that bound.  Assistant
turns of the span are targets; repeated ones are masked.  Whether a turn belongs
to a span depends on its prefix sum alone, so a long conversation is cut into
blocks of turns whose sums are added up first, and no task holds it whole.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn.  Control strings inside
roles and texts get U+241B after their first character, and U+241B itself is
doubled, which `unescape` reverses.

Defined results: null texts and roles are empty; equal turn numbers are ordered
by role, then text; a conversation of a system turn alone is one window; a turn larger than its stride has a
window of its own, which exceeds the budget; where system turn and history leave less than a quarter of the
budget, strides are that quarter, and windows exceed the budget by what the system turn is too large; a null
conv_id or turn sorts first and is a conversation or turn like others; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

START, END, ESC = "<|im_start|>", "<|im_end|>", "␛"
CONTROL = [START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = "|".join(r"(?<=%s)(?=\Q%s\E)" % (("\\" + c[0]) if c[0] == "[" else c[0], c[1:]) for c in CONTROL)
BLOCK = 256  # turns


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(ESC), F.lit(ESC * 2)), _CONTROL, ESC)


def escape_role(c: Column) -> Column:
    """A role ends at the first newline, so newlines in it become U+241B U+2424."""
    return F.replace(escape(c), F.lit("\n"), F.lit(ESC + "␤"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, f"{ESC}({ESC}?)", "$1")


def unescape_role(c: Column) -> Column:
    return unescape(F.regexp_replace(c, f"(?<!{ESC})((?:{ESC}{ESC})*){ESC}␤", "$1\n"))


def pieces(text: Column) -> Column:
    """An estimate of a text's tokens."""
    return F.regexp_count(text, F.lit(r"\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]|\s"))


MARKS = 5  # pieces of a turn's markers and role


def windows(turns: DataFrame, budget: int = 2048, history: int = 256, history_turns: int = 2, count: str = "bytes") -> DataFrame:
    """(conv_id, span, formatted, loss array<struct<start,length>>, repeats): code point ranges under the mask; `repeats` leading turns stand in an earlier window too."""
    t = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    tok = F.octet_length("head") + F.octet_length("body") + len(END) + 1 if count == "bytes" else pieces(F.col("body")) + MARKS
    t = t.withColumn("tok", tok.cast("long")).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    upto = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("conv", "block").agg(F.sum("tok").alias("bt"), F.count("*").alias("bn"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("bt").over(earlier), F.lit(0)).alias("bt"), F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("bn"))
    t = t.join(blocks, ["conv", "block"])
    t = t.withColumn("pos", F.col("bn") + F.count("*").over(upto)).withColumn("before", F.col("bt") + F.sum("tok").over(upto) - F.col("tok"))
    t = materialise(t.select("conv", "conv_id", "pos", "before", "tok", "role", "head", "body"))
    first = F.expr("pos = 1 AND role = 'system'")
    system = t.filter(first).select("conv", F.col("tok").alias("sys"), F.col("head").alias("sys_head"), F.col("body").alias("sys_body"))
    t = t.join(system.select("conv", "sys"), "conv", "left").fillna(0, ["sys"])
    stride = F.greatest(F.lit(budget - history) - F.col("sys"), F.lit(budget // 4))
    at = F.col("before") - F.col("sys")
    inside = F.floor(at / stride)
    crosses = F.floor((at + F.col("tok") - 1) / stride) > inside
    own = t.filter(~first).withColumn("span", inside * 2 + F.when(crosses, 1).otherwise(0))
    starts = own.groupBy("conv", "conv_id", "span").agg(F.min("pos").alias("pos0"), F.min("before").alias("tok0"))
    steps = starts.withColumn("pos", F.explode(F.array(*(F.col("pos0") - j for j in range(1, history_turns + 1))))).select("conv", "span", "tok0", "pos")
    past = own.drop("span").join(steps, ["conv", "pos"]).filter(F.col("before") >= F.col("tok0") - history)
    lead = starts.select("conv", "conv_id", "span").join(system, "conv").select("conv", "conv_id", "span", F.lit(0).alias("kind"), F.lit(1).cast("long").alias("pos"), F.lit(False).alias("target"), F.col("sys_head").alias("head"), F.col("sys_body").alias("body"))
    only = system.join(starts.select("conv").distinct(), "conv", "left_anti").join(t.filter(first).select("conv", "conv_id"), "conv")
    parts = (
        own.select("conv", "conv_id", "span", F.lit(2).alias("kind"), "pos", F.expr("role = 'assistant'").alias("target"), "head", "body")
        .unionByName(past.select("conv", "conv_id", "span", F.lit(1).alias("kind"), "pos", F.lit(False).alias("target"), "head", "body"))
        .unionByName(lead)
        .unionByName(only.select("conv", "conv_id", F.lit(0).cast("long").alias("span"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("pos"), F.lit(False).alias("target"), F.col("sys_head").alias("head"), F.col("sys_body").alias("body")))
    )
    listed = F.sort_array(F.collect_list(F.struct("kind", "pos", "target", "head", "body")))
    w = parts.groupBy("conv", "conv_id", "span").agg(listed.alias("p"))
    end = len(END) + 1

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        size = F.length(x["body"])
        ranges = F.when(x["target"], F.concat(acc["r"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(acc["r"])
        return F.struct((start + size + end).alias("at"), ranges.alias("r"))

    zero = F.expr("named_struct('at', 0, 'r', cast(array() as array<struct<start:int,length:int>>))")
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    w = w.withColumn("first", F.min("span").over(Window.partitionBy("conv")) == F.col("span"))
    shown_before = F.size(F.filter("p", lambda x: x["kind"] < F.when(F.col("first"), 0).otherwise(2)))
    return w.select("conv_id", "span", formatted.alias("formatted"), F.aggregate("p", zero, place)["r"].alias("loss"), shown_before.alias("repeats"))


def read_back(w: DataFrame) -> DataFrame:
    """Per conversation what its windows say: turns, each once, and the text under the mask.

    A digest of a whole conversation needs its turns in order in one place: this, unlike `windows`, holds one conversation in one task.
    """
    turns = F.slice(F.split("formatted", r"\Q" + END + r"\E\n"), F.col("repeats") + 1, 2**30)
    turns = F.filter(turns, lambda x: x != "")
    plain = F.transform(turns, lambda x: F.concat(unescape_role(F.substr(F.split_part(x, F.lit("\n"), F.lit(1)), F.lit(len(START) + 1))), F.lit("\n"), unescape(F.substr(x, F.locate("\n", x) + 1)), F.lit("\n")))
    loss = F.transform("loss", lambda r: unescape(F.substr(F.col("formatted"), r["start"] + 1, r["length"])))
    one = w.select("conv_id", "span", F.size(turns).alias("n"), F.array_join(plain, "").alias("turns"), F.array_join(loss, "").alias("target"), F.length("formatted").cast("long").alias("chars"))
    c = one.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("span", "turns", "target"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    target = F.array_join(F.col("w.target"), "")
    return c.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("w.turns"), ""), 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")


TRICKY = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return read_back(windows(turns.unionByName(extra)))
