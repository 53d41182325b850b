"""The corpus pipeline: language ID, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept and returns the columns of documents; the last returns packed pieces.
run() writes each stage's rows to the shared folder and reads them back.  docs needs doc_id,
text, lang and source; other columns pass untouched, whatever their names.  An empty table passes every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op2_packing, op4_substring, op6_language, op7_mix, op8_ngram_join
from lodestone.llm.common import free_name, materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts, texts without letters, and texts whose words are recognised too badly.

    A null lang is filled with the predicted one; null doc_ids and sources stay; repeated rows are judged alike.
    """
    return op6_language.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the least doc_id, nulls last; ties go to the least hash of the text, then of the row.

    Texts without words, null ones among them, resemble nothing and stay, each row.
    """
    return op8_ngram_join.one_per_group(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that stand in an earlier document are cut; a text that they fill becomes empty.

    A null doc_id is the latest document; rows of one doc_id are one document and keep what they repeat of each other; null texts stay null. n_chars, where there is one, follows the text.
    """
    return op4_substring.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, never for rows without words, so null and empty texts go.

    A null source is one source, the last; rows of equal doc_ids draw the same number, a null one like others, and each row is taken for itself.
    """
    row, copy = free_name(docs, "row"), free_name(docs, "copy")
    # numbered and written out, so that equal rows stay apart and a number stays with its row
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = op7_mix.mix(rows, carry=(row,)).filter("size > 0 AND copies > 0").select(row, "copies")
    taken = taken.select(F.col(row).alias(copy), F.col("copies").cast("int"))
    each = rows.join(taken.select(F.struct(copy, "copies").alias(copy)), F.col(f"{copy}.{copy}") == F.col(row))
    return each.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(f"{copy}.copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens in sequences of at most 2048; null and empty texts are the end mark alone, repeated rows are packed each."""
    return op2_packing.packed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("mixture", mixture), ("packing", packing)]

#: The conditional random field and the packing's tokenizer cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
