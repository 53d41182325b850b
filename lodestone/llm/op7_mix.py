"""Operator 7: mixing sources to target weights by Pareto order sampling.

Each source has a target size.  A document's expected copies are the target
over the source's size (times its weight); the whole part is certain and the
rest is its inclusion probability.  What the certain copies leave of the target
is filled by a fixed-size sample: documents are ranked by random odds over
inclusion odds and taken in that order up to the nearest document.  The random
number is a hash of doc_id, so reruns agree.

Ranks need no global sort: the logarithm of the ranking variable is cut into
steps, words are summed per source and step, and only documents of one step are
sorted together, so a source with a third of all rows is spread over its steps.

Defined results: a null text has size 0; a null source is one source, the last;
equal doc_ids draw the same number and repeated rows count each; documents of
size 0 take nothing; an empty table gives an empty result; extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

MOST = 3
STEPS = 256  # per unit of the logarithm of the ranking variable


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights 1, 2, 3, 1, ... by code point, null last, of the whole size, at most `most` times the source's.

    The sources of a mixture are few: their names and sums, a row each, are ordered in one task, which some millions of them fit in.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    # the sources that reach their cap first are those of least cap per weight
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    s = s.withColumn("level", F.max(fits).over(Window.partitionBy()))
    return s.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def pareto_mix(sized: DataFrame, goals: DataFrame, seed: str = "mix", most: int = MOST) -> DataFrame:
    """(doc_id, source, size[, weight]) with source_size, target, copies; goals: (source, source_size, target)."""
    if "weight" not in sized.columns:
        sized = sized.withColumn("weight", F.lit(1.0))
    g = goals.withColumnRenamed("source", "_source")
    mass = sized.groupBy("source").agg(F.sum(F.col("weight") * F.col("size")).alias("mass")).withColumnRenamed("source", "_mass_source")
    g = g.join(mass, F.col("_source").eqNullSafe(F.col("_mass_source"))).drop("_mass_source")
    d = sized.join(g, sized["source"].eqNullSafe(g["_source"])).drop("_source")
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    expected = F.least(F.lit(float(most)), F.when(F.col("mass") > 0, F.col("target") * F.col("weight") / F.col("mass")).otherwise(0.0))
    d = d.withColumn("expected", expected).withColumn("certain", F.floor("expected"))
    p = F.col("expected") - F.col("certain")
    d = d.withColumn("rank", F.when(p > 0, F.log(u / (1 - u)) - F.log(p / (1 - p)))).withColumn("step", F.floor(F.col("rank") * STEPS))
    step = d.groupBy("source", "step").agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"))
    by_step = Window.partitionBy("source").orderBy(F.col("step").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    step = step.select(F.col("source").alias("_source"), F.col("step").alias("_step"), F.coalesce(F.sum("words").over(by_step), F.lit(0)).alias("ahead"), F.sum("sure").over(Window.partitionBy("source")).alias("sure"))
    d = d.join(step, d["source"].eqNullSafe(step["_source"]) & d["step"].eqNullSafe(step["_step"]))
    inside = Window.partitionBy("_source", "_step").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # documents that are never drawn (no fraction) need no order
    ahead = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    drawn = d.filter("rank IS NOT NULL AND size > 0").withColumn("drawn", (ahead + F.col("size") / 2 <= F.col("target") - F.col("sure")).cast("long"))
    still = d.filter("rank IS NULL OR size = 0 OR size IS NULL").withColumn("drawn", F.lit(0).cast("long"))
    return drawn.unionByName(still).withColumn("copies", F.col("certain") + F.col("drawn")).drop("_source", "_step", "ahead", "sure", "rank", "step", "expected", "certain", "drawn", "mass", "weight")


def sizes_of(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.select(*carry, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, doc_id, source, size, source_size, target, copies) of all documents, a row each; carry: other columns that stay."""
    sized = materialise(sizes_of(docs, *carry))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    return pareto_mix(sized, goals, most=most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
m AS (SELECT *, max(CASE WHEN level <= cap / w THEN level END) OVER () AS top FROM l),
t AS (SELECT source, source_size, coalesce(least(top * w, cap::DOUBLE), cap::DOUBLE) AS target FROM m),
e AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
  least(3.0::DOUBLE, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END) AS expected,
  (('0x' || substr(md5(concat(d.doc_id, ':mix')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, floor(expected) AS certain, CASE WHEN expected > floor(expected) THEN ln(u / (1 - u)) - ln((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS rk FROM e),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rk ASC NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
  sum(certain * size) OVER (PARTITION BY source) AS sure FROM r)
SELECT doc_id, source, size, source_size, target,
  ((certain + CASE WHEN rk IS NOT NULL AND size > 0 AND ahead + size / 2 <= target - sure THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM a
"""
