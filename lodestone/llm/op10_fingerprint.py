"""Operator 10 (native): canonical exact digests of documents.

A text's canonical form is NFKC, full case folding, NFKC again, and white space
runs as one space with none at the ends.  The digest is 128 bits of xxhash64
under two seeds; inside equal buckets the canonical bytes are compared, and a
bucket that holds different forms has each member's SHA-256 appended, so equal
digests mean equal forms.  Buckets are compared by least and greatest form, a
partial aggregate, so a form that fills a third of the table costs one row a task.

Defined results: null is the empty text; repeated rows and ties get equal
digests; documents are ordered by doc_id, then by a hash of the text, and a null
doc_id comes last; clashing extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, table

ICU = "com.ibm.icu"


def canonical(c: Column) -> Column:
    def nfkc(x: Column) -> Column:
        return F.reflect(F.lit(f"{ICU}.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = nfkc(F.reflect(F.lit(f"{ICU}.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(c, F.lit(""))), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("wide"), c).alias("b"))


def _hex(h: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(h[x]), 16, "0") for x in "ab")))


def unlike_buckets(forms: DataFrame) -> DataFrame:
    """Hashes (h) whose rows differ in `form`."""
    return forms.groupBy("h").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).filter("lo <> hi").select("h")


def digest_names(rows: DataFrame, unlike: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds each name from its (hash, SHA-256 of the form) columns."""
    for name, (h, sha) in names.items():
        marked = unlike.select(F.col("h").alias("_h"), F.lit(True).alias("_unlike"))
        rows = rows.join(marked, F.col(h) == F.col("_h"), "left").withColumn(name, F.concat(_hex(F.col(h)), F.when(F.col("_unlike"), F.concat(F.lit("-"), F.col(sha))).otherwise(""))).drop("_h", "_unlike")
    return rows


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, fingerprint."""
    form = docs.select("doc_id", canonical(F.col("text")).alias("form"))
    rows = form.select("doc_id", wide(F.col("form")).alias("h"), F.sha2("form", 256).alias("sha"))
    unlike = unlike_buckets(form.select(wide(F.col("form")).alias("h"), "form"))
    return digest_names(rows, unlike, {"fingerprint": ("h", "sha")}).select("doc_id", "fingerprint")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_h, of the next document by descending doc_id, the first after the last.

    Documents are dealt into ranges of doc_id; the first of each range is also
    sent to the end of the range before it, so no range needs to see another.
    """
    n = partitions(docs.sparkSession)
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    bounds = docs.agg(F.percentile_approx(key, [(i + 1) / n for i in range(n)], 100_000).alias("p"), F.max(key).alias("m")).first()
    upper = sorted({*(bounds.p or []), bounds.m if bounds.m is not None else 0})
    listed, m = F.array(*(F.lit(x).cast("bigint") for x in upper)), len(upper)
    # binary search: the number of bounds below the key
    steps = F.array(*(F.lit(2**i) for i in reversed(range(m.bit_length()))))
    own = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= m) & (F.try_element_at(listed, at + step) < key), at + step).otherwise(at))
    copies = F.when(F.element_at(listed, own + 1) == key, F.array(F.struct(own.alias("bucket"), F.lit(False).alias("guest")), F.struct(((own + 1) % m).alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("guest"))))
    rows = docs.withColumn("_at", F.explode(copies)).select("*", "_at.*", key.alias("_key")).drop("_at")
    from pyspark.sql import Window

    order = Window.partitionBy("bucket").orderBy("guest", F.desc("_key"), F.desc(F.xxhash64("text")), F.desc("text"))
    return rows.select("*", F.lead("text").over(order).alias("next_text"), F.lead("h").over(order).alias("next_h")).filter("NOT guest").drop("bucket", "guest", "_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    form = canonical(F.col("text"))
    rows = with_next(docs.withColumn("h", wide(form)))
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - k), F.left("next_text", k)))
    rows = rows.withColumn("edited_form", canonical(F.col("edited"))).withColumn("edited_h", wide(F.col("edited_form")))

    def like(h: str, other: Column) -> Column:
        return F.when((F.col("h") == F.col(h)) & (form == other), 1.0).otherwise(0.0)

    done = materialise(
        rows.select(
            "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h", "edited_h",
            F.sha2(form, 256).alias("sha"), F.sha2("edited_form", 256).alias("edited_sha"),
            like("edited_h", F.col("edited_form")).alias("near_edited"), like("next_h", canonical(F.col("next_text"))).alias("near_next"),
        )
    )
    # the documents' forms are compared byte by byte; edited forms by their SHA-256, since moving both corpora would double the shuffle
    bytes_differ = unlike_buckets(docs.select(wide(form).alias("h"), form.alias("form")))
    sha_differ = unlike_buckets(done.select("h", F.col("sha").alias("form")).unionByName(done.select(F.col("edited_h").alias("h"), F.col("edited_sha").alias("form"))))
    named = digest_names(done, bytes_differ.union(sha_differ).distinct(), {"fingerprint": ("h", "sha"), "edited_fingerprint": ("edited_h", "edited_sha")})
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
