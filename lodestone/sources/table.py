"""Opening a file or a folder of files as one table.

Columns are united by name in the order first seen, missing ones are NULL, partition
columns come first, unreadable files are left out and named, and a column
with two types in two files is refused with both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refusal
from ..operators.joins import Table
from ..plans.spec import QuerySpec
from . import footer

SNIFF = 64


def kinds_of(chunks: DataFrame) -> list:
    """Each column's signatures with a file of each, its column chunks that Spark's reader refuses, and the first file that has it; a few rows a column."""
    rows = chunks.filter("signature IS NOT NULL")
    logical = F.split("signature", " ")[1]
    refused = (F.col("codec") == "BROTLI") | F.contains("encodings", F.lit("BYTE_STREAM_SPLIT")) | logical.startswith("TIME/") | (logical == "TIMESTAMP/nanoseconds")
    return rows.groupBy("column", "signature").agg(F.min("path").alias("path"), F.coalesce(F.bool_or(refused), F.lit(False)).alias("refused"), logical.alias("logical")).orderBy("column", "path").collect()


def conflicts(kinds: list) -> list[tuple[str, str, str, str, str]]:
    """(column, file, its type, other file, its type) of columns whose files disagree, at most six."""
    by: dict[str, list] = {}
    for r in kinds:
        by.setdefault(r.column, []).append(r)
    return [(c, x[0].path, x[0].signature, x[1].path, x[1].signature) for c, x in by.items() if len(x) > 1][:6]


def half(c: Column) -> Column:
    """The double of a little-endian IEEE half-precision binary(2)."""
    bits = F.conv(F.hex(F.concat(F.substring(c, 2, 1), F.substring(c, 1, 1))), 16, 10).cast("int")
    sign = F.when(F.shiftright(bits, 15) == 1, -1.0).otherwise(1.0)
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    return sign * F.when(e == 31, F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(e == 0, m * F.lit(2.0**-24)).otherwise((1 + m / 1024.0) * F.pow(F.lit(2.0), e - 15))


def uuid(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def interval(c: Column) -> Column:
    def part(i: int) -> Column:
        return F.conv(F.concat(*(F.hex(F.substring(c, i + j, 1)) for j in (3, 2, 1, 0))), 16, 10)

    return F.when(c.isNotNull(), F.concat(part(1), F.lit("mo "), part(5), F.lit("d "), part(9), F.lit("ms")))


#: Logical types that Spark's reader has no type for: the type to read them as, and what to make of it.
EXOTIC = {"FLOAT16": ("binary", half), "UUID": ("binary", uuid), "INTERVAL": ("binary", interval)}


def sniff_text(df: DataFrame) -> DataFrame:
    """Untyped binary columns whose first values are clean UTF-8 become text; bytes of later values that are none read as U+FFFD."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    if not names:
        return df
    few = df.select(*names).limit(SNIFF)

    def clean(n: str) -> Column:
        ok = F.is_valid_utf8(F.col(f"`{n}`").cast("string")) & ~F.col(f"`{n}`").cast("string").rlike(r"[\x00-\x08\x0E-\x1F]")
        return F.coalesce(F.bool_and(F.when(F.length(f"`{n}`") > 0, ok)), F.lit(False))

    r = few.agg(*(clean(n).alias(n) for n in names)).first()
    return df.withColumns({n: F.make_valid_utf8(F.col(f"`{n}`").cast("string")) for n in names if r[n]})


HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"


def hive_parts(path: Column, root: str) -> Column:
    """The `key=value` folders of a file below the root, as an array."""
    below = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(F.lit(""))
    folders = F.split(below, "/")
    return F.filter(F.slice(folders, F.lit(1), F.size(folders) - 1), lambda x: F.instr(x, "=") > 1)


def hive_value(parts: Column, key: str) -> Column:
    """The decoded value of a key among folders; NULL where there is none, or an empty or the default one."""
    raw = F.try_element_at(F.filter(parts, lambda x: x.startswith(key + "=")), F.lit(-1))
    return F.nullif(F.nullif(_decoded(F.substr(raw, F.lit(len(key) + 2))), F.lit(HIVE_NULL)), F.lit(""))


def _decoded(c: Column) -> Column:
    """%xx as the character it stands for; a text that cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


@dataclass(frozen=True)
class Layout:
    """Hive keys of the files below a folder, with their types, and whether every file has the same ones."""

    types: dict[str, str]
    uniform: bool


def layout_of(chunks: DataFrame, root: str) -> Layout:
    parts = chunks.filter("problem IS NULL").select("path").distinct().select(hive_parts(F.col("path"), root).alias("p"))
    keys = F.transform("p", lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    # a row for each arrangement of folders, not for each file
    found = [tuple(r.k) for r in parts.select(keys.alias("k")).distinct().orderBy(F.size("k").desc()).collect()]
    names = list(dict.fromkeys(k for ks in found for k in ks))
    if not names:
        return Layout({}, True)
    tests = {"int": r"^[+-]?\d{1,9}$", "bigint": r"^[+-]?\d{1,15}$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "date": r"^\d{4}-\d{2}-\d{2}$"}
    r = parts.agg(*(F.bool_and(hive_value(F.col("p"), k).rlike(t)).alias(f"{kind}_{i}") for i, k in enumerate(names) for kind, t in tests.items())).first()
    return Layout({k: next((kind for kind in tests if r[f"{kind}_{i}"]), "string") for i, k in enumerate(names)}, len(found) == 1)


def united_fields(kinds: list) -> list:
    """Arrow fields of all files by name, first seen first; a footer is read for each set of columns that adds one."""
    out: dict = {}
    for path in dict.fromkeys(r.path for r in sorted(kinds, key=lambda r: r.path)):
        for f in footer.arrow_schema(path):
            out.setdefault(f.name, f)
    return list(out.values())


def read_with_arrow(spark: SparkSession, chunks: DataFrame, kinds: list, root: str, layout: Layout, columns: list[str] | None = None, where: QuerySpec | None = None) -> DataFrame:
    """Files that Spark's reader refuses, through Arrow, a row group a task.

    Only `columns` are decoded, and only row groups that the clauses of `where` do not exclude by
    statistics or Hive keys.  Times of day become text and nanoseconds microseconds; columns a file lacks
    are NULL.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    from ..plans.report import kept_groups

    def plain(t: pa.DataType) -> pa.DataType:
        if pa.types.is_time(t):
            return pa.string()
        if pa.types.is_timestamp(t):
            return pa.timestamp("us", t.tz)
        return pa.float32() if pa.types.is_float16(t) else plain(t.value_type) if pa.types.is_dictionary(t) else t

    united = pa.schema([pa.field(f.name, plain(f.type)) for f in united_fields(kinds) if columns is None or f.name in columns])
    keys = [k for k in layout.types if columns is None or k in columns]
    out = pa.schema([pa.field(k, pa.string()) for k in keys] + list(united))

    def run(batches):
        for b in batches:
            for path, group, *hive in zip(*(b[c].to_pylist() for c in b.schema.names)):
                t = footer.read_group(path, group, united.names)
                filled = [pa.array([v] * t.num_rows, pa.string()) for v in hive]
                for f in united:
                    filled.append(t[f.name].cast(f.type, safe=False) if f.name in t.column_names else pa.nulls(t.num_rows, f.type))
                yield from pa.table(filled, schema=out).to_batches(max_chunksize=65536)

    groups = kept_groups(chunks, where) if where else chunks.filter("row_group IS NOT NULL").select("path", "row_group").distinct()
    parts = hive_parts(F.col("path"), root)
    listed = groups.select("path", "row_group", *(hive_value(parts, k).alias(f"_h{i}") for i, k in enumerate(keys)))
    # numbered, so that each task gets one: a plain repartition would be merged again by its small size
    number = F.row_number().over(Window.orderBy("path", "row_group")) - 1
    dealt = listed.withColumn("_n", number).repartitionById(max(1, groups.count()), F.col("_n").cast("int")).drop("_n")
    df = dealt.mapInArrow(run, from_arrow_schema(out, prefer_timestamp_ntz=True))
    return df.select(*(F.col(f"`{k}`").cast(layout.types[k]).alias(k) for k in keys), *(F.col(f"`{n}`") for n in united.names))


def open_table(spark: SparkSession, path: str, name: str | None = None, check: bool = True, columns: list[str] | None = None, where: QuerySpec | None = None) -> Table:
    """A lazy table of all Parquet files at or below a path, whatever the case of their suffixes.

    With `check`, footers are read first, for conflicts, unreadable files, the folders' Hive
    keys and types that Spark does not read.  Folders with the same keys everywhere are left to Spark's
    partition discovery, which prunes them; where files disagree, keys come from each file's path.  Without `check`, Spark's own
    discovery decides.  `columns` and `where` only spare work on files that go through Arrow, where nothing is pushed down.
    """
    base = name or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    reader = spark.read.option("mergeSchema", "true").option("pathGlobFilter", footer.GLOB)
    if not check:
        return _table(reader.parquet(path), base, ())
    chunks = footer.column_chunks(spark, path).persist()  # footers are read once for all checks
    found = footer.files(chunks).agg(F.count("*").alias("n"), F.slice(F.collect_list(F.when(F.col("problem").isNotNull(), F.col("path"))), 1, 100).alias("bad")).first()
    skipped = tuple(found.bad)
    if not found.n or len(skipped) == found.n:
        raise Refusal("nothing to read", f"no readable Parquet file at {path}")
    kinds = kinds_of(chunks)
    if bad := conflicts(kinds):
        raise Refusal("schema conflict", "; ".join(f"column {c} is {a} in {fa} but {b} in {fb}" for c, fa, a, fb, b in bad))
    root = footer.listed_root(spark, path)
    layout = layout_of(chunks, root) if found.n > 1 or any("=" in r.path[len(root) :] for r in kinds) else Layout({}, True)
    if any(r.refused for r in kinds):
        return Table(sniff_text(read_with_arrow(spark, chunks, kinds, root, layout, columns, where)), base, skipped=skipped)
    chunks.unpersist()
    reader = reader.option("ignoreCorruptFiles", str(bool(skipped)).lower())
    discover = bool(layout.types) and layout.uniform
    if not discover:
        reader = reader.option("recursiveFileLookup", "true")
    exotic = {r.column: r.logical for r in kinds if r.logical in EXOTIC and "." not in r.column}
    if exotic:
        from pyspark.sql.pandas.types import from_arrow_type

        reader = reader.schema(T.StructType([T.StructField(f.name, T.BinaryType() if f.name in exotic else from_arrow_type(f.type)) for f in united_fields(kinds)]))
    df = reader.parquet(path)
    keys = {}
    if layout.types and not discover:
        # a listing writes file:/x where a row's path is the URI file:///x
        parts = hive_parts(F.regexp_replace(_decoded(F.col("_metadata.file_path")), "^file:/+", "file:/"), root)
        keys = {k: hive_value(parts, k).cast(t) for k, t in layout.types.items()}
        df = df.select(*(c.alias(k) for k, c in keys.items()), *(F.col(f"`{c}`") for c in df.columns if c not in keys))
    return _table(df.withColumns({c: EXOTIC[k][1](F.col(f"`{c}`")) for c, k in exotic.items()}) if exotic else df, base, skipped)


def _table(df: DataFrame, name: str, skipped: tuple[str, ...]) -> Table:
    """Partition columns first."""
    inside = {f.name for f in df.schema.fields}
    parts = [c for c in _partition_names(df) if c in inside]
    df = df.select(*(f"`{c}`" for c in parts), *(f"`{c}`" for c in df.columns if c not in parts)) if parts else df
    return Table(sniff_text(df), name, skipped=skipped)


def _partition_names(df: DataFrame) -> list[str]:
    """Hive keys that Spark discovered."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return []
    relation = plan.relation()
    if not hasattr(relation, "partitionSchema"):
        return []
    return [f.name() for f in relation.partitionSchema().fields()]


def with_row_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """A number that follows file, then place in the file, for stable sorts and first-seen rules.  It needs no shuffle."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


class Catalogue:
    """Opened tables by name, each a temporary view as well."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def remember(self, t: Table) -> Table:
        self.tables[t.name] = t
        t.df.createOrReplaceTempView("`" + t.name.replace("`", "``") + "`")
        return t

    def open(self, path: str, name: str | None = None) -> Table:
        return self.remember(open_table(self.spark, path, name))

    def tree(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of the Parquet files below a folder, by path."""
        return [(r.path, r.length) for r in footer.list_files(self.spark, path).orderBy("path").toLocalIterator()]
