"""Parquet footers as DataFrames: files, row groups, column chunks, key/value metadata.

Listing and reading run on the executors; the driver sees aggregates.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".parquet", ".parq", ".pq")
CHUNKS = (
    "path string, file_bytes bigint, file_rows bigint, created_by string, key_values string, problem string, row_group int, group_rows bigint, group_bytes bigint, column string, signature string, codec string, "
    "encodings string, compressed bigint, uncompressed bigint, nulls bigint, distinct bigint, kind string, min string, max string, min_key string, max_key string, has_index boolean"
)


#: Names of Parquet files, whatever the case of the suffix, as Spark's readers take them.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x[1:]) for x in SUFFIXES) + "}"


def listed_root(spark: SparkSession, path: str) -> str:
    """The path as listings spell it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def list_files(spark: SparkSession, path: str, tails: bool = False) -> DataFrame:
    """(path, length) of the Parquet files at or below a path; hidden files and others are left out.  With `tails` the bytes of each footer as well, for which Spark reads whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", *([_tail().alias("tail")] if tails else []))
    name = F.element_at(F.split("path", "/"), -1)
    ends = F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")
    return files.filter(ends & ~name.rlike(r"^[._]"))


def _tail():
    """The end of a file from its footer on: the last eight bytes are the footer's length, lowest byte first, and a mark."""
    low = F.concat(*(F.hex(F.substring("content", i, 1)) for i in (-5, -6, -7, -8)))
    n = F.conv(low, 16, 10).cast("bigint") + 8
    return F.substr("content", -F.when(n <= F.col("length"), n).otherwise(8).cast("int"))


def _signature(c) -> str:
    repeated = "repeated" if c.max_repetition_level else "single"
    kind = c.logical_type.type if c.logical_type else "NONE"
    if kind in ("TIME", "TIMESTAMP"):
        kind += "/" + str(json.loads(c.logical_type.to_json()).get("timeUnit", "")).lower()
    return f"{c.physical_type}({c.length or 0}) {kind} {repeated}"


def order_key(v) -> str | None:
    """A text whose code point order is the order of the values of one kind: exact for numbers of any size, times to the microsecond, UTF-8 for texts."""
    if v is None:
        return None
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        d = decimal.Decimal(repr(v) if isinstance(v, float) else v)
        if not d.is_finite():
            return None if d.is_nan() else "9" if d > 0 else "0"
        if not d:
            return "4"
        sign, digits, exponent = d.as_tuple()
        text = "".join(map(str, digits)).rstrip("0")
        head = f"{len(digits) + exponent + 50_000:06d}{text}"
        # a negative number orders by the complement of its digits, and a longer one first
        return "6" + head if not sign else "2" + "".join(str(9 - int(c)) for c in head) + "~"
    if isinstance(v, dt.datetime):
        v = v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
        return f"{v.year:04d}-{v:%m-%d %H:%M:%S.%f}"
    if isinstance(v, dt.date):
        return f"{v.year:04d}-{v:%m-%d} 00:00:00.000000"
    if isinstance(v, dt.time):
        return v.strftime("%H:%M:%S.%f")
    return v.hex() if isinstance(v, bytes) else str(v)


def _kind(c) -> str:
    """The kind of a column chunk's values: number (exact), float, string, bool, temporal or binary."""
    logical = c.logical_type.type if c.logical_type else "NONE"
    if logical in ("DATE", "TIME", "TIMESTAMP") or c.physical_type == "INT96":
        return "temporal"
    if logical in ("STRING", "ENUM", "JSON", "UUID"):
        return "string"
    if c.physical_type == "BOOLEAN":
        return "bool"
    if c.physical_type in ("FLOAT", "DOUBLE"):
        return "float"
    return "number" if logical == "DECIMAL" or c.physical_type in ("INT32", "INT64") else "binary"


def _place(path: str):
    """Arrow's file system for a listed path, and the path in it."""
    import pyarrow.fs as fs

    if re.match(r"(?!file:)[A-Za-z][\w+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    # a listing writes file:/x and escapes nothing
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


def arrow_opens(path: str) -> bool:
    """Whether Arrow knows the store of a path; Spark's readers know more."""
    try:
        _place(path)
    except (OSError, ValueError, NotImplementedError):  # no library for it, or no such kind of store
        return False
    return True


def _open(path: str):
    system, where = _place(path)
    return system.open_input_file(where)


def arrow_schema(path: str) -> pa.Schema:
    import pyarrow.parquet as pq

    with _open(path) as f:
        return pq.read_schema(f)


def read_group(path: str, group: int, columns: list[str] | None = None) -> pa.Table:
    """A row group; of `columns` those that the file has."""
    import pyarrow.parquet as pq

    with _open(path) as f:
        file = pq.ParquetFile(f)
        here = None if columns is None else [c for c in columns if c in file.schema_arrow.names]
        return file.read_row_group(group, columns=here)


def read_footer(path: str, size: int, tail: bytes | None = None) -> list[dict]:
    import pyarrow.parquet as pq

    base = {"path": path, "file_bytes": size, "file_rows": None, "created_by": None, "key_values": None, "problem": None}
    try:
        with _open(path) if tail is None else pa.BufferReader(tail) as f:
            m = pq.read_metadata(f)
    except Exception as e:  # an unreadable file is listed with its reason
        return [base | {"problem": str(e)[:200]}]
    base |= {"file_rows": m.num_rows, "created_by": m.created_by, "key_values": json.dumps({k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (m.metadata or {}).items()})}
    signatures = {m.schema.column(i).path: _signature(m.schema.column(i)) for i in range(m.num_columns)}
    kinds = {m.schema.column(i).path: _kind(m.schema.column(i)) for i in range(m.num_columns)}
    out = []
    for g in range(m.num_row_groups):
        rg = m.row_group(g)
        for i in range(rg.num_columns):
            c = rg.column(i)
            s = c.statistics if c.is_stats_set else None
            lo, hi = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
            out.append(base | {
                "row_group": g, "group_rows": rg.num_rows, "group_bytes": rg.total_byte_size, "column": c.path_in_schema, "signature": signatures[c.path_in_schema], "codec": c.compression, "encodings": ",".join(sorted(set(c.encodings))),
                "compressed": c.total_compressed_size, "uncompressed": c.total_uncompressed_size, "nulls": s.null_count if s is not None and s.has_null_count else None, "distinct": s.distinct_count if s is not None and s.has_distinct_count else None,
                "kind": kinds[c.path_in_schema], "min": None if lo is None else str(lo), "max": None if hi is None else str(hi), "min_key": order_key(lo), "max_key": order_key(hi), "has_index": bool(c.has_column_index),
            })
    if not out:
        out = [base | {"column": p, "signature": s, "kind": kinds[p]} for p, s in signatures.items()]
    return out


def column_chunks(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in CHUNKS.split(", "))])

    def run(batches):
        for b in batches:
            rows = [r for file in zip(*(c.to_pylist() for c in b.columns)) for r in read_footer(*file)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return list_files(spark, path, tails=not arrow_opens(listed_root(spark, path))).mapInArrow(run, CHUNKS)


def files(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.first("file_bytes").alias("bytes"), F.first("file_rows").alias("rows"), F.count_distinct("row_group").alias("row_groups"), F.count_distinct("column").alias("columns"), F.first("created_by").alias("created_by"), F.first("problem").alias("problem"))


def tables(chunks: DataFrame, root: str) -> DataFrame:
    """One row for each file or folder directly below the root: a folder is one table of all files in it, and its columns are those of any of them.  `rows` and `columns` are NULL where a footer is unreadable."""
    path = F.col("path")
    below = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(F.element_at(F.split(path, "/"), -1))
    each = chunks.groupBy(F.split_part(below, F.lit("/"), F.lit(1)).alias("name"), path).agg(F.first("file_bytes").alias("bytes"), F.first("file_rows").alias("rows"), F.first("problem").alias("problem"), F.array_sort(F.collect_set("column")).alias("names"))
    known = F.count("problem") == 0
    # files of a table mostly have the same columns, so that few sets of names meet
    names = F.array_distinct(F.flatten(F.collect_set("names")))
    return each.groupBy("name").agg(F.count("*").alias("files"), F.count("problem").alias("unreadable"), F.sum("bytes").alias("bytes"), F.when(known, F.sum("rows")).alias("rows"), F.when(known, F.size(names)).cast("bigint").alias("columns"))


def row_groups(chunks: DataFrame) -> DataFrame:
    return chunks.filter("row_group IS NOT NULL").groupBy("path", "row_group").agg(F.first("group_rows").alias("rows"), F.first("group_bytes").alias("bytes"), F.sum("compressed").alias("compressed"))


def columns(chunks: DataFrame) -> DataFrame:
    """Folded statistics of each column over all row groups, in the order of its kind; `exact` where every group has a range, `nulls_known` where every one counts NULLs."""
    c = chunks.filter("row_group IS NOT NULL")
    return c.groupBy("column").agg(
        F.count("*").alias("chunks"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"), _listed("codec").alias("codecs"), _listed("encodings").alias("encodings"),
        F.min_by("min", "min_key").alias("min"), F.max_by("max", "max_key").alias("max"),
        F.sum("nulls").alias("nulls"), (F.count("nulls") == F.count("*")).alias("nulls_known"), (F.count("min") == F.count("*")).alias("exact"),
    )


def _listed(c: str):
    """The different parts of a column of lists by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(c, ","))))), ",")


def key_values(chunks: DataFrame) -> DataFrame:
    kv = chunks.groupBy("path").agg(F.first("key_values").alias("kv"))
    return kv.select("path", F.explode(F.from_json("kv", "map<string,string>")))


def shape(chunks: DataFrame) -> DataFrame:
    """One row: files, rows, columns, row groups, sizes, codecs, encodings, writers."""
    f = chunks.filter("problem IS NULL").groupBy("path").agg(F.first("file_rows").alias("rows"), F.first("file_bytes").alias("bytes"), F.countDistinct("row_group").alias("groups"))
    total = f.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("groups").alias("row_groups"))
    more = chunks.agg(F.count_distinct("column").alias("columns"), _listed("codec").alias("codecs"), _listed("encodings").alias("encodings"), F.array_join(F.array_sort(F.collect_set("created_by")), ",").alias("writers"))
    return total.crossJoin(more)  # one row each


def shape_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return shape(a).select(F.lit("A").alias("side"), "*").unionByName(shape(b).select(F.lit("B").alias("side"), "*"))


def column_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = (columns(c).select("column", *(F.col(n).alias(f"{n}_{s}") for n in ("min", "max", "nulls", "exact", "compressed"))) for c, s in ((a, "a"), (b, "b")))
    return x.join(y, "column", "full")
