"""Results as CSV, TSV, JSON or Markdown.

`write` is distributed: one file a task.  `save` makes one local file by streaming
partitions through the driver, never holding more than one.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refusal
from ..functions.kinds import is_float, kind, text
from ..operators.predicates import column

CLIPBOARD_ROWS = 200_000


def file_name(base: str, fmt: str, label: str = "") -> str:
    return f"{base}{'-' + label if label else ''}.{fmt}"


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*(text(column(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


def json_line(df: DataFrame) -> Column:
    """One JSON object: numbers stay numbers, decimals and integers beyond 2^53 are text, times are text, NULLs are kept."""
    parts = []
    for f in df.schema.fields:
        c, t = column(f.name), f.dataType
        if is_float(t):
            v = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(text(c, t))
        elif isinstance(t, T.DecimalType):
            v = F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
        elif isinstance(t, T.LongType):
            s = c.cast("string")
            v = F.when(F.abs(c) > 2**53, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s)
        elif kind(t) in ("number", "bool"):
            v = c.cast("string")
        elif kind(t) == "nested":
            v = F.to_json(c, {"ignoreNullFields": "false"})
        else:
            v = F.to_json(F.array(text(c, t)))
            v = F.when(c.isNotNull(), F.substr(v, F.lit(2), F.length(v) - 2))
        name = F.to_json(F.array(F.lit(f.name)))
        parts.append(F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.coalesce(v, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def write(df: DataFrame, path: str, fmt: str) -> None:
    """A folder of files in `fmt` (csv, tsv or json, one object a line)."""
    if fmt in ("csv", "tsv"):
        as_text(df).write.csv(path, header=True, sep="," if fmt == "csv" else "\t", nullValue="", emptyValue="", escape='"')
    elif fmt == "json":
        df.select(json_line(df)).write.text(path)
    else:
        raise Refusal("format", f"{fmt} cannot be written in parts")


def _markdown(s: str | None) -> str:
    return "" if s is None else s.replace("|", "\\|").replace("\r\n", "<br>").replace("\n", "<br>")


def lines(df: DataFrame, fmt: str) -> Iterator[str]:
    if fmt in ("csv", "tsv"):
        def put(row) -> str:
            out = io.StringIO()
            csv.writer(out, delimiter="," if fmt == "csv" else "\t", lineterminator="\n").writerow(["" if v is None else v for v in row])
            return out.getvalue()

        yield put(df.columns)
        yield from (put(r) for r in as_text(df).toLocalIterator())
    elif fmt == "json":
        yield "["
        for i, r in enumerate(df.select(json_line(df).alias("j")).toLocalIterator()):
            yield ("," if i else "") + "\n" + r.j
        yield "\n]\n"
    elif fmt == "md":
        yield "| " + " | ".join(map(_markdown, df.columns)) + " |\n"
        yield "| " + " | ".join("---:" if kind(f.dataType) == "number" else "---" for f in df.schema.fields) + " |\n"
        for r in as_text(df).toLocalIterator():
            yield "| " + " | ".join(map(_markdown, r)) + " |\n"
    else:
        raise Refusal("format", f"{fmt} is not csv, tsv, json or md")


def save(df: DataFrame, path: str, fmt: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines(lines(df, fmt))


def clipboard(df: DataFrame, fmt: str = "tsv", rows: int = CLIPBOARD_ROWS) -> str:
    return "".join(lines(df.limit(rows), fmt))


def hex_dump(b: bytes, width: int = 16) -> str:
    rows = (b[i : i + width] for i in range(0, len(b), width))
    return "\n".join(f"{i * width:08x}  {r.hex(' '):<{width * 3 - 1}}  {''.join(chr(c) if 32 <= c < 127 else '.' for c in r)}" for i, r in enumerate(rows))


def inspect(df: DataFrame, row: dict, name: str) -> str:
    """The whole value of one cell: a dump of bytes, indented JSON of nested values, else its text."""
    cond = None
    for k, v in row.items():
        e = column(k).eqNullSafe(F.lit(v))
        cond = e if cond is None else cond & e
    t = df.schema[name].dataType
    c = column(name)
    shown = F.to_json(c, {"pretty": "true", "ignoreNullFields": "false"}) if kind(t) == "nested" else c if kind(t) == "binary" else text(c, t)
    got = df.filter(cond).select(shown.alias("v")).first()
    if got is None:
        raise Refusal("no such row", "no row has these values")
    return hex_dump(bytes(got.v)) if isinstance(got.v, (bytes, bytearray)) else "NULL" if got.v is None else str(got.v)
