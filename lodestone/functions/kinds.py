"""Column kinds, canonical text, numeric views and literals.

The kind of a column (number, string, bool, temporal, binary, nested) decides how
it compares, sorts, aggregates and prints.  All helpers return Columns that
stay inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEX_BYTES = 24


def kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) or t.typeName().startswith("time"):
        return "temporal"
    if isinstance(t, T.BinaryType):
        return "binary"
    return "nested" if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else "string"


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def number_text(c: Column) -> Column:
    """A double as ECMAScript prints it: shortest digits, exponents from 1e21 and below 1e-6."""
    c = c.cast("double")
    s = F.abs(c).cast("string")
    whole = F.regexp_extract(s, r"^(\d+)", 1)
    digits = F.concat(whole, F.regexp_extract(s, r"\.(\d+)", 1))
    exponent = F.coalesce(F.nullif(F.regexp_extract(s, r"E(-?\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    lead = F.length(F.regexp_extract(digits, "^(0*)", 1))
    point = F.length(whole) + exponent - lead
    digits = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    n = F.length(digits)
    plain = (
        F.when((point > 21) | (point < -5), F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string")))
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
    )
    signed = F.concat(F.when(c < 0, "-").otherwise(""), plain)
    inf = float("inf")
    return F.when(c.isNull(), None).when(F.isnan(c), "NaN").when(c == inf, "Infinity").when(c == -inf, "-Infinity").when(c == 0, "0").otherwise(signed)


def text(c: Column, t: T.DataType, full_binary: bool = False) -> Column:
    """The canonical text of a value, which LIKE searches and exports print."""
    k = kind(t)
    if is_float(t):
        return number_text(c)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        s = F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.regexp_extract(F.date_format(c, ".SSSSSS"), r"^(\.\d*[1-9])?", 1))
        return F.concat(s, F.lit("Z")) if isinstance(t, T.TimestampType) else s
    if k == "binary":
        short = F.lower(F.hex(c if full_binary else F.substring(c, 1, HEX_BYTES)))
        return short if full_binary else F.concat(short, F.when(F.length(c) > HEX_BYTES, "…").otherwise(""))
    if k == "nested":
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def number(c: Column, t: T.DataType) -> Column:
    """The double that numeric metrics see: NaN is missing, booleans are 0 and 1, times are milliseconds, text is missing."""
    k = kind(t)
    if is_float(t):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if k == "number":
        return c.cast("double")
    if k == "bool":
        return c.cast("int").cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double") * 86_400_000
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / F.lit(1000.0)  # the session is in UTC
    return F.lit(None).cast("double")


def sort_key(c: Column, t: T.DataType) -> Column:
    """What a sort compares: NaN counts as missing."""
    if is_float(t):
        return F.when(~F.isnan(c), c)
    return text(c, t) if kind(t) == "nested" else c


def parse_number(s: str) -> int | decimal.Decimal | None:
    """The number that a text starts with; not finite or none: None."""
    m = re.match(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", str(s))
    if not m:
        return None
    v = decimal.Decimal(m.group().strip())
    if abs(v) > decimal.Decimal("1.8e308"):
        return None
    return int(v) if v == v.to_integral_value() and abs(v) < 10**37 else v


_STAMP = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?\s*Z?$")


def parse_temporal(s: str) -> dt.datetime | None:
    """`YYYY-MM-DD[ T]HH:MM[:SS[.f]][Z]`, or a bare number of epoch milliseconds, as UTC without a zone."""
    s = str(s).strip()
    m = _STAMP.match(s)
    try:
        if m:
            y, mo, d, h, mi, sec, f = m.groups()
            return dt.datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(sec or 0), int((f or "0")[:6].ljust(6, "0")))
        if re.fullmatch(r"[+-]?\d+(\.\d+)?", s):
            return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=float(s))
    except (ValueError, OverflowError):
        pass
    return None


def parse_bool(s: object) -> bool:
    return str(s).strip().lower() in ("true", "t", "1", "y", "yes")


def temporal_literal(v: dt.datetime, t: T.DataType) -> Column:
    s = v.isoformat(sep=" ")
    if isinstance(t, T.DateType) and v.time() == dt.time():
        return F.lit(v.date())
    return F.lit(s).cast("timestamp" if isinstance(t, T.TimestampType) else "timestamp_ntz")


def leaves(schema: T.StructType) -> list[tuple[str, str]]:
    """(display name, SQL expression) of each leaf: structs by dots, lists of structs by field, maps as keys and values."""
    out: list[tuple[str, str]] = []

    def walk(name: str, expr: str, t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f"{name}.{f.name}", f"{expr}.`{f.name}`", f.dataType)
        elif isinstance(t, T.MapType):
            out.append((f"{name}.key", f"map_keys({expr})"))
            out.append((f"{name}.value", f"map_values({expr})"))
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            for f in t.elementType.fields:
                walk(f"{name}.{f.name}", f"transform({expr}, x -> x.`{f.name}`)", T.ArrayType(f.dataType))
        else:
            out.append((name, expr))

    for f in schema.fields:
        walk(f.name, f"`{f.name}`", f.dataType)
    return out


def flatten_leaves(df: DataFrame) -> DataFrame:
    return df.select(*(F.expr(e).alias(n) for n, e in leaves(df.schema)))


def nearest_name(name: str, names: list[str]) -> str | None:
    """The closest of `names` within a third of the length (two at least)."""
    best, allowed = None, max(2, math.ceil(len(name) / 3))
    for n in names:
        if abs(len(n) - len(name)) > 3:
            continue
        row = list(range(len(n) + 1))
        for i, a in enumerate(name.lower(), 1):
            last, row[0] = row[0], i
            for j, b in enumerate(n.lower(), 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        if row[-1] <= allowed and (best is None or row[-1] < best[0]):
            best = (row[-1], n)
    return best[1] if best else None
