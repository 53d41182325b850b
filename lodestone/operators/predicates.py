"""Filter clauses as Columns that Parquet scans can push down.

NULL never satisfies a comparison, nor does NaN, `<>` included.  LIKE is a
case-insensitive search for a substring in the canonical text of any kind.
A clause that cannot be used is left out and reported, never guessed at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import is_float, kind, parse_bool, parse_number, parse_temporal, temporal_literal, text
from ..plans.spec import Filter, or_groups

COMPARE = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def issue(f: Filter, schema: T.StructType) -> str | None:
    """Why a clause cannot be used: missing (no such column), empty (no operand yet), invalid (not a literal of the kind)."""
    if f.column not in schema.names:
        return "missing"
    if f.op.startswith("IS "):
        return None
    if f.value is None:
        return "empty"
    if f.op == "LIKE":
        return None
    t = schema[f.column].dataType
    parse = {"number": parse_number, "temporal": parse_temporal}.get(kind(t))
    if parse and any(parse(v) is None for v in (f.value, f.upper) if v is not None and str(v) != ""):
        return "invalid"
    return "invalid" if parse and str(f.value) == "" else None


def _whole(c: Column, op: str, v) -> Column:
    """An integer column against a fraction, without casting the column, so that it can be pushed down."""
    if op == "=":
        return F.lit(False)
    if op == "<>":
        return c.isNotNull()
    return c <= math.floor(v) if op in ("<", "<=") else c >= math.ceil(v)


def _one(c: Column, t: T.DataType, op: str, value: object) -> Column:
    k = kind(t)
    if k == "number":
        v = parse_number(value)
        if isinstance(t, T.IntegralType):
            if not isinstance(v, int):
                return _whole(c, op, v)
            lit = F.lit(v) if -(2**63) <= v < 2**63 else F.lit(v).cast("decimal(38,0)")
        else:
            lit = F.lit(float(v)) if is_float(t) else F.lit(str(v)).cast(T.DecimalType(38, max(0, -v.as_tuple().exponent)) if not isinstance(v, int) else "decimal(38,0)")
        test = getattr(c, COMPARE[op])(lit)
        return test & ~F.isnan(c) if is_float(t) and op in (">", ">=", "<>") else test
    if k == "bool":
        return getattr(c, COMPARE[op])(F.lit(parse_bool(value)))
    if k == "temporal":
        return getattr(c, COMPARE[op])(temporal_literal(parse_temporal(value), t))
    if k == "binary":
        return getattr(text(c, t, full_binary=True), COMPARE[op])(F.lit(str(value).lower()))
    return getattr(c if k == "string" else text(c, t), COMPARE[op])(F.lit(str(value)))


def compile_filter(f: Filter, schema: T.StructType) -> Column | None:
    if issue(f, schema):
        return None
    c, t = column(f.column), schema[f.column].dataType
    if f.op == "IS NULL":
        return c.isNull()
    if f.op == "IS NOT NULL":
        return c.isNotNull()
    if f.op == "LIKE":
        return F.contains(F.lower(text(c, t)), F.lit(str(f.value).lower()))
    if f.op == "BETWEEN":
        upper = f.value if f.upper is None or f.upper == "" else f.upper
        return _one(c, t, ">=", f.value) & _one(c, t, "<=", upper)
    return _one(c, t, f.op, f.value)


def compile_where(filters: tuple[Filter, ...], schema: T.StructType) -> tuple[Column | None, list[tuple[Filter, str]]]:
    """(condition or None, clauses left out with the reason).  A left-out clause takes nothing else with it."""
    skipped = [(f, why) for f in filters if (why := issue(f, schema))]
    groups = [[x for f in g if (x := compile_filter(f, schema)) is not None] for g in or_groups(filters)]
    ands = [reduce(Column.__and__, g) for g in groups if g]
    return (reduce(Column.__or__, ands) if ands else None), skipped
