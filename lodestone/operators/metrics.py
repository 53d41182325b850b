"""The eighteen aggregates as Columns over one kind of column each.

NaN is skipped by every numeric metric and counted by COUNT and COUNT DISTINCT;
divisions by zero give NULL; text yields NULL from numeric metrics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import is_float, kind, number, text
from ..plans.spec import Metric
from .predicates import column

QUANTILES = {"MED": 0.5, "P90": 0.9, "P95": 0.95, "P99": 0.99}


def metric(m: Metric, schema: T.StructType) -> Column:
    if m.kind == "COUNT_ALL":
        return F.count(F.lit(1))
    c, t = column(m.column), schema[m.column].dataType
    x = number(c, t)
    if m.kind == "COUNT":
        return F.count(c)
    if m.kind == "COUNT_DISTINCT":
        return F.count_distinct(text(c, t) if isinstance(t, T.MapType) else c)
    if m.kind == "NULLS":
        return F.count(F.lit(1)) - F.count(c)
    if m.kind in ("MIN", "MAX"):
        pick = F.min if m.kind == "MIN" else F.max
        if kind(t) == "nested":
            return (F.min_by if m.kind == "MIN" else F.max_by)(c, text(c, t))
        return pick(F.when(~F.isnan(c), c) if is_float(t) else c)
    if m.kind in QUANTILES:
        return F.percentile(x, QUANTILES[m.kind])
    return {
        "SUM": lambda: F.sum(x),
        "AVG": lambda: F.avg(x),
        "STD": lambda: F.stddev_samp(x),
        "STDP": lambda: F.stddev_pop(x),
        "VAR": lambda: F.var_samp(x),
        "CV": lambda: F.try_divide(F.stddev_samp(x), F.abs(F.avg(x))),
        "RANGE": lambda: F.max(x) - F.min(x),
        "IQR": lambda: F.percentile(x, 0.75) - F.percentile(x, 0.25),
    }[m.kind]()
