"""The mergeable metrics over a stream of arriving Parquet files.

Counts, sums, averages, spreads and extremes have partial states that merge, so
they can be kept up to date as files arrive; exact percentiles, modes and
distinct counts cannot, and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import Refusal
from ..operators.metrics import metric
from ..operators.predicates import column, compile_where
from ..plans.spec import QuerySpec

MERGEABLE = {"COUNT", "COUNT_ALL", "NULLS", "SUM", "AVG", "MIN", "MAX", "STD", "STDP", "VAR", "CV", "RANGE"}


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.{parquet,parq,pq}").parquet(path)


def running_aggregate(stream: DataFrame, q: QuerySpec) -> DataFrame:
    """A flat GROUP BY kept up to date; write it with output mode complete or update."""
    bad = [m.name for m in q.metrics if m.kind not in MERGEABLE]
    if bad or q.group_mode != "flat" or q.sort or q.limit is not None:
        raise Refusal("not mergeable", f"{', '.join(bad) or 'grouping sets, order and limit'} cannot be kept up to date over a stream")
    where, _ = compile_where(q.filters, stream.schema)
    rows = stream.filter(where) if where is not None else stream
    return rows.groupBy(*(column(k) for k in q.group_by)).agg(*(metric(m, stream.schema).alias(m.name) for m in q.metrics))
