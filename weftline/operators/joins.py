"""Joins with tables that are small by a check, not by hope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.files import file_bytes, scratch

#: Bytes of files up to which a table is broadcast.
SMALL_BYTES = 64 << 20


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """df, broadcast where it has at most max_rows rows and SMALL_BYTES bytes; otherwise the join shuffles and adaptive execution splits its skew.

    A table whose plan bounds its rows is taken as it is; any other is written once, and its size read from its files.
    """
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    if most.isDefined() and most.get() <= min(max_rows, 10_000):
        return F.broadcast(df)
    spark, path = df.sparkSession, scratch(df.sparkSession, "bounded")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(out) if file_bytes(spark, path) <= SMALL_BYTES and out.count() <= max_rows else out
