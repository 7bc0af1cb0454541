"""Running totals and dense numbers over tables of any size and skew.

Rows are dealt out by ranges of key and order, so that a key with many rows spreads over many tasks; totals run within each range, and
what the ranges before it have of the same key is added. Only a key that spans ranges needs that, so there are at most two such rows a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.files import scratch


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], totals: Mapping[str, Column]) -> DataFrame:
    """rows with the running totals of each group of by along order, the row itself included; null keys are a group.

    The order must tell rows apart, or rows that it doesn't have any order among them. The dealt rows are written once, so that a lost executor
    can't deal them out anew.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "running")
    added = {f"_add_{name}": c for name, c in totals.items()}
    dealt = rows.withColumns(added).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt.withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}).write.parquet(path)
    dealt = spark.read.parquet(path)
    along = Window.partitionBy("_range", *by).orderBy("_nth")
    inside = dealt.withColumns({f"_own_{name}": F.sum(f"_add_{name}").over(along) for name in totals})

    ranges = dealt.groupBy("_range", *by).agg(*(F.sum(f"_add_{name}").alias(f"_all_{name}") for name in totals))
    keyed = ranges.withColumn("_key", F.struct(F.lit(1), *by))
    spans = keyed.groupBy("_key").agg(F.count("*").alias("_ranges")).where("_ranges > 1")
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = keyed.join(spans, "_key", "left_semi").withColumns({f"_before_{name}": F.sum(f"_all_{name}").over(before) for name in totals})
    # two rows a range at most
    carried = F.broadcast(carried.select(F.col("_range").alias("_r"), F.col("_key").alias("_k"), *(f"_before_{name}" for name in totals)))
    out = inside.join(carried, (F.col("_range") == F.col("_r")) & F.struct(F.lit(1), *by).eqNullSafe(F.col("_k")), "left")
    return out.select(*rows.columns, *(F.when(F.col(f"_before_{name}").isNull(), F.col(f"_own_{name}")).otherwise(F.col(f"_before_{name}") + F.col(f"_own_{name}")).alias(name) for name in totals))


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, by: Sequence[str] = (), after: int = 0) -> DataFrame:
    """rows with dense numbers from after + 1 on, along order in each group of by."""
    return running(rows, by, order, {name: F.lit(1)}).withColumn(name, F.col(name) + after)
