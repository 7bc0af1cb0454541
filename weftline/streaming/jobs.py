"""Streaming forms: table streams, rates over windows, merges by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.sources.files import scratch
from weftline.sources.parts import Parts
from weftline.streaming.ordered import ROCKS, settings


def table_stream(spark: SparkSession, path: str, schema: StructType | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files at path: the polling consumer, with at most so many files a batch."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = spark.read.parquet(path).inputFiles()
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a file: a stream reads folders
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there now, through the stream into a table in the shared folder; late rows follow the watermark."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")
    if mode == "append":
        with settings(spark, ROCKS):
            query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
            query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    with settings(spark, ROCKS):
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def window_rates(events: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Requests of each tumbling window; the watermark is an addition of ours. Each update replaces its window's last."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("requests")).select(F.col("window.start").alias("bucket"), "requests")


def latest(updates: DataFrame, key: str) -> DataFrame:
    """Of the updates of each key, that of the last batch."""
    return updates.groupBy(key).agg(*(F.max_by(c, "_batch").alias(c) for c in updates.columns if c not in (key, "_batch")))


def merged_part(parts: Parts, name: str, rows: DataFrame, batch: int, key: str, by: dict[str, str]) -> None:
    """Rows (one a key) merged into the parts of a table that they touch, and committed; a batch that was committed before is left alone.

    by: how a value joins that which is there (sum, min or max).
    """
    if parts.committed(batch):
        return
    part = parts.schemas[name][1]
    old = parts.current(name).join(rows.select(part).distinct(), part, "left_semi")
    both = old.unionByName(rows.select(old.columns)).groupBy(key, part).agg(*(getattr(F, how)(c).alias(c) for c, how in by.items()))
    parts.write(batch, name, both)
    parts.commit(batch)


def to_outbox(messages: DataFrame, path: str, batch: int) -> None:
    """Messages of a batch into the outbox; a batch that is delivered again replaces its own messages, whatever else is there."""
    messages.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def outbox(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All messages, with the number of their batch."""
    return spark.read.schema(f"{schema}, batch int").parquet(path)
