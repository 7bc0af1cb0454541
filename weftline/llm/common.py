"""Shared plumbing: the shared folder, staged tables and size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Bytes of files up to which a staged table is broadcast.
SMALL_BYTES = 64 << 20

_MINE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set on a local master (tests), an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _MINE.setdefault("own", [f"file://{tempfile.mkdtemp(prefix='weftline-')}"])[0]
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex[:12]}"
    if "staged" not in _MINE:
        _MINE["staged"] = []
        atexit.register(_forget, spark)
    _MINE["staged"].append(path)
    return path


def _forget(spark: SparkSession) -> None:
    for path in _MINE.get("staged", []):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again: later jobs survive the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Drop staged tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            delete(df.sparkSession, path)
            _MINE["staged"].remove(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session kept to a few MB: whole texts stand in them, in the JVM and in Python."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a staged table when it has at most max_rows rows and SMALL_BYTES bytes; otherwise leave the join to shuffle."""
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(df._staged_at)
    size = where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return F.broadcast(df) if size <= SMALL_BYTES and df.limit(max_rows + 1).count() <= max_rows else df


def crc_mod(col: Column, m: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % m


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
