"""Readers and writers of logs, metrics, captions, side files and snapshots."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MINE: list[str] = []
SOAK = "event string, ts string, req_total bigint, req_5xx bigint, req_errors bigint, peak_inflight int, elapsed_s double, fts_parity_delta bigint, latency_ms double, status int, endpoint string, outcome string, _corrupt_record string"
METRICS = "label string, transcript string, phases array<struct<phase:string,ok:boolean,model:string,total_tokens:bigint,cost:double,wall_s:double,words:bigint>>"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where none is named on a local master (tests), an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this process ends."""
    path = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex[:12]}"
    if not _MINE:
        atexit.register(_forget, spark)
    _MINE.append(path)
    return path


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _forget(spark: SparkSession) -> None:
    for path in _MINE:
        try:
            store, where = _place(spark, path)
            store.delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def discard(spark: SparkSession, path: str) -> None:
    """What is below path is no longer needed."""
    store, where = _place(spark, path)
    store.delete(where, True)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below path."""
    store, where = _place(spark, path)
    return store.getContentSummary(where).getLength()


def append(df: DataFrame, path: str) -> None:
    """Rows added to a table's files; what is there stays."""
    df.write.mode("append").parquet(path)


def jsonl(spark: SparkSession, path: str, schema: str = SOAK) -> DataFrame:
    """Rows of a JSONL log; blank lines vanish and malformed ones are dropped."""
    read = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(read.alias("r")).select("r.*")
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """One nested JSON a run; an invalid file ends the read."""
    return spark.read.schema(METRICS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def side_files(spark: SparkSession, path: str, names: str = r"\.(srt|scc)$") -> DataFrame:
    """(path, ok, body_text) of .srt and .scc files: UTF-8 if valid, else Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(names))
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", (F.length("content") > 0).alias("ok"), body.alias("body_text"))


def manifests(spark: SparkSession, path: str, name: str = "manifest.json") -> DataFrame:
    """Projects with a manifest.json below path."""
    files = spark.read.schema("project string, status string, outputs map<string,string>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("folder"), "project", "status", F.array_sort(F.map_keys("outputs")).alias("deliverables"))


def provenance(text: Column) -> dict[str, Column]:
    """Model, tier, cost and tokens from a first-line comment."""
    first = F.split(text, "\n")[0]
    part = lambda k, p: F.nullif(F.regexp_extract(first, rf"<!--.*\b{k}:\s*({p})", 1), F.lit(""))
    return {"model": part("model", r"[^\s|>]+"), "tier": part("tier", r"[^\s|>]+"), "cost": part("cost", r"\$?[0-9.]+").substr(F.lit(1), F.lit(50)), "tokens": part("tokens", r"\d+").try_cast("long")}


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def write_captions(srt: DataFrame, path: str) -> None:
    """One text file a partition of a column of SRT texts."""
    srt.select("srt").write.mode("overwrite").text(path)


def rule_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, family, nth, item) of the YAML rule files below path: each item of each list of mappings, as JSON.

    A file's root must be a mapping with a meta entry; any other file ends the read with its path. Files are parsed where they are read.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            rows = []
            for where, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = yaml.safe_load(text)
                if not isinstance(tree, dict) or "meta" not in tree:
                    raise ValueError(f"{where}: rules need a mapping with meta at the root")
                rows += [(where, k, i, json.dumps(x)) for k, v in tree.items() if isinstance(v, list) for i, x in enumerate(v) if isinstance(x, dict)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "family", "nth", "item"])

    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInArrow(parse, "path string, family string, nth int, item string")
