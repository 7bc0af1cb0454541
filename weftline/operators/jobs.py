"""Job-store operators: filters, search, paging, priority, staleness, claims and partial updates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_ci(text: str, *columns: str) -> Column:
    """Case-insensitive substring over any of columns; % and _ in text are ordinary characters."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{safe}%") for c in columns))


def matching(df: DataFrame, status: str | None = None, search: str | None = None, columns: Sequence[str] = ("project_path", "transcript_file")) -> DataFrame:
    """Optional status and optional search: a missing parameter leaves its predicate out, so the rest pushes down."""
    if status is not None:
        df = df.where(F.col("status") == status)
    return df.where(contains_ci(search, *columns)) if search else df


def all_of(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Conjunction of those predicates that are given."""
    for p in predicates:
        df = df if p is None else df.where(p)
    return df


def page(df: DataFrame, number: int, size: int, newest: bool = True) -> DataFrame:
    """One page by queue time with the id as tie-break; page numbers start at 1."""
    order = [F.desc("queued_at"), F.desc("id")] if newest else [F.asc("queued_at"), F.asc("id")]
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def next_job(df: DataFrame, now: Column | None = None) -> DataFrame:
    """The pending job of highest priority, the oldest of these; with now, only those whose retry time has come."""
    ready = df.where("status = 'pending'")
    if now is not None:
        ready = ready.where(F.col("retry_after").isNull() | (F.col("retry_after") <= now))
    return ready.orderBy(F.desc("priority"), F.asc_nulls_first("queued_at"), "id").limit(1)


def stale(df: DataFrame, cutoff: Column) -> DataFrame:
    """Running jobs whose last heartbeat is before cutoff; no heartbeat at all is stale."""
    return df.where("status = 'in_progress'").where(F.col("last_heartbeat").isNull() | (F.col("last_heartbeat") < cutoff))


def reset_stuck(df: DataFrame, cutoff: Column) -> DataFrame:
    """(id, status, retry_count): stuck jobs after their reset. Without a heartbeat the start time counts."""
    stuck = df.where("status = 'in_progress'").where(F.coalesce("last_heartbeat", "started_at") < cutoff)
    retry = F.col("retry_count") + 1
    return stuck.select("id", F.when(retry >= F.col("max_retries"), "failed").otherwise("pending").alias("status"), retry.alias("retry_count"))


def queue_stats(df: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """One row: a count for each status, the total over all of them, and the cost; one pass."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return df.agg(*counts, F.count("*").alias("total"), F.round(F.sum("actual_cost"), 2).alias("total_cost"))


def duplicates_of(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, media_id, job_id): for each wanted pair the newest live job of the same file, else of the same media id."""
    live = df.where("status <> 'cancelled'")
    newest = lambda key: live.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("id", F.struct("queued_at", "id")).alias("job_id"))
    by_file = newest("transcript_file").withColumnsRenamed({"transcript_file": "file", "job_id": "by_file"})
    by_media = newest("media_id").withColumnRenamed("job_id", "by_media")
    return wanted.join(by_file, "file", "left").join(by_media, "media_id", "left").select("file", "media_id", F.coalesce("by_file", "by_media").alias("job_id"))


def with_status(df: DataFrame, status: str, now: Column) -> DataFrame:
    """Partial update: the new status and the timestamps that follow from it: a first start, and an end that any other state than an ended one takes back."""
    started = F.when(F.lit(status == "in_progress") & F.col("started_at").isNull(), now).otherwise(F.col("started_at"))
    ended = F.lit(status) if status in ("completed", "failed", "cancelled") else F.lit(None).cast("string")
    return df.withColumn("started_at", started).withColumn("completed_at", F.when(ended.isNotNull(), now)).withColumn("status", F.lit(status))


def deferrals(df: DataFrame, now: Column, schedule: Sequence[int] = (60, 300, 900, 3600), ceiling_seconds: int = 86_400) -> DataFrame:
    """Backoff: the next retry time by how often a job was deferred; beyond the ceiling since the first deferral it fails."""
    wait = F.element_at(F.array(*map(F.lit, schedule)), F.least(F.col("defer_count") + 1, F.lit(len(schedule))))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(F.col("first_deferred_at"), now))
    given_up = age >= ceiling_seconds
    return df.select("id", F.when(given_up, "failed").otherwise("pending").alias("status"), (F.col("defer_count") + 1).alias("defer_count"), F.when(~given_up, wait).alias("wait_seconds"))


def heartbeat_age(column: str, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(F.col(column))


def rank_one(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group; null keys form one group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


#: What may be uploaded, by extension or content type.
UPLOADS, UPLOAD_TYPES = ("srt", "txt", "csv", "tsv"), ("text/csv", "text/plain", "application/csv", "application/octet-stream")


def upload_error(name: Column, content_type: Column, path: Column, root: str) -> Column:
    """Why an upload is refused: its type, or a folder outside root; null where it is taken."""
    known = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*UPLOADS) | F.coalesce(content_type, F.lit("")).isin(*UPLOAD_TYPES)
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~F.array_contains(F.split(path, "/"), "..")
    return F.when(~known, "type").when(~F.coalesce(inside, F.lit(False)), "path")


def run_states(events: DataFrame, at: str = "run") -> DataFrame:
    """(source, run, status) of a run log (source, run, event, and at, what runs are ordered by): running until completed, suppressed or failed; a run still open when its source has a later one is interrupted."""
    runs = events.groupBy("source", "run").agg(F.max_by("event", F.when(F.col("event") == "running", 0).otherwise(1)).alias("status"), F.min(at).alias("_at"))
    later = F.lead("run").over(Window.partitionBy("source").orderBy("_at", "run")).isNotNull()
    return runs.select("source", "run", F.when((F.col("status") == "running") & later, "interrupted").otherwise(F.col("status")).alias("status"))


def attach_decisions(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(id, outcome, before, after) of files (id, media_id, filename) against records (media_id, attachments: array of names)."""
    joined = wanted.join(records.select("media_id", "attachments"), "media_id", "left")
    before = F.when(F.col("attachments").isNotNull(), F.size("attachments"))
    there = F.array_contains("attachments", F.col("filename"))
    outcome = F.when(F.col("attachments").isNull(), "no_match").when(there, "duplicate").otherwise("attached")
    return joined.select("id", outcome.alias("outcome"), before.alias("before"), (before + (~there).cast("int")).alias("after"))


def retried(phases: Column, name: str) -> Column:
    """Struct phases, cost: the phase of that name pending again with its run archived, later "validator" runs too; the cost is that of what still stands."""
    again = lambda p: (p["name"] == name) | (p["name"] == "validator")
    state = F.transform(phases, lambda p: F.struct(p["name"].alias("name"), F.when(again(p), "pending").otherwise(p["status"]).alias("status"), F.when(again(p), 0.0).otherwise(p["cost"]).alias("cost"), F.when(again(p), F.array(p)).otherwise(F.array().cast("array<struct<name:string,status:string,cost:double>>")).alias("previous_runs")))
    return F.struct(state.alias("phases"), F.aggregate(state, F.lit(0.0), lambda a, p: a + F.coalesce(p["cost"], F.lit(0.0))).alias("cost"))


def access(required: str, scopes: Column, consumer: Column) -> Column:
    """allowed where a consumer's comma-separated scopes have the required one, shared for the common key without a consumer, else denied."""
    has = F.array_contains(F.transform(F.split(F.coalesce(scopes, F.lit("")), ","), lambda s: F.trim(s)), required)
    return F.when(consumer.isNull(), "shared").when(has, "allowed").otherwise("denied")
