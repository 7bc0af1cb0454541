"""Streaming queries (K) and nested-column queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.sources.files import scratch
from weftline.sources.parts import Parts
from weftline.sources.tables import raw
from weftline.streaming import jobs as K
from weftline.streaming import ordered as O


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, count(*) AS requests FROM events GROUP BY 1")
def k9_window_rates(spark, sf):
    """The windows of E11 from a stream."""
    updates = K.run_once(K.window_rates(K.table_stream(spark, f"{sf}/events.parquet"), late="60 days"), mode="update")
    return K.latest(updates, "bucket").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "requests")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def k1_polling_consumer(spark, sf):
    """Whatever files are there, once each."""
    stream = K.table_stream(spark, f"{sf}/events.parquet", files_per_batch=4).where("event_type = 'error'").select("event_id", "user_id", "value")
    return K.run_once(stream)


@query("SELECT user_id, count(*) AS seen, min(event_id) AS first_id FROM events GROUP BY user_id")
def k5_delta_ingest(spark, sf):
    """K5: each batch rewrites the parts that it touches and commits them; a batch that comes again changes nothing."""
    path = scratch(spark, "ingest")
    parts = Parts(spark, f"{path}/users", {"users": ("user_id long, seen long, first_id long, part string", "part")})

    def twice(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            K.merged_part(parts, "users", batch.groupBy("user_id").agg(F.count("*").alias("seen"), F.min("event_id").alias("first_id")).withColumn("part", (F.col("user_id") % 16).cast("string")), number, "user_id", {"seen": "sum", "first_id": "min"})

    events = K.table_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    events.writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return parts.current("users").drop("part")


@query("""WITH RECURSIVE e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, ['claim', 'complete', 'fail', 'pause', 'resume', 'retry', 'cancel'][event_id * 31 % 7 + 1] AS a FROM events),
r AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(0 AS BIGINT) AS applied FROM e UNION ALL SELECT id, n, coalesce(t, status), applied + CASE WHEN t IS NULL THEN 0 ELSE 1 END FROM (SELECT r.id, e.n, r.status, r.applied,
CASE WHEN a = 'claim' AND status = 'pending' THEN 'in_progress' WHEN a = 'complete' AND status = 'in_progress' THEN 'completed' WHEN a = 'fail' AND status = 'in_progress' THEN 'failed' WHEN a = 'pause' AND status IN ('pending', 'in_progress') THEN 'paused' WHEN a = 'resume' AND status = 'paused' THEN 'pending'
WHEN a = 'retry' AND status IN ('failed', 'cancelled') THEN 'pending' WHEN a = 'cancel' AND status IN ('pending', 'in_progress', 'paused') THEN 'cancelled' END AS t FROM r JOIN e ON e.id = r.id AND e.n = r.n + 1))
SELECT id, arg_max(status, n) AS status, max(applied) AS applied, max(n) - max(applied) AS refused FROM r GROUP BY id""")
def k2_state_machine(spark, sf):
    """K2: job states from a stream of actions, in the order of time whatever batches they come in."""
    names = F.array(*map(F.lit, ("claim", "complete", "fail", "pause", "resume", "retry", "cancel")))
    stream = K.table_stream(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") * 31 % 7 + 1).cast("int")).alias("kind"), F.lit(None).cast("long").alias("number"))
    return K.latest(K.run_once(O.in_order(stream, O.Machine(), "1 day", provisional=True), mode="update"), "id")


@query("SELECT event_id, event_id % 2 AS lane  , row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, event_id) AS place FROM events WHERE event_type = 'click'")
def k6_priority_lanes(spark, sf):
    lane = F.col("event_id") % 2
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(lane, "event_id"))
    return raw(spark, sf, "events").where("event_type = 'click'").select("event_id", lane.alias("lane"), place.alias("place"))


@query("SELECT event_id, (hour(ts) * 60 + minute(ts) >= 1380 OR hour(ts) * 60 + minute(ts) < 330) AS paused FROM events")
def k7_pause_window(spark, sf):
    """K7: a pause from 23:00 to 05:30 wraps midnight, told on a stream."""
    at = F.hour("ts") * 60 + F.minute("ts")
    start, end = 23 * 60, 5 * 60 + 30
    inside = (at >= start) | (at < end) if start > end else (at >= start) & (at < end)
    return K.run_once(K.table_stream(spark, f"{sf}/events.parquet").select("event_id", inside.alias("paused")))


def _phases(spark, sf):
    """Jobs with their phases as an array of structs, from JSON text."""
    names = ("analyst", "formatter", "seo", "validator")
    items = [F.to_json(F.struct(F.lit(n).alias("name"), F.when(F.col("o_orderkey") % (i + 2) == 0, "failed").otherwise("completed").alias("status"), (F.col("o_custkey") * (i + 1)).cast("double").alias("cost"))) for i, n in enumerate(names)]
    text = F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    rows = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 != 1, text).alias("phases"))
    return rows.withColumn("phases", F.from_json("phases", "array<struct<name:string,status:string,cost:double>>"))


_P = "WITH j AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders)"


@query(f"{_P} SELECT id, CASE WHEN id % 10 = 1 THEN 'pending,pending' ELSE array_to_string([CASE WHEN id % 2 = 0 THEN 'failed' ELSE 'completed' END, CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'completed' END, CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'completed' END, CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'completed' END], ',') END AS states FROM j")
def b62_typed_jobs(spark, sf):
    """Phases from JSON; where there are none, the planned ones as pending."""
    planned = F.transform(F.array(F.lit("analyst"), F.lit("seo")), lambda n: F.struct(n.alias("name"), F.lit("pending").alias("status"), F.lit(None).cast("double").alias("cost")))
    return _phases(spark, sf).select("id", F.array_join(F.transform(F.coalesce("phases", planned), lambda p: p["status"]), ",").alias("states"))


@query(f"{_P} SELECT id, CASE WHEN id % 10 <> 1 THEN array_to_string([CASE WHEN id % 2 = 0 THEN 'failed' ELSE 'completed' END, CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'completed' END, 'skipped', CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'completed' END], ',') END AS states FROM j")
def b63_patch_phase(spark, sf):
    """The element whose name matches is patched."""
    patched = F.transform("phases", lambda p: F.when(p["name"] == "seo", F.struct(p["name"].alias("name"), F.lit("skipped").alias("status"), p["cost"].alias("cost"))).otherwise(p))
    return _phases(spark, sf).select("id", F.when(F.col("phases").isNotNull(), F.array_join(F.transform(patched, lambda p: p["status"]), ",")).alias("states"))


@query(f"""{_P}, s AS (SELECT id, [id % 2 = 0, id % 3 = 0, id % 4 = 0, id % 5 = 0] AS f FROM j WHERE id % 10 <> 1), k AS (SELECT id, f, coalesce(list_position(f, true), 0) AS pos FROM s)
SELECT id, pos AS first_failed, CASE WHEN pos = 0 THEN 0 ELSE 5 - pos END AS archived FROM k""")
def b64_archive_tail(spark, sf):
    """From the first phase that isn't completed on, the runs are archived and reset."""
    rows = _phases(spark, sf).where("phases IS NOT NULL")
    at = F.array_position(F.transform("phases", lambda p: p["status"] != "completed"), True)
    tail = F.transform("phases", lambda p, i: F.when((at > 0) & (i + 1 >= at), F.struct(p["name"], F.lit("pending"), F.array(p).alias("previous_runs"))))
    return rows.select("id", at.cast("int").alias("first_failed"), F.size(F.filter(tail, lambda p: p.isNotNull())).alias("archived"))


@query(f"{_P} SELECT id, CASE WHEN id % 2 = 0 THEN 'analyst' WHEN id % 3 = 0 THEN 'formatter' WHEN id % 4 = 0 THEN 'seo' WHEN id % 5 = 0 THEN 'validator' END AS resume_at, NOT (id % 2 = 0 OR id % 3 = 0 OR id % 4 = 0 OR id % 5 = 0) AS all_complete, CAST(c * 10 AS DOUBLE) AS cost FROM j WHERE id % 10 <> 1")
def b67_resume_phase(spark, sf):
    """B67, N16 and N17."""
    rows = _phases(spark, sf).where("phases IS NOT NULL")
    done = lambda p: p["status"] == "completed"
    cost = F.aggregate("phases", F.lit(0.0), lambda a, p: a + p["cost"])
    return rows.select("id", F.get(F.filter("phases", lambda p: ~done(p)), F.lit(0))["name"].alias("resume_at"), F.forall("phases", done).alias("all_complete"), cost.alias("cost"))


@query(f"{_P} SELECT id, md5(concat('{{\"id\":', CAST(id AS STRING), ',\"phases\":4,\"total\":', CAST(c * 10 AS STRING), '}}')) AS manifest_md5 FROM j WHERE id % 10 <> 1")
def n23_manifest(spark, sf):
    """A run's manifest as JSON."""
    total = F.aggregate("phases", F.lit(0.0), lambda a, p: a + p["cost"]).cast("long")
    rows = _phases(spark, sf).where("phases IS NOT NULL")
    return rows.select("id", F.md5(F.to_json(F.struct("id", F.size("phases").alias("phases"), total.alias("total"))).cast("binary")).alias("manifest_md5"))


@query("SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS wrong, split_part(p_name, ' ', 2) AS fixed FROM part WHERE split_part(p_name, ' ', 1) <> 'red'")
def n22_glossary(spark, sf):
    """Lines "wrong -> right | note", but those already known."""
    line = F.concat(F.split("p_name", " ")[0], F.lit(" -> "), F.split("p_name", " ")[1], F.lit(" | noted"))
    rows = raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), line.alias("line"))
    pattern = r"^\s*(.+?)\s*->\s*(.+?)\s*(?:\|.*)?$"
    known = spark.createDataFrame([("red",)], "wrong string")
    return rows.select("id", F.regexp_extract("line", pattern, 1).alias("wrong"), F.regexp_extract("line", pattern, 2).alias("fixed")).join(F.broadcast(known), "wrong", "left_anti").select("id", "wrong", "fixed")


_TIMED = """w AS (SELECT max(ts) - INTERVAL '1' DAY AS w FROM events), e AS (SELECT user_id AS id, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'busy' WHEN 'purchase' THEN 'progress' ELSE event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN event_id % 1000 END AS number FROM events, w WHERE ts <= w)"""


def _timed(spark, sf) -> DataFrame:
    """Events of a stream: errors as a busy backend, some with the seconds that it asks for, purchases as progress."""
    kind = F.when(F.col("event_type") == "error", "busy").when(F.col("event_type") == "purchase", "progress").otherwise(F.col("event_type"))
    number = F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 1000)
    return K.table_stream(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), number.alias("number"))


@query(f"""WITH {_TIMED}, k AS (SELECT * FROM e WHERE kind IN ('busy', 'progress')), s AS (SELECT *, count(*) FILTER (kind = 'progress') OVER (PARTITION BY id ORDER BY ts, seq) AS spell, lead(ts) OVER (PARTITION BY id ORDER BY ts, seq) AS next_ts FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY id, spell ORDER BY ts, seq) AS n, min(ts) OVER (PARTITION BY id, spell) AS first FROM s WHERE kind = 'busy'), p AS (SELECT *, ts - first >= INTERVAL '1' HOUR * 36 AS over, count(*) FILTER (ts - first >= INTERVAL '1' HOUR * 36) OVER (PARTITION BY id, spell ORDER BY ts, seq) AS nth FROM b),
d AS (SELECT *, ts + INTERVAL '1' SECOND * coalesce(number, [300, 3600, 43200, 86400][least(n, 4)]) AS until FROM p WHERE NOT over)
SELECT id, epoch_us(ts) AS at, 'deferred' AS outcome, n, epoch_us(until) AS until FROM d UNION ALL SELECT id, epoch_us(until), 'woken', n, NULL FROM d, w WHERE until <= w AND (next_ts IS NULL OR next_ts > until) UNION ALL SELECT id, epoch_us(ts), 'paused', n - 1, NULL FROM p WHERE over AND nth = 1""")
def k3_deferral(spark, sf):
    """K3: jobs put off by a schedule wake by themselves, and are paused where the ceiling is reached; what the watermark has passed."""
    return K.run_once(O.in_order(_timed(spark, sf), O.Deferral((300, 3600, 43_200, 86_400), 36 * 3600), "1 day"))


@query(f"""WITH {_TIMED}, n AS (SELECT id, ts, lead(ts) OVER (PARTITION BY id ORDER BY ts, seq) AS next_ts FROM e)
SELECT id, epoch_us(ts) AS last_beat, epoch_us(ts + INTERVAL '12' HOUR) AS stale_at FROM n, w WHERE ts + INTERVAL '12' HOUR <= w AND (next_ts IS NULL OR next_ts > ts + INTERVAL '12' HOUR)""")
def k4_silence(spark, sf):
    """K4: users without an event for twelve hours, once for each silence; what the watermark has passed."""
    return K.run_once(O.in_order(_timed(spark, sf), O.Silence(12 * 3600), "1 day"))


@query(f"""WITH {_TIMED}, r AS (SELECT id % 97 AS id, seq, ts, CASE kind WHEN 'view' THEN 'running' WHEN 'progress' THEN 'completed' WHEN 'busy' THEN 'failed' END AS kind FROM e WHERE kind IN ('view', 'progress', 'busy')),
n AS (SELECT *, lead(kind) OVER o AS next_kind, lead(ts) OVER o AS next_ts FROM r WINDOW o AS (PARTITION BY id ORDER BY ts, seq))
SELECT id, seq AS run, CASE next_kind WHEN 'running' THEN 'interrupted' ELSE next_kind END AS status, epoch_us(ts) AS started, epoch_us(next_ts) AS finished FROM n WHERE kind = 'running' AND next_kind IS NOT NULL""")
def k8b_run_log_stream(spark, sf):
    """K8: runs of a source are closed by their end or interrupted by the next run's start, from events as they come."""
    rows = _timed(spark, sf).where("kind IN ('view', 'progress', 'busy')").withColumns({"id": F.col("id") % 97, "kind": F.expr("CASE kind WHEN 'view' THEN 'running' WHEN 'progress' THEN 'completed' ELSE 'failed' END")})
    return K.run_once(O.in_order(rows, O.RunLog(), "1 day"))


@query(f"""WITH RECURSIVE {_TIMED}, n AS (SELECT id, seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS n FROM e),
r AS (SELECT id, n, seq, us, us AS granted, us + 7200000000 AS nxt FROM n WHERE n = 1 UNION ALL SELECT n.id, n.n, n.seq, n.us, greatest(n.us, r.nxt - 14400000000), greatest(n.us, r.nxt) + 7200000000 FROM r JOIN n ON n.id = r.id AND n.n = r.n + 1)
SELECT id, seq, us AS at, granted FROM r""")
def k7b_rate_limit(spark, sf):
    """K7: when each request of a user may go, at one in two hours after a burst of three; what the watermark has passed."""
    return K.run_once(O.in_order(_timed(spark, sf), O.Throttle(7_200_000_000, 3), "1 day"))
