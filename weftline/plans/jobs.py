"""Job-store queries (C, E1, E6, G, J7-J9, L4-L6, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import jobs as J
from weftline.operators.numbering import running
from weftline.plans.registry import query
from weftline.sources.tables import STATUSES, cte, role

_J = cte("jobs")
NOW = "TIMESTAMP '1998-01-01 00:00:00'"
_now = lambda: F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")


def jobs(spark, sf):
    return role(spark, sf, "jobs")


@query(f"{_J} SELECT id, status, priority FROM jobs WHERE id = 42")
def c1_job_by_id(spark, sf):
    return jobs(spark, sf).where("id = 42").select("id", "status", "priority")


@query(f"{_J} SELECT id, transcript_file, status, queued_at FROM jobs WHERE transcript_file = 'Clip 7.srt' AND status <> 'cancelled'")
def c2_jobs_of_file(spark, sf):
    return jobs(spark, sf).where("transcript_file = 'Clip 7.srt' AND status <> 'cancelled'").select("id", "transcript_file", "status", "queued_at").orderBy(F.desc("queued_at"), F.desc("id"))


@query(f"{_J} SELECT id, project_path, transcript_file FROM jobs WHERE status = 'pending' AND (contains(lower(project_path), 'clip 8') OR contains(lower(transcript_file), 'clip 8'))")
def c3_search_jobs(spark, sf):
    return J.matching(jobs(spark, sf), "pending", "CLIP 8").select("id", "project_path", "transcript_file")


@query(f"{_J} SELECT count(*) AS n FROM jobs WHERE contains(lower(project_path), 't_1')")
def c3b_search_escapes_wildcards(spark, sf):
    return J.matching(jobs(spark, sf), search="T_1", columns=("project_path",)).agg(F.count("*").alias("n"))


@query(f"{cte('files')} SELECT id, media_id, file_type, status FROM files WHERE status = 'new' AND file_type = 'srt' AND first_seen_at >= TIMESTAMP '1997-06-01' AND file_size_bytes > 100000 AND media_id IS NOT NULL AND trim(media_id) <> ''")
def c4_dynamic_filter(spark, sf):
    picked = {"status": "new", "file_type": "srt", "prefix": None}
    tests = [F.col(k) == v if v is not None else None for k, v in picked.items()]
    files = role(spark, sf, "files").where("first_seen_at >= TIMESTAMP_NTZ '1997-06-01'")
    return J.all_of(files, *tests, F.col("file_size_bytes") > 100000, F.col("media_id").isNotNull() & (F.trim("media_id") != "")).select("id", "media_id", "file_type", "status")


@query(f"{cte('files')} SELECT id FROM files WHERE first_seen_at >= {NOW} - INTERVAL '14' DAY AND first_seen_at < {NOW}")
def c5_seen_within_days(spark, sf):
    return role(spark, sf, "files").where((F.col("first_seen_at") >= _now() - F.expr("INTERVAL '14' DAY")) & (F.col("first_seen_at") < _now())).select("id")


@query(f"{cte('files')} SELECT id, prefix FROM files WHERE lower(prefix) = lower('6twn') AND NOT superseded")
def c6_optional_prefix(spark, sf):
    prefix: str | None = "6twn"
    return J.all_of(role(spark, sf, "files").where("NOT superseded"), None if prefix is None else F.lower("prefix") == prefix.lower()).select("id", "prefix")


@query(f"{cte('files')} SELECT count(*) AS n FROM files WHERE media_id IS NOT NULL AND trim(media_id) <> ''")
def c8_not_blank(spark, sf):
    return role(spark, sf, "files").where("media_id IS NOT NULL AND trim(media_id) <> ''").agg(F.count("*").alias("n"))


@query(f"{cte('files')} SELECT id FROM files WHERE remote_url IN (SELECT concat('https://media.example/d', CAST(l_suppkey AS STRING), '/f', CAST(l_orderkey AS STRING), '_1') FROM lineitem WHERE l_quantity > 45)")
def c9_in_list(spark, sf):
    urls = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 45").selectExpr("concat('https://media.example/d', CAST(l_suppkey AS STRING), '/f', CAST(l_orderkey AS STRING), '_1') AS remote_url")
    return role(spark, sf, "files").join(urls, "remote_url", "left_semi").select("id")


@query(f"{cte('files')} SELECT count(*) AS n FROM files WHERE media_id LIKE '2LAK%' AND file_type = 'mp4'")
def c10_starts_with(spark, sf):
    return role(spark, sf, "files").where(F.col("media_id").startswith("2LAK") & (F.col("file_type") == "mp4")).agg(F.count("*").alias("n"))


@query(f"{_J} SELECT id, retry_after FROM jobs WHERE status = 'pending' AND (retry_after IS NULL OR retry_after <= {NOW})")
def c12_claimable(spark, sf):
    return jobs(spark, sf).where("status = 'pending'").where(F.col("retry_after").isNull() | (F.col("retry_after") <= _now())).select("id", "retry_after")


@query(f"{_J} SELECT project_path, id FROM jobs WHERE contains(lower(project_path), 'project_3') AND status = 'completed' AND queued_at >= TIMESTAMP '1996-01-01' AND queued_at < TIMESTAMP '1997-01-01' ORDER BY project_path DESC, id LIMIT 50")
def c13_project_search(spark, sf):
    hits = J.matching(jobs(spark, sf), "completed", "Project_3", ("project_path",)).where("queued_at >= TIMESTAMP_NTZ '1996-01-01' AND queued_at < TIMESTAMP_NTZ '1997-01-01'")
    return hits.orderBy(F.desc("project_path"), "id").limit(50).select("project_path", "id")


@query(f"{_J} SELECT id FROM jobs WHERE status = 'completed' OR (media_id IS NOT NULL AND word_count IS NOT NULL AND duration_minutes IS NOT NULL AND status = 'paused')")
def c14_eligible_jobs(spark, sf):
    outputs = F.col("media_id").isNotNull() & F.col("word_count").isNotNull() & F.col("duration_minutes").isNotNull()
    return jobs(spark, sf).where((F.col("status") == "completed") | (outputs & (F.col("status") == "paused"))).select("id")


@query("SELECT DISTINCT p_brand AS model FROM part WHERE p_brand = 'Brand#1' OR p_brand LIKE 'Brand#1:%' OR p_brand = 'Brand#2' OR p_brand LIKE 'Brand#2:%'")
def c15_allowlist(spark, sf):
    allowed = F.array(F.lit("Brand#1"), F.lit("Brand#2"))
    hit = F.exists(allowed, lambda a: (F.col("p_brand") == a) | F.startswith(F.col("p_brand"), F.concat(a, F.lit(":"))))
    return spark.read.parquet(f"{sf}/part.parquet").where(hit).select(F.col("p_brand").alias("model")).distinct()


@query(f"{_J} SELECT id FROM jobs WHERE word_count IS NULL OR duration_minutes IS NULL")
def c16_missing_metrics(spark, sf):
    return jobs(spark, sf).where("word_count IS NULL OR duration_minutes IS NULL").select("id")


@query(f"{_J} SELECT count(*) AS n FROM jobs WHERE status = 'pending' AND (contains(lower(project_path), 'clip') OR contains(lower(transcript_file), 'clip'))")
def e1_filtered_count(spark, sf):
    return J.matching(jobs(spark, sf), "pending", "clip").agg(F.count("*").alias("n"))


@query(f"{_J} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES) + ", count(*) AS total, round(sum(actual_cost), 2) AS total_cost FROM jobs")
def e6_queue_stats(spark, sf):
    return J.queue_stats(jobs(spark, sf), STATUSES)


@query(f"{_J} SELECT id, status, queued_at FROM jobs ORDER BY queued_at DESC, id DESC LIMIT 25 OFFSET 50")
def g1_page_newest(spark, sf):
    return J.page(jobs(spark, sf), 3, 25).select("id", "status", "queued_at")


@query(f"{_J} SELECT id, status, queued_at FROM jobs ORDER BY queued_at, id LIMIT 25")
def g1b_page_oldest(spark, sf):
    return J.page(jobs(spark, sf), 1, 25, newest=False).select("id", "status", "queued_at")


@query(f"{_J} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM jobs WHERE status = 'failed'")
def g2_page_count(spark, sf):
    n = F.count("*")
    return J.matching(jobs(spark, sf), "failed").agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / 25)).cast("long").alias("pages"))


@query(f"{_J} SELECT id, priority, queued_at FROM jobs WHERE status = 'pending' ORDER BY priority DESC, queued_at, id LIMIT 1")
def g3_priority_top1(spark, sf):
    return J.next_job(jobs(spark, sf)).select("id", "priority", "queued_at")


@query(f"{_J} SELECT id, priority FROM jobs WHERE status = 'pending' AND (retry_after IS NULL OR retry_after <= {NOW}) ORDER BY priority DESC, queued_at, id LIMIT 1")
def l4_claim_selection(spark, sf):
    return J.next_job(jobs(spark, sf), _now()).select("id", "priority")


@query(f"{cte('files')} SELECT id, media_id FROM files WHERE status = 'new' ORDER BY (media_id IS NULL OR trim(media_id) = ''), coalesce(remote_modified_at, first_seen_at) DESC, id LIMIT 100")
def g4_null_bucket_sort(spark, sf):
    blank = F.col("media_id").isNull() | (F.trim("media_id") == "")
    return role(spark, sf, "files").where("status = 'new'").orderBy(blank, F.desc(F.coalesce("remote_modified_at", "first_seen_at")), "id").limit(100).select("id", "media_id")


@query(f"{cte('files')} SELECT id, prefix, first_seen_at FROM files WHERE NOT superseded AND first_seen_at >= TIMESTAMP '1998-06-01' ORDER BY first_seen_at DESC, id LIMIT 50")
def g6_recent_arrivals(spark, sf):
    return role(spark, sf, "files").where("NOT superseded AND first_seen_at >= TIMESTAMP_NTZ '1998-06-01'").orderBy(F.desc("first_seen_at"), "id").limit(50).select("id", "prefix", "first_seen_at")


@query(f"{cte('files')} SELECT id, first_seen_at FROM files WHERE status = 'new' AND file_type = 'transcript' ORDER BY first_seen_at, id LIMIT 40")
def g7_oldest_pending(spark, sf):
    return role(spark, sf, "files").where("status = 'new' AND file_type = 'transcript'").orderBy("first_seen_at", "id").limit(40).select("id", "first_seen_at")


@query(f"{cte('stats')} SELECT id, ts, event_type FROM stats WHERE job_id = 46 ORDER BY ts, id")
def g12_events_of_job(spark, sf):
    return role(spark, sf, "stats").where("job_id = 46").orderBy("ts", "id").select("id", "ts", "event_type")


@query(f"{_J} SELECT id, last_heartbeat FROM jobs WHERE status = 'in_progress' AND (last_heartbeat IS NULL OR last_heartbeat < {NOW})")
def j7_stale_jobs(spark, sf):
    return J.stale(jobs(spark, sf), _now()).select("id", "last_heartbeat")


@query(f"{_J} SELECT id, CASE WHEN retry_count + 1 >= max_retries THEN 'failed' ELSE 'pending' END AS status, retry_count + 1 AS retry_count FROM jobs WHERE status = 'in_progress' AND coalesce(last_heartbeat, started_at) < {NOW}")
def j8_reset_stuck(spark, sf):
    return J.reset_stuck(jobs(spark, sf), _now())


@query(f"""{_J}, live AS (SELECT * FROM jobs WHERE status <> 'cancelled'),
wanted AS (SELECT concat('Clip ', CAST(n_nationkey * 40 AS STRING), '.srt') AS file, concat('6TWN', lpad(CAST(n_nationkey AS STRING), 4, '0')) AS media_id FROM nation)
SELECT file, w.media_id, coalesce((SELECT arg_max(id, (queued_at, id)) FROM live WHERE transcript_file = file), (SELECT arg_max(id, (queued_at, id)) FROM live l WHERE l.media_id = w.media_id)) AS job_id FROM wanted w""")
def j9_duplicate_detection(spark, sf):
    wanted = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("concat('Clip ', CAST(n_nationkey * 40 AS STRING), '.srt') AS file", "concat('6TWN', lpad(CAST(n_nationkey AS STRING), 4, '0')) AS media_id")
    return J.duplicates_of(jobs(spark, sf), wanted)


@query(f"{_J} SELECT id, 'in_progress' AS status, coalesce(started_at, {NOW}) AS started_at FROM jobs WHERE status = 'paused'")
def l5_partial_update(spark, sf):
    return J.with_status(jobs(spark, sf).where("status = 'paused'"), "in_progress", _now()).select("id", "status", "started_at")


@query(f"{_J} SELECT status, count(*) AS n FROM jobs WHERE NOT (status IN ('cancelled', 'failed')) GROUP BY status")
def l6_bulk_delete(spark, sf):
    return jobs(spark, sf).where(~F.col("status").isin("cancelled", "failed")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{_J} SELECT id, CASE WHEN age >= 86400 THEN 'failed' ELSE 'pending' END AS status, retry_count + 1 AS defer_count,
CASE WHEN age < 86400 THEN CASE least(retry_count + 1, 4) WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END END AS wait_seconds
FROM (SELECT *, epoch({NOW}) - epoch(coalesce(retry_after, {NOW})) AS age FROM jobs WHERE status = 'pending')""")
def k3_deferrals(spark, sf):
    pending = jobs(spark, sf).where("status = 'pending'").select("id", F.col("retry_count").alias("defer_count"), F.col("retry_after").alias("first_deferred_at"))
    return J.deferrals(pending, _now())


@query(f"{_J} SELECT id, CAST(epoch({NOW}) - epoch(last_heartbeat) AS BIGINT) AS age_s, coalesce(epoch({NOW}) - epoch(last_heartbeat) <= 864000, false) AS fresh FROM jobs WHERE status = 'in_progress'")
def b56_heartbeat_age(spark, sf):
    age = J.heartbeat_age("last_heartbeat", _now())
    return jobs(spark, sf).where("status = 'in_progress'").select("id", age.alias("age_s"), F.coalesce(age <= 864000, F.lit(False)).alias("fresh"))


@query(f"""{_J} SELECT project_path, CAST(queued_at AS DATE) AS day, count(*) AS jobs, CASE WHEN bool_or(status = 'in_progress') THEN 'processing' WHEN bool_or(status = 'failed') THEN 'failed'
WHEN bool_or(status = 'investigating') THEN 'revision' WHEN bool_and(status = 'completed') THEN 'ready' ELSE 'incomplete' END AS project_status FROM jobs GROUP BY project_path, CAST(queued_at AS DATE)""")
def b72_project_status(spark, sf):
    is_ = lambda s: F.col("status") == s
    state = F.when(F.bool_or(is_("in_progress")), "processing").when(F.bool_or(is_("failed")), "failed").when(F.bool_or(is_("investigating")), "revision").when(F.bool_and(is_("completed")), "ready").otherwise("incomplete")
    return jobs(spark, sf).groupBy("project_path", F.to_date("queued_at").alias("day")).agg(F.count("*").alias("jobs"), state.alias("project_status"))


@query(f"""{_J} SELECT id, round(coalesce(word_count, 0) / CAST(150 AS DOUBLE), 2) AS est_minutes, coalesce(duration_minutes, round(word_count / CAST(150 AS DOUBLE), 2)) AS best_minutes,
CASE WHEN coalesce(duration_minutes, round(word_count / CAST(150 AS DOUBLE), 2)) > 0 AND coalesce(duration_minutes, round(word_count / CAST(150 AS DOUBLE), 2)) < 1.5 THEN 'short' ELSE 'full' END AS content_type,
coalesce(coalesce(duration_minutes, round(word_count / CAST(150 AS DOUBLE), 2)) >= 10, false) AS run_timestamp FROM jobs""")
def n18_best_duration(spark, sf):
    """The best duration known, what kind of content it makes, and whether the timestamp phase runs."""
    estimate = F.round(F.col("word_count") / 150.0, 2)
    best = F.coalesce("duration_minutes", estimate)
    kind = F.when((best > 0) & (best < 1.5), "short").otherwise("full")
    return jobs(spark, sf).select("id", F.coalesce(estimate, F.lit(0.0)).alias("est_minutes"), best.alias("best_minutes"), kind.alias("content_type"), F.coalesce(best >= 10, F.lit(False)).alias("run_timestamp"))


@query(f"""{_J} SELECT id, phase, CAST(floor(w * 1.33) AS BIGINT) AS tokens, CAST(floor(floor(w * 1.33) * mult) AS BIGINT) AS output_tokens,
round(floor(w * 1.33) / 1e6 * pin + floor(floor(w * 1.33) * mult) / 1e6 * pout, 6) AS cost
FROM (SELECT id, word_count AS w FROM jobs WHERE word_count IS NOT NULL) CROSS JOIN (VALUES ('analyst', CAST(0.3 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(3.0 AS DOUBLE)), ('formatter', 1.1, 3.0, 15.0), ('seo', 0.2, 1.0, 3.0)) p(phase, mult, pin, pout)""")
def b51_cost_estimate(spark, sf):
    """Every job by phase, with the price of the phase's model (1 and 3 a million where none is known)."""
    phases = spark.createDataFrame([("analyst", 0.3, "small"), ("formatter", 1.1, "large"), ("seo", 0.2, "unlisted")], "phase string, mult double, model string")
    prices = spark.createDataFrame([("small", 1.0, 3.0), ("large", 3.0, 15.0)], "model string, pin double, pout double")
    priced = phases.join(F.broadcast(prices), "model", "left").fillna({"pin": 1.0, "pout": 3.0})
    tokens = F.floor(F.col("word_count") * 1.33)
    out = F.floor(tokens * F.col("mult"))
    rows = jobs(spark, sf).where("word_count IS NOT NULL").crossJoin(F.broadcast(priced))
    return rows.select("id", "phase", tokens.alias("tokens"), out.alias("output_tokens"), F.round(tokens / 1e6 * F.col("pin") + out / 1e6 * F.col("pout"), 6).alias("cost"))


@query(f"{_J} SELECT id, day, round(sum(actual_cost) OVER (PARTITION BY day ORDER BY id ROWS UNBOUNDED PRECEDING), 2) AS spent, sum(actual_cost) OVER (PARTITION BY day ORDER BY id ROWS UNBOUNDED PRECEDING) >= 500000 AS stopped FROM (SELECT *, CAST(queued_at AS DATE) AS day FROM jobs)")
def n31_cost_cap(spark, sf):
    """What a day's jobs have cost so far, and whether that stops it; a day of any size runs over ranges of ids."""
    rows = jobs(spark, sf).select("id", F.to_date("queued_at").alias("day"), F.col("actual_cost").cast("decimal(18,2)").alias("cost"))
    spent = F.col("spent").cast("double")
    return running(rows, ["day"], ["id"], {"spent": F.col("cost")}).select("id", "day", F.round(spent, 2).alias("spent"), (spent >= 500000).alias("stopped"))


@query(f"""{_J}, ranked AS (SELECT id, project_path, queued_at, row_number() OVER (PARTITION BY project_path ORDER BY queued_at DESC, id DESC) AS nth FROM jobs)
SELECT project_path, nth, id FROM ranked WHERE nth <= 5""")
def f18_last_versions(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("project_path").orderBy(F.desc("queued_at"), F.desc("id")))
    return jobs(spark, sf).withColumn("nth", nth).where("nth <= 5").select("project_path", "nth", "id")


@query(f"{_J} SELECT arg_max(id, id) AS id, (arg_max(status, id) = 'in_progress') AS running FROM jobs WHERE project_path = 'project_5'")
def f14_latest_run(spark, sf):
    latest = F.max_by("status", "id")
    return jobs(spark, sf).where("project_path = 'project_5'").agg(F.max("id").alias("id"), (latest == "in_progress").alias("running"))


@query(f"{_J} SELECT project_path, coalesce(max(TRY_CAST(regexp_extract(transcript_file, '(\\d+)', 1) AS BIGINT)), 0) + 1 AS next_version FROM jobs GROUP BY project_path")
def e24_next_version(spark, sf):
    number = F.regexp_extract("transcript_file", r"(\d+)", 1).try_cast("long")
    return jobs(spark, sf).groupBy("project_path").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_version"))


@query(f"{_J} SELECT DISTINCT media_id FROM jobs WHERE media_id IS NOT NULL")
def e25_distinct(spark, sf):
    return jobs(spark, sf).where("media_id IS NOT NULL").select("media_id").distinct()


@query(f"{_J} SELECT id, 'v' || CAST(priority AS STRING) || '.' || CAST(retry_count AS STRING) AS version_tag, coalesce(actual_cost, 0) AS actual_cost, concat('OUTPUT/', project_path) AS output_path, 'pending' AS status FROM jobs")
def n1_create_jobs(spark, sf):
    """Rows as a new job would be stored, with defaults, a tag and an output path."""
    rows = jobs(spark, sf)
    return rows.select("id", F.concat(F.lit("v"), F.col("priority").cast("string"), F.lit("."), F.col("retry_count").cast("string")).alias("version_tag"), F.coalesce("actual_cost", F.lit(0.0)).alias("actual_cost"), F.concat(F.lit("OUTPUT/"), F.col("project_path")).alias("output_path"), F.lit("pending").alias("status"))
