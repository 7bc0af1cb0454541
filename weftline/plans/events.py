"""Event-log queries (A2, B60-B68, E2-E22, F-, H- and report queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import events as E
from weftline.operators import phrases as P
from weftline.plans.registry import query
from weftline.sources.tables import cte, raw, role

_S = cte("stats")
_F = cte("files")
SINCE = "2024-01-10 00:00:00"
_since = lambda: F.expr(f"TIMESTAMP_NTZ '{SINCE}'")


def stats(spark, sf):
    return role(spark, sf, "stats")


@query(f"{_S} SELECT id, event_type FROM stats WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '2024-01-11 00:00:00'")
def a2_event_scan(spark, sf):
    return stats(spark, sf).where((F.col("ts") >= _since()) & (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-11 00:00:00'"))).select("id", "event_type")


@query(f"""{_S}, f AS (SELECT phase, count(*) AS failures FROM stats WHERE ts >= TIMESTAMP '{SINCE}' AND event_type = 'phase_failed' AND phase IS NOT NULL GROUP BY phase),
c AS (SELECT phase, coalesce(model, 'unknown') AS model, count(*) AS completions, sum(coalesce(cost, 0)) AS cost, sum(coalesce(tokens, 0)) AS tokens FROM stats WHERE ts >= TIMESTAMP '{SINCE}' AND event_type = 'phase_completed' AND phase IS NOT NULL GROUP BY 1, 2)
SELECT c.phase, model, completions, coalesce(failures, 0) AS failures, round(cost, 4) AS total_cost, CAST(tokens AS BIGINT) AS total_tokens, round(completions / (completions + coalesce(failures, 0)) * 100, 1) AS success_rate FROM c LEFT JOIN f ON c.phase = f.phase""")
def e2_phase_stats(spark, sf):
    return E.phase_stats(stats(spark, sf), _since())


@query(f"""{_S}, f AS (SELECT phase, count(*) AS f FROM stats WHERE ts >= TIMESTAMP '{SINCE}' AND event_type = 'phase_failed' AND phase IS NOT NULL GROUP BY phase),
c AS (SELECT phase, count(*) AS c, sum(coalesce(cost, 0)) AS cost FROM stats WHERE ts >= TIMESTAMP '{SINCE}' AND event_type = 'phase_completed' AND phase IS NOT NULL GROUP BY 1)
SELECT coalesce(c.phase, f.phase) AS phase, coalesce(c, 0) AS completions, coalesce(f, 0) AS failures, round(coalesce(cost, 0), 4) AS total_cost, round(coalesce(c, 0) / (coalesce(c, 0) + coalesce(f, 0)) * 100, 1) AS success_rate FROM c FULL JOIN f ON c.phase = f.phase""")
def e2b_phase_totals(spark, sf):
    return E.phase_totals(stats(spark, sf), _since())


@query(f"""{_S}, m AS (SELECT model, count(*) AS requests, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, sum(coalesce(cost, 0)) AS cost FROM stats WHERE event_type = 'phase_completed' AND model IS NOT NULL GROUP BY model)
SELECT model, requests, tokens, round(cost, 4) AS cost, round(cost / (SELECT sum(cost) FROM m) * 100, 1) AS share FROM m ORDER BY cost DESC, model LIMIT 3""")
def e3_model_stats(spark, sf):
    return E.model_stats(stats(spark, sf), 3)


@query(f"{_F} SELECT status, file_type, count(*) AS n FROM files GROUP BY ALL")
def e4_group_counts(spark, sf):
    return role(spark, sf, "files").groupBy("status", "file_type").agg(F.count("*").alias("n"))


@query(f"{_F} SELECT media_id, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'queued') AS n_queued, count(*) FILTER (status = 'ignored') AS n_ignored FROM files WHERE file_type = 'image' GROUP BY media_id")
def e5_screengrab_counts(spark, sf):
    n = lambda s: F.count_if(F.col("status") == s)
    return role(spark, sf, "files").where("file_type = 'image'").groupBy("media_id").agg(n("new").alias("n_new"), n("queued").alias("n_queued"), n("ignored").alias("n_ignored"))


_V = f"{_S}, v AS (SELECT phase, coalesce(nullif(concat('rule_', CAST(id % 12 AS STRING)), 'rule_0'), '(unknown_rule)') AS rule, CASE id % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'flagged' WHEN 2 THEN 'reverted' ELSE 'other' END AS action, model FROM stats WHERE event_type = 'rule_violation')"


def violations(spark, sf) -> DataFrame:
    rows = stats(spark, sf).where("event_type = 'rule_violation'")
    rule = F.coalesce(F.nullif(F.concat(F.lit("rule_"), (F.col("id") % 12).cast("string")), F.lit("rule_0")), F.lit("(unknown_rule)"))
    raw_action = F.when(F.col("id") % 5 == 0, "applied").when(F.col("id") % 5 == 1, "flagged").when(F.col("id") % 5 == 2, "reverted").otherwise("other")
    return rows.select("id", "phase", rule.alias("rule"), E.action_of(raw_action).alias("action"), "model")


@query(f"""{_V}, n AS (SELECT rule, phase, coalesce(model, '?') AS model, count(*) AS n FROM v GROUP BY ALL)
SELECT rule, phase, count(*) AS total, count(*) FILTER (action = 'applied') AS applied, count(*) FILTER (action = 'flagged') AS flagged, count(*) FILTER (action = 'reverted') AS reverted, count(*) FILTER (action = 'other') AS unknown,
(SELECT string_agg(n.model || '=' || CAST(n.n AS STRING), ',' ORDER BY n.n DESC, nullif(n.model, '?') NULLS FIRST) FROM n WHERE n.rule = v.rule AND n.phase IS NOT DISTINCT FROM v.phase) AS models FROM v GROUP BY rule, phase""")
def e7_violation_summary(spark, sf):
    rows = violations(spark, sf)
    n = lambda a: F.count_if(F.col("action") == a)
    totals = rows.groupBy("rule", "phase").agg(F.count("*").alias("total"), n("applied").alias("applied"), n("flagged").alias("flagged"), n("reverted").alias("reverted"), n("unknown").alias("unknown"))
    models = E.counted(rows, ["rule", "phase"], "model", "models").select(F.col("rule").alias("r"), F.col("phase").alias("p"), "models")
    return totals.join(models, (F.col("rule") == F.col("r")) & F.col("phase").eqNullSafe(F.col("p"))).drop("r", "p")


_C = f"{_S}, c AS (SELECT id, job_id, CASE WHEN id % 4 = 0 THEN NULL ELSE concat('w', CAST(id % 6 AS STRING)) END AS old, concat('w', CAST(job_id % 6 AS STRING)) AS new FROM stats WHERE event_type = 'correction')"


def corrections(spark, sf) -> DataFrame:
    rows = stats(spark, sf).where("event_type = 'correction'")
    return rows.select("id", "job_id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("w"), (F.col("id") % 6).cast("string"))).alias("old"), F.concat(F.lit("w"), (F.col("job_id") % 6).cast("string")).alias("new"))


@query(f"{_C} SELECT old, new, count(*) AS n, array_to_string((list(id ORDER BY id))[1:3], ',') AS examples FROM c WHERE old IS NOT NULL AND old <> new GROUP BY old, new")
def e8_correction_clusters(spark, sf):
    """Count and first three examples: the rank within a group keeps three rows before they are listed."""
    rows = corrections(spark, sf).where("old IS NOT NULL AND old <> new")
    w = Window.partitionBy("old", "new")
    ranked = rows.withColumn("nth", F.row_number().over(w.orderBy("id"))).withColumn("n", F.count("*").over(w)).where("nth <= 3")
    return ranked.groupBy("old", "new").agg(F.max("n").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))


@query(f"{_C} SELECT new AS field, count(*) AS n FROM c WHERE old IS NULL GROUP BY new")
def e9_null_buckets(spark, sf):
    return corrections(spark, sf).where("old IS NULL").groupBy(F.col("new").alias("field")).agg(F.count("*").alias("n"))


@query(f"{_C} SELECT old, new, count(*) AS n, CASE WHEN lower(old) = lower(new) THEN 'case_only' ELSE 'phrase' END AS kind FROM c WHERE old IS NOT NULL AND old <> '' AND new <> '' AND old <> new GROUP BY old, new HAVING count(*) >= 3")
def i23_proposals(spark, sf):
    rows = corrections(spark, sf).where("old IS NOT NULL AND old <> '' AND new <> '' AND old <> new").groupBy("old", "new").agg(F.count("*").alias("n"))
    return rows.where("n >= 3").select("old", "new", "n", F.when(F.lower("old") == F.lower("new"), "case_only").otherwise("phrase").alias("kind"))


@query("SELECT d.lang AS phase, d.source AS category, count(*) FILTER (quality = 0 AND toxic = 1) AS both, count(*) FILTER (quality = 0 AND toxic = 0) AS first_only, count(*) FILTER (quality = 1 AND toxic = 1) AS second_only, count(*) AS total FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY GROUPING SETS ((), (d.lang), (d.source))")
def e10_agreement(spark, sf):
    """Totals, by phase and by category, in one pass of grouping sets."""
    rows = raw(spark, sf, "labels").join(raw(spark, sf, "documents").select("doc_id", F.col("lang").alias("phase"), F.col("source").alias("category")), "doc_id")
    both = lambda quality, toxic, name: F.count_if((F.col("quality") == quality) & (F.col("toxic") == toxic)).alias(name)
    return rows.groupingSets([[], ["phase"], ["category"]], "phase", "category").agg(both(0, 1, "both"), both(0, 0, "first_only"), both(1, 1, "second_only"), F.count("*").alias("total"))


@query("SELECT max(n) AS busiest, round(max(n) / 300.0, 6) AS max_rate, count(*) AS buckets FROM (SELECT time_bucket(INTERVAL '5 minutes', ts) AS b, count(*) AS n FROM events GROUP BY 1)")
def e11_max_rate(spark, sf):
    return E.rates(raw(spark, sf, "events")).agg(F.max("requests").alias("busiest"), F.max("rate").alias("max_rate"), F.count("*").alias("buckets"))


@query("SELECT round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_ratio, max(value) AS peak, count(*) FILTER (hour(ts) >= 11 AND hour(ts) < 15) AS in_pause, round(avg(value), 6) AS avg_value FROM events")
def e12_ratio_peak(spark, sf):
    """E12, E16 and K7's pause window."""
    paused = F.hour("ts").between(11, 14)
    return raw(spark, sf, "events").agg(F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("error_ratio"), F.max("value").alias("peak"), F.count_if(paused).alias("in_pause"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, v[least(CAST(floor(len(v) * 50 / 100) AS BIGINT), len(v) - 1) + 1] AS p50, v[least(CAST(floor(len(v) * 95 / 100) AS BIGINT), len(v) - 1) + 1] AS p95, v[least(CAST(floor(len(v) * 99 / 100) AS BIGINT), len(v) - 1) + 1] AS p99,
len(v) AS n, v[1] AS least, v[len(v)] AS most, round(list_sum(v) / len(v), 6) AS mean FROM s""")
def e13_percentiles(spark, sf):
    return E.percentiles(raw(spark, sf, "events").where("value IS NOT NULL"), ["event_type"], "value")


@query(f"{_F} SELECT count(*) FILTER (prefix = '2LAK' AND file_type = 'mp4') AS actual, round(abs(count(*) FILTER (prefix = '2LAK' AND file_type = 'mp4') - 3000) / 3000.0 * 100, 4) AS diff_pct, abs(count(*) FILTER (prefix = '2LAK' AND file_type = 'mp4') - 3000) / 3000.0 * 100 <= 5 AS within FROM files")
def e14_coverage_diff(spark, sf):
    n = F.count_if((F.col("prefix") == "2LAK") & (F.col("file_type") == "mp4"))
    diff = F.abs(n - 3000) / 3000 * 100
    return role(spark, sf, "files").agg(n.alias("actual"), F.round(diff, 4).alias("diff_pct"), (diff <= 5).alias("within"))


@query("SELECT user_id AS endpoint, count(*) AS checks, count(*) FILTER (event_type = 'error') AS failures, arg_max(event_type, (ts, event_id)) AS last_status FROM events GROUP BY user_id")
def e15_endpoint_regressions(spark, sf):
    return raw(spark, sf, "events").groupBy(F.col("user_id").alias("endpoint")).agg(F.count("*").alias("checks"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"))


@query("SELECT count(*) AS checks, count(*) FILTER (delta <> 0) AS violations, count(*) >= 1 AND count(*) FILTER (delta <> 0) = 0 AS passed FROM (SELECT event_id % 2 AS delta FROM events WHERE event_type = 'view' UNION ALL SELECT 0 FROM events WHERE event_type = 'click')")
def e17_parity_checks(spark, sf):
    e = raw(spark, sf, "events")
    rows = e.where("event_type = 'view'").select((F.col("event_id") % 2).alias("delta")).unionByName(e.where("event_type = 'click'").select(F.lit(0).cast("long").alias("delta")))
    bad = F.count_if(F.col("delta") != 0)
    return rows.agg(F.count("*").alias("checks"), bad.alias("violations"), ((F.count("*") >= 1) & (bad == 0)).alias("passed"))


@query("SELECT phase, max(n) AS agreeing, count(*) AS distinct_values, arg_max(v, (n, v)) AS most_common FROM (SELECT user_id % 5 AS phase, value AS v, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY phase")
def e19_convergence(spark, sf):
    n = raw(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("phase"), F.col("value").alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy("phase").agg(F.max("n").alias("agreeing"), F.count("*").alias("distinct_values"), F.max_by("v", F.struct("n", "v")).alias("most_common"))


@query("SELECT user_id % 12 AS rule, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS pre, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS post FROM events WHERE event_type = 'signup' GROUP BY 1")
def e20_pre_post(spark, sf):
    stage = F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "pre").otherwise("post")
    rows = raw(spark, sf, "events").where("event_type = 'signup'").select((F.col("user_id") % 12).alias("rule"), stage.alias("stage"))
    return rows.groupBy("rule").pivot("stage", ["pre", "post"]).agg(F.count(F.lit(1))).fillna(0)


@query(f"{_S} SELECT job_id, count(*) AS calls, round(sum(coalesce(cost, 0)), 6) AS total, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM stats WHERE event_type = 'phase_completed' GROUP BY job_id")
def e21_cost_tracker(spark, sf):
    """E21 and N30."""
    return stats(spark, sf).where("event_type = 'phase_completed'").groupBy("job_id").agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("total"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


@query(f"{_F} SELECT count(*) AS files, count(*) FILTER (NOT superseded) AS current, count(*) FILTER (file_type IN ('srt', 'scc')) AS sidecars FROM files")
def e22_status_counts(spark, sf):
    return role(spark, sf, "files").agg(F.count("*").alias("files"), F.count_if(~F.col("superseded")).alias("current"), F.count_if(F.col("file_type").isin("srt", "scc")).alias("sidecars"))


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def e26_event_counters(spark, sf):
    return raw(spark, sf, "events").groupBy(F.col("event_type").alias("event")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events WHERE event_type = 'purchase'")
def b60_json_extract(spark, sf):
    return raw(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, '(unknown_rule)' AS rule, coalesce(nullif(event_type, 'view'), '(unknown_type)') AS kind FROM events")
def b61_payload_flatten(spark, sf):
    """Typed payloads, with defaults for what is missing or blank."""
    rows = raw(spark, sf, "events").withColumn("p", F.from_json("props", "k int, extra struct<rule_id:string>"))
    return rows.select("event_id", "p.k", F.coalesce(F.nullif("p.extra.rule_id", F.lit("")), F.lit("(unknown_rule)")).alias("rule"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("(unknown_type)")).alias("kind"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN CAST(event_id AS STRING) WHEN 2 THEN NULL WHEN 3 THEN 'true' ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS STRING) END AS value FROM events")
def b65_typed_config(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("string", "int", "float", "bool", "json"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = raw(spark, sf, "events").select("event_id", "props", kind.alias("kind"))
    text = F.when(F.col("kind") == "string", "text").when(F.col("kind") == "int", F.col("event_id").cast("string")).when(F.col("kind") == "float", "not a number").when(F.col("kind") == "bool", "true").otherwise(F.col("props"))
    typed = F.when(F.col("kind") == "int", text.try_cast("long").cast("string")).when(F.col("kind") == "float", text.try_cast("double").cast("string")).when(F.col("kind") == "bool", text.try_cast("boolean").cast("string")).when(F.col("kind") == "json", F.get_json_object(text, "$.k")).otherwise(text)
    return rows.select("event_id", typed.alias("value"))


_RUN = "SELECT o_custkey AS run, o_orderkey AS ord, CAST(substring(o_orderpriority, 1, 1) AS INT) AS phase, o_totalprice AS cost FROM orders"


@query(f"WITH r AS ({_RUN}), b AS (SELECT phase, sum(cost) AS base FROM r WHERE run = 899 GROUP BY phase), t AS (SELECT run, phase, sum(cost) AS cost FROM r WHERE run <> 899 GROUP BY ALL) SELECT run, t.phase, round((cost - base) / base * 100, 4) AS delta_pct FROM t JOIN b ON t.phase = b.phase")
def d13_run_vs_baseline(spark, sf):
    """Every run's phases against the baseline run's."""
    r = raw(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.substring("o_orderpriority", 1, 1).cast("int").alias("phase"), F.col("o_totalprice").alias("cost"))
    base = r.where("run = 899").groupBy("phase").agg(F.sum("cost").alias("base"))
    rows = r.where("run <> 899").groupBy("run", "phase").agg(F.sum("cost").alias("cost")).join(F.broadcast(base), "phase")  # one row a phase
    return rows.select("run", "phase", F.round(F.try_divide(F.col("cost") - F.col("base"), F.col("base")) * 100, 4).alias("delta_pct"))


@query("SELECT s_suppkey AS rule FROM supplier WHERE s_suppkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 0)")
def h1_zero_hit_rules(spark, sf):
    seen = raw(spark, sf, "events").where("event_type = 'signup' AND user_id % 3 = 0").select(F.col("user_id").alias("rule")).distinct()
    return raw(spark, sf, "supplier").select(F.col("s_suppkey").alias("rule")).join(seen, "rule", "left_anti")


@query("SELECT 'nation' AS family, n_name AS rule FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'brand', p_brand FROM (SELECT DISTINCT p_brand FROM part)")
def h2_candidate_rules(spark, sf):
    of = lambda df, family, c: df.select(F.lit(family).alias("family"), F.col(c).alias("rule"))
    brands = raw(spark, sf, "part").select("p_brand").distinct()
    return of(raw(spark, sf, "nation"), "nation", "n_name").unionByName(of(raw(spark, sf, "region"), "region", "r_name")).unionByName(of(brands, "brand", "p_brand"))


@query("SELECT event_type AS name, min(event_id) AS first_seen FROM events GROUP BY 1")
def h3_first_seen_union(spark, sf):
    return raw(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("first_seen"))


@query("""WITH j AS (SELECT max(n) / 300.0 AS rate FROM (SELECT time_bucket(INTERVAL '5 minutes', ts) AS b, count(*) AS n FROM events GROUP BY 1)), e AS (SELECT count(*) FILTER (event_type = 'error') / count(*) AS ratio FROM events)
SELECT round(rate, 6) AS max_rate, round(ratio, 6) AS error_ratio, rate <= 1 AS rate_ok, ratio < 0.01 AS errors_ok, CASE WHEN rate <= 1 AND ratio < 0.01 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM j, e""")
def j10_go_no_go(spark, sf):
    e = raw(spark, sf, "events")
    rate = e.groupBy(F.window("ts", "5 minutes")).agg((F.count("*") / 300).alias("r")).agg(F.max("r").alias("rate"))
    ratio = e.agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("ratio"))
    ok = (F.col("rate") <= 1, F.col("ratio") < 0.01)
    return rate.crossJoin(ratio).select(F.round("rate", 6).alias("max_rate"), F.round("ratio", 6).alias("error_ratio"), ok[0].alias("rate_ok"), ok[1].alias("errors_ok"), F.when(ok[0] & ok[1], "GO").otherwise("NO-GO").alias("verdict"))


@query("""WITH d AS (SELECT doc_id, doc_id // 3 AS job, lang, string_split(lower(text), chr(10)) AS ls, doc_id % 4 = 0 AS passed FROM documents),
f AS (SELECT doc_id, job, passed, ls, CASE WHEN doc_id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE ls[1:3] END AS flags FROM d), r AS (SELECT *, CASE WHEN len(flags) = 0 THEN [''] ELSE flags END AS fs, contains(ls[-1], 'sch') AS bad FROM f WHERE NOT passed OR len(flags) > 0),
n AS (SELECT job, count(*) FILTER (NOT (bad OR contains(x, 'ough') OR contains(x, 'ción'))) AS fixable, count(*) FILTER (bad OR contains(x, 'ough') OR contains(x, 'ción')) AS nonfixable FROM (SELECT job, bad, unnest(fs) AS x FROM r) GROUP BY job)
SELECT DISTINCT d.job AS id, coalesce(fixable, 0) AS fixable, coalesce(nonfixable, 0) AS nonfixable, coalesce(nonfixable, 0) = 0 AS escalate FROM d LEFT JOIN n ON n.job = d.job""")
def b70_qa_failures(spark, sf):
    """Jobs of three phases, whose flags are a document's first lines and whose output is its last; by a table of patterns."""
    lines = F.split("text", "\n")
    flags = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, 1, 3))
    results = raw(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).alias("id"), F.col("doc_id").cast("string").alias("phase"), F.when(F.col("doc_id") % 4 == 0, "pass").otherwise("fail").alias("status"), flags.alias("flags"), F.element_at(lines, -1).alias("output"))
    return P.qa_outcome(results, spark.createDataFrame([("flag", "ough"), ("flag", "ción"), ("output", "sch")], "kind string, part string"))


@query("""WITH f AS (SELECT user_id AS job, CAST(list(value > 150 ORDER BY ts, event_id) AS VARCHAR) AS seen, bool_or(event_type = 'error' AND value > 150) AS fixed FROM events GROUP BY 1)
SELECT job, NOT fixed AS escalate FROM f""")
def b70_qa_escalation(spark, sf):
    """B70 over the event log: any flag that is not fixable stops the escalation of its job."""
    fixed = F.bool_or((F.col("event_type") == "error") & (F.col("value") > 150))
    return raw(spark, sf, "events").groupBy(F.col("user_id").alias("job")).agg((~fixed).alias("escalate"))


@query("SELECT event_id, array_to_string(list_filter(['analyst', 'formatter', 'seo', 'validator'], lambda x, i: i >= event_id % 4 + 1), '>') AS phases FROM events")
def b71_escalation_phases(spark, sf):
    """The earliest flagged phase and all after it."""
    order = F.array(*map(F.lit, ("analyst", "formatter", "seo", "validator")))
    flagged = F.element_at(order, (F.col("event_id") % 4 + 1).cast("int"))
    rest = F.slice(order, F.array_position(order, flagged).cast("int"), F.size(order))
    return raw(spark, sf, "events").select("event_id", F.array_join(rest, ">").alias("phases"))


@query("SELECT user_id AS consumer, count(*) AS calls, count(*) FILTER (event_type = 'error') AS denied, max(ts) AS last_call FROM events GROUP BY 1")
def n36_audit_analytics(spark, sf):
    return raw(spark, sf, "events").groupBy(F.col("user_id").alias("consumer")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("denied"), F.max("ts").alias("last_call"))


@query("SELECT event_id, list_contains(string_split(CASE event_id % 3 WHEN 0 THEN 'read,write' WHEN 1 THEN 'read' ELSE 'admin' END, ','), 'write') AS allowed FROM events")
def n35_scope_check(spark, sf):
    scopes = F.transform(F.split(F.when(F.col("event_id") % 3 == 0, "read, write").when(F.col("event_id") % 3 == 1, "read").otherwise("admin"), ","), lambda s: F.trim(s))
    return raw(spark, sf, "events").select("event_id", F.array_contains(scopes, "write").alias("allowed"))


@query("SELECT user_id AS id, max(CASE WHEN event_type = 'click' THEN k END) AS click, max(CASE WHEN event_type = 'view' THEN k END) AS view, coalesce(max(CASE WHEN event_type = 'signup' THEN k END), 0) AS signup FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) GROUP BY 1")
def n5_config_pivot(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int").alias("k")
    return raw(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type", k).groupBy("id").pivot("event_type", ["click", "view", "signup"]).agg(F.max("k")).fillna({"signup": 0})


@query("SELECT event_id, strftime(CASE WHEN event_id % 3 = 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS merged_ts FROM events")
def n6_normalised_timestamps(spark, sf):
    """T or space, date alone, fractions: all become seconds in UTC."""
    form = lambda f: F.date_format("ts", f)
    text = F.when(F.col("event_id") % 3 == 0, form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(F.col("event_id") % 3 == 1, form("yyyy-MM-dd HH:mm:ss")).otherwise(form("yyyy-MM-dd"))
    whole = F.date_trunc("second", F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" "))))
    return raw(spark, sf, "events").select("event_id", F.date_format(whole, "yyyy-MM-dd HH:mm:ss").alias("merged_ts"))
