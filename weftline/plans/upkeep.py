"""Run states, uploads, touches and other upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import time as TM
from weftline.operators import captions as C
from weftline.operators import jobs as J
from weftline.operators import media as M
from weftline.operators.jobs import rank_one
from weftline.plans.registry import query
from weftline.plans.reports import pick
from weftline.plans.texts import captions
from weftline.sources.tables import cte, raw, role

_J, _F, _S = cte("jobs"), cte("files"), cte("stats")


@query("""WITH u AS (SELECT p_partkey AS id, ['SRT', 'exe', 'csv', 'Txt', 'tsv.bak'][p_size % 5 + 1] AS ext, CASE p_partkey % 3 WHEN 1 THEN 'text/csv' WHEN 2 THEN 'image/png' END AS kind, CASE p_size % 4 WHEN 0 THEN '/out/' || p_brand WHEN 1 THEN '/out/../' || p_brand WHEN 2 THEN '/' || p_brand ELSE '/out/' || p_name || '..x' END AS path FROM part)
SELECT id, CASE WHEN NOT (lower(string_split(ext, '.')[-1]) IN ('srt', 'txt', 'csv', 'tsv') OR coalesce(kind, '') = 'text/csv') THEN 'type' WHEN NOT starts_with(path, '/out/') OR list_contains(string_split(path, '/'), '..') THEN 'path' END AS error FROM u""")
def a22_uploads(spark, sf):
    """Uploads, named after the parts, of a known type into a folder below the root."""
    name = F.concat("p_name", F.lit("."), F.element_at(F.array(*map(F.lit, ("SRT", "exe", "csv", "Txt", "tsv.bak"))), F.col("p_size") % 5 + 1))
    kind = F.when(F.col("p_partkey") % 3 == 1, "text/csv").when(F.col("p_partkey") % 3 == 2, "image/png")
    size = F.col("p_size") % 4
    path = F.when(size == 0, F.concat(F.lit("/out/"), "p_brand")).when(size == 1, F.concat(F.lit("/out/../"), "p_brand")).when(size == 2, F.concat(F.lit("/"), "p_brand")).otherwise(F.concat(F.lit("/out/"), "p_name", F.lit("..x")))
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), J.upload_error(name, kind, path, "/out").alias("error"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '2LAK' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') WHEN 1 THEN '6TWN' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || '_REV20251202' WHEN 2 THEN 'a+b_' || CAST(p_partkey AS STRING) ELSE NULL END AS media_id FROM part")
def b3_media_id_of_url(spark, sf):
    """Encoded names, doubled extensions and a plus sign in a URL."""
    n, k = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("2lak"), n, F.lit("%20(2).srt"))).when(k == 1, F.concat(F.lit("6TWN"), n, F.lit("_REV20251202.srt.srt"))).when(k == 2, F.concat(F.lit("a+b_"), F.col("p_partkey").cast("string"), F.lit(".txt.txt"))).otherwise("no%20id%20here.srt")
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.media_id_of_url(F.concat(F.lit("https://h/d%20e/"), name)).alias("media_id"))


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM s), k AS (SELECT * FROM l WHERE trim(line) <> '')
SELECT d.doc_id, count(k.n) AS captions, CAST(coalesce(sum(len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> ''))), 0) AS BIGINT) AS words, round(coalesce(max((n - 1) * 3000 + 2500), 0) / 60000.0, 2) AS minutes, coalesce(max((n - 1) * 3000 + 2500), 0) / 60000.0 > 15 AS is_long FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""")
def b46_file_metrics(spark, sf):
    """Captions, words and length of an SRT file, from its array."""
    end = F.coalesce(F.array_max(F.transform("captions", lambda c: c["end_ms"])), F.lit(0)) / 60000.0
    words = F.aggregate("captions", F.lit(0).cast("long"), lambda a, c: a + T.word_count(c["text"]))
    return captions(spark, sf).select("doc_id", F.size("captions").cast("long").alias("captions"), words.alias("words"), F.round(end, 2).alias("minutes"), (end > 15).alias("is_long"))


@query("""SELECT doc_id, CASE WHEN n < 180 THEN 'whole' WHEN doc_id % 2 = 0 THEN 'captions' ELSE 'paragraphs' END AS way FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '')) AS n FROM documents)""")
def f9_chunk_dispatch(spark, sf):
    """short texts stay whole; SRT files are cut by captions, others by paragraphs."""
    name = F.when(F.col("doc_id") % 2 == 0, "a.SRT").otherwise("a.txt")
    way = F.when(T.word_count(F.col("text")) < 1.5 * 120, "whole").when(T.extension(name) == "srt", "captions").otherwise("paragraphs")
    return raw(spark, sf, "documents").select("doc_id", way.alias("way"))


@query("WITH p AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'haiku' WHEN 1 THEN 'sonnet' ELSE 'opus' END AS family FROM part) SELECT p_brand, family, p_partkey AS newest FROM p QUALIFY row_number() OVER (PARTITION BY p_brand, family ORDER BY p_size DESC, p_partkey) = 1")
def f16_newest_of_family(spark, sf):
    """F16: the newest model of a family, the first listed of equal ones."""
    family = T.model_family(pick(("x/haiku-4", "Sonnet:beta", "OPUS"), "p_partkey"))
    rows = raw(spark, sf, "part").select("p_brand", family.alias("family"), "p_size", "p_partkey")
    return rank_one(rows, ["p_brand", "family"], F.desc("p_size"), F.asc("p_partkey")).select("p_brand", "family", F.col("p_partkey").alias("newest"))


@query("""WITH n AS (SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS spans, CASE o_orderkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.99 END AS ratio FROM orders) SELECT id, 'formatter output is missing ' || CAST(spans AS STRING) || CASE WHEN spans = 1 THEN ' span' ELSE ' spans' END || ' of source dialogue, first near 0:03' AS message FROM n WHERE spans > 0 AND ratio < 0.98""")
def i12_seam_gap(spark, sf):
    """Spans that are missing count only where words are missing too."""
    rows = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("spans"), pick((0.9, 0.99, None), "o_orderkey").alias("ratio"))
    message = F.concat(F.lit("formatter output is missing "), F.col("spans").cast("string"), F.when(F.col("spans") == 1, " span").otherwise(" spans"), F.lit(" of source dialogue, first near "), TM.display_time(F.lit(3000)))
    return rows.where((F.col("spans") > 0) & (F.col("ratio") < 0.98)).select("id", message.alias("message"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 9 + 1 AS n FROM orders), r AS (SELECT id, n, unnest(range(n)) AS i FROM c) SELECT id, CASE WHEN n > 6 THEN 1 ELSE 0 END AS over_cap, CAST(count(*) FILTER (i % 4 = 3) AS INT) AS long_titles, CAST(count(*) FILTER (i % 3 = 2) AS INT) AS off_boundary FROM r GROUP BY id, n""")
def i17_chapter_checks(spark, sf):
    """Too many chapters, titles of more than eight words, and starts that no boundary is near."""
    n = F.col("o_orderkey") % 9 + 1
    title = lambda i: F.when(i % 4 == 3, "one two three four five six seven eight nine").otherwise("Short title")
    rows = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i * 60_000 + F.when(i % 3 == 2, 5000).otherwise(0)).alias("start_ms"), title(i).alias("title"))).alias("c"))
    return rows.select("id", *(x.alias(k) for k, x in C.chapter_checks(F.col("c"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i * 60_000), 6, 8).items()))


@query("""WITH e AS (SELECT user_id AS source, event_id // 10 AS run, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'suppressed' ELSE 'running' END AS event FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id // 10 ORDER BY CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN 0 ELSE 1 END, event_id) = 1)
SELECT source, run, CASE WHEN event = 'running' AND lead(run) OVER (PARTITION BY source ORDER BY run) IS NOT NULL THEN 'interrupted' ELSE event END AS status FROM e""")
def k8_run_log(spark, sf):
    """K8: runs by their end, and those without one as interrupted where another follows."""
    end = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "suppressed").otherwise("running")
    rows = raw(spark, sf, "events").select(F.col("user_id").alias("source"), F.floor(F.col("event_id") / 10).alias("run"), "event_id", end.alias("event"))
    first = rank_one(rows, ["source", "run"], (F.col("event") == "running").cast("int"), F.asc("event_id"))
    return J.run_states(first)


@query(f"""{_F}, seen AS (SELECT id FROM files WHERE id % 2 = 0) SELECT f.id, CASE WHEN s.id IS NOT NULL AND directory_path IN ('/d1', '/d2', '/d3') THEN TIMESTAMP '2030-01-01' ELSE first_seen_at END AS last_seen FROM files f LEFT JOIN seen s ON s.id = f.id""")
def l2_scoped_touch(spark, sf):
    """L2: only files of the folders that were walked are touched."""
    f = role(spark, sf, "files")
    seen = f.where("id % 2 = 0").select("id", F.lit(True).alias("seen"))
    now = F.expr("TIMESTAMP_NTZ '2030-01-01 00:00:00'")
    touched = F.col("seen").isNotNull() & F.col("directory_path").isin("/d1", "/d2", "/d3")
    return f.join(seen, "id", "left").select("id", F.when(touched, now).otherwise(F.col("first_seen_at").cast("timestamp_ntz")).alias("last_seen"))


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.value, o.value) AS value, coalesce(o.created, n.created) AS created FROM (SELECT p_partkey AS k, p_name AS value, 1 AS created FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT p_partkey AS k, upper(p_name) AS value, 2 AS created FROM part WHERE p_partkey % 2 = 0) n ON o.k = n.k")
def l7_config_upsert(spark, sf):
    """Settings by key; a new value wins, the time of creation stays."""
    p = raw(spark, sf, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("value"), F.lit(1).alias("created"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("value"), F.lit(2).alias("created"))
    return M.upsert(old, new, "k", keep="created")


@query(f"{_J} SELECT id, coalesce(word_count, CASE WHEN id % 2 = 0 THEN id * 3 END) AS words, coalesce(duration_minutes, CASE WHEN id % 2 = 0 THEN id % 50 + 0.5 END) AS minutes, (word_count IS NULL OR duration_minutes IS NULL) AND id % 2 = 0 AS filled FROM jobs")
def l11_metric_backfill(spark, sf):
    """Metrics of the files that are still there, only where a job has none."""
    j = role(spark, sf, "jobs")
    found = j.where("id % 2 = 0").select("id", (F.col("id") * 3).alias("w"), (F.col("id") % 50 + 0.5).alias("m"), F.lit(True).alias("there"))
    gap = F.col("word_count").isNull() | F.col("duration_minutes").isNull()
    return j.join(found, "id", "left").select("id", F.coalesce("word_count", "w").alias("words"), F.coalesce("duration_minutes", "m").alias("minutes"), (gap & F.coalesce("there", F.lit(False))).alias("filled"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'no_match' WHEN p_partkey % 4 = 1 THEN 'duplicate' ELSE 'attached' END AS outcome, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 3 + 1 AS INT) END AS before, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 3 + 1 + CASE WHEN p_partkey % 4 = 1 THEN 0 ELSE 1 END AS INT) END AS after FROM part""")
def n11_attach_decisions(spark, sf):
    """No record, a name that is attached already, or one more attachment."""
    p = raw(spark, sf, "part").withColumn("media_id", F.concat(F.lit("m"), F.col("p_partkey").cast("string")))
    wanted = p.select(F.col("p_partkey").alias("id"), "media_id", F.when(F.col("p_partkey") % 4 == 1, "a0.jpg").otherwise("new.jpg").alias("filename"))
    records = p.where("p_partkey % 4 <> 0").select("media_id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 3), lambda i: F.concat(F.lit("a"), i.cast("string"), F.lit(".jpg"))).alias("attachments"))
    return J.attach_decisions(wanted, records)


@query("SELECT o_orderkey AS id, 'completed,pending,completed,pending' AS states, CAST(o_custkey + o_custkey * 3 AS DOUBLE) AS cost, 2 AS archived FROM orders")
def n16_phase_retry(spark, sf):
    """A phase and the validator run again, their runs archived, the cost summed anew."""
    names = ("analyst", "formatter", "seo", "validator")
    phases = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("completed").alias("status"), (F.col("o_custkey") * (i + 1)).cast("double").alias("cost")) for i, n in enumerate(names)))
    r = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), J.retried(phases, "formatter").alias("r"))
    archived = F.aggregate("r.phases", F.lit(0), lambda a, p: a + F.size(p["previous_runs"]))
    return r.select("id", F.array_join(F.transform("r.phases", lambda p: p["status"]), ",").alias("states"), "r.cost", archived.alias("archived"))


@query(f"{_J} SELECT id, id % 4 <> 0 AND coalesce(duration_minutes, 0) >= 1.5 AND (id % 5 = 0 OR coalesce(duration_minutes, 0) >= 10) AS runs FROM jobs")
def n19_timestamp_phase(spark, sf):
    """The phase needs captions and no short, and was asked for or is worth it."""
    minutes = F.coalesce("duration_minutes", F.lit(0.0))
    runs = (F.col("id") % 4 != 0) & (minutes >= 1.5) & ((F.col("id") % 5 == 0) | (minutes >= 10))
    return role(spark, sf, "jobs").select("id", runs.alias("runs"))


@query(f"{_S} SELECT job_id AS trace, round(coalesce(sum(CASE WHEN event_type = 'phase_completed' THEN cost END), 0), 6) AS cost, count(cost) AS observed FROM stats GROUP BY job_id")
def n30_trace_cost(spark, sf):
    """Known costs of a trace's observations, 0 without any."""
    cost = F.coalesce(F.sum(F.when(F.col("event_type") == "phase_completed", F.col("cost"))), F.lit(0.0))
    return role(spark, sf, "stats").groupBy(F.col("job_id").alias("trace")).agg(F.round(cost, 6).alias("cost"), F.count("cost").alias("observed"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'shared' WHEN event_id % 4 >= 2 AND event_id % 9 <> 0 THEN 'allowed' ELSE 'denied' END AS outcome FROM events")
def n35_access_outcomes(spark, sf):
    """Consumers with any mix of scopes, or none, and the common key."""
    bit = lambda n, name: F.when(F.floor(F.col("event_id") / n) % 2 == 1, name)
    scopes = F.when(F.col("event_id") % 9 != 0, F.concat_ws(" , ", bit(1, "read"), bit(2, "write"), bit(4, "write:all")))
    consumer = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("c"), F.col("user_id").cast("string")))
    return raw(spark, sf, "events").select("event_id", J.access("write", scopes, consumer).alias("outcome"))


@query(f"{_J} SELECT name FROM (SELECT DISTINCT concat('Clip ', CAST(p_partkey AS STRING), '.srt') AS name FROM part) WHERE name NOT IN (SELECT transcript_file FROM jobs WHERE status <> 'cancelled' AND id % 3 = 0)")
def n47_unqueued_files(spark, sf):
    """Files of a folder that no live job has."""
    folder = raw(spark, sf, "part").select(F.concat(F.lit("Clip "), F.col("p_partkey").cast("string"), F.lit(".srt")).alias("name")).distinct()
    queued = role(spark, sf, "jobs").where("status <> 'cancelled' AND id % 3 = 0").select(F.col("transcript_file").alias("name"))
    return folder.join(queued, "name", "left_anti")


@query("""SELECT event_id, '{"level":"' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '","message":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"job_id":' || CAST(user_id AS STRING) ELSE '' END || '}' AS line FROM events""")
def n49_log_lines(spark, sf):
    """A record as one line of JSON, without what is unknown."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.to_json(F.struct(level.alias("level"), F.col("event_type").alias("message"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("job_id")))
    return raw(spark, sf, "events").select("event_id", line.alias("line"))
