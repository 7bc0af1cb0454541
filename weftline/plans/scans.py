"""Files written and read whole (A3, A4, A5, A10, A11, A14, A17, A20), and lookups of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import captions as C
from weftline.operators import records as R
from weftline.plans.registry import query
from weftline.plans.texts import captions
from weftline.sources import files as FS
from weftline.sources.tables import cte, raw, role

_J, _F = cte("jobs"), cte("files")


@query("SELECT event_type AS event, count(*) AS rows, count(*) FILTER (user_id % 2 = 0) AS with_status, max(event_id) AS last FROM events WHERE event_id % 13 <> 5 GROUP BY event_type")
def a3_jsonl_scan(spark, sf):
    """A3: the event log as lines of JSON, with blank and broken lines between them, read back."""
    path = FS.scratch(spark, "log")
    e = raw(spark, sf, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("ts").cast("string").alias("ts"), F.col("event_id").alias("req_total"), F.when(F.col("user_id") % 2 == 0, 200).alias("status")))
    broken = F.when(F.col("event_id") % 13 == 5, F.concat(F.lit("{broken "), line)).otherwise(line)
    e.select(F.explode(F.array(broken, F.lit("   "))).alias("value")).write.text(path)
    return FS.jsonl(spark, path).groupBy("event").agg(F.count("*").alias("rows"), F.count("status").alias("with_status"), F.max("req_total").alias("last"))


_RUNS = "SELECT o_custkey AS run, substring(o_orderpriority, 1, 1) AS phase, o_orderkey AS k, o_orderkey % 5 <> 0 AS ok, concat('owner/m', CAST(o_orderkey % 3 AS STRING)) AS model, o_orderkey * 10 AS tokens, o_totalprice AS cost, o_orderkey % 90 / CAST(2 AS DOUBLE) AS wall FROM orders"


def _runs(spark, sf):
    """Runs with their phases in order: a run is a customer, a phase the priority of an order."""
    o = raw(spark, sf, "orders")
    phase = F.struct(
        F.col("o_orderkey").alias("k"), F.when(F.substring("o_orderpriority", 1, 1) == "1", "formatter").otherwise(F.substring("o_orderpriority", 1, 1)).alias("phase"), (F.col("o_orderkey") % 5 != 0).alias("ok"), F.concat(F.lit("owner/m"), (F.col("o_orderkey") % 3).cast("string")).alias("model"),
        (F.col("o_orderkey") * 10).alias("total_tokens"), F.col("o_totalprice").alias("cost"), (F.col("o_orderkey") % 90 / 2).alias("wall_s"), (F.col("o_orderkey") % 700).alias("words"),
    )
    phases = F.transform(F.array_sort(F.collect_list(phase)), lambda p: p.dropFields("k"))
    return o.groupBy(F.col("o_custkey").alias("run")).agg(phases.alias("phases"))


@query(f"WITH r AS ({_RUNS}) SELECT CAST(run AS STRING) AS label, count(*) AS phases, count(*) FILTER (ok) AS good, round(sum(cost), 2) AS cost, arg_max(model, k) AS last_model FROM r GROUP BY run")
def a4_run_metrics(spark, sf):
    """A4: nested metrics of every run as JSON, read back."""
    path = FS.scratch(spark, "metrics")
    runs = _runs(spark, sf).select(F.to_json(F.struct(F.col("run").cast("string").alias("label"), F.lit("t").alias("transcript"), "phases")).alias("value"))
    # one document a file would be a file a run; the reader takes a list of documents too
    runs.select(F.monotonically_increasing_id().alias("i"), F.spark_partition_id().alias("p"), "value").groupBy("p").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]), ","), F.lit("]")).alias("value")).select("value").write.text(path)
    m = FS.metrics(spark, path)
    return m.select("label", F.size("phases").cast("long").alias("phases"), F.size(F.filter("phases", lambda p: p["ok"])).cast("long").alias("good"), F.round(F.aggregate("phases", F.lit(0.0), lambda a, p: a + p["cost"]), 2).alias("cost"), F.element_at("phases", -1)["model"].alias("last_model"))


@query("SELECT n_name AS programme, 'limits' AS family, 'title' AS field, n_nationkey + 40 AS most FROM nation UNION ALL SELECT n_name, 'limits', 'keywords', NULL FROM nation UNION ALL SELECT n_name, 'forbidden', NULL, n_regionkey FROM nation")
def a5_rule_scan(spark, sf):
    """A5: a YAML file of rules for each programme, read where the files are."""
    path = FS.scratch(spark, "rules")
    text = F.concat(F.lit("meta: {version: 1}\nprogramme: x\nlimits:\n  - {field: title, most: "), (F.col("n_nationkey") + 40).cast("string"), F.lit("}\n  - field: keywords\nforbidden:\n  - {id: a, most: "), F.col("n_regionkey").cast("string"), F.lit("}\nempty: []\n"))
    raw(spark, sf, "nation").select(text.alias("value"), F.col("n_name").alias("programme")).repartition("programme").write.partitionBy("programme").text(path)
    rows = FS.rule_rows(spark, path)
    programme = F.url_decode(F.regexp_extract("path", "programme=([^/]+)/", 1))
    return rows.select(programme.alias("programme"), "family", F.get_json_object("item", "$.field").alias("field"), F.get_json_object("item", "$.most").cast("long").alias("most"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 'm' || CAST(doc_id % 7 AS STRING) END AS model, CASE WHEN doc_id % 4 <> 3 THEN CAST(doc_id % 3 AS STRING) END AS tier, CASE WHEN doc_id % 4 = 0 THEN '$0.' || CAST(doc_id AS STRING) END AS cost, CASE WHEN doc_id % 4 <> 3 THEN n_chars END AS tokens FROM documents")
def a10_provenance(spark, sf):
    """A10: model, tier, cost and tokens of every document's first line, where it is a comment that says so."""
    d = raw(spark, sf, "documents")
    head = F.concat(F.lit("<!-- model: m"), (F.col("doc_id") % 7).cast("string"), F.lit(" | tier: "), (F.col("doc_id") % 3).cast("string"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" | cost: $0."), F.col("doc_id").cast("string"))).otherwise(""), F.lit(" | tokens: "), F.col("n_chars").cast("string"), F.lit(" -->\n"))
    text = F.when(F.col("doc_id") % 4 != 3, F.concat(head, "text")).otherwise(F.concat(F.lit("Text\n"), head))
    return d.select("doc_id", text.alias("text")).select("doc_id", *(c.alias(k) for k, c in FS.provenance(F.col("text")).items()))


@query("SELECT 'p' || CAST(c_nationkey AS STRING) AS folder, 'Project ' || CAST(c_nationkey AS STRING) AS project, CASE WHEN count(*) % 2 = 0 THEN 'ok' ELSE 'open' END AS status, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS deliverables FROM customer GROUP BY c_nationkey")
def a11_manifests(spark, sf):
    """A manifest in the folder of every project, found and read."""
    path = FS.scratch(spark, "projects")
    outputs = F.map_from_arrays(F.array_sort(F.collect_set("c_mktsegment")), F.transform(F.array_sort(F.collect_set("c_mktsegment")), lambda s: F.concat(s, F.lit(".md"))))
    rows = raw(spark, sf, "customer").groupBy("c_nationkey").agg(outputs.alias("outputs"), F.count("*").alias("n"))
    rows = rows.select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("name"), F.to_json(F.struct(F.concat(F.lit("Project "), F.col("c_nationkey").cast("string")).alias("project"), F.when(F.col("n") % 2 == 0, "ok").otherwise("open").alias("status"), "outputs")).alias("value"))
    rows.repartition("name").write.partitionBy("name").text(path)
    found = FS.manifests(spark, path, "*.txt")
    return found.select(F.regexp_replace("folder", "^name=", "").alias("folder"), "project", "status", F.array_join("deliverables", ",").alias("deliverables"))


@query("SELECT lang, count(*) AS texts, sum(length(text)) AS chars FROM documents WHERE text IS NOT NULL GROUP BY lang")
def a14_side_files(spark, sf):
    """A side file for each language, of all its texts, fetched and decoded."""
    path = FS.scratch(spark, "side")
    body = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    raw(spark, sf, "documents").where("text IS NOT NULL").select(body.alias("value"), "lang").write.partitionBy("lang").text(path)
    got = FS.side_files(spark, path, r"\.txt$").where("ok").select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.regexp_replace("body_text", "\n$", "").alias("body"))
    parts = got.select("lang", F.explode(F.split("body", "\n")).alias("t"))
    return parts.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.length("t")).alias("chars"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), c AS (SELECT doc_id, line, n, (n - 1) * 3000 AS a FROM l WHERE trim(line) <> '')
SELECT doc_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', (a + 2500) // 3600000, (a + 2500) // 60000 % 60, (a + 2500) // 1000 % 60, (a + 2500) % 1000) || chr(10) || line || chr(10), chr(10) ORDER BY n)) AS vtt_md5 FROM c GROUP BY doc_id""")
def a17b_vtt_sink(spark, sf):
    """Captions of every document in the other format."""
    return captions(spark, sf).where(F.size("captions") > 0).select("doc_id", F.md5(C.emit_vtt(F.col("captions")).cast("binary")).alias("vtt_md5"))


@query("SELECT count(*) AS n, sum(o_orderkey) AS keys, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def a20_snapshot(spark, sf):
    """A compressed copy of the job store, read back."""
    path = FS.scratch(spark, "snapshot")
    FS.snapshot(raw(spark, sf, "orders"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size * 1024 WHEN 2 THEN -p_size ELSE -p_size * 1048576 END AS bytes FROM part")
def b7_signed_sizes(spark, sf):
    """Sizes of a listing whose negative ones are kept."""
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, "-").when(F.col("p_size") % 4 == 1, F.concat(n, F.lit("K"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("-"), n)).otherwise(F.concat(F.lit("-"), n, F.lit("M")))
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.size_bytes(text, negatives=True).alias("bytes"))


@query("""WITH b AS (SELECT p_partkey AS id, 'limits' AS family, 'title' AS k, CAST(p_size AS STRING) AS v FROM part UNION ALL SELECT p_partkey, 'limits', 'tags', '9' FROM part UNION ALL SELECT p_partkey, 'voice', 'we', 'no' FROM part WHERE p_partkey % 3 <> 0),
o AS (SELECT p_partkey AS id, 'limits' AS family, 'title' AS k, p_brand AS v FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'own', p_type, 'x' FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(b.id, o.id) AS id, coalesce(b.family, o.family) AS family, coalesce(b.k, o.k) AS k, coalesce(o.v, b.v) AS v FROM b FULL JOIN o ON o.id = b.id AND o.family = b.family AND o.k = b.k""")
def b66_deep_merge(spark, sf):
    """Rules of every part under those that override them."""
    base = F.map_from_arrays(F.array(F.lit("limits"), F.lit("voice")), F.array(F.create_map(F.lit("title"), F.col("p_size").cast("string"), F.lit("tags"), F.lit("9")), F.create_map(F.lit("we"), F.lit("no"))))
    base = F.map_filter(base, lambda k, v: (k == "limits") | (F.col("p_partkey") % 3 != 0))
    over = F.when(F.col("p_partkey") % 2 == 0, F.map_from_arrays(F.array(F.lit("limits"), F.lit("own")), F.array(F.create_map(F.lit("title"), F.col("p_brand")), F.create_map(F.col("p_type"), F.lit("x")))))
    rows = raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(R.deep_merged(base, over)).alias("family", "m"))
    return rows.select("id", "family", F.explode("m").alias("k", "v"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'completed' END AS seo, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS seo_runs, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS analyst_runs, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS reset FROM orders")
def f17_escalate_once(spark, sf):
    """failing phases are escalated once, however often that is asked for; earlier runs stay."""
    run = F.struct(F.lit("failed").alias("status"), F.col("o_totalprice").alias("cost"))
    phase = lambda name, status, escalated, runs: F.struct(F.lit(name).alias("name"), F.lit(status).alias("status"), F.col("o_totalprice").alias("cost"), escalated.alias("escalated"), runs.alias("previous_runs")).cast(R.PHASE)
    phases = F.array(phase("analyst", "failed", F.col("o_orderkey") % 2 != 0, F.array(run)), phase("seo", "completed", F.lit(None).cast("boolean"), F.lit(None).cast("array<struct<status:string,cost:double>>")))
    failing = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("analyst"), F.lit("seo"))).otherwise(F.array(F.lit("analyst")))
    twice = R.escalated_once(R.escalated_once(phases, failing), failing)
    rows = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), twice.alias("p"))
    runs = lambda i: F.size(F.coalesce(F.col("p")[i]["previous_runs"], F.array().cast("array<struct<status:string,cost:double>>")))
    return rows.select("id", F.col("p")[1]["status"].alias("seo"), runs(1).alias("seo_runs"), runs(0).alias("analyst_runs"), F.exists("p", lambda x: x["status"] == "pending").alias("reset"))


@query(f"""{_F}, s AS (SELECT id AS file_id, id, first_seen_at, CASE WHEN id % 7 = 0 THEN '  ' WHEN id % 11 = 0 THEN NULL ELSE 'Body ' || CAST(id AS STRING) END AS body FROM files WHERE file_type = 'srt' AND id % 3 <> 1),
c AS (SELECT DISTINCT media_id, id FROM files WHERE NOT superseded AND media_id IS NOT NULL AND file_type = 'srt'), one AS (SELECT file_id, arg_min(coalesce(body, ''), (first_seen_at, id)) AS body FROM s GROUP BY file_id),
b AS (SELECT c.media_id, c.id, one.file_id IS NULL AS bare, one.body FROM c LEFT JOIN one ON one.file_id = c.id QUALIFY row_number() OVER (PARTITION BY c.media_id ORDER BY one.file_id IS NULL, c.id) = 1), p AS (SELECT concat('2LAK', lpad(CAST(p_partkey AS STRING), 6, '0')) AS media_id FROM part)
SELECT p.media_id, CASE WHEN b.id IS NULL THEN 404 WHEN trim(coalesce(b.body, '')) = '' THEN 503 ELSE 200 END AS status, CASE WHEN trim(coalesce(b.body, '')) <> '' THEN b.body END AS body FROM p LEFT JOIN b ON b.media_id = p.media_id""")
def j5b_captions_outcome(spark, sf):
    """The captions of every media id: found, without a file, without a body."""
    f = role(spark, sf, "files").where("file_type = 'srt'")
    files = f.select("media_id", "id", F.when(F.col("superseded"), F.lit(0)).alias("superseded_by"))
    body = F.when(F.col("id") % 7 == 0, "  ").when(F.col("id") % 11 != 0, F.concat(F.lit("Body "), F.col("id").cast("string")))
    sides = f.where("id % 3 <> 1").select(F.col("id").alias("file_id"), F.col("first_seen_at").alias("fetched_at"), "id", body.alias("body_text"))
    asked = raw(spark, sf, "part").select(F.concat(F.lit("2LAK"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("media_id"))
    return R.captions_outcome(asked, files, sides).select("media_id", "status", "body")


@query(f"""WITH r AS ({_RUNS}), l AS (SELECT run, CASE phase WHEN '1' THEN 'formatter' ELSE phase END AS phase, max_by(struct_pack(ok := ok, model := model, tokens := tokens, cost := cost, wall := wall, k := k), k) AS p FROM r GROUP BY ALL)
SELECT run, phase, NOT p.ok AS failed, CASE WHEN p.ok THEN substring(p.model, 7) END AS model, CASE WHEN p.ok THEN p.tokens END AS total_tokens, CASE WHEN p.ok THEN p.cost END AS cost, p.wall AS wall_s, CASE WHEN p.ok THEN p.k % 700 END AS words, CASE WHEN p.ok AND phase = 'formatter' THEN run % 100 / CAST(100 AS DOUBLE) END AS coverage FROM l""")
def j12_phase_metrics(spark, sf):
    """Every run by phase, with all its numbers."""
    return R.phase_metrics(_runs(spark, sf).withColumn("coverage", F.col("run") % 100 / 100))


@query(f"{_J} SELECT id, CASE WHEN media_id IS NOT NULL THEN 'https://records.example/base/' || media_id || '+x' END AS url FROM jobs")
def n10_record_urls(spark, sf):
    """The address of every job's record."""
    return role(spark, sf, "jobs").select("id", R.record_url("https://records.example/base/", F.concat("media_id", F.lit(" x"))).alias("url"))


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS seo, o_orderkey % 3 <> 0 AS file FROM orders) SELECT id, array_to_string(list_filter([CASE WHEN NOT file THEN 'analyst' END, CASE WHEN NOT seo OR id % 5 = 0 THEN 'seo' END], lambda x: x IS NOT NULL), ',') AS missing, file AND seo AND id % 5 <> 0 AS complete FROM j""")
def n17_phases_complete(spark, sf):
    """Jobs whose phases are done and whose outputs are there."""
    o = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/out/"), F.col("o_orderkey").cast("string")).alias("project_path"))
    done = F.when(F.col("id") % 2 == 0, F.array(F.lit("analyst"), F.lit("seo"))).otherwise(F.array(F.lit("analyst")))
    outputs = o.where("id % 3 <> 0").select(F.concat("project_path", F.lit("/analyst_output.md")).alias("path")).unionByName(o.where("id % 5 <> 0").select(F.concat("project_path", F.lit("/seo_output.md")).alias("path")))
    return R.complete(o.withColumn("done", done), outputs, ["analyst", "seo"]).select("id", F.array_join("missing", ",").alias("missing"), "complete")


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_orderkey % 7 = 2 AS done, 'Clip ' || CAST(o_orderkey AS STRING) || '.srt' AS name FROM orders)
SELECT id, CASE WHEN k = 3 THEN NULL WHEN k IN (2, 5) OR done THEN '/arc/' || name WHEN k = 0 THEN '/in/a/' || name ELSE '/in/' || name END AS path, k <> 3 AND (k IN (2, 5) OR done) AS archived, CASE WHEN k = 3 THEN NULL WHEN k = 4 AND NOT done OR k <> 4 THEN 'é' || CAST(id AS STRING) ELSE 'é' || CAST(id AS STRING) END AS text FROM j""")
def n24_transcripts(spark, sf):
    """Transcripts of completed jobs go to the archive (twice, which is once), then every job's transcript is sought and read."""
    jobs = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 2, "completed").otherwise("pending").alias("status"), F.concat(F.lit("a/Clip "), F.col("o_orderkey").cast("string"), F.lit(".srt")).alias("transcript_file"))
    text = F.concat(F.lit("é"), F.col("id").cast("string"))
    content = F.when(F.col("id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    name, k = F.concat(F.lit("Clip "), F.col("id").cast("string"), F.lit(".srt")), F.col("id") % 6
    places = F.when(k == 0, F.array(F.concat(F.lit("/in/a/"), name))).when(k == 1, F.array(F.concat(F.lit("/in/"), name))).when(k.isin(2, 5), F.array(F.concat(F.lit("/arc/"), name))).when(k == 4, F.array(F.concat(F.lit("/in/"), name), F.concat(F.lit("/arc/"), name)))
    files = jobs.select("id", content.alias("content"), F.explode(places).alias("path")).select("path", "content")
    for _ in range(2):
        files = R.moved(files, R.archive_moves(jobs, files, "/in", "/arc"))
    return R.loaded_transcripts(jobs, files, "/in", "/arc").select("id", "path", F.coalesce("archived", F.lit(False)).alias("archived"), "text")
