"""Project, model, listing, report and upkeep queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import captions as C
from weftline.operators import diff as D
from weftline.operators import events as E
from weftline.operators import jobs as J
from weftline.operators import reports as R
from weftline.operators import search as S
from weftline.operators.joins import bounded
from weftline.operators.numbering import numbered
from weftline.plans import events  # noqa: F401  its queries are sections here
from weftline.plans.registry import ORACLES, QUERIES, query
from weftline.sources.files import append, scratch
from weftline.sources.tables import cte, raw, role
from weftline.streaming import jobs as K

_J, _F, _S = cte("jobs"), cte("files"), cte("stats")


def pick(values, column: str):
    """One of a few texts by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


@query("SELECT p_partkey AS id, trim(regexp_replace(concat(p_name, ' / ', p_brand, ' (', p_type, ')--'), '[^a-zA-Z0-9._]+', '-', 'g'), '-') || '-seo.md' AS file FROM part")
def b28_export_names(spark, sf):
    name = F.concat("p_name", F.lit(" / "), "p_brand", F.lit(" ("), "p_type", F.lit(")--"))
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), R.export_name(name, F.lit("seo.md")).alias("file"))


_PT = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'special' WHEN o_orderkey % 7 = 1 THEN '' END AS explicit, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 6 AS DOUBLE) END AS minutes, CASE o_orderkey % 5 WHEN 0 THEN '2LAK0101' WHEN 1 THEN '9LECShortOne' WHEN 2 THEN '6TWN0101' WHEN 3 THEN 'TALKDS01' ELSE '9LEC0100' END AS name FROM orders"


@query(f"SELECT id, CASE WHEN explicit = 'special' THEN 'special' WHEN minutes IS NOT NULL THEN CASE WHEN minutes < 3 THEN 'digital_short' ELSE 'segment' END WHEN id % 5 IN (1, 3) THEN 'digital_short' ELSE 'segment' END AS type, CASE WHEN explicit = 'special' THEN 'explicit' WHEN minutes IS NULL AND id % 5 = 2 THEN 'unknown' ELSE 'inferred' END AS confidence FROM ({_PT})")
def b48_project_type(spark, sf):
    rows = raw(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 7 = 0 THEN 'special' WHEN o_orderkey % 7 = 1 THEN '' END AS explicit", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 6 AS DOUBLE) END AS minutes", "CASE o_orderkey % 5 WHEN 0 THEN '2LAK0101' WHEN 1 THEN '9LECShortOne' WHEN 2 THEN '6TWN0101' WHEN 3 THEN 'TALKDS01' ELSE '9LEC0100' END AS name")
    return rows.select("id", R.project_type(F.col("explicit"), F.col("minutes"), F.col("name")).alias("t")).select("id", "t.type", "t.confidence")


@query("""SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 4 = 0 THEN value / 100 ELSE value * 10 / 1e6 * CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 1.0 END + value / 1e6 * CASE event_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 8.0 ELSE 3.0 END END, 9) AS cost FROM events""")
def b49_call_cost(spark, sf):
    """Flat, reported, by price and by default price."""
    prices = spark.createDataFrame([("a", 0.5, 1.5), ("b", 2.0, 8.0)], "model string, pin double, pout double")
    e = raw(spark, sf, "events").select("event_id", "value", pick(("a", "b", "c"), "event_id").alias("model")).join(F.broadcast(prices), "model", "left")
    flat, reported = F.when(F.col("event_id") % 11 == 0, 0.0), F.when(F.col("event_id") % 4 == 0, F.col("value") / 100)
    return e.select("event_id", F.round(R.call_cost(reported, flat, F.col("value") * 10, F.col("value"), F.col("pin"), F.col("pout")), 9).alias("cost"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN false ELSE (p_size / 2.0 + p_retailprice / 50) / 3 / 1000 > 0.01 END AS too_dear FROM part")
def b52_guard_price(spark, sf):
    price = F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 2.0)
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), R.too_dear(price, F.col("p_retailprice") / 100, 0.01).alias("too_dear"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) + INTERVAL '7 hours' + CASE WHEN hour(ts) >= 7 THEN INTERVAL '1 day' ELSE INTERVAL '0 day' END WHEN 1 THEN date_trunc('day', ts) + INTERVAL '23 hours 30 minutes' + CASE WHEN hour(ts) * 60 + minute(ts) >= 1410 THEN INTERVAL '1 day' ELSE INTERVAL '0 day' END END AS next_run FROM events""")
def b55_next_run(spark, sf):
    e = raw(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("now"), pick(("07:00", "23:30", "24:00", "soon"), "event_id").alias("at"))
    return e.select("event_id", R.next_run(F.col("at"), F.col("now")).alias("next_run"))


@query(f"""{_S}, g AS (SELECT coalesce(phase, '?') AS phase, coalesce(model, '?') AS model, count(*) AS total FROM stats WHERE event_type = 'rule_violation' GROUP BY 1, 2) SELECT phase, model, total, row_number() OVER (PARTITION BY phase ORDER BY total DESC, model) AS place FROM g""")
def g9_violation_order(spark, sf):
    """Most first, ties by name, within each phase."""
    from pyspark.sql import Window

    rows = role(spark, sf, "stats").where("event_type = 'rule_violation'").groupBy(F.coalesce("phase", F.lit("?")).alias("phase"), F.coalesce("model", F.lit("?")).alias("model")).agg(F.count("*").alias("total"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("total"), "model")))


@query("SELECT p_brand AS provider, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_name, p_partkey) AS place FROM part")
def g10_roster_order(spark, sf):
    """By tier, then name, within each provider."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.col("p_size") % 3, "p_name", "p_partkey")
    return raw(spark, sf, "part").select(F.col("p_brand").alias("provider"), F.col("p_partkey").alias("id"), F.row_number().over(w).alias("place"))


@query(f"{_F} SELECT remote_url, min(file_type) AS file_type FROM files WHERE directory_path IN ('/d1', '/d2', '/d3') OR media_id LIKE '2LAK00000%' GROUP BY remote_url")
def h5_file_union(spark, sf):
    """H5: files of several folders in one table, those that two of them list only once."""
    f = role(spark, sf, "files")
    parts = [f.where(F.col("directory_path") == d) for d in ("/d1", "/d2", "/d3")] + [f.where("media_id LIKE '2LAK00000%'")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("remote_url").agg(F.min("file_type").alias("file_type"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN 'v0.0' ELSE 'v' || CAST(s_nationkey AS STRING) || '.' || CAST(s_suppkey % 10 AS STRING) END AS tag, s_suppkey % 4 = 1 AS agrees FROM supplier")
def n3_version_tags(spark, sf):
    """The tag of a package version, and whether a release tag names the same one."""
    base = F.concat(F.col("s_nationkey").cast("string"), F.lit("."), (F.col("s_suppkey") % 10).cast("string"))
    version = F.when(F.col("s_suppkey") % 4 == 0, F.concat(base, F.lit(".1.dev3+g8a"))).when(F.col("s_suppkey") % 4 == 3, "7").otherwise(F.concat(base, F.lit(".0")))
    release = F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("v"), base, F.lit(".0"))).otherwise("v999.1.0")
    return raw(spark, sf, "supplier").select("s_suppkey", R.version_tag(version).alias("tag"), (F.concat(F.lit("v"), version) == release).alias("agrees"))


@query("""SELECT page_id, concat('f', CAST(i AS STRING), '_', CAST(page_id AS STRING), CASE i WHEN 1 THEN '.SRT' ELSE '.jpg' END) AS name, CASE i WHEN 1 THEN 'transcript' ELSE 'screengrab' END AS file_type, strftime(TIMESTAMP '2025-01-01' + INTERVAL '1' MINUTE * (page_id * 37 + i), '%Y-%m-%d %H:%M') AS modified, CASE i WHEN 1 THEN page_id * 1024 END AS size_bytes FROM pages, (SELECT unnest([1, 3]) AS i)""")
def a8_plain_listing(spark, sf):
    """The older listing form with both date forms; unknown types are left out."""

    def line(i: int, ext: str, form: str, size):
        name = F.concat(F.lit(f"f{i}_"), F.col("page_id").cast("string"), F.lit(ext))
        when = F.date_format(F.expr(f"TIMESTAMP '2025-01-01 00:00:00' + make_dt_interval(0, 0, page_id * 37 + {i}, 0)"), form)
        return F.concat(F.lit('<a href="'), name, F.lit('">'), name, F.lit("</a>  "), when, F.lit("  "), size, F.lit("\n"))

    html = F.concat(F.lit('<a href="?C=N">Name</a> <a href="sub/">sub/</a>  01-Jan-2025 10:00  -\n'), line(1, ".SRT", "dd-MMM-yyyy HH:mm", F.concat(F.col("page_id").cast("string"), F.lit("K"))), line(2, ".docx", "dd-MMM-yyyy HH:mm", F.lit("1K")), line(3, ".jpg", "yyyy-MM-dd HH:mm", F.lit("-")))
    out = R.plain_listing(raw(spark, sf, "pages").select("page_id", html.alias("html")))
    return out.withColumn("modified", F.date_format("modified", "yyyy-MM-dd HH:mm"))


def _tree(spark, sf):
    """Folders three deep, one of them ignored, one linked twice: each supplier has a folder under a root by nation, each part a file."""
    s, p = raw(spark, sf, "supplier"), raw(spark, sf, "part")
    top = s.selectExpr("concat('/r', CAST(s_nationkey AS STRING)) AS directory", "concat('/r', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING)) AS url", "CASE WHEN s_suppkey % 9 = 0 THEN 'old' ELSE concat('s', CAST(s_suppkey AS STRING)) END AS name", "true AS is_dir")
    back = s.selectExpr("concat('/r', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING)) AS directory", "concat('/r', CAST(s_nationkey AS STRING)) AS url", "'up' AS name", "true AS is_dir")
    own = p.crossJoin(F.broadcast(s.agg(F.count("*").alias("n")))).join(bounded(s, 100_000), F.col("p_partkey") % F.col("n") == F.col("s_suppkey"))
    files = own.selectExpr("concat('/r', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING)) AS directory", "concat('/r', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING), '/', CAST(p_partkey AS STRING), '.srt') AS url", "concat(CAST(p_partkey AS STRING), '.srt') AS name", "false AS is_dir")
    roots = s.where("s_nationkey < 20").selectExpr("concat('/r', CAST(s_nationkey AS STRING)) AS url").distinct()
    return top.unionByName(back).unionByName(files), roots


_WALK = "SELECT concat('/r', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING), '/', CAST(p_partkey AS STRING), '.srt') AS url, concat(CAST(p_partkey AS STRING), '.srt') AS name FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) WHERE s_nationkey < 20 AND s_suppkey % 9 <> 0"


@query(_WALK)
def n8_recursive_listing(spark, sf):
    """A walk with a depth, an ignore list and folders that link back."""
    entries, roots = _tree(spark, sf)
    return R.walked(entries, roots, 2, ["old"]).select("url", "name")


@query(f"SELECT url FROM ({_WALK}) WHERE name = '7.srt'")
def n9_files_of_media_id(spark, sf):
    entries, roots = _tree(spark, sf)
    return R.walked(entries, roots, 2, ["old"]).where(F.regexp_replace("name", r"\.[^.]*$", "") == "7").select("url")


@query("SELECT p_partkey % 50 AS project, 'keyword_report_v' || CAST(p_partkey AS STRING) || '.md' AS file, CAST(p_partkey AS INT) AS version, CASE WHEN p_size % 2 = 0 THEN '2025-01-' || lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0') END AS uploaded_at FROM part")
def n15_keyword_reports(spark, sf):
    name = F.concat(F.lit("keyword_report_v"), F.col("p_partkey").cast("string"), F.lit(".md"))
    text = F.concat(F.lit("# Report\n\n"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("**Uploaded:** 2025-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit(" \n"))).otherwise(F.lit("\n\n\n\n\n**Uploaded:** too late\n")), F.lit("a,b"))
    rows = raw(spark, sf, "part").select((F.col("p_partkey") % 50).alias("project"), name.alias("file"), text.alias("text"))
    return rows.select("project", "file", R.keyword_report(F.col("file"), F.col("text")).alias("r")).select("project", "file", "r.version", "r.uploaded_at")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'busy ' || CAST(user_id AS STRING) WHEN 1 THEN 'later, ' || event_type WHEN 2 THEN 'gateway of ' || CAST(user_id AS STRING) ELSE 'backend returned 503' END AS detail,
CAST(CASE event_id % 4 WHEN 0 THEN event_id % 100 WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id + 7 END WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN user_id + 1 END ELSE CASE WHEN event_id % 3 = 0 THEN user_id + 1 END END AS INT) AS retry_after_s, event_id % 4 <> 0 AS retryable FROM events""")
def n32_unavailable(spark, sf):
    """Refusals with a full body, a short one, plain text and nothing; a header's number before a short body's."""
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    full = F.concat(F.lit('{"error": {"retryable": false, "retry_after_s": '), (F.col("event_id") % 100).cast("string"), F.lit(', "message": "busy '), user, F.lit('"}}'))
    short = F.concat(F.lit('{"detail": "later, '), "event_type", F.lit('", "retry_after_s": '), (F.col("user_id") + 7).cast("string"), F.lit("}"))
    body = F.when(kind == 0, full).when(kind == 1, short).when(kind == 2, F.concat(F.lit("gateway of "), user)).otherwise("")
    header = F.when(F.col("event_id") % 3 == 0, (F.col("user_id") + 1).cast("string")).when(F.col("event_id") % 3 == 1, "soon")
    return raw(spark, sf, "events").select("event_id", R.unavailable(body, header).alias("u")).select("event_id", "u.*")


@query("SELECT p_brand AS id, 'cloud' AS host, min(p_retailprice) AS price FROM part GROUP BY p_brand UNION ALL SELECT s_name, 'local' || CAST(s_nationkey % 3 AS STRING), 0.0 FROM supplier WHERE s_suppkey % 4 = 1")
def n33_roster_merge(spark, sf):
    """What enabled local servers have, appended to the cloud list at no price."""
    cloud = raw(spark, sf, "part").groupBy(F.col("p_brand").alias("id")).agg(F.lit("cloud").alias("host"), F.min("p_retailprice").alias("price"))
    local = raw(spark, sf, "supplier").where("s_suppkey % 4 = 1").select(F.col("s_name").alias("id"), F.concat(F.lit("local"), (F.col("s_nationkey") % 3).cast("string")).alias("host"), F.lit(0.0).alias("price"))
    return cloud.unionByName(local)


@query("WITH r AS (SELECT p_brand AS id, min(p_retailprice) AS price FROM part GROUP BY p_brand) SELECT phase, model, price FROM (VALUES ('analyst', 'Brand#1'), ('formatter', 'Brand#2'), ('seo', 'gone')) v(phase, model) LEFT JOIN r ON r.id = model")
def n34_phase_models(spark, sf):
    phases = spark.createDataFrame([("analyst", "Brand#1"), ("formatter", "Brand#2"), ("seo", "gone")], "phase string, model string")
    roster = raw(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(F.min("p_retailprice").alias("price"))
    return phases.join(roster, "model", "left").select("phase", "model", "price")


@query("""SELECT o_orderkey AS id, array_to_string(list_filter(['Analysis', CASE WHEN o_orderkey % 2 = 0 THEN 'Formatted Transcript' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Revisions (' || CAST(o_orderkey % 3 + 1 AS STRING) || ')' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Keyword Reports (1)' END], lambda x: x IS NOT NULL), ', ') AS labels FROM orders""")
def n37_deliverables(spark, sf):
    outputs = F.create_map(F.lit("analysis"), F.lit("a.md"), F.lit("formatted_transcript"), F.lit("f.md"), F.lit("seo_metadata"), F.lit("s.md"))
    revisions = F.when(F.col("o_orderkey") % 5 == 0, F.transform(F.sequence(F.lit(0), F.col("o_orderkey") % 3), lambda i: F.concat(F.lit("copy_revision_v"), i.cast("string"), F.lit(".md")))).otherwise(F.array().cast("array<string>"))
    files = F.concat(F.array(F.lit("a.md")), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("f.md"))).otherwise(F.array(F.lit("x.md"))), revisions, F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("keyword_report_v1.md"))).otherwise(F.array().cast("array<string>")))
    return raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(R.deliverables(outputs, files), ", ").alias("labels"))


@query("SELECT c_custkey AS id, 'rec' || CAST(c_custkey AS STRING) AS record_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS program, c_nationkey AS keywords FROM customer")
def n38_record_fields(spark, sf):
    """An external record, JSON with display names, as flat columns."""
    fields = F.struct(F.col("c_name").alias("Release Title"), F.when(F.col("c_custkey") % 3 == 0, F.array("c_mktsegment")).alias("Program"), F.col("c_nationkey").alias("Keyword Count"))
    text = F.to_json(F.struct(F.concat(F.lit("rec"), F.col("c_custkey").cast("string")).alias("id"), fields.alias("fields")))
    rows = raw(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.from_json(text, "id string, fields struct<`Release Title`:string,Program:array<string>,`Keyword Count`:int>").alias("r"))
    return rows.select("id", F.col("r.id").alias("record_id"), F.col("r.fields")["Release Title"].alias("title"), F.get("r.fields.Program", F.lit(0)).alias("program"), F.col("r.fields")["Keyword Count"].alias("keywords"))


@query(f"""{_J} SELECT project_path, count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, round(sum(actual_cost), 2) AS cost, max(queued_at) AS last_queued, arg_max(id, (queued_at, id)) AS last_job FROM jobs GROUP BY project_path""")
def n39_project_summary(spark, sf):
    j = role(spark, sf, "jobs")
    last = F.max_by("id", F.struct("queued_at", "id"))
    return j.groupBy("project_path").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"), F.round(F.sum("actual_cost"), 2).alias("cost"), F.max("queued_at").alias("last_queued"), last.alias("last_job"))


@query(f"""{_J}, w AS (SELECT p_partkey, concat('6TWN', lpad(CAST(p_partkey % 900 AS STRING), 4, '0')) AS media_id, p_size % 3 = 0 AS has_source FROM part), d AS (SELECT media_id, arg_max(id, (queued_at, id)) AS job FROM jobs WHERE status <> 'cancelled' AND media_id IS NOT NULL GROUP BY media_id)
SELECT p_partkey, CASE WHEN NOT has_source THEN 'no_source' WHEN job IS NOT NULL THEN 'duplicate' ELSE 'created' END AS outcome, CASE WHEN has_source THEN job END AS job_id FROM w LEFT JOIN d USING (media_id)""")
def n40_submit_job(spark, sf):
    """A job for each media id that has a source and no live job."""
    wanted = raw(spark, sf, "part").select("p_partkey", F.concat(F.lit("6TWN"), F.lpad((F.col("p_partkey") % 900).cast("string"), 4, "0")).alias("media_id"), F.lit(None).cast("string").alias("file"), (F.col("p_size") % 3 == 0).alias("has_source"))
    found = J.duplicates_of(role(spark, sf, "jobs"), wanted.select("file", "media_id").distinct()).select("media_id", "job_id")
    rows = wanted.join(found, "media_id", "left")
    outcome = F.when(~F.col("has_source"), "no_source").when(F.col("job_id").isNotNull(), "duplicate").otherwise("created")
    return rows.select("p_partkey", outcome.alias("outcome"), F.when(F.col("has_source"), F.col("job_id")).alias("job_id"))


@query("""SELECT 'm' || CAST(c_custkey AS STRING) AS media_id, 'title' AS field, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_name END, '') AS original_value, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS pipeline_value, c_mktsegment AS committed_value FROM customer""")
def n41_corrections(spark, sf):
    c = raw(spark, sf, "customer").withColumn("media_id", F.concat(F.lit("m"), F.col("c_custkey").cast("string")))
    edits = c.select("media_id", F.lit("title").alias("field"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("current_value"), F.col("c_mktsegment").alias("proposed_value"))
    pipeline = c.where("c_custkey % 2 = 0").select("media_id", F.lit("title").alias("field"), F.col("c_mktsegment").alias("value"))
    return R.corrections(edits, pipeline).drop("data")


@query("""SELECT doc_id, CASE WHEN n >= 40 THEN 12 ELSE 0 END AS cut FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\f]+'), lambda w: w <> '')) AS n FROM documents)""")
def n45_window_trim(spark, sf):
    """A part that starts with the last twelve words of the one before, then eight others."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = raw(spark, sf, "documents").select("doc_id", F.transform(words, lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))).alias("w"))
    after = F.concat(F.transform(F.slice("w", -12, 12), lambda w: F.when(w.rlike("^[!-~]+$"), F.upper(w)).otherwise(w)), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("new"), i.cast("string"))))
    return rows.select("doc_id", F.when(F.size("w") >= 40, R.trimmed_overlap(F.col("w"), after)).otherwise(0).alias("cut"))


@query(f"""{_J}, h AS (SELECT project_path, max(last_heartbeat) AS beat FROM jobs GROUP BY project_path) SELECT project_path, CAST(epoch(TIMESTAMP '1998-08-01') - epoch(beat) AS BIGINT) AS age_s, coalesce(epoch(TIMESTAMP '1998-08-01') - epoch(beat) <= 600000, false) OR project_path = 'project_3' AS running FROM h""")
def n48_component_status(spark, sf):
    """A component runs if its heartbeat is fresh or its process is there."""
    now = F.expr("TIMESTAMP_NTZ '1998-08-01 00:00:00'")
    beat = role(spark, sf, "jobs").groupBy("project_path").agg(F.max("last_heartbeat").alias("beat"))
    age = J.heartbeat_age("beat", now)
    return beat.select("project_path", age.alias("age_s"), (F.coalesce(age <= 600000, F.lit(False)) | (F.col("project_path") == "project_3")).alias("running"))


@query(f"{_F} SELECT file_type, count(*) FILTER (status = 'new' AND media_id IS NOT NULL) AS queued, count(*) FILTER (status <> 'new' OR media_id IS NULL) AS failed FROM files WHERE file_type IN ('srt', 'transcript') GROUP BY file_type")
def n13_bulk_queue(spark, sf):
    """Files asked to be queued; those that aren't new or have no media id fail."""
    ok = (F.col("status") == "new") & F.col("media_id").isNotNull()
    return role(spark, sf, "files").where("file_type IN ('srt', 'transcript')").groupBy("file_type").agg(F.count_if(ok).alias("queued"), F.count_if(~ok).alias("failed"))


@query("SELECT event_type, count(*) + count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY event_type")
def l8_append_events(spark, sf):
    """Events appended to a log that holds others."""
    path = scratch(spark, "log")
    e = raw(spark, sf, "events")
    append(e, path)
    append(e.where("event_type = 'error'"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fresh words ' || lang ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM t) SELECT term, count(*) AS df FROM w GROUP BY term""")
def l9_index_upkeep(spark, sf):
    """Postings after documents are changed and deleted."""
    d = raw(spark, sf, "documents").select("doc_id", "text", "lang")
    index = S.postings(d)
    edited = d.where("doc_id % 3 = 0 AND doc_id % 7 <> 0").select("doc_id", F.concat(F.lit("fresh words "), F.col("lang")).alias("text"))
    gone = d.where("doc_id % 7 = 0 OR doc_id % 3 = 0")
    return R.maintained(index, gone, S.postings(edited)).groupBy("term").agg(F.count("*").alias("df"))


@query(f"""{_J}, live AS (SELECT DISTINCT project_path, transcript_file, queued_at FROM jobs WHERE id % 2 = 0), s AS (SELECT j.id, l.project_path IS NOT NULL AS known FROM jobs j LEFT JOIN live l ON l.project_path = j.project_path AND l.transcript_file = j.transcript_file AND l.queued_at IS NOT DISTINCT FROM j.queued_at) SELECT id AS src, (SELECT max(id) FROM jobs WHERE id % 2 = 0) + row_number() OVER (ORDER BY id) AS id FROM s WHERE NOT known""")
def l10_backfill_jobs(spark, sf):
    """Rows of another store whose natural key isn't live yet, with new ids that follow the live ones without gaps."""
    j = role(spark, sf, "jobs")
    own = j.where("id % 2 = 0")
    last = own.agg(F.max("id")).first()[0] or 0
    more = R.without_known(j, own.select("project_path", "transcript_file", "queued_at"), ["project_path", "transcript_file", "queued_at"])
    return numbered(more.select(F.col("id").alias("src")), ["src"], "id", after=last)


@query(f"""{_F}, a AS (SELECT id, media_id, CASE WHEN media_id IS NULL THEN 'no_match' WHEN id % 5 = 0 THEN 'new' ELSE 'attached' END AS status FROM files WHERE file_type = 'image') SELECT status, count(*) AS files, count(*) FILTER (status = 'attached') AS successes, count(*) FILTER (media_id IS NULL) AS without_record FROM a GROUP BY status""")
def l12_attachment_audit(spark, sf):
    """An audit row for each attempt, and the file's status that follows from it."""
    path = scratch(spark, "audit")
    f = role(spark, sf, "files").where("file_type = 'image'")
    tries = f.select("id", "media_id", (F.col("media_id").isNotNull() & (F.col("id") % 5 != 0)).alias("success"), F.when(F.col("media_id").isNull(), "No SST record found").when(F.col("id") % 5 == 0, "timeout").alias("error"))
    append(tries, path)
    status = F.when(F.col("success"), "attached").when(F.contains("error", F.lit("No SST record found")), "no_match").otherwise("new")
    done = spark.read.parquet(path).select(status.alias("status"), "success", "media_id")
    return done.groupBy("status").agg(F.count("*").alias("files"), F.count_if("success").alias("successes"), F.count_if(F.col("media_id").isNull()).alias("without_record"))


@query(f"{_F} SELECT media_id, file_type, arg_max(id, (first_seen_at, id)) AS id FROM files WHERE media_id IS NOT NULL AND file_type IN ('srt', 'scc') GROUP BY media_id, file_type")
def l14_sidecars(spark, sf):
    """Of the side files of an id and kind the newest stays."""
    rows = role(spark, sf, "files").where("media_id IS NOT NULL AND file_type IN ('srt', 'scc')")
    return R.first_of(rows, ["media_id", "file_type"], F.desc("first_seen_at"), F.desc("id")).select("media_id", "file_type", "id")


@query("""SELECT c_custkey AS id, 'm' || CAST(c_custkey AS STRING) AS media_id, CASE WHEN c_custkey % 2 = 0 THEN 'm' || CAST(c_custkey AS STRING) || '.mp4' WHEN c_custkey % 3 = 0 THEN 'm' || CAST(c_custkey AS STRING) || '.wav' END AS name FROM customer""")
def a12_media_lookup(spark, sf):
    """The preferred file of each media id over folders."""
    c = raw(spark, sf, "customer").select("c_custkey", F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("media_id"))
    of = lambda df, ext, folder: df.select(F.concat("media_id", F.lit(ext)).alias("name"), F.lit(folder).alias("folder"))
    files = of(c.where("c_custkey % 2 = 0"), ".mp4", 2).unionByName(of(c.where("c_custkey % 3 = 0"), ".wav", 1)).unionByName(of(c, ".txt", 1))
    return c.select(F.col("c_custkey").alias("id"), "media_id").join(R.best_media(c, files), "media_id", "left").select("id", "media_id", "name")


@query(f"""{_S}, g AS (SELECT coalesce(phase, '—') AS phase, count(*) AS total FROM stats WHERE event_type = 'rule_violation' GROUP BY 1) SELECT '## Violations' || chr(10) || chr(10) || '| phase | total |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || phase || ' | ' || CAST(total AS STRING) || ' |', chr(10) ORDER BY total DESC, phase) AS report FROM g""")
def a18_markdown_report(spark, sf):
    """A small aggregate as a Markdown table."""
    rows = role(spark, sf, "stats").where("event_type = 'rule_violation'").groupBy(F.coalesce("phase", F.lit("—")).alias("phase")).agg(F.count("*").alias("total"))
    return R.markdown(rows, ["phase", "total"], [-F.col("total"), F.col("phase")], "Violations")


@query("SELECT event_id, '{\"type\":\"' || event_type || '\",\"job\":' || CAST(user_id AS STRING) || '}' AS message FROM events WHERE event_type <> 'view'")
def k11_change_feed(spark, sf):
    """A message for each change of a job, from a stream."""
    stream = K.table_stream(spark, f"{sf}/events.parquet").where("event_type <> 'view'")
    return K.run_once(stream.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("job"))).alias("message")))


@query(f"""{_J}, b AS (SELECT id, status, priority, retry_after FROM jobs WHERE id % 6 <> 0), a AS (SELECT id, CASE WHEN id % 4 = 1 THEN 'completed' WHEN id % 4 = 2 THEN 'in_progress' ELSE status END AS status, CASE WHEN id % 9 = 0 THEN priority + 1 ELSE priority END AS priority, CASE WHEN id % 10 = 0 THEN NULL ELSE retry_after END AS retry_after FROM jobs WHERE id % 8 <> 0)
SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'delete' ELSE 'update' END AS change, '{{"type":"' || CASE WHEN a.id IS NULL THEN 'job_deleted' WHEN a.status = 'completed' THEN 'job_completed' WHEN a.status = 'failed' THEN 'job_failed' WHEN a.status = 'in_progress' THEN 'job_started' ELSE 'job_updated' END
|| '","job":' || CAST(coalesce(b.id, a.id) AS STRING) || coalesce(',"was":"' || b.status || '"', '') || coalesce(',"is":"' || a.status || '"', '') || '}}' AS message
FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status IS DISTINCT FROM b.status OR a.priority IS DISTINCT FROM b.priority OR a.retry_after IS DISTINCT FROM b.retry_after""")
def k11b_change_broadcast(spark, sf):
    """What two snapshots of the jobs differ in, announced once, though the batch is delivered twice."""
    j = role(spark, sf, "jobs")
    before = j.where("id % 6 <> 0").select("id", "status", "priority", "retry_after")
    after = j.where("id % 8 <> 0").select("id", F.when(F.col("id") % 4 == 1, "completed").when(F.col("id") % 4 == 2, "in_progress").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 9 == 0, F.col("priority") + 1).otherwise(F.col("priority")).alias("priority"), F.when(F.col("id") % 10 != 0, F.col("retry_after")).alias("retry_after"))
    path = scratch(spark, "outbox")
    for _ in range(2):
        changes = D.row_changes(before, after, "id")
        K.to_outbox(changes.select("id", "change").join(D.announcements(changes, "id"), "id"), path, 0)
    return K.outbox(spark, path, "id long, change string, message string").select("id", "change", "message")


@query(f"{_J} SELECT id, transcript_file, CASE WHEN duration_minutes > 3 THEN 'full' WHEN duration_minutes IS NOT NULL THEN 'short' END AS content_type, duration_minutes FROM jobs")
def n43_study_context(spark, sf):
    """A job's row as the context of its checks."""
    kind = F.when(F.col("duration_minutes") > 3, "full").when(F.col("duration_minutes").isNotNull(), "short")
    context = F.struct("transcript_file", kind.alias("content_type"), "duration_minutes", F.lit(None).cast("string").alias("transcript"))
    return role(spark, sf, "jobs").select("id", context.alias("c")).select("id", "c.transcript_file", "c.content_type", "c.duration_minutes")


@query(f"{_S} SELECT coalesce(phase, '?') AS phase, string_agg(model || '×' || CAST(n AS STRING), ', ' ORDER BY n DESC, model) AS by_model FROM (SELECT phase, model, count(*) AS n FROM stats WHERE model IS NOT NULL GROUP BY ALL) GROUP BY 1")
def n50_model_cells(spark, sf):
    """N50: a report's cells of counted models, the most common first."""
    rows = role(spark, sf, "stats").where("model IS NOT NULL").select(F.coalesce("phase", F.lit("?")).alias("phase"), "model")
    return E.counted(rows, ["phase"], "model", "by_model").withColumn("by_model", F.replace(F.replace("by_model", F.lit("="), F.lit("×")), F.lit(","), F.lit(", ")))


#: Sections of the report on rules: title, query, columns, and what its rows are ordered by (- for falling).
_SECTIONS = (
    ("Corrections", "e8_correction_clusters", ("old", "new", "n", "examples"), ("-n", "old", "new")), ("Corrections of nothing", "e9_null_buckets", ("field", "n"), ("-n", "field")),
    ("Rules without a hit", "h1_zero_hit_rules", ("rule",), ("rule",)), ("Proposals", "i23_proposals", ("old", "new", "n", "kind"), ("-n", "old", "new")),
)


def _section_sql(place: int, title: str, name: str, columns: tuple[str, ...], order: tuple[str, ...]) -> str:
    line = " || ' | ' || ".join(f"coalesce(CAST({c} AS STRING), '—')" for c in columns)
    by = ", ".join(f"{o.removeprefix('-')} DESC" if o[0] == "-" else o for o in order)
    head = f"'## {title}' || chr(10) || chr(10)"
    return f"SELECT {place} AS place, coalesce({head} || '| {' | '.join(columns)} |' || chr(10) || '|{'---|' * len(columns)}' || chr(10) || string_agg('| ' || {line} || ' |', chr(10) ORDER BY {by}), {head} || '_None._') AS report FROM ({ORACLES[name]})"


@query(" UNION ALL ".join(_section_sql(i, *x) for i, x in enumerate(_SECTIONS)))
def n50b_rule_report(spark, sf):
    """N50: the report on rules, section by section, each a small aggregate."""
    order = lambda o: -F.col(o[1:]) if o[0] == "-" else F.col(o)
    parts = [R.markdown(QUERIES[name](spark, sf), columns, [order(o) for o in by], title).select(F.lit(i).alias("place"), "report") for i, (title, name, columns, by) in enumerate(_SECTIONS)]
    return reduce(DataFrame.unionByName, parts)


@query(f"""{_F}, g AS (SELECT media_id, min(remote_url) FILTER (variant_tag = 'PLEDGE') AS own, min(remote_url) FILTER (variant_tag IS NULL AND unknown_tag IS NULL) AS main FROM files WHERE media_id IS NOT NULL GROUP BY media_id) SELECT media_id, coalesce(own, main) AS url FROM g WHERE coalesce(own, main) IS NOT NULL""")
def n7_asset_url(spark, sf):
    """A variant's file in any case, else the primary one."""
    f = role(spark, sf, "files").where("media_id IS NOT NULL")
    rows = f.select("media_id", F.col("variant_tag").alias("variant"), (F.col("variant_tag").isNull() & F.col("unknown_tag").isNull()).alias("primary"), F.col("remote_url").alias("url"))
    return R.asset_url(rows, "Pledge")


@query("""WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') || '/' || p_brand || ':' || CAST(p_size AS STRING) AS name FROM part)
SELECT id, CASE WHEN regexp_matches(name, '^s.*/Brand#1:.*$') THEN 'early' WHEN regexp_matches(name, '^.*:.$') THEN 'small' WHEN regexp_matches(name, '^.*e.*/.*5$') THEN 'round' END AS family FROM n""")
def b31_glob_family(spark, sf):
    """The first of several patterns that a name matches."""
    names = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), "p_brand", F.lit(":"), F.col("p_size").cast("string"))
    globs = [("S*/brand#1:*", "early"), ("*:?", "small"), ("*e*/*5", "round")]
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), R.family_of(names, globs).alias("family"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '—' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN '0' ELSE 'n/a' END ELSE printf('%+.1f', round((event_id % 50 - 20) * 100.0 / 20, 1)) END AS delta FROM events")
def b53_percent_delta(spark, sf):
    """No base, a base of nothing, and others."""
    k = F.col("event_id")
    base = F.when(k % 4 == 1, 0).when(k % 4 != 0, 20)
    value = F.when(k % 4 == 1, F.when(k % 3 == 0, 0).otherwise(7)).otherwise(k % 50)
    return raw(spark, sf, "events").select("event_id", R.percent_delta(value.cast("double"), base.cast("double")).alias("delta"))


@query("""WITH x AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type END AS a, CASE WHEN event_id % 3 = 0 THEN 'lint' ELSE 'llm' END AS s, CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'enforce' WHEN 1 THEN 'shadow' END AS m FROM events)
SELECT event_id, CASE WHEN a IN ('click', 'view') THEN a WHEN s = 'lint' AND m = 'enforce' THEN 'applied' WHEN s = 'lint' THEN 'flagged' ELSE 'unknown' END AS action FROM x""")
def b68_event_actions(spark, sf):
    """A known action, else what a lint event's mode tells, else unknown."""
    mode = F.floor("value").cast("long") % 3
    e = raw(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 3 == 0, "lint").otherwise("llm").alias("s"), F.when(mode == 0, "enforce").when(mode == 1, "shadow").alias("m"))
    return e.select("event_id", E.action_of(F.col("a"), ("click", "view"), F.col("s"), F.col("m")).alias("action"))


@query(f"""{_J}, t AS (SELECT id, media_id FROM jobs WHERE id % 3 <> 0 ORDER BY id LIMIT 1000) SELECT count(*) AS checked, count(*) FILTER (media_id IS NOT NULL AND CAST(substring(media_id, 5) AS INT) % 2 = 0) AS linked, count(*) FILTER (media_id IS NULL OR CAST(substring(media_id, 5) AS INT) % 2 <> 0) AS not_found FROM t""")
def n44_link_backfill(spark, sf):
    """The first thousand jobs without a record, looked up; the limit is the feature."""
    j = role(spark, sf, "jobs")
    records = j.where("media_id IS NOT NULL AND CAST(substring(media_id, 5, 4) AS INT) % 2 = 0").select("media_id", F.concat(F.lit("rec"), "media_id").alias("record_id")).distinct()
    every = spark.range(350).select(F.concat(F.lit("6TWN"), F.lpad((F.col("id") * 2).cast("string"), 4, "0")).alias("media_id")).withColumn("record_id", F.concat(F.lit("rec"), "media_id"))
    return R.link_counts(j.select("id", "media_id", F.when(F.col("id") % 3 == 0, "rec").alias("record_id")), records.unionByName(every))


@query(f"""{_F}, v AS (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL), r AS (SELECT max(n) / 300.0 AS rate FROM (SELECT count(*) AS n FROM events GROUP BY time_bucket(INTERVAL '5 minutes', ts))), c AS (SELECT unnest(['rate', 'errors', 'p95', 'p99', 'parity', 'coverage']) AS name, unnest([(SELECT rate <= 1 FROM r), (SELECT count(*) FILTER (event_type = 'error') / count(*) < 0.01 FROM events),
(SELECT v[least(CAST(floor(len(v) * 95 / 100) AS BIGINT), len(v) - 1) + 1] < 50 FROM v), (SELECT v[least(CAST(floor(len(v) * 99 / 100) AS BIGINT), len(v) - 1) + 1] < 200 FROM v), (SELECT count(*) > 0 AND count(*) FILTER (d <> 0) = 0 FROM (SELECT count(*) - count(event_id) AS d FROM events GROUP BY date_trunc('day', ts))), (SELECT abs(count(*) FILTER (file_type = 'mp4') - count(*) FILTER (file_type = 'srt')) / count(*) FILTER (file_type = 'srt') <= 0.05 FROM files WHERE prefix = '2LAK')]) AS passed)
SELECT count(*) FILTER (passed) AS passed, count(*) AS total, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT passed), '') AS failed, CASE WHEN count(*) FILTER (passed) = count(*) THEN 'GO' ELSE 'NO-GO' END AS verdict FROM c""")
def j10b_all_criteria(spark, sf):
    """Request rate, errors, latencies, parity checks and coverage against a baseline count."""
    e = raw(spark, sf, "events")
    of = lambda df, name, test: df.select(F.lit(name).alias("name"), test.alias("passed"))
    rate = E.rates(e).agg(F.max("rate").alias("rate"))
    ratio = e.agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("ratio"))
    late = E.percentiles(e.where("value IS NOT NULL"), [], "value")
    parity = e.groupBy(F.to_date("ts").alias("day")).agg((F.count("*") - F.count("event_id")).alias("delta")).agg(F.count("*").alias("checks"), F.count_if(F.col("delta") != 0).alias("bad"))
    files = role(spark, sf, "files").where("prefix = '2LAK'").agg(F.count_if(F.col("file_type") == "mp4").alias("have"), F.count_if(F.col("file_type") == "srt").alias("base"))
    every = of(rate, "rate", F.col("rate") <= 1)
    for part in (of(ratio, "errors", F.col("ratio") < 0.01), of(late, "p95", F.col("p95") < 50), of(late, "p99", F.col("p99") < 200), of(parity, "parity", (F.col("checks") > 0) & (F.col("bad") == 0)), of(files, "coverage", F.abs(F.col("have") - F.col("base")) / F.col("base") <= 0.05)):
        every = every.unionByName(part)
    return R.verdict(every)


@query("""WITH n AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id) SELECT doc_id, 'SEAM GAP DETECTED: Formatter output is missing ' || CASE WHEN k > 3 THEN '2 sections' ELSE '1 section' END || ' of source dialogue: 00:00:00–00:00:03 (1 captions, e.g. "x")' || CASE WHEN k > 3 THEN '; 00:00:09–00:00:12 (' || CAST(k AS STRING) || ' captions, e.g. "y")' ELSE '' END || '. Likely a chunk-boundary drop — retry to escalate / re-chunk.' AS message FROM n""")
def n28_gap_message(spark, sf):
    """One span for each document, two for longer ones."""
    k = F.size(F.split("text", "\n"))
    span = lambda a, b, n, x: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), n.alias("captions"), F.lit(x).alias("sample"))
    spans = F.when(k > 3, F.array(span("00:00:09", "00:00:12", k, "y"), span("00:00:00", "00:00:03", F.lit(1), "x"))).otherwise(F.array(span("00:00:00", "00:00:03", F.lit(1), "x")))
    return C.gap_message(raw(spark, sf, "documents").select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*"))
