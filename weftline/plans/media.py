"""Media-index queries (A7, B1-B8, B40-B43, C17, D, F1, F2, J2, J6, L, N)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import time as TM
from weftline.operators import media as M
from weftline.operators import search as S
from weftline.operators import walk as W
from weftline.operators.jobs import rank_one
from weftline.operators.numbering import numbered
from weftline.plans.registry import query
from weftline.sources.files import scratch
from weftline.sources.tables import cte, raw, role

_F = cte("files")
_NAME = """concat(CASE l_partkey % 4 WHEN 0 THEN '2LAK' WHEN 1 THEN '6TWN' WHEN 2 THEN '9LEC' ELSE 'ZZZZ' END, CASE WHEN l_linenumber = 5 THEN 'S' ELSE '' END, lpad(CAST(l_suppkey % 20 AS STRING), 2, '0'), lpad(CAST(l_partkey % 60 AS STRING), 2, '0'),
CASE WHEN l_linenumber % 2 = 0 THEN 'hd' ELSE '' END, CASE l_linenumber WHEN 3 THEN '_REV20250931' WHEN 4 THEN '_REV20250930' ELSE '' END, CASE l_returnflag WHEN 'A' THEN '_pledge' WHEN 'R' THEN '_NoBug' ELSE '' END, CASE WHEN l_suppkey % 2 = 0 THEN '.mp4' ELSE '.srt' END)"""


def files(spark, sf) -> DataFrame:
    return role(spark, sf, "files")


def names(spark, sf) -> DataFrame:
    return raw(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", f"{_NAME} AS name")


def prefixes(spark) -> DataFrame:
    """The prefix dimension, a handful of rows."""
    return F.broadcast(spark.createDataFrame([("2LAK", "series", "Lake Stories"), ("6TWN", "news", "Town Hall"), ("9LEC", "special", "Open Lectures")], "prefix string, category string, show string"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000")
def a1_table_scan(spark, sf):
    return raw(spark, sf, "customer").where("c_acctbal > 9000").select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT page_id, concat('f', CAST(i AS STRING), '_', CAST(page_id AS STRING), CASE WHEN i = 2 THEN '/' ELSE '.mp4' END) AS name, i = 2 AS is_dir, strftime(TIMESTAMP '2025-01-01' + INTERVAL '1' MINUTE * (page_id * 37 + i), '%Y-%m-%d %H:%M') AS modified,
CASE WHEN i = 2 THEN NULL WHEN i = 1 THEN page_id * 1024 ELSE CAST(floor((page_id % 90 / 10.0) * 1048576) AS BIGINT) END AS size_bytes FROM pages, (SELECT unnest([1, 2, 3]) AS i)""")
def a7_listing_scan(spark, sf):
    """Directory listings, written in the query, read back by patterns over their rows."""
    def line(i: int):
        name = F.concat(F.lit(f"f{i}_"), F.col("page_id").cast("string"), F.lit("/" if i == 2 else ".mp4"))
        when = F.date_format(F.expr(f"TIMESTAMP '2025-01-01 00:00:00' + make_dt_interval(0, 0, page_id * 37 + {i}, 0)"), "yyyy-MM-dd HH:mm")
        size = F.lit("-") if i == 2 else F.concat(F.col("page_id").cast("string"), F.lit("K")) if i == 1 else F.concat((F.col("page_id") % 90 / 10).cast("decimal(4,1)").cast("string"), F.lit("M"))
        return F.concat(F.lit('<tr><td><img></td><td><a href="'), name, F.lit('">'), name, F.lit('</a></td><td align="right">'), when, F.lit('  </td><td align="right"> '), size, F.lit("</td><td>&nbsp;</td></tr>"))

    head = F.lit('<table><tr><th><a href="?C=N;O=D">Name</a></th></tr><tr><td><a href="/parent/">Parent Directory</a></td></tr>')
    pages = raw(spark, sf, "pages").select("page_id", F.concat(head, *(line(i) for i in (1, 2, 3)), F.lit("</table>")).alias("html"))
    return M.listing_entries(pages).select("page_id", "name", "is_dir", F.date_format("modified", "yyyy-MM-dd HH:mm").alias("modified"), "size_bytes")


@query("""SELECT page_id, CAST(unnest(range(len(h))) AS INT) AS ord, unnest(h) AS href, unnest(l) AS label FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1) AS l FROM pages)""")
def a7b_page_links(spark, sf):
    return M.links(raw(spark, sf, "pages"))


@query(f"""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, regexp_extract(upper(regexp_replace({_NAME}, '\\.[^.]*$', '')), '^([A-Z0-9]{{4}})(\\d{{2}})(\\d{{2}})(HD)?(?:_REV(\\d{{8}}))?(_[A-Z0-9]+)?$', ['p', 's', 'e', 'hd', 'rev', 'tag']) AS m, upper({_NAME}) AS u FROM lineitem),
q AS (SELECT *, m.p <> '' AS matched, try_strptime(nullif(m.rev, ''), '%Y%m%d') AS d FROM p), r AS (SELECT *, matched AND (m.rev = '' OR d IS NOT NULL) AS ok FROM q)
SELECT id, CASE WHEN NOT matched THEN CASE WHEN left(u, 4) IN ('2LAK', '6TWN', '9LEC') THEN 'nonstandard' ELSE 'error' END WHEN ok THEN 'parsed' ELSE 'error' END AS outcome, CASE WHEN ok THEN m.p || m.s || m.e END AS media_id, CASE WHEN ok THEN TRY_CAST(m.s AS INT) END AS season, CASE WHEN ok THEN TRY_CAST(m.e AS INT) END AS episode,
CASE WHEN ok THEN m.hd <> '' END AS hd, CASE WHEN ok THEN strftime(d, '%Y-%m-%d') END AS revision_date, CASE WHEN ok AND m.tag IN ('_PLEDGE', '_DS') THEN substring(m.tag, 2) END AS variant_tag, CASE WHEN ok AND m.tag <> '' AND m.tag NOT IN ('_PLEDGE', '_DS') THEN substring(m.tag, 2) END AS unknown_tag,
CASE WHEN ok THEN CASE m.p WHEN '2LAK' THEN 'series' WHEN '6TWN' THEN 'news' WHEN '9LEC' THEN 'special' ELSE 'unknown' END END AS category FROM r""")
def b1_parse_filename(spark, sf):
    """B1, D5 and A6."""
    rows = names(spark, sf).select("id", T.parse_filename(F.col("name")).alias("p")).select("id", "p.*").join(prefixes(spark), "prefix", "left")
    outcome = F.when(F.col("outcome") == "parsed", "parsed").when((F.col("outcome") == "unmatched") & F.col("category").isNotNull(), "nonstandard").otherwise("error")
    category = F.when(F.col("outcome") == "parsed", F.coalesce("category", F.lit("unknown")))
    return rows.select("id", outcome.alias("outcome"), "media_id", "season", "episode", "hd", F.date_format("revision_date", "yyyy-MM-dd").alias("revision_date"), "variant_tag", "unknown_tag", category.alias("category"))


_TITLE = "concat(CASE p_partkey % 6 WHEN 0 THEN concat('2lak', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), 'HD') WHEN 1 THEN concat('6TWN', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), '_REV20251202') WHEN 2 THEN p_name WHEN 3 THEN replace(p_name, ' ', '_') ELSE concat('9LEC', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0')) END, CASE p_partkey % 5 WHEN 0 THEN ' - Copy (2)' WHEN 1 THEN ' (3)' WHEN 2 THEN '_ForClaude' WHEN 3 THEN ' copy 2' ELSE '' END)"


@query(f"""WITH t AS (SELECT p_partkey AS id, {_TITLE} AS name FROM part)
SELECT id, name, CASE WHEN regexp_matches(name, '(?i)\\s*-\\s*Copy(?:\\s*\\((\\d+)\\))?\\s*$') THEN trim(regexp_replace(name, '(?i)\\s*-\\s*Copy(?:\\s*\\((\\d+)\\))?\\s*$', '')) WHEN regexp_matches(name, '(?i)\\s+copy(?:\\s+(\\d+))?\\s*$') THEN trim(regexp_replace(name, '(?i)\\s+copy(?:\\s+(\\d+))?\\s*$', ''))
WHEN regexp_matches(name, '\\s*\\((\\d+)\\)\\s*$') THEN trim(regexp_replace(name, '\\s*\\((\\d+)\\)\\s*$', '')) ELSE name END AS clean FROM t""")
def b4_copy_suffix(spark, sf):
    rows = raw(spark, sf, "part").selectExpr("p_partkey AS id", f"{_TITLE} AS name")
    return rows.select("id", "name", T.without_copy_suffix(F.col("name")).alias("clean"))


@query(f"""WITH t AS (SELECT p_partkey AS id, regexp_replace(regexp_replace({_TITLE}, '(?i)(\\s*-\\s*Copy(\\s*\\(\\d+\\))?|\\s+copy(\\s+\\d+)?|\\s*\\(\\d+\\))\\s*$', ''), '(?i)_ForClaude', '', 'g') AS clean FROM part), m AS (SELECT *, regexp_extract(clean, '(?i)([A-Z0-9]{{4}}\\d{{4}}(?:[A-Z]+\\d{{0,2}})?)(_REV\\d+)?') AS hit FROM t)
SELECT id, CASE WHEN hit <> '' THEN upper(hit) WHEN NOT contains(clean, ' ') THEN clean END AS media_id FROM m""")
def b2_media_id(spark, sf):
    """B2 and B3."""
    rows = raw(spark, sf, "part").selectExpr("p_partkey AS id", f"concat({_TITLE}, '.txt') AS name")
    return rows.select("id", T.media_id(F.col("name")).alias("media_id"))


@query("SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(concat(p_name, ': ', p_brand, '/', p_type, '__x_'), '[^\\p{L}\\p{N}\\-_. ]', '_', 'g'), '_{2,}', '_', 'g'), '_ ') AS component FROM part")
def b5_path_component(spark, sf):
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.path_component(F.concat("p_name", F.lit(": "), "p_brand", F.lit("/"), "p_type", F.lit("__x_"))).alias("component"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_size * 1024 WHEN 2 THEN CAST(floor(p_size / 10.0 * 1048576) AS BIGINT) WHEN 3 THEN NULL ELSE p_size END AS bytes FROM part")
def b6_parse_size(spark, sf):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 5 == 0, "-").when(F.col("p_size") % 5 == 1, F.concat(n, F.lit("K"))).when(F.col("p_size") % 5 == 2, F.concat((F.col("p_size") / 10).cast("decimal(6,1)").cast("string"), F.lit("m"))).when(F.col("p_size") % 5 == 3, F.concat(F.lit("-"), n)).otherwise(n)
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.size_bytes(text).alias("bytes"))


@query("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mp4' WHEN 2 THEN 'image' WHEN 3 THEN 'srt' WHEN 4 THEN 'scc' ELSE 'other' END AS kind FROM part")
def b8_file_type(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("MP4", "mov", "Jpeg", "srt", "SCC", "docx"))), F.col("p_size") % 6 + 1)
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.file_type(F.concat("p_name", F.lit(".x."), ext)).alias("kind"))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(concat(p_name, ' / ', p_brand, ' (', p_type, ')')), '[^a-z0-9]+', '_', 'g'), '_') AS rule_id FROM part")
def b21_slug(spark, sf):
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.slug(F.concat("p_name", F.lit(" / "), "p_brand", F.lit(" ("), "p_type", F.lit(")"))).alias("rule_id"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'M' || CAST(page_id AS STRING) WHEN 1 THEN 'M' || CAST(page_id AS STRING) END AS media_id FROM pages")
def b29_audit_path(spark, sf):
    """The media id in the path of an audited request, for an asset or a stream; other paths have none."""
    ident = F.concat(F.lit("M"), F.col("page_id").cast("string"))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/api/mmingest/asset/"), ident)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/api/mmingest/asset/"), ident, F.lit("/captions?x=1"))).otherwise("/api/mmingest/search?q=asset")
    return raw(spark, sf, "pages").select("page_id", T.group(path, r"/asset/([^/?]+)").alias("media_id"))


@query("SELECT DISTINCT p_brand, CASE CAST(substring(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'haiku' WHEN 1 THEN 'sonnet' WHEN 2 THEN 'opus' END AS family, CASE CAST(substring(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'sonnet' WHEN 1 THEN 'opus' END AS bumped FROM part")
def b30_model_family(spark, sf):
    """B30 and B31."""
    kinds = F.array(*map(F.lit, ("x/Haiku-4", "sonnet:beta", "big-OPUS", "other")))
    rows = raw(spark, sf, "part").select("p_brand", F.element_at(kinds, F.substring("p_brand", 7, 9).cast("int") % 4 + 1).alias("model")).distinct()
    family = T.model_family(F.col("model"))
    return rows.select("p_brand", family.alias("family"), T.next_family(family).alias("bumped"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, ms, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt, CASE WHEN ms >= 3600000 THEN printf('%d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) ELSE printf('%d:%02d', ms // 60000, ms // 1000 % 60) END AS shown, ms AS back
FROM (SELECT *, CAST(floor(l_extendedprice * 100) AS BIGINT) AS ms FROM lineitem)""")
def b40_timecodes(spark, sf):
    """Emitted and parsed again."""
    ms = F.col("ms")
    rows = raw(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "CAST(floor(l_extendedprice * 100) AS BIGINT) AS ms")
    return rows.select("id", "ms", TM.srt_time(ms).alias("srt"), TM.display_time(ms).alias("shown"), TM.srt_ms(TM.srt_time(ms)).alias("back"))


@query("""SELECT id, t, CASE WHEN id % 4 = 3 OR s >= 60 OR (h IS NOT NULL AND m >= 60) THEN NULL ELSE ((coalesce(h, 0) * 60 + m) * 60 + s) * 1000 + coalesce(f, 0) END AS ms FROM (SELECT id, h, m, s, f, concat(coalesce(CAST(h AS STRING) || ':', ''), CAST(m AS STRING), ':', lpad(CAST(s AS STRING), 2, '0'), CASE id % 4 WHEN 1 THEN '.5' WHEN 3 THEN 'x' ELSE '' END) AS t
FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 END AS h, p_partkey % 90 AS m, p_size + 20 AS s, CASE WHEN p_partkey % 4 = 1 THEN 500 END AS f FROM part))""")
def b42_strict_timecode(spark, sf):
    hours = F.when(F.col("p_partkey") % 2 == 0, F.concat((F.col("p_partkey") % 5).cast("string"), F.lit(":"))).otherwise("")
    end = F.when(F.col("p_partkey") % 4 == 1, ".5").when(F.col("p_partkey") % 4 == 3, "x").otherwise("")
    t = F.concat(hours, (F.col("p_partkey") % 90).cast("string"), F.lit(":"), F.lpad((F.col("p_size") + 20).cast("string"), 2, "0"), end)
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), t.alias("t")).select("id", "t", TM.strict_ms(F.col("t")).alias("ms"))


# joins


@query(f"{_F} SELECT f.id, s.s_name, n.n_name FROM files f JOIN supplier s ON s.s_suppkey = f.id % 100 JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE f.status = 'new' AND f.file_type = 'srt'")
def d1_three_way_join(spark, sf):
    rows = files(spark, sf).where("status = 'new' AND file_type = 'srt'").select("id", (F.col("id") % 100).alias("s_suppkey"))
    return rows.join(raw(spark, sf, "supplier"), "s_suppkey").join(raw(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("id", "s_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def d2_anti_join(spark, sf):
    done = raw(spark, sf, "orders").where("o_custkey IS NOT NULL AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return raw(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query(f"{_F} SELECT DISTINCT remote_url FROM files WHERE remote_url NOT IN (SELECT remote_url FROM files WHERE superseded AND file_type = 'srt' AND variant_tag IS NULL)")
def d3_untracked(spark, sf):
    """What isn't tracked yet, each once."""
    tracked = files(spark, sf).where("superseded AND file_type = 'srt' AND variant_tag IS NULL").select("remote_url")
    return files(spark, sf).select("remote_url").dropDuplicates(["remote_url"]).join(tracked, "remote_url", "left_anti")


_KNOWN = "SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN file_size_bytes + 1 ELSE file_size_bytes END AS file_size_bytes, remote_modified_at FROM files WHERE id % 3 <> 0"


def known(spark, sf) -> DataFrame:
    return files(spark, sf).where("id % 3 <> 0").selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN file_size_bytes + 1 ELSE file_size_bytes END AS file_size_bytes", "remote_modified_at")


@query(f"{_F}, k AS ({_KNOWN}) SELECT f.id, CASE WHEN k.id IS NULL THEN 'new' WHEN coalesce(f.file_size_bytes <> k.file_size_bytes, false) OR coalesce(f.remote_modified_at <> k.remote_modified_at, false) THEN 'changed' ELSE 'same' END AS change FROM files f LEFT JOIN k ON f.id = k.id")
def d4_delta(spark, sf):
    """Only what is known on both sides can have changed."""
    seen = files(spark, sf).select("id", "file_size_bytes", "remote_modified_at")
    return M.delta(seen, known(spark, sf), "id", ["file_size_bytes", "remote_modified_at"]).select("id", "change")


@query(f"{_F} SELECT CASE WHEN k.id IS NULL THEN 'new' WHEN coalesce(f.file_size_bytes <> k.file_size_bytes, false) THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM files f LEFT JOIN ({_KNOWN}) k ON f.id = k.id GROUP BY 1")
def j6_crawl_summary(spark, sf):
    """New, changed and unchanged files told apart (Q12)."""
    seen = files(spark, sf).select("id", "file_size_bytes")
    return M.delta(seen, known(spark, sf), "id", ["file_size_bytes"]).groupBy("change").agg(F.count("*").alias("n"))


_WALK = f"""{_F}, s AS (SELECT f.*, concat_ws('-', remote_url, CAST(file_size_bytes AS STRING)) AS url, id % 3 <> 0 AS was, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN file_size_bytes + 1 ELSE file_size_bytes END AS old_size FROM files f),
c AS (SELECT *, CASE WHEN NOT was THEN 'new' WHEN coalesce(file_size_bytes <> old_size, false) THEN 'changed' ELSE 'same' END AS change FROM s)"""


#: Files that a turn of a walk takes.
WALK_ROWS = 20_000_000


@lru_cache(maxsize=4)
def walked(spark, sf):
    """Two walks: what is known, then all files, with the second one delivered twice. The queries over one folder share them."""
    slices = max(1, -(-files(spark, sf).count() // WALK_ROWS))
    parts = W.tables(spark, scratch(spark, "index"), many=True, slices=slices)
    f = files(spark, sf).select(F.concat_ws("-", "remote_url", F.col("file_size_bytes").cast("string")).alias("url"), "id", "directory_path", "media_id", "variant_tag", "unknown_tag", "revision_date", "file_type", F.col("file_size_bytes").alias("size"), F.col("remote_modified_at").alias("modified"))
    at = lambda day: F.lit(f"2025-01-0{day}").cast("timestamp_ntz").alias("at")
    old = f.where("id % 3 <> 0").withColumn("size", F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN size + 1 ELSE size END"))
    bodies = f.where("id % 10 <> 0").select("url", F.concat(F.lit("Captions of "), "url").alias("body_text"))
    W.walk(parts, 0, old.select("*", at(1)), bodies)
    run = W.walk(parts, 1, f.select("*", at(2)), bodies)
    assert W.walk(parts, 1, f.select("*", at(3)), bodies) is None
    return parts, run


@query(f"{_WALK} SELECT url, id, CASE WHEN change = 'same' THEN old_size ELSE file_size_bytes END AS size, CASE WHEN was THEN DATE '2025-01-01' ELSE DATE '2025-01-02' END AS first_seen, CASE WHEN change = 'same' THEN DATE '2025-01-01' ELSE DATE '2025-01-02' END AS last_seen FROM c")
def j6a_walk_files(spark, sf):
    """The files after a walk: new ones, changed ones, and those that stay."""
    return walked(spark, sf)[0].current("files").select("url", "id", "size", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"))


@query(f"{_F}, lin AS (SELECT id, first_value(id) OVER (PARTITION BY media_id, variant_tag, file_type ORDER BY revision_date DESC NULLS LAST, id) AS winner FROM files WHERE media_id IS NOT NULL AND unknown_tag IS NULL) SELECT id, CASE WHEN winner <> id THEN winner END AS superseded_by FROM lin")
def j6b_walk_lineage(spark, sf):
    """The lineage that a walk leaves, also of groups that span directories."""
    return walked(spark, sf)[0].current("lineage").select("id", "superseded_by")


@query(f"{_F} SELECT id AS file_id, concat('Captions of ', remote_url, '-', CAST(file_size_bytes AS STRING)) AS body_text FROM files WHERE file_type IN ('srt', 'scc') AND id % 10 <> 0")
def j6c_walk_side_files(spark, sf):
    """One side file a file, whose fetch didn't fail."""
    return walked(spark, sf)[0].current("side_files").select("file_id", "body_text")


@query(f"""{_WALK} SELECT count(*) AS seen, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'same') AS same, count(*) FILTER (change <> 'same' AND file_type IN ('srt', 'scc')) AS fetched,
count(*) FILTER (change <> 'same' AND file_type IN ('srt', 'scc') AND id % 10 <> 0) AS persisted, count(*) FILTER (file_type IN ('srt', 'scc') AND id % 10 = 0) AS parity FROM c""")
def j6d_walk_run(spark, sf):
    """The account of a walk, counted while it ran."""
    return spark.createDataFrame([vars(walked(spark, sf)[1])], "seen long, new long, changed long, same long, fetched long, persisted long, parity long")


@query("SELECT p_partkey, p_brand, round(p_size / 1e6 * coalesce(price, 3.0), 9) AS cost FROM part LEFT JOIN (VALUES ('Brand#1', CAST(1.5 AS DOUBLE)), ('Brand#2', CAST(2.5 AS DOUBLE))) t(brand, price) ON p_brand = brand")
def d6_price_lookup(spark, sf):
    """A default where no price is known."""
    prices = spark.createDataFrame([("Brand#1", 1.5), ("Brand#2", 2.5)], "p_brand string, price double")
    return raw(spark, sf, "part").join(F.broadcast(prices), "p_brand", "left").select("p_partkey", "p_brand", F.round(F.col("p_size") / 1e6 * F.coalesce("price", F.lit(3.0)), 9).alias("cost"))


@query("WITH r AS (SELECT l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS record FROM lineitem GROUP BY l_partkey) SELECT p_partkey, record FROM part LEFT JOIN r ON p_partkey = l_partkey")
def d7_last_record(spark, sf):
    """Of several records of an id, the last wins."""
    last = rank_one(raw(spark, sf, "lineitem"), ["l_partkey"], F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    return raw(spark, sf, "part").select("p_partkey").join(last.select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("record")), "p_partkey", "left")


@query(f"""{_F}, lin AS (SELECT *, first_value(id) OVER (PARTITION BY media_id, variant_tag, file_type ORDER BY revision_date DESC NULLS LAST, id) AS winner FROM files WHERE media_id IS NOT NULL AND unknown_tag IS NULL)
SELECT a.id AS old_id, b.id AS new_id, b.remote_url AS new_url, b.revision_date AS new_revision FROM lin a LEFT JOIN files b ON b.id = a.winner AND a.winner <> a.id""")
def d8_superseding_row(spark, sf):
    """Each file with the one that superseded it, where there is one."""
    f = files(spark, sf)
    newer = f.select(F.col("id").alias("superseded_by"), F.col("remote_url").alias("new_url"), F.col("revision_date").alias("new_revision"))
    return M.lineage(f).join(newer, "superseded_by", "left").select(F.col("id").alias("old_id"), F.col("superseded_by").alias("new_id"), "new_url", "new_revision")


@query("""WITH m AS (SELECT o_orderkey AS src, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS live FROM orders WHERE o_orderkey % 2 = 0)
SELECT event_id, live AS job_id FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS src FROM events) e LEFT JOIN m ON m.src = e.src WHERE e.src IS NULL OR live IS NOT NULL""")
def d11_id_remap(spark, sf):
    """The other store's ids move to new ones that follow the live ones without gaps; events of unknown jobs are dropped, those without a job stay."""
    orders = raw(spark, sf, "orders")
    last = orders.where("o_orderkey % 2 = 1").agg(F.max("o_orderkey")).first()[0] or 0
    idmap = numbered(orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("src"), "o_orderdate"), ["o_orderdate", "src"], "job_id", after=last)
    e = raw(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("src"))
    return e.where("src IS NOT NULL").join(idmap, "src").select("event_id", "job_id").unionByName(e.where("src IS NULL").select("event_id", F.lit(None).cast("long").alias("job_id")))


@query("SELECT o_orderkey, CASE WHEN m < 10 THEN 5 WHEN m < 20 THEN 8 WHEN m < 30 THEN 12 ELSE 15 END AS cap FROM (SELECT o_orderkey, o_custkey % 40 AS m FROM orders)")
def d14_range_lookup(spark, sf):
    """The first cap whose bound is above the duration, or has none."""
    caps = spark.createDataFrame([(10, 5), (20, 8), (30, 12), (None, 15)], "lt int, cap int")
    rows = raw(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("m"))
    hit = rows.join(F.broadcast(caps), F.col("lt").isNull() | (F.col("m") < F.col("lt")))
    return hit.groupBy("o_orderkey").agg(F.min_by("cap", F.coalesce("lt", F.lit(2**31 - 1))).alias("cap"))


@query(f"""{_F}, w AS (SELECT id, row_number() OVER (PARTITION BY media_id, variant_tag ORDER BY revision_date DESC NULLS LAST, id) AS nth FROM files WHERE unknown_tag IS NULL) SELECT id FROM w WHERE nth = 1""")
def f1_rank_one(spark, sf):
    return rank_one(files(spark, sf).where("unknown_tag IS NULL"), ["media_id", "variant_tag"], F.desc_nulls_last("revision_date"), F.asc("id")).select("id")


_LIN = "lin AS (SELECT id, CASE WHEN winner <> id THEN winner END AS superseded_by FROM (SELECT id, first_value(id) OVER (PARTITION BY media_id, variant_tag, file_type ORDER BY revision_date DESC NULLS LAST, id) AS winner FROM files WHERE media_id IS NOT NULL AND unknown_tag IS NULL))"


@query(f"{_F}, {_LIN} SELECT id, superseded_by FROM lin")
def f2_lineage(spark, sf):
    return M.lineage(files(spark, sf))


@query(f"""{_F}, {_LIN}, r AS (SELECT f.*, superseded_by FROM files f LEFT JOIN lin ON f.id = lin.id WHERE media_id IS NOT NULL)
SELECT media_id, coalesce(string_agg(CAST(id AS STRING), ',' ORDER BY id) FILTER (superseded_by IS NULL AND coalesce(variant_tag, unknown_tag) IS NULL), '') AS primary_ids, coalesce(string_agg(CAST(id AS STRING), ',' ORDER BY id) FILTER (superseded_by IS NULL AND coalesce(variant_tag, unknown_tag) IS NOT NULL), '') AS variant_ids,
count(*) FILTER (superseded_by IS NOT NULL) AS n_superseded FROM r GROUP BY media_id""")
def j2_asset_resolve(spark, sf):
    """J2 and N7."""
    f = files(spark, sf)
    out = M.resolved(f, M.lineage(f))
    return out.select("media_id", F.array_join("primary", ",").alias("primary_ids"), F.array_join("variants", ",").alias("variant_ids"), F.size("superseded").cast("long").alias("n_superseded"))


@query(f"{_F} SELECT media_id, arg_min(remote_url, (first_seen_at, id)) AS url FROM files WHERE file_type = 'srt' AND media_id IS NOT NULL GROUP BY media_id")
def j5_captions_body(spark, sf):
    """One side file of an id, the first by time and id."""
    srt = files(spark, sf).where("file_type = 'srt' AND media_id IS NOT NULL")
    return srt.groupBy("media_id").agg(F.min_by("remote_url", F.struct("first_seen_at", "id")).alias("url"))


_OLD = "SELECT id, file_size_bytes AS size, first_seen_at AS seen FROM files WHERE id % 3 <> 0"
_NEW = "SELECT id, file_size_bytes + 5 AS size, first_seen_at + INTERVAL '1' DAY AS seen FROM files WHERE id % 2 = 0"


def versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The files as they were stored and as they are seen now."""
    f = files(spark, sf)
    old = f.where("id % 3 <> 0").selectExpr("id", "file_size_bytes AS size", "first_seen_at AS seen")
    return old, f.where("id % 2 = 0").selectExpr("id", "file_size_bytes + 5 AS size", "first_seen_at + INTERVAL '1' DAY AS seen")


@query(f"{_F}, o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.id, o.id) AS id, coalesce(n.size, o.size) AS size, coalesce(o.seen, n.seen) AS seen FROM o FULL JOIN n ON o.id = n.id")
def l1_upsert(spark, sf):
    """New values win, the first sighting stays."""
    old, new = versions(spark, sf)
    return M.upsert(old, new, "id", keep="seen")


@query(f"{_F}, o AS ({_OLD}), n AS ({_NEW}) SELECT o.id, coalesce(CASE WHEN o.id % 4 = 0 THEN NULL ELSE o.size END, n.size) AS size FROM o LEFT JOIN n ON o.id = n.id")
def l3_backfill(spark, sf):
    """Only what is missing gets filled."""
    before, after = versions(spark, sf)
    old = before.select("id", F.when(F.col("id") % 4 != 0, F.col("size")).alias("size"))
    return old.join(after.select("id", F.col("size").alias("found")), "id", "left").select("id", F.coalesce("size", "found").alias("size"))


@query(f"{_F}, o AS ({_OLD}), n AS ({_NEW}) SELECT n.id, o.size IS NOT DISTINCT FROM n.size - 5 AS accepted FROM n LEFT JOIN o ON o.id = n.id")
def l13_optimistic_edits(spark, sf):
    """An edit is accepted if the value is still the one it expected."""
    old, new = versions(spark, sf)
    edits = new.select("id", (F.col("size") - 5).alias("expected"))
    return edits.join(old.select("id", "size"), "id", "left").select("id", F.col("size").eqNullSafe(F.col("expected")).alias("accepted"))


@query("SELECT count(*) AS texts, count(*) FILTER (regexp_matches(lower(text), '[a-z0-9]')) AS indexed, count(*) - count(*) FILTER (regexp_matches(lower(text), '[a-z0-9]')) AS delta FROM documents")
def e18_index_parity(spark, sf):
    """Texts, those that the index's postings name, and the difference: texts without a word."""
    docs = raw(spark, sf, "documents")
    indexed = S.postings(docs).select("doc_id").distinct()
    both = docs.select("doc_id").join(indexed.withColumn("_in", F.lit(1)), "doc_id", "left")
    return both.agg(F.count("*").alias("texts"), F.count("_in").alias("indexed"), (F.count("*") - F.count("_in")).alias("delta"))


@query(f"""{_F} SELECT id, CASE WHEN media_id IS NULL THEN 'no_match' WHEN nth > 1 THEN 'duplicate' ELSE 'attached' END AS outcome FROM (SELECT id, media_id, row_number() OVER (PARTITION BY media_id, directory_path ORDER BY id) AS nth FROM files WHERE file_type = 'image')""")
def j11_attach_outcome(spark, sf):
    """A file name is attached to its record once."""
    nth = F.row_number().over(Window.partitionBy("media_id", "directory_path").orderBy("id"))
    rows = files(spark, sf).where("file_type = 'image'").select("id", "media_id", nth.alias("nth"))
    return rows.select("id", F.when(F.col("media_id").isNull(), "no_match").when(F.col("nth") > 1, "duplicate").otherwise("attached").alias("outcome"))


@query(f"{_F} SELECT id, CASE WHEN id % 6 = 0 AND file_type IN ('srt', 'transcript') AND status <> 'queued' THEN 'ignored' WHEN id % 6 = 1 AND status = 'ignored' THEN 'new' ELSE status END AS status FROM files")
def n12_ignore_flips(spark, sf):
    flip = F.when((F.col("id") % 6 == 0) & F.col("file_type").isin("srt", "transcript") & (F.col("status") != "queued"), "ignored").when((F.col("id") % 6 == 1) & (F.col("status") == "ignored"), "new").otherwise(F.col("status"))
    return files(spark, sf).select("id", flip.alias("status"))


@query("SELECT p_brand AS id, min(p_partkey) AS first_id, arg_max(p_name, (p_retailprice, -p_partkey)) AS newest FROM part GROUP BY p_brand")
def f15_roster(spark, sf):
    """First id of a roster entry and the newest of a family."""
    return raw(spark, sf, "part").groupBy(F.col("p_brand").alias("id")).agg(F.min("p_partkey").alias("first_id"), F.max_by("p_name", F.struct("p_retailprice", -F.col("p_partkey"))).alias("newest"))


@query("SELECT s_suppkey, s_nationkey % 3 = 0 AS has_host, s_name, row_number() OVER (PARTITION BY s_nationkey % 3 = 0 ORDER BY s_name, s_suppkey) AS place FROM supplier")
def g11_grouped_order(spark, sf):
    """A place in each group by name, ties by key."""
    rows = raw(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3 == 0).alias("has_host"), "s_name")
    return numbered(rows, ["s_name", "s_suppkey"], "place", by=["has_host"])
