"""Caption, rule and search queries (A9, A17, B9-B27, D10, D12, D15, F3-F13, H4, H6, I, J1, J3, J4)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import captions as C
from weftline.operators import diff as D
from weftline.operators import phrases as P
from weftline.operators import rules as R
from weftline.operators import search as S
from weftline.operators.jobs import rank_one
from weftline.operators.joins import bounded
from weftline.operators.text_index import TextIndex, search_files
from weftline.plans.registry import query
from weftline.session import text_batches
from weftline.sources.files import scratch
from weftline.sources.tables import cte, raw, role

_L = "WITH s AS (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents), lines AS (SELECT doc_id, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM s)"
_TC = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


def docs(spark, sf) -> DataFrame:
    return raw(spark, sf, "documents").select("doc_id", "text", "lang")


def captions(spark, sf) -> DataFrame:
    """(doc_id, captions): documents written as SRT and parsed again."""
    return C.document_captions(docs(spark, sf)).select("doc_id", C.parse_srt(F.col("srt")).alias("captions"))


def lines(spark, sf) -> DataFrame:
    return docs(spark, sf).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


@query(f"{_L} SELECT doc_id, CAST(n AS INT) AS index, CAST((n - 1) * 3000 AS BIGINT) AS start_ms, CAST((n - 1) * 3000 + 2500 AS BIGINT) AS end_ms, line AS text FROM lines WHERE trim(line) <> ''")
def a9_srt_reader(spark, sf):
    return captions(spark, sf).select("doc_id", F.explode("captions").alias("c")).select("doc_id", "c.*")


@query(f"""{_L}, c AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, (n - 1) * 3000 AS a FROM lines WHERE trim(line) <> '')
SELECT doc_id, md5(string_agg(concat(CAST(k AS STRING), chr(10), {_TC.format('CAST(a AS BIGINT)')}, ' --> ', {_TC.format('CAST(a + 2500 AS BIGINT)')}, chr(10), line, chr(10)), chr(10) ORDER BY k)) AS srt_md5 FROM c GROUP BY doc_id""")
def a17_srt_sink(spark, sf):
    return captions(spark, sf).where(F.size("captions") > 0).select("doc_id", F.md5(C.emit_srt(F.col("captions")).cast("binary")).alias("srt_md5"))


@query(f"{_L} SELECT doc_id, CAST(coalesce(max((n - 1) * 3000 + 2500) FILTER (trim(line) <> ''), 0) AS BIGINT) AS end_ms FROM lines GROUP BY doc_id")
def e23_max_end(spark, sf):
    """From the array, without exploding it."""
    return captions(spark, sf).select("doc_id", F.coalesce(F.array_max(F.transform("captions", lambda c: c["end_ms"])), F.lit(0).cast("long")).alias("end_ms"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INT) AS words, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / 150.0, 2) AS minutes, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / 150.0 > 15 AS is_long FROM documents")
def b45_transcript_metrics(spark, sf):
    n = T.word_count(F.col("text"))
    return docs(spark, sf).select("doc_id", n.alias("words"), F.round(n / 150.0, 2).alias("minutes"), (n / 150.0 > 15).alias("is_long"))


@query("SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))), '|')) AS grams, len(w) AS n_words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']{3,}') AS w FROM documents)")
def b24_trigram_words(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z']{3,})"), 1)
    return docs(spark, sf).select("doc_id", F.md5(F.array_join(F.array_sort(T.trigrams(F.col("text"))), "|").cast("binary")).alias("grams"), F.size(words).cast("long").alias("n_words"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[#*$%&|<>]')) AS marks, CASE WHEN length(flat) > 40 THEN rtrim(left(flat, 39)) || '…' ELSE flat END AS excerpt FROM (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')) AS flat FROM documents)")
def b22_excerpt(spark, sf):
    return docs(spark, sf).select("doc_id", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("marks"), T.excerpt(F.col("text")).alias("excerpt"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, n + CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS words, n AS source_words FROM w""")
def b25_content_words(spark, sf):
    """A formatted body with a header and a status line, with a heading and a label, or plain; and an SRT source's plain text."""
    plain = F.regexp_replace("text", r"[*#]", "x")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<!-- model: x -->\n**Project:** p\n---\n"), plain, F.lit("\n**Status:** ready for all")))
    body = body.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<!-- a comment\nof two lines -->Head\n---\n## Part\n**Ann:**\n"), plain)).otherwise(F.concat(F.lit("h\n---\n***Bold*** "), plain))
    srt = F.concat(F.lit("1\n00:00:00,000 --> 00:00:02,000\n"), F.regexp_replace(plain, r"(?m)^\s*\d+\s*$", "x"))
    return docs(spark, sf).select("doc_id", T.content_words(body).cast("long").alias("words"), T.word_count(T.srt_plain(srt)).cast("long").alias("source_words"))


@query(f"""{_L} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT regexp_matches(line, '[.!?…"”'')\\]]\\s*$')) AS unended FROM lines WHERE trim(line) <> '' GROUP BY doc_id""")
def i9_line_endings(spark, sf):
    ends = F.col("line").rlike(r"[.!?…\"”')\]]\s*$")
    return lines(spark, sf).where("trim(line) <> ''").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(~ends).alias("unended"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) < 50 AS missing FROM documents")
def i4_output_missing(spark, sf):
    return docs(spark, sf).select("doc_id", R.output_missing(F.col("text")).alias("missing"))


_LIMITS = [("title", 60), ("description", 150)]


@query("SELECT doc_id, concat('limits.', field, '.max') AS rule_id, 'error' AS severity, concat(field, ' has ', CAST(length(value) AS STRING), ' of ', CAST(max AS STRING)) AS message FROM (SELECT doc_id, 'title' AS field, string_split(text, chr(10))[1] AS value, 60 AS max FROM documents UNION ALL SELECT doc_id, 'description', text, 150 FROM documents) WHERE length(value) > max")
def i1_limit_findings(spark, sf):
    """I1, I6 and I22."""
    limits = spark.createDataFrame(_LIMITS, "field string, max int")
    d = docs(spark, sf)
    fields = d.select("doc_id", F.lit("title").alias("field"), F.split("text", "\n")[0].alias("value")).unionByName(d.select("doc_id", F.lit("description").alias("field"), F.col("text").alias("value")))
    return R.limit_findings(fields, limits)


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n, 'warning' AS severity FROM documents WHERE len(string_split(text, chr(10))) NOT BETWEEN 2 AND 20")
def i1b_count_findings(spark, sf):
    limits = spark.createDataFrame([("lines", 2, 20)], "field string, min_count int, max_count int")
    fields = docs(spark, sf).select("doc_id", F.lit("lines").alias("field"), F.split("text", "\n").alias("items"))
    return R.count_findings(fields, limits).select("doc_id", F.col("message").cast("long").alias("n"), "severity")


_PHRASES = [("stupid", "stupid"), ("worthless", "worthless"), ("we", "we|our|us"), ("you", "you|your"), ("onthe", r"of\s+the")]


@query("""WITH n AS (SELECT doc_id, unnest(['stupid', 'worthless', 'we', 'you', 'onthe']) AS id, unnest([len(regexp_extract_all(text, '(?i)\\bstupid\\b')), len(regexp_extract_all(text, '(?i)\\bworthless\\b')), len(regexp_extract_all(text, '(?i)\\b(we|our|us)\\b')), len(regexp_extract_all(text, '(?i)\\b(you|your)\\b')), len(regexp_extract_all(text, '(?i)\\bof[ \\t\\n\\r\\x0b\\f]+the\\b'))]) AS n FROM documents)
SELECT doc_id, id, CAST(n AS INT) AS n FROM n WHERE n > 0""")
def d15_rules_by_text(spark, sf):
    """Every rule against every text, the rules being few."""
    return R.phrase_counts(docs(spark, sf), spark.createDataFrame(_PHRASES, "id string, pattern string"))


_TOK = "'[a-z0-9]+|[^a-z0-9\\s]'"


@query(f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]|_', '.', 'g')), {_TOK}), lambda t: t) AS ws FROM documents), p AS (SELECT min(doc_id) AS id, a, b FROM (SELECT doc_id, ws[1] AS a, ws[2] AS b FROM w WHERE len(ws) >= 2) GROUP BY a, b),
t AS (SELECT doc_id, unnest(ws) AS a, unnest(list_concat(ws[2:], [NULL])) AS b FROM w), n AS (SELECT doc_id, id, count(*) AS n FROM t JOIN p ON t.a = p.a AND t.b = p.b GROUP BY ALL)
SELECT doc_id, 'voice.forbidden.' || CAST(id AS STRING) AS rule_id, CASE WHEN id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, n FROM n""")
def i2b_phrase_findings(spark, sf):
    """I2, I15 and D15 by a table of rules: the first two words of every document, found in all documents; as many phrases as documents."""
    plain = lambda text: F.lower(F.regexp_replace(text, r"[_\x{80}-\x{10FFFF}]", "."))
    texts = docs(spark, sf).select("doc_id", plain(F.col("text")).alias("text"))
    first = F.regexp_extract("text", r"\A\s*+(?:[A-Za-z0-9]++|[^A-Za-z0-9\s])\s*+(?:[A-Za-z0-9]++|[^A-Za-z0-9\s])", 0)
    phrase = F.regexp_replace(plain(first), r"\A\s*+([a-z0-9]++|[^a-z0-9\s])\s*+", "$1 ")
    rules = docs(spark, sf).select("doc_id", phrase.alias("phrase")).where("phrase <> ''").groupBy("phrase").agg(F.min("doc_id").alias("id"))
    rules = rules.withColumn("severity", F.when(F.col("id") % 2 == 0, "error").otherwise("warning"))
    return P.phrase_findings(texts, rules).groupBy("doc_id", "rule_id", "severity").agg(F.count("*").alias("n"))


_SPANS = " UNION ALL ".join(f"SELECT doc_id, '{i}' AS id, regexp_extract_all(text, {p}) AS vs, string_split_regex(text, {p}) AS gs FROM documents" for i, p in ((i, "'(?i)\\b(?:" + p.replace("\\s+", "[ \\t\\n\\r\\x0b\\f]+") + ")\\b'") for i, p in _PHRASES))


@query(f"""WITH f AS ({_SPANS}), u AS (SELECT doc_id, id, i, vs[i] AS v, gs[i] AS g FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM f)), e AS (SELECT doc_id, id, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id, id ORDER BY i) AS INTEGER) AS e FROM u)
SELECT doc_id, id, CAST(e - length(v) AS INTEGER) AS start, e AS "end" FROM e""")
def i2_phrase_spans(spark, sf):
    """Each match with its span."""
    spans = R.phrase_spans(_PHRASES)
    return docs(spark, sf).select("doc_id", F.explode(spans("text")).alias("s")).select("doc_id", "s.*")


@query()
def b9_guarded_substitutions(spark, sf):
    """With the guard that reverts a text whose word count moves by more than half a percent."""
    apply = R.guarded_substitutions([(r"\bthe\b", "The"), (r"\bof of\b", "of"), (r"\bis\b", "was")])
    rows = text_batches(docs(spark, sf)).select("doc_id", "text", apply("text").alias("r"))
    ratio = T.word_count(F.col("r.text")) / F.greatest(T.word_count(F.col("text")), F.lit(1))
    told = rows.select("doc_id", "text", "r", ratio.between(0.995, 1.005).alias("ok"))
    return told.select("doc_id", F.col("r.count").alias("applied"), (~F.col("ok")).alias("reverted"), F.md5(F.when(F.col("ok"), F.col("r.text")).otherwise(F.col("text")).cast("binary")).alias("text_md5"))


@query("SELECT c_custkey, concat(upper(left(lower(t), 1)), substring(replace(replace(lower(t), 'usa', 'USA'), 'lake radio', 'LAKE Radio'), 2)) AS title FROM (SELECT c_custkey, concat('The ', c_mktsegment, ' of USA and LAKE RADIO ', CAST(c_nationkey AS STRING)) AS t FROM customer)")
def b11_down_style(spark, sf):
    title = F.concat(F.lit("The "), F.col("c_mktsegment"), F.lit(" of USA and LAKE RADIO "), F.col("c_nationkey").cast("string"))
    return raw(spark, sf, "customer").select("c_custkey", R.down_style(title, ["LAKE Radio", "USA", "Radio"]).alias("title"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN rtrim(regexp_replace(left(text, 99), '\\s\\S*$', '')) || '…' ELSE text END AS cut FROM documents")
def b14_truncate(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncated(F.col("text"), 100).alias("cut"))


@query("SELECT doc_id, string_split(text, chr(10))[1] AS recommended, array_to_string(list_filter(list_transform(string_split(string_split(text, chr(10))[1], ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM documents")
def b15_field_extract(spark, sf):
    """A recommended value under a heading and a tag list in a fence, of any text."""
    first = F.split("text", "\n")[0]
    page = F.concat(F.lit("## Title\n\n**Recommended:** "), first, F.lit("\n\n```tags\n"), first, F.lit("\n```\n"))
    tags = F.filter(F.transform(F.split(F.regexp_extract("page", r"(?s)```tags\n(.*?)\n```", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return docs(spark, sf).select("doc_id", page.alias("page")).select("doc_id", F.regexp_extract("page", r"## Title\s+\*\*Recommended:\*\* ([^\n]*)", 1).alias("recommended"), F.array_join(tags, "|").alias("tags"))


@query(r"SELECT doc_id, regexp_replace(text, '\A[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+\z', '', 'g') AS body, regexp_replace(regexp_replace(text, '\A[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+\z', '', 'g'), '\n---+[ \t\n\r\x0b\f]*\z', '') AS chunk FROM documents")
def b18_strip_wrappers(spark, sf):
    """Think blocks, provenance, lines before a fence, fences and attribution lines go, the text stays."""
    wrapped = F.concat(F.lit("<think>plan\nmore</think>\n```markdown\n"), F.col("text"), F.lit("\n```"))
    signed = F.concat(F.lit("<!-- model: m | tier: 1 -->\nSure, here it is.\n```markdown\n**Model:** x\n"), F.col("text"), F.lit("\n```\n"))
    return docs(spark, sf).select("doc_id", T.strip(T.without_reasoning(wrapped)).alias("body"), T.clean_chunk(signed).alias("chunk"))


@query("""SELECT doc_id, CASE WHEN doc_id % 9 BETWEEN 1 AND 6 AND n >= doc_id % 9 THEN CAST(doc_id % 9 AS INT) ELSE 0 END AS echo FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '')) AS n FROM documents)""")
def f10_seam_echo(spark, sf):
    """a part that starts with the last 0 to 8 items of the one before; six at most count."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = docs(spark, sf).select("doc_id", F.transform(words, lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))).alias("w"))
    m = (F.col("doc_id") % 9).cast("int")
    after = F.concat(F.when((m > 0) & (F.size("w") >= m), F.slice("w", -m, m)).otherwise(F.array().cast("array<string>")), F.array(F.lit("new"), F.lit("words")))
    return rows.select("doc_id", C.seam_echo(F.col("w"), after).alias("echo"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS merged, count(*) AS parts FROM conversations GROUP BY conv_id")
def f11_merge_chunks(spark, sf):
    """the parts of one document, a bounded list, joined in order."""
    rows = raw(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").cast("binary")).alias("merged"), F.size("parts").cast("long").alias("parts"))


_CH = "ch AS (SELECT doc_id, n AS ord, CAST(((n * 7919 + doc_id) % 40) * 1000 AS BIGINT) AS start_ms, left(line, 20) AS title, CAST(30000 AS BIGINT) AS media_end FROM lines)"


def chapters(spark, sf) -> DataFrame:
    rows = lines(spark, sf)
    return rows.select("doc_id", F.col("n").alias("ord"), (((F.col("n") * 7919 + F.col("doc_id")) % 40) * 1000).cast("long").alias("start_ms"), F.substring("line", 1, 20).alias("title"), F.lit(30000).cast("long").alias("media_end"))


@query(f"""{_L}, {_CH}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start_ms ORDER BY ord) AS k FROM ch), e AS (SELECT doc_id, start_ms, title FROM u WHERE k = 1 AND start_ms <> 0 AND start_ms <= media_end UNION ALL SELECT DISTINCT doc_id, 0, 'Intro' FROM ch),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms) AS n FROM e) SELECT doc_id, CAST(n AS INT) AS n, start_ms, title, coalesce(lead(start_ms) OVER (PARTITION BY doc_id ORDER BY start_ms) - 1, 30000) AS end_ms FROM r WHERE n <= 6""")
def f4_snap_chapters(spark, sf):
    """F3, F4 and I17."""
    return C.snapped(chapters(spark, sf), "Intro", 6)


_ST = "st AS (SELECT doc_id, n AS ord, CASE WHEN length(line) < 25 THEN NULL ELSE (n * 31 + doc_id) % 3 <> 0 END AS missing FROM lines)"


@query(f"""{_L}, {_ST}, g AS (SELECT *, sum(CASE WHEN missing = false THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM st)
SELECT doc_id, CAST(min(ord) AS INT) AS first, CAST(max(ord) AS INT) AS last, count(*) AS missing FROM g WHERE missing GROUP BY doc_id, run HAVING count(*) >= 2""")
def f5_islands(spark, sf):
    status = lines(spark, sf).select("doc_id", F.col("n").alias("ord"), F.when(F.length("line") >= 25, (F.col("n") * 31 + F.col("doc_id")) % 3 != 0).alias("missing"))
    return C.missing_runs(status, 2)


_CAP = f"{_L.replace('WITH s', 'WITH RECURSIVE s')}, cap AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, count(*) OVER (PARTITION BY doc_id) AS total, n, line FROM lines WHERE trim(line) <> '')"


@query(f"""{_CAP}, c AS (SELECT doc_id, i, (n - 1) * 3000 AS s, (n - 1) * 3000 + n * 7 % 5 * 900 AS e, line AS t FROM cap), m AS (SELECT doc_id, i, 1 AS k, s, CASE WHEN e <= s THEN s + 1000 ELSE e END AS e, t FROM c WHERE i = 1
UNION ALL SELECT doc_id, i, CASE WHEN same OR short THEN k ELSE k + 1 END, CASE WHEN same OR short THEN s ELSE s1 END, CASE WHEN same THEN greatest(e, ce) ELSE e1 END, CASE WHEN same THEN t WHEN short THEN t || chr(10) || ct ELSE ct END FROM (
SELECT *, e1 - s1 < 1000 AND s1 - e < 500 AS short FROM (SELECT m.doc_id, c.i, m.k, m.s, m.e, m.t, c.e AS ce, c.t AS ct, trim(c.t) = trim(m.t, chr(10) || ' ') AS same, CASE WHEN c.e <= c.s THEN c.s + 1000 ELSE c.e END AS e1, greatest(c.s, m.e + 50) AS s1 FROM m JOIN c ON c.doc_id = m.doc_id AND c.i = m.i + 1)))
SELECT doc_id, CAST(k AS INT) AS index, arg_max(s, i) AS start_ms, arg_max(e, i) AS end_ms, arg_max(t, i) AS text FROM m GROUP BY doc_id, k""")
def f6_clean_captions(spark, sf):
    """F6 on captions of 0 to 3.6 seconds, three seconds apart."""
    clean = F.pandas_udf(C.cleaned, C.CAPTIONS)
    uneven = F.transform("captions", lambda c: F.struct(c["index"].alias("index"), c["start_ms"].alias("start_ms"), (c["start_ms"] + c["index"] * 7 % 5 * 900).alias("end_ms"), c["text"].alias("text")))
    return captions(spark, sf).select("doc_id", F.explode(clean(uneven)).alias("c")).select("doc_id", "c.*")


@query(f"""{_CAP}, t AS (SELECT doc_id, i - 1 AS i, total, CASE WHEN n % 17 = 0 THEN '>> ' ELSE '' END || line AS t FROM cap), w AS (SELECT *, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '')) AS words, lead(starts_with(ltrim(t), '>>')) OVER (PARTITION BY doc_id ORDER BY i) AS before_turn, regexp_matches(trim(t), '[.?!]$') AS ended FROM t),
p AS (SELECT *, sum(words) OVER (PARTITION BY doc_id) AS every, min(CASE WHEN before_turn THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS turn, min(CASE WHEN ended THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS sentence FROM w),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS acc, true AS opens FROM p WHERE i = 0 UNION ALL SELECT doc_id, CASE WHEN cut THEN coalesce(turn, sentence, i) + 1 ELSE i + 1 END, CASE WHEN cut THEN 0 ELSE acc END, cut FROM (SELECT p.doc_id, p.i, p.turn, p.sentence, r.acc + p.words AS acc, r.acc + p.words >= 120 AND p.i < p.total - 1 AND p.every >= 180 AS cut FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i)),
o AS (SELECT r.doc_id, r.i AS first, coalesce(lead(r.i) OVER (PARTITION BY r.doc_id ORDER BY r.i), p.total) AS next, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.i) - 1 AS chunk FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i WHERE opens)
SELECT o.doc_id, CAST(chunk AS INT) AS chunk, CAST(first AS INT) AS first, CAST(next - first AS INT) AS captions, CAST(sum(words) AS BIGINT) AS words FROM o JOIN p ON p.doc_id = o.doc_id AND p.i >= first AND p.i < next GROUP BY ALL""")
def f7_chunk_captions(spark, sf):
    """greedy chunks with look-ahead to a turn's or a sentence's end; short documents are one chunk."""
    marked = F.transform("captions", lambda c: F.struct(c["index"].alias("index"), c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), F.concat(F.when(c["index"] % 17 == 0, ">> ").otherwise(""), c["text"]).alias("text")))
    return C.chunked(captions(spark, sf).select("doc_id", marked.alias("captions")))


@query()
def f12_split_speakers(spark, sf):
    split = F.pandas_udf(C.split_speakers, C.CAPTIONS)
    marked = F.transform("captions", lambda c: F.struct(c["index"].alias("index"), c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), F.replace(c["text"], F.lit(". "), F.lit(". >> ")).alias("text")))
    return text_batches(captions(spark, sf)).select("doc_id", F.explode(split(marked)).alias("c")).select("doc_id", "c.*")


@query(f"{_L}, c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS total, line FROM lines) SELECT doc_id, k, line FROM c WHERE total <= 5 OR k IN (SELECT CAST(floor(i * total / 5) AS BIGINT) FROM (SELECT unnest(range(5)) AS i))")
def f13_even_sample(spark, sf):
    """items int(i * n / 5) of each list."""
    w = Window.partitionBy("doc_id")
    rows = lines(spark, sf).select("doc_id", (F.col("n") - 1).cast("long").alias("k"), F.count("*").over(w).alias("total"), "line")
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * F.col("total") / 5))
    return rows.where((F.col("total") <= 5) | F.array_contains(picks, F.col("k"))).select("doc_id", "k", "line")


@query("""WITH g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']{3,}') AS w FROM documents)), b AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']{3,}') AS w FROM benchmark)),
ge AS (SELECT doc_id, unnest(s) AS t FROM g), be AS (SELECT item_id, len(s) AS size, unnest(s) AS t FROM b) SELECT item_id, doc_id, round(count(*) / any_value(size), 6) AS coverage FROM be JOIN ge USING (t) GROUP BY item_id, doc_id HAVING count(*) / any_value(size) >= 0.5""")
def h4_trigram_overlap(spark, sf):
    """H4: share of a passage's trigrams in a document, through the trigrams that they have in common."""
    own = docs(spark, sf).select("doc_id", F.explode(T.trigrams(F.col("text"))).alias("t"))
    items = raw(spark, sf, "benchmark").select("item_id", T.trigrams(F.col("text")).alias("s"))
    items = items.select("item_id", F.size("s").alias("size"), F.explode("s").alias("t"))
    both = own.join(bounded(items, 500_000), "t").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("size")).alias("coverage"))
    return both.where("coverage >= 0.5").select("item_id", "doc_id", F.round("coverage", 6).alias("coverage"))


@query("""WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), o AS (SELECT doc_id, text, array_to_string(ls[1:CAST(floor(len(ls) * (doc_id % 5 + 6) / 10) AS INT)], chr(10)) AS output FROM s), n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '')) AS source_words, len(list_filter(regexp_split_to_array(output, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '')) AS output_words FROM o)
SELECT doc_id, source_words, output_words, source_words >= 500 AND output_words / source_words < 0.7 AS incomplete FROM n""")
def j3_completeness(spark, sf):
    """Output of 0.7 of the source's words or more is complete; short sources are not judged."""
    n = T.source_words(F.concat(F.lit("1\n00:00:00,000 --> 00:00:02,000\n"), F.col("text"))).cast("long")
    ls = F.split("text", "\n")
    output = F.array_join(F.slice(ls, F.lit(1), F.floor(F.size(ls) * (F.col("doc_id") % 5 + 6) / 10).cast("int")), "\n")
    rows = docs(spark, sf).select("doc_id", n.alias("source_words"), T.word_count(output).cast("long").alias("output_words"))
    return rows.select("doc_id", "source_words", "output_words", ((F.col("source_words") >= 500) & (F.try_divide("output_words", "source_words") < 0.7)).alias("incomplete"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), o AS (SELECT doc_id, ls, regexp_extract_all(lower(array_to_string(ls[1:len(ls) // 3] || ls[2 * (len(ls) // 3) + 1:], chr(10))), '[a-z'']{3,}') AS w FROM d), og AS (SELECT doc_id, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM o),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS ord, regexp_extract_all(lower(unnest(ls)), '[a-z'']{3,}') AS w FROM d), c AS (SELECT doc_id, ord, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS own FROM l),
s AS (SELECT c.doc_id, ord, CASE WHEN len(own) > 0 THEN len(list_intersect(own, g)) / len(own) < 0.34 END AS missing FROM c JOIN og ON c.doc_id = og.doc_id), r AS (SELECT *, sum(CASE WHEN missing = false THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM s)
SELECT doc_id, CAST(min(ord) AS INT) AS first, CAST(max(ord) AS INT) AS last, count(*) AS missing FROM r WHERE missing GROUP BY doc_id, run HAVING count(*) >= 3""")
def j4_seam_coverage(spark, sf):
    """Captions missing from an output that lacks each document's middle third."""
    d = docs(spark, sf).select("doc_id", F.split("text", "\n").alias("ls"))
    third = F.floor(F.size("ls") / 3).cast("int")
    output = d.select("doc_id", F.array_join(F.concat(F.slice("ls", F.lit(1), third), F.slice("ls", 2 * third + 1, F.size("ls"))), "\n").alias("output"))
    own = lines(spark, sf).select("doc_id", F.col("n").alias("ord"), F.col("line").alias("text"))
    return C.missing_runs(C.caption_status(own, output))


@query()
def h6_sequence_diff(spark, sf):
    """Phrases that differ between a line and its edited form."""
    edited = F.regexp_replace(F.regexp_replace("line", r"\bthe\b", "a"), r"\band\b ", "")
    # what is equal differs in nothing, and isn't cut into tokens or sent to Python
    rows = text_batches(lines(spark, sf)).where(F.col("line") != edited).select("doc_id", "n", T.tokens(F.col("line")).alias("old"), T.tokens(edited).alias("new")).where(F.col("old") != F.col("new"))
    return rows.select("doc_id", "n", F.posexplode(D.replaced_phrases()("old", "new")).alias("ord", "p")).select("doc_id", "n", "ord", "p.old", "p.new")


@query("SELECT text_len AS n_tokens, count(*) AS docs FROM (SELECT len(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}''’\\-]+|[^\\p{L}\\p{N}_\\p{M}\\s]')) AS text_len FROM documents) GROUP BY 1")
def b23_tokenise(spark, sf):
    return docs(spark, sf).select(F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("docs"))


_OWN = "WITH l AS (SELECT doc_id, unnest(CASE WHEN doc_id % 4 = 0 THEN [lang, 'Ann ' || lang, 'Ann Lee ' || lang] WHEN doc_id % 4 = 1 THEN ['Bob Day', 'Day Bob', 'Day'] ELSE ['Eve', 'Eva'] END) AS label FROM documents), w AS (SELECT *, list_distinct(string_split(lower(label), ' ')) AS ws FROM l)"


def _own_labels() -> Column:
    """A few labels of each document, some of them parts of others."""
    array = lambda *xs: F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    full = array(F.col("lang"), F.concat(F.lit("Ann "), "lang"), F.concat(F.lit("Ann Lee "), "lang"))
    return F.when(F.col("doc_id") % 4 == 0, full).when(F.col("doc_id") % 4 == 1, array("Bob Day", "Day Bob", "Day")).otherwise(array("Eve", "Eva"))


@query(f"{_OWN} SELECT doc_id, (SELECT count(*) FROM w a JOIN w b ON a.doc_id = b.doc_id AND len(a.ws) < len(b.ws) AND list_has_all(b.ws, a.ws) WHERE a.doc_id = d.doc_id) AS pairs FROM documents d")
def d12_label_subsets(spark, sf):
    """For each document, pairs of labels where one's words are a strict part of the other's."""
    return docs(spark, sf).select("doc_id", F.size(R.subset_labels(_own_labels())).cast("long").alias("pairs"))


@query(f"{_OWN} SELECT a.doc_id, a.label AS short, b.label AS long FROM w a JOIN w b ON a.doc_id = b.doc_id AND len(a.ws) < len(b.ws) AND list_has_all(b.ws, a.ws)")
def d12b_subset_pairs(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(R.subset_labels(_own_labels())).alias("p")).select("doc_id", "p.short", "p.long")


@query()
def d10_greedy_match(spark, sf):
    """Flags claim violations in order, one group a document and source (both few rows)."""
    rows = lines(spark, sf).select(F.col("doc_id").alias("job"), F.col("lang").alias("phase"), F.when(F.col("n") % 2 == 0, "lint").otherwise("flag").alias("kind"), F.col("n").alias("ord"), F.array((F.length("line") % 5).cast("string"), (F.length("line") % 3).cast("string")).alias("rules"))
    return R.matched_flags(rows)


_BM = """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), size AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM documents), tf AS (SELECT t, doc_id, count(*) AS tf FROM w WHERE t IN ('stupid', 'worthless', 'thheer') GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), c AS (SELECT count(*) AS n, avg(len) AS mean FROM size)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (t) JOIN size USING (doc_id), c GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50"""


@query(_BM)
def j1_bm25_search(spark, sf):
    """J1 and G5."""
    return S.bm25(docs(spark, sf), ["stupid", "worthless", "thheer"], 50)


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents) SELECT doc_id FROM w WHERE list_contains(ws, 'the') AND (list_contains(ws, 'stupid') OR list_contains(ws, 'worthless')) AND NOT list_contains(ws, 'pathetic') AND len(list_filter(ws, lambda x: starts_with(x, 'wh'))) > 0""")
def c11_boolean_match(spark, sf):
    """C11: AND, OR, NOT and a prefix, given as lists."""
    return S.matching(S.postings(docs(spark, sf).where(F.contains(F.lower("text"), F.lit("the")))), every=["the"], some=["stupid", "worthless"], none=["pathetic"], prefix="wh")


@query("""WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents) SELECT doc_id FROM w WHERE contains(t, ' of the ')""")
def c11b_phrase_match(spark, sf):
    return S.phrase(S.postings(docs(spark, sf), ["of", "the"]), ["of", "the"])


@query("""WITH h AS (SELECT doc_id FROM ({0}) ORDER BY score DESC, doc_id LIMIT 10), w AS (SELECT doc_id, regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\f]+') AS ws FROM documents WHERE doc_id IN (SELECT doc_id FROM h)),
p AS (SELECT *, list_transform(ws, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS ls FROM w), q AS (SELECT *, coalesce(least(list_position(ls, 'stupid'), list_position(ls, 'worthless')), list_position(ls, 'stupid'), list_position(ls, 'worthless'), 1) AS place FROM p)
SELECT doc_id, array_to_string(ws[greatest(1, place - 16):greatest(1, place - 16) + 31], ' ') AS snippet FROM q""".format(_BM.replace("'stupid', 'worthless', 'thheer'", "'stupid', 'worthless'")))
def j1b_snippets(spark, sf):
    hits = S.bm25(docs(spark, sf), ["stupid", "worthless"], 10).select("doc_id")
    return docs(spark, sf).join(F.broadcast(hits), "doc_id").select("doc_id", S.snippet(F.col("text"), ["stupid", "worthless"]).alias("snippet"))


_INDEXED = """, s AS (SELECT * FROM (SELECT *, id // 10 AS doc_id, row_number() OVER (PARTITION BY id ORDER BY remote_url, file_size_bytes) AS nth FROM files WHERE id % 10 = 1) WHERE nth = 1),
b AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 10 = 3 THEN concat('late ', text) ELSE text END), '[a-z0-9]+') AS ws FROM documents WHERE doc_id % 10 <> 7), c AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM b),
tf AS (SELECT doc_id, len(ws) AS len, t, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS t FROM b) WHERE t IN ('the', 'late', 'of', 'thheer') GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
h AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (t), c GROUP BY doc_id),
r AS (SELECT doc_id, media_id, score FROM h JOIN s USING (doc_id) WHERE lower(prefix) = '2lak' AND remote_modified_at >= TIMESTAMP '1995-01-01' AND NOT superseded)"""


@lru_cache(maxsize=4)
def side_file_index(spark, sf) -> tuple[TextIndex, DataFrame]:
    """Side files: first every text, then a batch that changes some and removes others; and the files that they belong to. The queries over one folder share them."""
    index = TextIndex(spark, scratch(spark, "index"))
    texts = docs(spark, sf).select("doc_id", "text")
    index.add(0, texts)
    index.add(1, texts.where("doc_id % 10 = 3").select("doc_id", F.concat(F.lit("late "), "text").alias("text")), texts.where("doc_id % 10 = 7").select("doc_id"))
    own = role(spark, sf, "files").where("id % 10 = 1").withColumn("superseded_by", F.when(F.col("superseded"), F.lit(0)))
    own = rank_one(own, ["id"], F.asc("remote_url"), F.asc("file_size_bytes"))
    return index, own.select(F.floor(F.col("id") / 10).alias("doc_id"), "media_id", "prefix", "remote_modified_at", "superseded_by")


@query(f"{cte('files')}{_INDEXED} SELECT doc_id, media_id, score, (SELECT count(*) FROM r) AS total FROM r ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5")
def j1c_indexed_search(spark, sf):
    """One page of a search over a stored index: terms, prefix, since, not superseded, and how many there are in all."""
    index, own = side_file_index(spark, sf)
    found = search_files(index, own, ["the", "late", "of", "thheer"], 20, 5, prefix="2Lak", since=F.lit("1995-01-01").cast("timestamp_ntz"))
    return found.page.select("doc_id", "media_id", "score", F.lit(found.total).alias("total"))


_LIVE = "WITH w AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 10 = 3 THEN concat('late ', text) ELSE text END), '[a-z0-9]+') AS ws FROM documents WHERE doc_id % 10 <> 7)"


@query(f"""{_LIVE} SELECT doc_id FROM w WHERE list_contains(ws, 'of') AND (list_contains(ws, 'late') OR list_contains(ws, 'thheer') OR list_contains(ws, 'her')) AND NOT list_contains(ws, 'stupid') AND len(list_filter(ws, lambda x: starts_with(x, 'wh'))) > 0""")
def c11c_indexed_match(spark, sf):
    """C11: AND, OR, NOT and a prefix from the stored index, after texts were changed and removed."""
    index, _ = side_file_index(spark, sf)
    words = {"every": ["of"], "some": ["late", "thheer", "her"], "none": ["stupid"]}
    return S.matching(index.postings([t for ts in words.values() for t in ts], prefix="wh"), **words, prefix="wh")


@query(f"""{_LIVE} SELECT doc_id FROM w WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' of the ')""")
def c11d_indexed_phrase(spark, sf):
    """C11: a phrase from the stored index."""
    index, _ = side_file_index(spark, sf)
    return S.phrase(index.postings(["of", "the"]), ["of", "the"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), e AS (SELECT doc_id, n * 3 AS k, CASE WHEN n % 5 = 1 THEN 'new ' || line ELSE line END AS line FROM l WHERE n % 7 <> 3 UNION ALL SELECT doc_id, n * 3 + 1, 'added' FROM l WHERE n % 11 = 2)
SELECT d.doc_id, len(string_split(text, chr(10))) AS old_lines, (SELECT count(*) FROM e WHERE e.doc_id = d.doc_id) AS new_lines, md5(coalesce((SELECT string_agg(line, chr(10) ORDER BY k) FROM e WHERE e.doc_id = d.doc_id), '')) AS rebuilt FROM documents d""")
def h8_version_diff(spark, sf):
    """H8: lines that two versions differ in; hunks put to the first version give the second."""
    def edited(line: Column, i: Column) -> Column:
        n = i + 1
        own = F.when(n % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(F.when(n % 5 == 1, F.concat(F.lit("new "), line)).otherwise(line)))
        return F.concat(own, F.when(n % 11 == 2, F.array(F.lit("added"))).otherwise(F.array().cast("array<string>")))

    new = F.array_join(F.flatten(F.transform(F.split("text", "\n"), edited)), "\n")
    rows = D.line_hunks(docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("old"), new.alias("new")))
    back = D.rebuilt(F.col("old"), F.col("hunks"))
    return rows.select(F.col("id").alias("doc_id"), F.size(F.split("old", "\n")).cast("long").alias("old_lines"), F.size(back).cast("long").alias("new_lines"), F.md5(F.array_join(back, "\n").cast("binary")).alias("rebuilt"))
