"""Draft checks and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import let, word_count
from weftline.operators import phrases as P
from weftline.operators import style as S
from weftline.plans.registry import query
from weftline.sources.tables import cte, raw, role

_D = cte("drafts")
_BARE = "regexp_replace(coalesce({0}, ''), '(?s)<!--.*?-->', '', 'g')"
_SOLID = f"length(regexp_replace({_BARE}, '\\s', '', 'g')) >= 50"
_OUT = f"o AS (SELECT id, minutes, unnest(['analyst', 'formatter', 'seo']) AS phase, unnest([analyst, formatter, seo]) AS t FROM drafts), ok AS (SELECT * FROM o WHERE {_SOLID.format('t')})"
_FMT = f"f AS (SELECT id, minutes, formatter AS t, {_BARE.format('formatter')} AS b FROM drafts WHERE {_SOLID.format('formatter')})"
_SECONDS = "list_reduce(list_transform(string_split({0}, ':'), lambda x: CAST(x AS INT)), lambda a, x: a * 60 + x)"
_REC = "trim(regexp_extract(seo, '(?s)### {0}.*?\\*\\*Recommended:\\*\\*\\s*\\n+([^\\n]+)', 1))"
_FIELDS = "fld AS (SELECT id, analyst, formatter, seo, " + ", ".join(f"nullif({_REC.format(h)}, '') AS {k}" for k, h in (("title", "Title"), ("short_description", "Short Description"), ("long_description", "Long Description"))) + " FROM drafts)"
#: House terms of the examples: written forms, and a variant.
_SEED = S.canonical_seed(["USA", "Springfield Public Library"], {"atty gen": "Atty. Gen."})
_STOP = ["State"]
_NOUNS = """nouns AS (SELECT id, list_distinct_ordered AS ns FROM (SELECT id, list(x ORDER BY k) AS list_distinct_ordered FROM (SELECT id, x, min(k) AS k FROM (
SELECT id, unnest(CASE WHEN length(w) >= 4 AND w <> 'State' THEN [c, w] ELSE [c] END) AS x, n * 2 + generate_subscripts(CASE WHEN length(w) >= 4 AND w <> 'State' THEN [c, w] ELSE [c] END, 1) AS k FROM (SELECT *, string_split(c, ' ')[-1] AS w FROM (SELECT id, n, regexp_extract(l, '^\\|\\s*([A-Z][a-zA-Z.''-]+( [A-Z][a-zA-Z.''-]+){1,3})\\s*\\|', 1) AS c FROM (SELECT id, unnest(string_split(analyst, chr(10))) AS l, generate_subscripts(string_split(analyst, chr(10)), 1) AS n FROM drafts)) WHERE c <> '')) GROUP BY id, x) GROUP BY id))"""


def drafts(spark, sf):
    return role(spark, sf, "drafts")


def _rule(spark, sf, rule: str):
    found = S.lint(limited(spark, sf), rule).select("id", "phase", F.explode("findings").alias("f"))
    return found.where(F.col("f.rule_id") == rule)


@query(f"""{_D}, {_OUT}, n AS (SELECT id, phase, CAST(contains(t, '{{media_id}}') AS INT) + CAST(contains(t, '{{TODAY') AS INT) + CAST(contains(t, '[INSERT') AS INT) + CAST(contains(t, '{{model name') AS INT)
+ len(list_filter(regexp_extract_all(t, '\\*\\*Recommended:\\*\\*[ \\t]*\\n([^\\n]*)', 1), lambda v: trim(v) = '' OR regexp_matches(trim(v), '^\\[.*\\]$'))) AS n FROM ok) SELECT id, phase, n FROM n WHERE n > 0""")
def i5_placeholders(spark, sf):
    return _rule(spark, sf, "lint.placeholder_text").groupBy("id", "phase").agg(F.count("*").alias("n"))


_LABELS = f"""{_FMT}, bl AS (SELECT id, regexp_extract_all(t, '(?m)^\\*\\*([A-Z][\\w.''-]*(?:\\s(?:[A-Z][\\w.''-]*|\\d+))*):\\*\\*', 1) AS ls FROM f), ll AS (SELECT DISTINCT id, unnest(ls) AS l FROM bl), lab AS (SELECT id, l, list_distinct(string_split(l, ' ')) AS w FROM ll WHERE l NOT IN ('Project', 'Note', 'Status'))"""


@query(f"""{_D}, {_LABELS} SELECT id, 'label ' || l || ' has one word' AS message FROM lab WHERE len(w) = 1 UNION ALL SELECT id, 'label ' || l || ' has a form of address' FROM lab WHERE regexp_matches(l, '^(Dr|Mr)\\.? ')
UNION ALL SELECT a.id, 'labels of one person: ' || a.l || ', ' || b.l FROM lab a JOIN lab b ON a.id = b.id AND len(a.w) < len(b.w) AND list_has_all(b.w, a.w)""")
def i7_speaker_labels(spark, sf):
    """Labels of one word, with honorifics, and pairs of one person."""
    return _rule(spark, sf, "lint.formatter.speaker_label_inconsistent").select("id", "f.message")


@query(f"{_D}, {_FMT} SELECT id, m AS marker FROM (SELECT DISTINCT id, minutes, unnest(regexp_extract_all(b, '\\((\\d{{1,2}}(?::\\d{{2}}){{1,2}})\\)', 1)) AS m FROM f WHERE minutes > 0) WHERE {_SECONDS.format('m')} > minutes * 60 + 60")
def i8_past_duration(spark, sf):
    return _rule(spark, sf, "lint.formatter.content_past_duration").select("id", F.regexp_extract("f.message", r" at ([0-9:]+),", 1).alias("marker"))


@query(f"""{_D}, {_FMT}, m AS (SELECT id, b, minutes, regexp_extract_all(b, '\\((\\d{{1,2}}(?::\\d{{2}}){{1,2}})\\)', 1)[-1] AS m FROM f)
SELECT id, 'coverage' AS why FROM m WHERE minutes > 0 AND m IS NOT NULL AND {_SECONDS.format('m')} / (minutes * 60) < 0.85 UNION ALL SELECT id, 'ending' FROM m WHERE NOT regexp_matches(rtrim(split_part(b, chr(10) || '**Note', 1)), '[.]$') OR contains(b, '**Note')""")
def i10_truncation(spark, sf):
    """An open last line, and a last marker well before the end."""
    found = _rule(spark, sf, "lint.formatter.truncation_suspect")
    return found.select("id", F.when(F.startswith("f.message", F.lit("times stop")), "coverage").otherwise("ending").alias("why"))


@query(f"{_D}, {_FMT} SELECT id FROM f WHERE contains(substring(t, strpos(t, chr(10) || '---')), '<!-- review')")
def i13_review_notes(spark, sf):
    return _rule(spark, sf, "lint.formatter.review_notes_in_body").select("id")


_SECTIONS = ["Speakers & Roles", "SEO Keywords"]


@query(f"""{_D} SELECT id, 'analyst.section_missing' AS rule_id FROM drafts WHERE NOT contains(analyst, '## Speakers & Roles') UNION ALL SELECT id, 'analyst.section_missing' FROM drafts WHERE NOT contains(analyst, '## SEO Keywords')
UNION ALL SELECT id, 'analyst.speaker_table_unparseable' FROM drafts WHERE len(list_filter(regexp_split_to_array(analyst, '\\s+'), lambda w: w <> '')) > 50 AND NOT regexp_matches(analyst, '\\| [A-Z][a-zA-Z.''-]+( [A-Z][a-zA-Z.''-]+)+ \\|') UNION ALL SELECT id, 'analyst.truncation_suspect' FROM drafts WHERE NOT ends_with(analyst, '.')""")
def i14_analyst_checks(spark, sf):
    found = drafts(spark, sf).select("id", F.explode(S.analyst_findings(F.col("analyst"), _SECTIONS, _STOP)).alias("f"))
    return found.select("id", "f.rule_id")


_DOWN = """low AS (SELECT id, title, CASE WHEN list_contains(ns, 'Ann Leeds') THEN replace(lower(title), 'ann leeds', 'Ann Leeds') ELSE lower(title) END AS x, list_contains(ns, 'Ann Leeds') AS ann FROM fld LEFT JOIN nouns USING (id) WHERE title IS NOT NULL),
styled AS (SELECT id, title, regexp_replace(regexp_replace(x, '\\busa\\b', 'USA'), '\\batty gen\\b', 'Atty. Gen.') AS y FROM low), down AS (SELECT id, title, CASE WHEN left(y, 1) = '[' THEN '[' || upper(y[2]) || substring(y, 3) ELSE upper(left(y, 1)) || substring(y, 2) END AS new_title FROM styled)"""
_CUT = "CASE WHEN length({0}) > {1} THEN rtrim(regexp_replace(left({0}, {1} - 1), '\\s\\S*$', '')) || '…' ELSE {0} END"
_POST = f"""{_D}, {_FIELDS}, {_NOUNS}, {_DOWN}, post AS (SELECT id, seo, title, new_title, short_description, {_CUT.format('short_description', 100)} AS new_short, long_description, {_CUT.format('long_description', 350)} AS new_long FROM fld LEFT JOIN down USING (id, title))"""


@query(f"""{_POST} SELECT id, title IS NOT NULL AS parsed, new_title AS title, CASE WHEN title IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN new_title <> title THEN 'title' END, CASE WHEN new_short <> short_description THEN 'short_description' END, CASE WHEN new_long <> long_description THEN 'long_description' END], lambda x: x IS NOT NULL), ',') END AS fixes,
md5(CASE WHEN title IS NULL THEN seo ELSE replace(replace(replace(seo, chr(10) || title || chr(10), chr(10) || new_title || chr(10)), coalesce(short_description, '~'), coalesce(new_short, '~')), coalesce(long_description, '~'), coalesce(new_long, '~')) END) AS document FROM post""")
def i18_seo_post_stage(spark, sf):
    """The title down-styled, long descriptions cut, both put back at their spans."""
    out = S.post_stage(limited(spark, sf), _SEED, _STOP)
    return out.select("id", "parsed", "title", F.array_join("fixes", ",").alias("fixes"), F.md5(F.col("document").cast("binary")).alias("document"))


_ERRORS = f"""er AS (SELECT id, phase, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings FROM (
SELECT id, phase, 'error' AS s FROM o WHERE NOT {_SOLID.format('t')}
UNION ALL SELECT id, phase, 'error' FROM (SELECT id, phase, unnest(range(CAST(contains(t, '{{media_id}}') AS INT) + CAST(contains(t, '[INSERT') AS INT) + len(list_filter(regexp_extract_all(t, '\\*\\*Recommended:\\*\\*[ \\t]*\\n([^\\n]*)', 1), lambda v: trim(v) = '' OR regexp_matches(trim(v), '^\\[.*\\]$'))))) FROM ok)
UNION ALL SELECT id, 'seo', 'error' FROM fld WHERE length(title) > 60 UNION ALL SELECT id, 'seo', 'error' FROM fld WHERE length(short_description) > 100 UNION ALL SELECT id, 'seo', 'error' FROM fld WHERE length(long_description) > 350
UNION ALL SELECT id, 'seo', 'warning' FROM tg WHERE n > 0 AND n NOT BETWEEN 2 AND 10
UNION ALL SELECT id, 'formatter', 'error' FROM f WHERE contains(substring(t, strpos(t, chr(10) || '---')), '<!-- review')
UNION ALL SELECT id, 'formatter', 'warning' FROM lab WHERE len(w) = 1 UNION ALL SELECT id, 'formatter', 'warning' FROM lab WHERE regexp_matches(l, '^(Dr|Mr)\\.? ') UNION ALL SELECT a.id, 'formatter', 'warning' FROM lab a JOIN lab b ON a.id = b.id AND len(a.w) < len(b.w) AND list_has_all(b.w, a.w)
UNION ALL SELECT id, 'formatter', 'warning' FROM (SELECT DISTINCT id, minutes, unnest(regexp_extract_all(b, '\\((\\d{{1,2}}(?::\\d{{2}}){{1,2}})\\)', 1)) AS m FROM f WHERE minutes > 0) WHERE {_SECONDS.format('m')} > minutes * 60 + 60
UNION ALL SELECT id, 'formatter', 'warning' FROM f WHERE minutes > 0 AND {_SECONDS.format("regexp_extract_all(b, '[(]([0-9]+(?::[0-9]+)+)[)]', 1)[-1]")} / (minutes * 60) < 0.85 UNION ALL SELECT id, 'formatter', 'warning' FROM f) GROUP BY id, phase)"""
_TAGS = "tg AS (SELECT id, len(list_filter(list_transform(string_split(regexp_extract(seo, '(?s)### YouTube Tags.*?```\\n(.*?)\\n```', 1), ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM drafts)"
_ALL = f"{_D}, {_OUT}, {_FIELDS}, {_TAGS}, {_LABELS}, {_ERRORS}"


@query(f"{_ALL} SELECT o.id, o.phase, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM o LEFT JOIN er ON o.id = er.id AND o.phase = er.phase")
def i20_lint(spark, sf):
    """All checks, three phases a draft, counted by severity."""
    count = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long")
    return S.lint(limited(spark, sf)).select("id", "phase", count("error").alias("errors"), count("warning").alias("warnings"))


@query(f"{_ALL} SELECT o.id, o.phase, CASE WHEN coalesce(errors, 0) > 0 THEN 'fail' ELSE 'pass' END AS status, coalesce(errors, 0) + coalesce(warnings, 0) + 1 AS n_flags FROM o LEFT JOIN er ON o.id = er.id AND o.phase = er.phase")
def i19_merged_verdict(spark, sf):
    """Findings appended to the flags that a verdict has; errors fail the phase."""
    merged = S.merged_verdict(F.array(F.lit("tone: stiff")), F.lit("pass"), F.col("findings"))
    return S.lint(limited(spark, sf)).select("id", "phase", merged.alias("v")).select("id", "phase", "v.status", F.size("v.flags").cast("long").alias("n_flags"))


@query("SELECT o_orderkey AS id, array_to_string(CASE WHEN o_orderkey % 3 = 0 THEN ['a', 'a', 'b', 'c'] WHEN o_orderkey % 3 = 1 THEN ['c', 'b'] ELSE ['b', 'c'] END, ',') AS flags FROM orders")
def h7_flag_append(spark, sf):
    """H7: what is there stays as it is, repeats too; new flags follow once."""
    has = F.when(F.col("o_orderkey") % 3 == 0, F.array(*map(F.lit, "aab"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(S.appended(has, F.array(*map(F.lit, "bcb"))), ",").alias("flags"))


@query(f"""{_POST}, n AS (SELECT id, unnest(['title', 'short_description']) AS field, unnest([new_title, new_short]) AS shown, unnest([title, short_description]) AS v FROM post WHERE title IS NOT NULL)
SELECT id, field, length(v) > CASE field WHEN 'title' THEN 60 ELSE 100 END AS over, len(regexp_extract_all(lower(v), '\\b(we|our|us|you|your)\\b')) AS person, CASE WHEN field = 'title' AND shown <> v THEN shown END AS suggestion FROM n""")
def i21_edit_preview(spark, sf):
    """An edit's limits, person and casing, before it is made."""
    rows = limited(spark, sf).select("id", "limits", S.canonical_terms(S.proper_nouns(F.col("analyst"), _STOP), _SEED).alias("terms"), S.field(F.col("seo"), "title")["value"].alias("title"), S.field(F.col("seo"), "short_description")["value"].alias("short_description")).where("title IS NOT NULL")
    items = F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("v"), F.try_element_at("limits", F.lit(k))["max"].alias("limit")) for k in ("title", "short_description")))
    rows = rows.select("id", "terms", F.explode(items).alias("i"))
    changed = let(S.down_styled(F.col("i.v"), F.col("terms")), lambda styled: F.when(styled != F.col("i.v"), styled))
    return rows.select("id", "i.field", (F.length("i.v") > F.col("i.limit")).alias("over"), F.regexp_count("i.v", F.lit(r"(?i)\b(we|our|us|you|your)\b")).cast("long").alias("person"), F.when(F.col("i.field") == "title", changed).alias("suggestion"))


@query(f"""{_POST} SELECT id, stage, CAST(coalesce(length(t) > 60, false) AS INT) + CAST(coalesce(length(short_description) > 100, false) AS INT) + CAST(coalesce(length(long_description) > 350, false) AS INT) + CAST(regexp_matches(lower(t), '\\byou\\b') AS INT) AS findings, t AS title
FROM (SELECT *, unnest(['pre', 'post']) AS stage, unnest([title, new_title]) AS t FROM post WHERE title IS NOT NULL)""")
def i24_pre_post(spark, sf):
    """The same checks on the raw title and on the down-styled one."""
    rows = limited(spark, sf).select("id", "limits", S.canonical_terms(S.proper_nouns(F.col("analyst"), _STOP), _SEED).alias("terms"), *(S.field(F.col("seo"), k)["value"].alias(k) for k in S.HEADINGS)).where("title IS NOT NULL")
    stages = F.array(F.struct(F.lit("pre").alias("stage"), F.col("title").alias("title")), F.struct(F.lit("post").alias("stage"), S.down_styled(F.col("title"), F.col("terms")).alias("title")))
    rows = rows.select("id", "limits", "short_description", "long_description", F.explode(stages).alias("s")).select("id", "limits", "s.stage", "s.title", "short_description", "long_description")
    n = F.size(S.limit_findings({k: F.col(k) for k in S.HEADINGS}, "seo", F.col("limits"))) + F.col("title").rlike(r"(?i)\byou\b").cast("int")
    return rows.select("id", "stage", n.alias("findings"), "title")


_NAMES = "\\*\\*(?:Ann Leeds|Leeds|Dr. Bob Day|Speaker 1|Bob Day|Note):\\*\\*"


@query(f"""{_D}, s AS (SELECT id, regexp_replace(coalesce(formatter, ''), '({_NAMES}) *\\n', '\\1  ' || chr(10), 'g') AS t FROM drafts), b AS (SELECT id, regexp_replace(t, '\\s*\\n({_NAMES})', chr(10) || chr(10) || '\\1', 'g') AS t FROM s)
SELECT id, md5(replace(t, '---' || chr(10) || chr(10) || '**Ann', '---' || chr(10) || '**Ann')) AS body FROM b""")
def b10_speaker_turns(spark, sf):
    """Two spaces after each label, one blank line between turns."""
    return drafts(spark, sf).select("id", F.md5(F.coalesce(S.speaker_turns(F.col("formatter")), F.lit("")).cast("binary")).alias("body"))


@query(f"{_D}, {_NOUNS} SELECT d.id, coalesce(array_to_string(ns, '|'), '') AS nouns FROM drafts d LEFT JOIN nouns USING (id)")
def b13_proper_nouns(spark, sf):
    return drafts(spark, sf).select("id", F.array_join(S.proper_nouns(F.col("analyst"), _STOP), "|").alias("nouns"))


@query(f"""{_D}, {_NOUNS}, e AS (SELECT id, lower(n) AS key, n AS value FROM (SELECT id, unnest(ns) AS n FROM nouns) UNION ALL SELECT id, k, v FROM drafts, (VALUES ('usa', 'USA'), ('springfield public library', 'Springfield Public Library'), ('atty gen', 'Atty. Gen.'), ('atty. gen.', 'Atty. Gen.')) s(k, v)) SELECT * FROM e""")
def b12_canonical_terms(spark, sf):
    """The house's terms, a draft's own names over them, and each written form's own key."""
    terms = S.canonical_terms(S.proper_nouns(F.col("analyst"), _STOP), _SEED)
    return drafts(spark, sf).select("id", F.explode(terms).alias("t")).select("id", "t.key", "t.value")


@query(f"{_D}, {_FIELDS} SELECT id, title, short_description, long_description, md5(CASE WHEN title IS NULL THEN seo ELSE replace(seo, chr(10) || title || chr(10), chr(10) || 'A new title' || chr(10)) END) AS spliced FROM fld")
def b15_field_splice(spark, sf):
    """Values with their spans, and another value put at a span."""
    title = S.field(F.col("seo"), "title")
    new = S.spliced(F.col("seo"), [(title, F.lit("A new title")), (S.field(F.col("seo"), "long_description"), F.lit(None).cast("string"))])
    return drafts(spark, sf).select("id", *(S.field(F.col("seo"), k)["value"].alias(k) for k in S.HEADINGS), F.md5(new.cast("binary")).alias("spliced"))


@query(f"{_D} SELECT id, CASE WHEN id % 11 <> 0 THEN CASE id % 3 WHEN 0 THEN 'a|b|c' WHEN 1 THEN repeat('tag|', 12) || 'last' END END AS tags FROM drafts")
def b16_tag_list(spark, sf):
    return drafts(spark, sf).select("id", F.array_join(S.tags(F.col("seo")), "|").alias("tags"))


@query(f"{_D} SELECT id, CASE WHEN id % 11 <> 0 THEN '0 Start' || CASE WHEN id % 80 < 60 THEN ',' || CAST(120000 + id % 80 * 1000 AS STRING) || ' Middle part' ELSE '' END || ',3723000 End' END AS chapters FROM drafts")
def b17_chapter_fence(spark, sf):
    return drafts(spark, sf).select("id", F.array_join(F.transform(S.chapters(F.col("seo")), lambda c: F.concat(c["start_ms"].cast("string"), F.lit(" "), c["title"])), ",").alias("chapters"))


@query(f"""{_D} SELECT id, md5('# Timestamp Report' || chr(10) || chr(10) || CASE WHEN id % 2 = 0 THEN '**Project:** p' || CAST(id AS STRING) || chr(10) ELSE '' END || '**Duration:** 1:05:00' || chr(10) || chr(10) || '| Title | Start Time | End Time |' || chr(10) || '|-------|------------|----------|' || chr(10)
|| CASE WHEN id % 80 < 60 THEN '| Start | 0:00:00.000 | ' || printf('0:%02d:%02d.999', 2 + (id % 80 - 1) // 60 - CASE WHEN id % 80 = 0 THEN 1 ELSE 0 END, (id % 80 + 59) % 60) || ' |' || chr(10) || '| Middle part | 0:02:' || lpad(CAST(id % 80 AS STRING), 2, '0') || '.000 | 1:02:02.999 |' ELSE '| Start | 0:00:00.000 | 1:02:02.999 |' END || chr(10) || '| End | 1:02:03.000 | 1:05:00.000 |'
|| chr(10) || chr(10) || '0:00 Start' || chr(10) || CASE WHEN id % 80 < 60 THEN '2:' || lpad(CAST(id % 80 AS STRING), 2, '0') || ' Middle part' || chr(10) ELSE '' END || '1:02:03 End' || chr(10)) AS report FROM drafts WHERE id % 11 <> 0""")
def n27_timestamp_report(spark, sf):
    """A draft's chapters as a report of table and list."""
    rows = drafts(spark, sf).select("id", S.chapters(F.col("seo")).alias("c")).where("c IS NOT NULL")
    report = S.timestamp_report(F.col("c"), F.lit(3900000), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id").cast("string"))))
    return rows.select("id", F.md5(report.cast("binary")).alias("report"))


_FIRST, _LAST = ("Ann", "Bob", "Carla", "Dan", "Eve"), ("Leeds", "Day", "Moss", "van Reed", "Hart", "Ortiz", "Kim")
_PERSON = "concat([{f}][CAST(s_suppkey * {a} % 5 AS INT) + 1], ' ', [{l}][CAST(s_suppkey * {a} % 7 AS INT) + 1])"
_PERSONS = ", ".join(f"{_PERSON.format(f=', '.join(map(repr, _FIRST)), l=', '.join(map(repr, _LAST)), a=a)} AS p{a}" for a in (1, 2, 3, 4))


@query(f"""WITH p AS (SELECT s_suppkey, s_suppkey % 4 AS k, {_PERSONS} FROM supplier),
n AS (SELECT s_suppkey, CASE WHEN k IN (0, 2) THEN p1 WHEN k = 1 THEN p3 END AS host, CASE k WHEN 0 THEN [p2, p3, p4] WHEN 1 THEN [p3, p4] ELSE CAST([] AS VARCHAR[]) END AS guests FROM p)
SELECT s_suppkey, host, array_to_string(list_filter(list_transform(range(len(guests)), lambda i: CASE WHEN list_position(guests, guests[i + 1]) = i + 1 AND guests[i + 1] <> host THEN guests[i + 1] END), lambda x: x IS NOT NULL), '|') AS panelists FROM n""")
def b19_speaker_names(spark, sf):
    """Host and panelists from two note fields, whose names follow the row."""
    key = F.col("s_suppkey")
    of = lambda values, a, m: F.element_at(F.array(*map(F.lit, values)), (key * a % m + 1).cast("int"))
    p1, p2, p3, p4 = (F.concat(of(_FIRST, a, 5), F.lit(" "), of(_LAST, a, 7)) for a in (1, 2, 3, 4))
    notes = F.when(key % 4 == 0, F.concat(F.lit("The show is led by Senior Political Editor "), p1, F.lit(" and features Judge "), p2, F.lit(". More follows."))).when(key % 4 == 2, F.concat(F.lit("It was hosted by "), p1, F.lit(". Yes"))).otherwise("No Names here")
    post = F.when(key % 4 == 0, F.concat(F.lit("Reporters "), p3, F.lit(" and "), p4, F.lit(" talk"))).when(key % 4 == 1, F.concat(F.lit("With reporter "), p3, F.lit(" and "), p4, F.lit(" today"))).otherwise("reporters only")
    fields = [(notes, ("led by", "hosted by"), "host"), (notes, ("and features",), "guest"), (post, ("reporters", "reporter"), "guest")]
    names = S.speaker_names(fields, ("Senior", "Political", "Editor", "Judge"))
    return raw(spark, sf, "supplier").select("s_suppkey", names.alias("n")).select("s_suppkey", "n.host", F.array_join("n.panelists", "|").alias("panelists"))


@query(f"{_D}, {_LABELS} SELECT id, coalesce(md5(substring(t, strpos(t, chr(10) || '---' || chr(10)) + 5, strpos(t, chr(10) || '---' || chr(10) || '**Status') - strpos(t, chr(10) || '---' || chr(10)) - 5)), '') AS body, (SELECT array_to_string(list_sort(list(l)), '|') FROM lab WHERE lab.id = f.id) AS labels FROM f")
def b20_body_region(spark, sf):
    """The part between the rules, and the bare labels in it."""
    rows = drafts(spark, sf).where(S.substance(F.col("formatter")) >= S.SUBSTANCE)
    return rows.select("id", F.md5(S.region(F.col("formatter"))["body"].cast("binary")).alias("body"), F.array_join(F.array_sort(S.labels(F.col("formatter"))), "|").alias("labels"))


@query(f"""{_D}, {_NOUNS} SELECT d.id, coalesce(array_to_string(list_filter(ns, lambda n: contains(lower(coalesce(formatter, '')), lower(n))), '|'), '') AS candidates, len(list_filter(regexp_split_to_array(coalesce(formatter, ''), '\\s+'), lambda w: w <> '')) AS words, CAST(minutes * 60000 AS BIGINT) AS duration_ms FROM drafts d LEFT JOIN nouns USING (id)""")
def n25_pre_stage_facts(spark, sf):
    """Names that the text has, its words and its duration."""
    text = F.coalesce("formatter", F.lit(""))
    names = F.filter(S.proper_nouns(F.col("analyst"), _STOP), lambda n: F.contains(F.lower(text), F.lower(n)))
    return drafts(spark, sf).select("id", F.array_join(names, "|").alias("candidates"), word_count(text).cast("long").alias("words"), (F.col("minutes") * 60000).cast("long").alias("duration_ms"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pass' ELSE 'fail' END END AS overall, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_custkey % 5 AS INT) END AS score FROM orders")
def n21_verdict_json(spark, sf):
    """A verdict in a fence, bare, or broken."""
    body = F.concat(F.lit('{"overall": "'), F.when(F.col("o_orderkey") % 2 == 0, "pass").otherwise("fail"), F.lit('", "score": '), (F.col("o_custkey") % 5).cast("string"), F.lit("}"))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("o_orderkey") % 4 == 3, "not a verdict").otherwise(F.concat(F.lit("  "), body, F.lit("\n")))
    return raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.verdict_of(text, "overall string, score int").alias("v")).select("id", "v.overall", "v.score")


@query(f"{_D} SELECT id, coalesce(left(trim(string_split(rtrim(coalesce(formatter, ''), chr(10) || ' '), chr(10))[-1]), 200), '') AS tail FROM drafts")
def n20_section_tail(spark, sf):
    return drafts(spark, sf).select("id", S.section_tail(F.coalesce("formatter", F.lit(""))).alias("tail"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS head, text FROM documents) SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN head || 'short text.' || chr(10) || text WHEN 1 THEN text ELSE 'Full rules ' || text || ' Slim' || head END) AS prompt FROM d""")
def b33_prompt_tokens(spark, sf):
    """Prompts around every document, with the blocks of a profile, or the full one where it has none."""
    blocks = {"rules.a": {"full": "Full rules\n", "slim": "short text."}, "rules.b": {"full": "Full rules"}, "c": {"slim": "Slim"}}
    head, k = F.split("text", "\n")[0], F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(head, F.lit("{{style:rules.a}}\n"), "text")).when(k == 1, F.col("text")).otherwise(F.concat(F.lit("{{style:rules.b}} "), "text", F.lit(" {{style:c}}"), head))
    return raw(spark, sf, "documents").select("doc_id", F.md5(S.rendered_tokens(text, blocks, "slim").cast("binary")).alias("prompt"))


#: category, need (0 excludes), part, rule: what flags about texts of the tables can be about.
_FLAG_RULES = [("greeting", 1, "the", "r.the"), ("greeting", 0, "zz", None), ("length", 1, "ion", None), ("length", 2, "er", "r.er"), ("length", 2, "ing", "r.ing"), ("accent", 1, "é", "r.accent"), ("accent", 1, "ü", "r.umlaut"), ("accent", 0, "ñ", None)]


@query("""WITH f AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS t FROM documents), c AS (SELECT doc_id, contains(t, 'the') AND NOT contains(t, 'zz') AS g, contains(t, 'ion') AND (contains(t, 'er') OR contains(t, 'ing')) AS l, (contains(t, 'é') OR contains(t, 'ü')) AND NOT contains(t, 'ñ') AS a, t FROM f)
SELECT doc_id, array_to_string(list_filter([CASE WHEN a THEN 'accent' END, CASE WHEN g THEN 'greeting' END, CASE WHEN l THEN 'length' END], lambda x: x IS NOT NULL), ',') AS categories,
array_to_string(list_sort(list_filter([CASE WHEN a THEN CASE WHEN contains(t, 'é') THEN 'r.accent' ELSE 'r.umlaut' END END, CASE WHEN g THEN 'r.the' END, CASE WHEN l THEN CASE WHEN contains(t, 'er') THEN 'r.er' ELSE 'r.ing' END END], lambda x: x IS NOT NULL)), ',') AS rule_ids FROM c""")
def b69_flag_categories(spark, sf):
    """What each flag (here a document's first line) is about, by a table of parts, parts that go together and parts that exclude."""
    flags = raw(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.split("text", "\n")[0].alias("text"))
    rules = spark.createDataFrame([(c, n, p, r, i) for i, (c, n, p, r) in enumerate(_FLAG_RULES)], "category string, need int, part string, rule_id string, rank int")
    return P.categories(flags, rules).select(F.col("key").alias("doc_id"), F.array_join("categories", ",").alias("categories"), F.array_join("rule_ids", ",").alias("rule_ids"))


#: field, content type, programme, max, min_count, max_count; the limits of the drafts' own checks are those that hold for all.
_LIMIT_ROWS = [("title", None, None, 60, None, None), ("short_description", None, None, 100, None, None), ("long_description", None, None, 350, None, None), ("keywords", None, None, None, 2, 10)]
_MORE_LIMITS = [("keywords", "short", None, None, None, 3), ("title", "short", None, 20, None, None), ("title", None, "p1", 90, None, None), ("title", "short", "p1", 15, None, None), ("keywords", None, "p1", None, 5, None)]


def limited(spark, sf) -> DataFrame:
    return P.with_limits(drafts(spark, sf), limit_table(spark))


def limit_table(spark, more=()) -> DataFrame:
    return spark.createDataFrame([*_LIMIT_ROWS, *more], "field string, content_type string, programme string, max int, min_count int, max_count int")


@query(f"""{_D}, {_FIELDS}, {_TAGS}, k AS (SELECT f.id, title, t.n, CASE WHEN d.minutes <= 10 THEN 'short' ELSE 'full' END AS ct, CASE WHEN f.id % 3 = 0 THEN 'p1' WHEN f.id % 3 = 1 THEN 'p2' END AS pr FROM fld f JOIN drafts d ON d.id = f.id LEFT JOIN tg t ON t.id = f.id),
m AS (SELECT *, CASE WHEN ct = 'short' AND pr = 'p1' THEN 15 WHEN pr = 'p1' THEN 90 WHEN ct = 'short' THEN 20 ELSE 60 END AS most, CASE WHEN pr = 'p1' THEN 5 ELSE 2 END AS low, CASE WHEN ct = 'short' THEN 3 ELSE 10 END AS high FROM k)
SELECT id, 'lint.seo.title_over_limit' AS rule_id, 'title has ' || CAST(length(title) AS STRING) || ' of ' || CAST(most AS STRING) AS message FROM m WHERE length(title) > most UNION ALL SELECT id, 'lint.seo.keywords_count', CAST(n AS STRING) || ' tags' FROM m WHERE n > 0 AND (n < low OR n > high)""")
def i6_resolved_limits(spark, sf):
    """I6, I18 and I1 by rules: limits by content type and programme, the most specific one of each number."""
    kind = F.when(F.col("minutes") <= 10, "short").otherwise("full")
    rows = P.with_limits(drafts(spark, sf), limit_table(spark, _MORE_LIMITS), kind, F.when(F.col("id") % 3 == 0, "p1").when(F.col("id") % 3 == 1, "p2"))
    found = rows.select("id", F.explode(S.seo_findings(F.col("seo"), F.col("limits"))).alias("f")).select("id", "f.rule_id", "f.message")
    return found.where(F.col("rule_id").isin("lint.seo.title_over_limit", "lint.seo.keywords_count"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, count(*) OVER (PARTITION BY doc_id) AS total, words, sum(words) OVER (PARTITION BY doc_id) AS every FROM (SELECT doc_id, generate_subscripts(ls, 1) AS n, len(list_filter(regexp_split_to_array(unnest(ls), '[ \\t\\n\\r\\x0b\\f]+'), lambda w: w <> '')) AS words FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE words > 0),
r AS (SELECT doc_id, n, total, every, 0 AS chunk, words AS acc, words FROM p WHERE n = 1 UNION ALL SELECT p.doc_id, p.n, p.total, p.every, CASE WHEN r.acc >= 60 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.acc >= 60 THEN p.words ELSE r.acc + p.words END, p.words FROM r JOIN p ON p.doc_id = r.doc_id AND p.n = r.n + 1),
c AS (SELECT doc_id, chunk, CAST(min(n) - 1 AS INT) AS first, CAST(count(*) AS INT) AS paragraphs, CAST(sum(words) AS BIGINT) AS words, any_value(every) AS every FROM r GROUP BY doc_id, chunk), k AS (SELECT doc_id FROM c GROUP BY doc_id HAVING count(*) > 1) SELECT doc_id, chunk, first, paragraphs, words FROM c WHERE every >= 90 AND doc_id IN (SELECT doc_id FROM k)""")
def f8_paragraph_chunks(spark, sf):
    """F8: lines as paragraphs, added up to a target of words."""
    return S.paragraph_chunks(raw(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), 60)
