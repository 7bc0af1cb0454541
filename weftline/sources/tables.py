"""The engine's tables over the star schema: jobs, event log, media files, transcripts, verdicts.

Each role is a list of (column, expression) over one source table, in the SQL that Spark and the oracle share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Job states and pipeline phases.
STATUSES = ("pending", "in_progress", "completed", "failed", "paused", "cancelled", "investigating")
PHASES = ("analyst", "formatter", "seo", "manager", "timestamp")
MODELS = ("gemini-flash", "claude-haiku", "claude-sonnet", "claude-opus")


def _pick(expr: str, values: tuple[str, ...]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _lines(expr: str) -> str:
    return f"replace({expr}, '¶', chr(10))"


ROLES: dict[str, tuple[str, dict[str, str]]] = {
    "jobs": ("orders", {
        "id": "o_orderkey",
        "project_path": "concat('project_', CAST(o_custkey % 40 AS STRING))",
        "transcript_file": "concat('Clip ', CAST(o_orderkey % 900 AS STRING), '.srt')",
        "media_id": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('6TWN', lpad(CAST(o_orderkey % 700 AS STRING), 4, '0')) END",
        "status": _pick("o_orderkey % 7", STATUSES),
        "priority": "CAST(substring(o_orderpriority, 1, 1) AS INT)",
        "queued_at": "o_orderdate",
        "started_at": "CASE WHEN o_orderkey % 7 IN (1, 2, 3) THEN o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 90) END",
        "last_heartbeat": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 7200) END",
        "retry_after": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '1' DAY * (o_orderkey % 60) END",
        "actual_cost": "o_totalprice",
        "retry_count": "CAST(o_orderkey % 4 AS INT)",
        "max_retries": "3",
        "word_count": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey * 7 END",
        "duration_minutes": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_custkey % 4000) / CAST(100 AS DOUBLE) END",
    }),
    "files": ("lineitem", {
        "id": "l_orderkey * 10 + l_linenumber",
        "remote_url": "concat('https://media.example/d', CAST(l_suppkey AS STRING), '/f', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING))",
        "directory_path": "concat('/d', CAST(l_suppkey AS STRING))",
        "media_id": "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE concat('2LAK', lpad(CAST(l_partkey AS STRING), 6, '0')) END",
        "prefix": _pick("l_partkey % 4", ("2LAK", "6TWN", "9LEC", "2HIL")),
        "variant_tag": "CASE l_returnflag WHEN 'A' THEN 'PLEDGE' WHEN 'R' THEN 'DS' END",
        "unknown_tag": "CASE WHEN l_linenumber = 7 THEN 'NOBUG' END",
        "revision_date": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END",
        "file_type": _pick("l_linenumber % 5", ("mp4", "srt", "scc", "image", "transcript")),
        "file_size_bytes": "CAST(floor(l_extendedprice * 100) AS BIGINT)",
        "status": "CASE WHEN l_linestatus = 'O' THEN 'new' WHEN l_linenumber % 2 = 0 THEN 'queued' ELSE 'ignored' END",
        "first_seen_at": "l_shipdate",
        "remote_modified_at": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_shipdate - INTERVAL '1' DAY * (l_partkey % 9) END",
        "superseded": "l_discount > 0.07",
    }),
    "stats": ("events", {
        "id": "event_id",
        "job_id": "user_id",
        "ts": "ts",
        "event_type": "CASE event_type WHEN 'purchase' THEN 'phase_completed' WHEN 'error' THEN 'phase_failed' WHEN 'signup' THEN 'rule_violation' WHEN 'view' THEN 'correction' ELSE 'job_queued' END",
        "phase": f"CASE WHEN user_id % 19 = 0 THEN NULL ELSE {_pick('user_id % 5', PHASES)} END",
        "model": f"CASE WHEN event_id % 23 = 0 THEN NULL ELSE {_pick('event_id % 4', MODELS)} END",
        "cost": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE value END",
        "tokens": "CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END",
        "data": "props",
    }),
    "drafts": ("orders", {
        "id": "o_orderkey",
        "minutes": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 40 + 1 AS DOUBLE) END",
        "analyst": _lines(f"concat('<!-- model: m | tier: 1 -->¶# Analysis¶', CASE WHEN o_orderkey % 7 = 0 THEN 'No table.¶' ELSE concat('## Speakers & Roles¶| Speaker | Role/Title |¶|---|---|¶| ', {_pick('o_orderkey % 4', ('Ann Leeds', 'Robert Moss Dyke', 'Mary-Jo Ortiz', 'Kim'))}, ' | Host |¶| ', {_pick('o_orderkey % 3', ('Bob Day', 'Carla State', 'Ann Leeds'))}, ' | Guest |¶') END, "
            "CASE WHEN o_orderkey % 2 = 0 THEN concat(repeat('word ', 60), '¶') ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '## SEO Keywords (Preliminary)¶' END, 'A closing line that says enough to count as text', CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '.' END)"),
        "formatter": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN '<!-- a comment that alone is longer than fifty characters, no more -->' ELSE " + _lines(
            f"concat(CASE WHEN o_orderkey % 8 = 1 THEN '<!-- review: check (99:59) -->¶' ELSE '' END, '**Project:** p¶---¶**Ann Leeds:**', repeat(' ', CAST(o_orderkey % 4 AS INT)), '¶Hello there, and welcome to the show of today. (1:05)¶', repeat('¶', CAST(o_orderkey % 3 AS INT)), '**', {_pick('o_orderkey % 5', ('Leeds', 'Dr. Bob Day', 'Speaker 1', 'Ann Leeds', 'Bob Day'))}, ':**¶', "
            "CASE WHEN o_orderkey % 8 = 0 THEN '<!-- review: look -->¶' ELSE '' END, CASE o_orderkey % 9 WHEN 0 THEN 'Id {media_id} here.¶' WHEN 1 THEN '[INSERT name] here.¶' ELSE '' END, 'The rest follows at (', CASE WHEN o_orderkey % 10 = 3 THEN '1:' ELSE '' END, lpad(CAST(o_orderkey * 7 % 50 AS STRING), 2, '0'), ':30)', CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE '.' END, '¶**Note:**¶---¶**Status:** ready')") + " END",
        "seo": "CASE WHEN o_orderkey % 11 = 0 THEN 'No fields at all, only a line of text that is long enough to count.' ELSE " + _lines(
            f"concat('# Metadata¶¶### Title¶¶**Recommended:**¶', {_pick('o_orderkey % 4', ('A LOOK AT THE ANN LEEDS SHOW IN THE USA', 'you and our best guide to a very long title that goes beyond sixty characters', '[Title here]', 'News of the atty gen'))}, '¶¶### Short Description¶¶**Recommended:**¶¶  ', CASE WHEN o_orderkey % 3 = 0 THEN concat(repeat('short words ', 12), 'end') ELSE 'A short text for you.' END, "
            "'  ¶¶### Long Description¶¶', CASE WHEN o_orderkey % 4 = 0 THEN '(none)' ELSE concat('**Recommended:**¶', CASE WHEN o_orderkey % 5 = 0 THEN concat(repeat('long words go on ', 25), 'end') ELSE 'Long text.' END) END, '¶¶### YouTube Tags¶¶```¶', CASE o_orderkey % 3 WHEN 0 THEN 'a, b, , c' WHEN 1 THEN concat(repeat('tag, ', 12), 'last') ELSE ' , ' END, '¶```¶¶```chapters¶0:00 Start¶bad line¶2:', lpad(CAST(o_orderkey % 80 AS STRING), 2, '0'), ' Middle part¶1:02:03 End¶```¶')") + " END",
    }),
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = ROLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def cte(*names: str) -> str:
    """WITH clause that defines these roles for the oracle."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ROLES[n][1].items())} FROM {ROLES[n][0]})" for n in names)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
