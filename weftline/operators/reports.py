"""Project, model, listing and report operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import group, let, size_bytes, strip

#: What a listing's older form keeps, by extension; media extensions, the preferred first; limits of content kinds.
OLDER_TYPES = {"srt": "transcript", "txt": "transcript", "jpg": "screengrab", "jpeg": "screengrab", "png": "screengrab"}
MEDIA_EXTENSIONS = (".mp4", ".mkv", ".mov", ".webm", ".wav", ".mp3", ".m4a", ".flac")
SHORT_MINUTES = 3.0
DELIVERABLES = (("analysis", "Analysis"), ("formatted_transcript", "Formatted Transcript"), ("seo_metadata", "SEO Metadata"), ("qa_review", "QA Review"))
DEFAULT_PRICE = (1.0, 3.0)


def export_name(project: Column, file: Column) -> Column:
    """A file name under its project's name, with runs of other characters as one dash."""
    clean = F.regexp_replace(F.regexp_replace(project, r"[^a-zA-Z0-9._-]+", "-"), "-{2,}", "-")
    return F.concat(F.regexp_replace(clean, "^-+|-+$", ""), F.lit("-"), file)


def project_type(explicit: Column, minutes: Column, name: Column) -> Column:
    """Struct type, confidence: what is stated, else by duration, else by name."""
    kind = lambda t, c: F.struct(t.alias("type"), F.lit(c).alias("confidence"))
    low = F.lower(name)
    short = F.contains(low, F.lit("sm")) | F.contains(low, F.lit("short")) | F.contains(low, F.lit("ds"))
    out = F.when(F.coalesce(explicit, F.lit("")) != "", kind(explicit, "explicit"))
    out = out.when(minutes.isNotNull(), kind(F.when(minutes < SHORT_MINUTES, "digital_short").otherwise("segment"), "inferred")).when(short, kind(F.lit("digital_short"), "inferred"))
    return out.when(F.startswith(name, F.lit("2LAK")) | F.startswith(name, F.lit("9LEC")), kind(F.lit("segment"), "inferred")).otherwise(kind(F.lit("segment"), "unknown"))


def call_cost(reported: Column, flat: Column, tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """What a call cost: a backend's flat value, else the cost that it reported, else tokens at the model's price (or the default one) a million."""
    by_tokens = tokens_in / 1e6 * F.coalesce(price_in, F.lit(DEFAULT_PRICE[0])) + tokens_out / 1e6 * F.coalesce(price_out, F.lit(DEFAULT_PRICE[1]))
    return F.coalesce(flat, reported, by_tokens)


def too_dear(price_in: Column, price_out: Column, limit: float) -> Column:
    """Whether a model's mean price a thousand tokens, output counted twice, is above limit; an unknown price is let through."""
    return F.coalesce((price_in + price_out * 2) / 3 / 1000 > limit, F.lit(False))


def next_run(at: Column, now: Column) -> Column:
    """The first time of day HH:MM after now; null for a malformed one."""
    h, m = group(at, r"^(\d{1,2}):(\d{1,2})$", 1).cast("int"), group(at, r"^(\d{1,2}):(\d{1,2})$", 2).cast("int")
    today = F.date_trunc("day", now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h, m)
    return F.when((h <= 23) & (m <= 59), F.when(today > now, today).otherwise(today + F.expr("INTERVAL 1 DAY")))


def version_tag(version: Column) -> Column:
    """v<major>.<minor> of a package version; v0.0 without a minor part."""
    return F.concat(F.lit("v"), F.coalesce(group(version, r"^([^.]*\.[^.]*)", 1), F.lit("0.0")))


def unavailable(body: Column, header: Column) -> Column:
    """Struct detail, retry_after_s, retryable of a busy answer: a flat body, an error object, or plain text."""
    b = F.from_json(body, "detail string, retry_after_s int, error struct<retryable:boolean,retry_after_s:int,message:string>")
    seconds = F.when(header.rlike(r"^\d+$"), header.cast("int"))
    return let(b, lambda x: F.struct(
        F.coalesce(x["error"]["message"], x["detail"], F.nullif(F.left(body, F.lit(200)), F.lit("")), F.lit("backend returned 503")).alias("detail"),
        F.coalesce(x["error"]["retry_after_s"], seconds, x["retry_after_s"]).alias("retry_after_s"),
        F.coalesce(x["error"]["retryable"], F.lit(True)).alias("retryable"),
    ))


def deliverables(outputs: Column, files: Column) -> Column:
    """Labels of what a project folder has: outputs (map kind -> file) that exist among files, then revisions and keyword reports with their number."""
    own = [F.when(F.array_contains(files, F.try_element_at(outputs, F.lit(k))), F.lit(label)) for k, label in DELIVERABLES]
    count = lambda p: F.size(F.filter(files, lambda f: f.rlike(p)))
    more = [F.when(count(p) > 0, F.concat(F.lit(f"{label} ("), count(p).cast("string"), F.lit(")"))) for p, label in ((r"^copy_revision_v.*\.md$", "Revisions"), (r"^keyword_report_v.*\.md$", "Keyword Reports"))]
    return F.filter(F.array(*own, *more), lambda x: x.isNotNull())


def keyword_report(name: Column, text: Column) -> Column:
    """Struct version, uploaded_at of a keyword report: from its name, and from a line of its first six."""
    line = F.get(F.filter(F.slice(F.split(text, "\n"), 1, 6), lambda x: F.startswith(x, F.lit("**Uploaded:**"))), F.lit(0))
    return F.struct(F.coalesce(group(name, r"^keyword_report_v(\d+)\.md$").cast("int"), F.lit(0)).alias("version"), F.trim(F.replace(line, F.lit("**Uploaded:**"), F.lit(""))).alias("uploaded_at"))


def plain_listing(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, name, file_type, modified, size_bytes) of a listing's older form, "<a ..>name</a>  12-Jan-2025 14:30  45K"; the newer date form counts too, other types are left out."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(<a\s+href=\"[^\"]*\">[^<]*</a>[^<]*)"), 1)).alias("row"))
    href = group(F.col("row"), r'href="([^"]*)"')
    rest = F.split(strip(F.regexp_extract("row", r"</a>([^<]*)", 1)), r"\s+")
    stamp = F.concat(F.get(rest, F.lit(0)), F.lit(" "), F.get(rest, F.lit(1)))
    when = F.coalesce(F.try_to_timestamp(stamp, F.lit("dd-MMM-yyyy HH:mm")), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm")))
    types = F.create_map(*(F.lit(x) for kv in OLDER_TYPES.items() for x in kv))
    rows = rows.where(~F.endswith(href, F.lit("/")) & ~F.startswith(href, F.lit("?")))
    out = rows.select("page_id", F.element_at(F.split(href, "/"), -1).alias("name"), when.alias("modified"), F.when(F.size(rest) >= 3, size_bytes(F.element_at(rest, -1), negatives=True)).alias("size_bytes"))
    kind = F.try_element_at(types, F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    return out.withColumn("file_type", kind).where("file_type IS NOT NULL").select("page_id", "name", "file_type", "modified", "size_bytes")


def walked(entries: DataFrame, roots: DataFrame, depth: int, ignored: Sequence[str] = ()) -> DataFrame:
    """(url, directory, name) of all files at most depth folders below roots (url); each folder is walked once, each file given once.

    entries has directory (a folder's url), url, name, is_dir. Folders named in ignored are left out. One join a level; depth is a bound of the walk.
    """
    here = entries.where(~F.col("is_dir") | ~F.col("name").isin(*ignored)) if ignored else entries
    frontier = roots.select(F.col("url").alias("directory")).distinct()
    visited, files = frontier, None
    for level in range(depth + 1):
        found = here.join(frontier, "directory", "left_semi")
        own = found.where("NOT is_dir").select("url", "directory", "name")
        files = own if files is None else files.unionByName(own)
        if level < depth:
            frontier = found.where("is_dir").select(F.col("url").alias("directory")).distinct().join(visited, "directory", "left_anti")
            visited = visited.unionByName(frontier)
    return files.dropDuplicates(["url"])


def best_media(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(media_id, name): for each wanted media_id its file among files (name, folder), by extension order, then folder order."""
    order = F.array(*map(F.lit, MEDIA_EXTENSIONS))
    own = files.select("name", "folder", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("media_id"), F.array_position(order, F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("place")).where("place > 0")
    first = own.groupBy("media_id").agg(F.min_by("name", F.struct("place", "folder", "name")).alias("name"))
    return wanted.select("media_id").distinct().join(first, "media_id", "left")


def trimmed_overlap(before: Column, after: Column, window: int = 100, least: int = 5) -> Column:
    """Words of after (an array) that repeat the last words of before: how many first words go.

    From each place in the last window words of before, words equal in any case are counted up to the first that differs; the most, if
    at least least and more than half of the window, counts.
    """
    tail, head = F.transform(F.slice(before, F.greatest(F.size(before) - window + 1, F.lit(1)), F.lit(window)), F.lower), F.transform(F.slice(after, F.lit(1), F.lit(window)), F.lower)

    def run(t: Column, h: Column) -> Column:
        at = lambda s: F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.least(F.size(t) - s, F.size(h)) - 1), lambda k: F.get(t, s + k) != F.get(h, k)), F.lit(0)), F.least(F.size(t) - s, F.size(h)))
        best = F.array_max(F.transform(F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda s: F.size(t) - s >= least), at))
        return F.when((best >= least) & (best / F.size(h) > 0.5), best).otherwise(0)

    return F.when((F.size(before) >= 10) & (F.size(after) >= 10), let(tail, lambda t: let(head, lambda h: run(t, h)))).otherwise(0)


def corrections(edits: DataFrame, pipeline: DataFrame) -> DataFrame:
    """(media_id, field, original_value, pipeline_value, committed_value, data) of edits (media_id, field, current_value, proposed_value): pipeline's value where it has one, and the event's JSON."""
    e = edits.select("media_id", "field", F.coalesce("current_value", F.lit("")).alias("original_value"), F.coalesce("proposed_value", F.lit("")).alias("committed_value"))
    rows = e.join(pipeline.select("media_id", "field", F.col("value").alias("pipeline_value")), ["media_id", "field"], "left")
    fields = ("field", "media_id", "committed_value", "pipeline_value", "original_value")
    return rows.withColumn("data", F.to_json(F.struct(F.lit("mcp_commit").alias("phase"), F.struct(*fields).alias("extra"))))


def markdown(rows: DataFrame, columns: Sequence[str], order: Sequence[Column], title: str) -> DataFrame:
    """One row report: a small aggregate as a Markdown table; an empty one says so."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), " | "), F.lit(" |"))
    lines = F.array_sort(F.collect_list(F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    head = f"## {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.agg(lines.alias("l"), body.alias("b")).select(F.when(F.size("l") > 0, F.concat(F.lit(head), "b")).otherwise(F.lit(f"## {title}\n\n_None._")).alias("report"))


def first_of(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def without_known(new: DataFrame, live: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new whose natural key, nulls equal to nulls, is not in live; of several with one key all stay."""
    same = [new[k].eqNullSafe(live[k]) for k in key]
    return new.join(live.select(*key), same, "left_anti")


def maintained(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """A postings table after documents changed (doc_id): their old postings go, fresh ones come."""
    return index.join(changed.select("doc_id").distinct(), "doc_id", "left_anti").select(*index.columns).unionByName(fresh)


def asset_url(files: DataFrame, variant: str | None) -> DataFrame:
    """(media_id, url) of files (media_id, variant, primary, url): the file of the variant in any case, the least url of several; without one the primary file's."""
    wanted = F.lower("variant") == F.lit((variant or "").lower())
    both = files.groupBy("media_id").agg(F.min(F.when(wanted, F.col("url"))).alias("own"), F.min(F.when(F.col("primary"), F.col("url"))).alias("main"))
    return both.select("media_id", F.coalesce("own", "main").alias("url") if variant else F.col("main").alias("url")).where("url IS NOT NULL")


def family_of(model: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The family of the first glob (pattern, family) that a model's name matches; * is any run of characters, ? any one."""
    out = F.lit(None).cast("string")
    for glob, family in reversed(patterns):
        like = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        out = F.when(F.lower(model).like(like.lower()), family).otherwise(out)
    return out


def percent_delta(value: Column, base: Column, places: int = 1) -> Column:
    """Change against base in percent as text: a dash where either is unknown; of a base of 0, 0 where nothing changed and n/a elsewhere."""
    change = F.round((value - base) * 100.0 / F.nullif(base, F.lit(0)), places)
    return F.when(value.isNull() | base.isNull(), "—").when(base == 0, F.when(value == 0, "0").otherwise("n/a")).otherwise(F.format_string(f"%+.{places}f", change))


def link_counts(jobs: DataFrame, records: DataFrame, limit: int = 1000) -> DataFrame:
    """One row (checked, linked, not_found): the first limit jobs without a record, oldest id first, looked up among records (media_id, record_id)."""
    todo = jobs.where("record_id IS NULL").orderBy("id").limit(limit)
    known = records.groupBy("media_id").agg(F.max("record_id").alias("found"))
    hit = todo.select("id", "media_id").join(known, "media_id", "left")
    return hit.agg(F.count("*").alias("checked"), F.count("found").alias("linked"), F.count_if(F.col("found").isNull()).alias("not_found"))


def verdict(criteria: DataFrame) -> DataFrame:
    """GO where every criterion (name, passed) passes and there is one at all: one row (passed, total, failed, verdict)."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))), ",")
    all_ = criteria.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), failed.alias("failed"))
    return all_.withColumn("verdict", F.when((F.col("total") > 0) & (F.col("passed") == F.col("total")), "GO").otherwise("NO-GO"))
