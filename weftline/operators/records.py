"""Records of jobs, files and runs: lookups with outcomes, nested phases, maps and transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASE = "struct<name:string,status:string,cost:double,escalated:boolean,previous_runs:array<struct<status:string,cost:double>>>"


def captions_outcome(asked: DataFrame, files: DataFrame, sides: DataFrame) -> DataFrame:
    """(media_id, status, file_id, body): 404 without a current file, 503 without a side file or with a blank one, else 200 and the body.

    files (media_id, id, superseded_by), sides (file_id, fetched_at, id, body_text). Of several the first file by id that has a side file, and its first side file by
    time and id; the same id asked for twice is answered twice.
    """
    current = files.where("superseded_by IS NULL AND media_id IS NOT NULL").select(F.col("media_id").alias("_media"), F.col("id").alias("file_id"))
    first = sides.groupBy("file_id").agg(F.min_by("body_text", F.struct("fetched_at", "id")).alias("body"), F.lit(True).alias("_side"))
    best = current.join(first, "file_id", "left").groupBy("_media").agg(F.min(F.struct(F.col("_side").isNull().alias("bare"), "file_id", "body")).alias("b"))
    rows = asked.select("media_id").join(best, F.col("media_id") == F.col("_media"), "left")
    blank = F.coalesce("b.body", F.lit("")).rlike(r"^\s*$")
    status = F.when(F.col("b").isNull(), 404).when(blank, 503).otherwise(200)
    return rows.select("media_id", status.alias("status"), "b.file_id", F.when(status == 200, F.col("b.body")).alias("body"))


def phase_metrics(runs: DataFrame) -> DataFrame:
    """(run, phase, failed, model, total_tokens, cost, wall_s, words, coverage) of runs (run, phases, coverage): a row for each phase that a run has.

    Of a phase that a run has twice the later one counts. A failed phase has only its time; the model is without its owner; coverage is the formatter's.
    """
    rows = runs.select("run", "coverage", F.posexplode("phases").alias("nth", "p")).where("p.phase IS NOT NULL AND p.phase <> ''")
    last = rows.groupBy("run", "coverage", "p.phase").agg(F.max_by("p", "nth").alias("p"))
    ok = F.coalesce("p.ok", F.lit(True))
    keep = lambda c: F.when(ok, c)
    return last.select(
        "run", "phase", (~ok).alias("failed"), keep(F.element_at(F.split("p.model", "/"), -1)).alias("model"), keep(F.col("p.total_tokens")).alias("total_tokens"), keep(F.col("p.cost")).alias("cost"),
        F.col("p.wall_s").alias("wall_s"), keep(F.col("p.words")).alias("words"), keep(F.when(F.col("phase") == "formatter", F.col("coverage"))).alias("coverage"),
    )


def escalated_once(phases: Column, failing: Column) -> Column:
    """phases (array of PHASE) with those named in failing pending again, their run kept in previous_runs; a phase that was escalated before stays as it is."""

    def one(p: Column) -> Column:
        again = F.array_contains(failing, p["name"]) & ~F.coalesce(p["escalated"], F.lit(False))
        runs = F.concat(F.coalesce(p["previous_runs"], F.array().cast("array<struct<status:string,cost:double>>")), F.array(F.struct(p["status"].alias("status"), p["cost"].alias("cost"))))
        fresh = F.struct(p["name"].alias("name"), F.lit("pending").alias("status"), F.lit(0.0).alias("cost"), F.lit(True).alias("escalated"), runs.alias("previous_runs"))
        return F.when(again, fresh.cast(PHASE)).otherwise(p.cast(PHASE))

    return F.transform(phases, one)


def deep_merged(base: Column, over: Column) -> Column:
    """Two maps of maps as one: inner values of over win, inner and outer keys of either stay; a null map is empty."""
    empty = lambda m: F.coalesce(m, F.from_json(F.lit("{}"), "map<string,map<string,string>>"))
    inner = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)))
    return F.map_zip_with(empty(base), empty(over), lambda k, a, b: inner(a, b))


def complete(jobs: DataFrame, outputs: DataFrame, required: Sequence[str]) -> DataFrame:
    """(id, missing, complete) of jobs (id, project_path, done: names of completed phases): required phases that aren't done or whose output file (path) isn't there."""
    rows = jobs.select("id", F.explode(F.array(*map(F.lit, required))).alias("phase"), "project_path", "done")
    rows = rows.withColumn("path", F.concat("project_path", F.lit("/"), "phase", F.lit("_output.md")))
    there = rows.join(outputs.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    good = F.coalesce(F.array_contains("done", F.col("phase")), F.lit(False)) & F.coalesce("_there", F.lit(False))
    missing = F.array_sort(F.collect_list(F.when(~good, F.col("phase"))))
    return there.groupBy("id").agg(missing.alias("missing")).withColumn("complete", F.size("missing") == 0)


def record_url(base: str, record: Column) -> Column:
    """Address of a record; null without one."""
    return F.when(F.coalesce(record, F.lit("")) != "", F.concat(F.lit(base.rstrip("/") + "/"), F.url_encode(record)))


def _candidates(name: Column, root: str, archive: str, archived: bool) -> Column:
    last = F.element_at(F.split(name, "/"), -1)
    places = [name, F.concat(F.lit(f"{root}/"), name), F.concat(F.lit(f"{root}/"), last)]
    return F.array(*places, *([F.concat(F.lit(f"{archive}/"), name), F.concat(F.lit(f"{archive}/"), last)] if archived else []))


def _first_place(jobs: DataFrame, files: DataFrame, root: str, archive: str, archived: bool) -> DataFrame:
    tried = jobs.where("coalesce(transcript_file, '') <> ''").select("id", F.posexplode(_candidates(F.col("transcript_file"), root, archive, archived)).alias("nth", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "nth").alias("path"))


def loaded_transcripts(jobs: DataFrame, files: DataFrame, root: str, archive: str) -> DataFrame:
    """(id, path, archived, text) of jobs (id, transcript_file): the first of the places where a transcript may be, in the archive last; null where it is nowhere.

    files has path and content; a text is read as UTF-8 if it is that, else as Latin-1.
    """
    found = _first_place(jobs, files, root, archive, True).join(files.select("path", "content"), "path")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    rows = found.select("id", "path", F.startswith("path", F.lit(f"{archive}/")).alias("archived"), text.alias("text"))
    return jobs.select("id").join(rows, "id", "left")


def archive_moves(jobs: DataFrame, files: DataFrame, root: str, archive: str) -> DataFrame:
    """(path, target): where the transcripts of completed jobs go, each once; after that there is nothing to move, so moving twice does nothing."""
    done = jobs.where("status = 'completed'")
    found = _first_place(done, files, root, archive, False).select("path").distinct()
    return found.select("path", F.concat(F.lit(f"{archive}/"), F.element_at(F.split("path", "/"), -1)).alias("target")).where("path <> target")


def moved(files: DataFrame, moves: DataFrame) -> DataFrame:
    """files with paths moved; a file that was at the target is replaced."""
    left = files.join(moves.select(F.col("target").alias("path")), "path", "left_anti")
    names = [c for c in files.columns if c != "path"]
    return left.join(moves, "path", "left").select(F.coalesce("target", "path").alias("path"), *names)
