"""Event-log analytics: phase and model statistics, rule violations, corrections, log evaluation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.numbering import running


def phase_stats(events: DataFrame, since: Column) -> DataFrame:
    """Per phase and model: completions, cost, tokens, the phase's failures and the success rate, from one scan.

    Failures are counted per phase and stand beside each of its models. Rows without a phase are left out; a missing
    model is "unknown".
    """
    rows = events.where((F.col("ts") >= since) & F.col("event_type").isin("phase_completed", "phase_failed") & F.col("phase").isNotNull())
    done, failed = F.col("event_type") == "phase_completed", F.col("event_type") == "phase_failed"
    by_model = rows.groupBy("phase", F.when(done, F.coalesce("model", F.lit("unknown"))).alias("model")).agg(
        F.count_if(done).alias("completions"), F.count_if(failed).alias("failures"), F.sum(F.when(done, F.coalesce("cost", F.lit(0.0)))).alias("cost"), F.sum(F.when(done, F.coalesce("tokens", F.lit(0)))).alias("total_tokens"),
    )
    by_phase = by_model.groupBy("phase").agg(F.sum("failures").alias("failures"))
    rate = F.round(F.col("completions") / (F.col("completions") + F.col("failures")) * 100, 1)
    out = by_model.where("model IS NOT NULL").drop("failures").join(by_phase, "phase")
    return out.select("phase", "model", "completions", "failures", F.round("cost", 4).alias("total_cost"), "total_tokens", rate.alias("success_rate"))


def phase_totals(events: DataFrame, since: Column) -> DataFrame:
    """Per phase: completions merged with failures by a full outer join, each counted once; phases that only fail stay with rate 0."""
    rows = events.where((F.col("ts") >= since) & F.col("phase").isNotNull())
    done = rows.where("event_type = 'phase_completed'").groupBy("phase").agg(F.count("*").alias("c"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    failed = rows.where("event_type = 'phase_failed'").groupBy("phase").agg(F.count("*").alias("f"))
    c, f = F.coalesce("c", F.lit(0)), F.coalesce("f", F.lit(0))
    return done.join(failed, "phase", "full_outer").select("phase", c.alias("completions"), f.alias("failures"), F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("total_cost"), F.round(c / (c + f) * 100, 1).alias("success_rate"))


def model_stats(events: DataFrame, limit: int) -> DataFrame:
    """Models by cost: requests, tokens, cost and its share of all models' cost; sorted before it is cut."""
    from pyspark.sql import Window

    rows = events.where("event_type = 'phase_completed' AND model IS NOT NULL").groupBy("model").agg(F.count("*").alias("requests"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    share = F.round(F.col("cost") / F.sum("cost").over(Window.partitionBy()) * 100, 1)
    return rows.select("model", "requests", "tokens", F.round("cost", 4).alias("cost"), share.alias("share")).orderBy(F.desc("cost"), "model").limit(limit)


def action_of(action: Column, known: tuple[str, ...] = ("applied", "flagged", "reverted"), source: Column | None = None, mode: Column | None = None) -> Column:
    """The action if it is a known one; else what a lint event's mode tells; else unknown."""
    out = F.when(action.isin(*known), action)
    if source is not None and mode is not None:
        out = out.when((source == "lint") & (mode == "enforce"), "applied").when(source == "lint", "flagged")
    return out.otherwise("unknown")


def counted(pairs: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys with a text of value=count pairs, the most common first, ties by value: counts meet before the list is made."""
    n = pairs.groupBy(*keys, value).agg(F.count("*").alias("n"))
    item = F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))
    text = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(F.coalesce(x["v"], F.lit("?")), F.lit("="), (-x["m"]).cast("string")))
    return n.groupBy(*keys).agg(F.array_join(text, ",").alias(name))


def percentiles(rows: DataFrame, key: list[str], value: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Floor-index percentiles: the value of rank floor(n * p / 100), counted from 0, of all values; and count, least, most and mean.

    Values are counted first; the count runs along the distinct values over ranges of them, so that one key's values needn't fit in a task.
    """
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("_n"))
    ranked = running(counts, key, [value], {"_upto": F.col("_n")})
    stats = [F.sum("_n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 6).alias("mean")]
    whole = ranked.groupBy(*key).agg(*stats)
    both = ranked.crossJoin(whole) if not key else ranked.join(whole.withColumnsRenamed({k: f"_{k}" for k in key}), reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key)))
    at = lambda p: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col(value)))
    return both.groupBy(*key, "n", "least", "most", "mean").agg(*(at(p).alias(f"p{p}") for p in points)).select(*key, *(f"p{p}" for p in points), "n", "least", "most", "mean")


def rates(events: DataFrame, width: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """(bucket, requests, rate): tumbling windows; the same plan runs on a stream."""
    w = F.window("ts", width)
    return events.groupBy(w).agg(F.count("*").alias("requests")).select(F.col("window.start").alias("bucket"), "requests", F.round(F.col("requests") / seconds, 6).alias("rate"))
