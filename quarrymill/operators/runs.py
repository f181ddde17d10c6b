"""Aggregates and joins over run records and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import visible
from .dedup import latest


def valid_runs(runs: DataFrame, *columns: str) -> DataFrame:
    return latest(runs, "run_id", "loaded_at", *columns)


def failed() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def eligible() -> Column:
    """No error, verdict not FAIL, a comment that is not blank; null verdicts pass."""
    return ~failed() & (F.coalesce(F.col("gate_verdict"), F.lit("")) != "FAIL") & visible(F.col("final"))


def prediction() -> Column:
    return F.coalesce(F.when(F.col("final") != "", F.col("final")), F.col("draft"))


def matched_ids(runs: DataFrame) -> DataFrame:
    """Pairs done without error under every configuration: relational division by distinct counts."""
    total = runs.agg(F.count_distinct("config").alias("total"))
    done = runs.where(~failed()).groupBy("pair_id").agg(F.count_distinct("config").alias("n"))
    return done.join(F.broadcast(total), F.col("n") == F.col("total")).select("pair_id")  # one row


def blocks(runs: DataFrame) -> DataFrame:
    """Rates per configuration, over all runs and by whether facts were there (null as not), from one scan."""
    ok = runs.where(~failed()).withColumn("with_facts", F.coalesce("has_sigma", F.lit(False)))
    g = ok.groupingSets([["config", "with_facts"], ["config"]], "config", "with_facts").agg(
        F.grouping("with_facts").cast("int").alias("all_runs"),
        F.count(F.lit(1)).alias("n"),
        F.avg("support_rate").alias("support"),
        F.avg(F.when(F.col("gate_verdict") != "", (F.col("gate_verdict") == "PASS").cast("int"))).alias("pass_rate"),
        F.avg(F.col("gate_kept_draft").cast("int")).alias("kept_draft"),
        F.avg("rounds_used").alias("rounds"),
    )
    kind = F.when(F.col("all_runs") == 1, "all").when(F.col("with_facts"), "with").otherwise("without")
    return g.select("config", kind.alias("block"), "n", "support", "pass_rate", "kept_draft", "rounds")


def call_stats(calls: DataFrame) -> DataFrame:
    c = latest(calls, "call_id", "loaded_at", "prompt_id", "first_attempt_parsed", "repaired", "cached", "seconds", "attempts")
    return c.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("first_attempt_parsed").alias("first_ok"), F.count_if("repaired").alias("repaired"), F.count_if("cached").alias("cached"),
        F.avg("seconds").alias("mean_seconds"), F.avg(F.col("first_attempt_parsed").cast("int")).alias("first_rate"), F.max("attempts").alias("most_attempts"),
    )


def call_counts(runs: DataFrame) -> DataFrame:
    """Calls per configuration and prompt, from the map of each run; the total is left out."""
    return runs.select("config", F.explode("calls").alias("prompt_id", "k")).where("prompt_id <> 'total'").groupBy("config", "prompt_id").agg(
        F.sum("k").cast("long").alias("calls"), F.count(F.lit(1)).alias("runs"), F.min("k").alias("least"), F.max("k").alias("most")
    )


def per_config_means(runs: DataFrame) -> DataFrame:
    return runs.where(~failed()).where("support_rate is not null").select("config", "seed", "pair_id", F.col("support_rate").alias("score"))


def progress(runs: DataFrame) -> DataFrame:
    return runs.groupBy("config").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(failed()).alias("errors"), F.min("finished_at").alias("first"), F.max("finished_at").alias("last"), F.sum("seconds").alias("seconds")
    )


def exploded_claims(runs: DataFrame) -> DataFrame:
    """A row per claim, and how many facts back it."""
    return runs.select("run_id", F.posexplode("final_claims").alias("at", "c")).select("run_id", "at", F.col("c.text").alias("text"), F.size("c.ids").alias("facts"))


def marker(comment: Column) -> Column:
    """With which mark a comment opens."""
    t = F.ltrim(F.coalesce(comment, F.lit("")))
    return F.when(t.startswith("/**"), "/**").when(t.startswith("///"), "///").when(t.startswith("//"), "//").otherwise("bare or empty")


def extra_fields(got: Column, wanted: Column) -> Column:
    """Keys of a map of fields that another lacks, sorted."""
    keys = lambda m: F.map_keys(F.coalesce(m, F.create_map().cast("map<string,string>")))
    return F.array_sort(F.array_except(keys(got), keys(wanted)))


def view(fields: Column, target: str) -> Column:
    """The fields of a view: whole, notice, dev, param or return."""
    if target == "whole":
        return fields
    if target not in ("notice", "dev", "param", "return"):
        raise ValueError(f"view must be whole, notice, dev, param or return, not {target!r}")
    return F.map_filter(fields, lambda k, _: F.substring_index(k, ":", 1) == target)


def pace(runs: DataFrame, target: int, now: Column) -> DataFrame:
    """``done``, ``errors``, records an hour since the first, and hours left to ``target``; null where nothing can be told."""
    g = runs.agg(F.count(F.lit(1)).alias("done"), F.count_if(failed()).alias("errors"), F.min("finished_at").alias("first"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 3.6e9
    g = g.withColumn("per_hour", F.try_divide(F.col("done"), F.nullif(hours, F.lit(0.0))))
    return g.withColumn("hours_left", F.try_divide(F.greatest(F.lit(0), F.lit(target) - F.col("done")), F.col("per_hour"))).drop("first")


def by_seed(runs: DataFrame) -> DataFrame:
    """One row per seed and pair of runs without error; of several the last finished."""
    return runs.where(~failed()).groupBy("seed", "pair_id").agg(F.max(F.struct("finished_at", "run_id", "final", "support_rate")).alias("r")).select("seed", "pair_id", "r.*")


def both_trees(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two run trees, which need not have the same columns."""
    return first.withColumn("tree", F.lit(1)).unionByName(second.withColumn("tree", F.lit(2)), allowMissingColumns=True)
