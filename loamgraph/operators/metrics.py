"""Figures of retrieval: recall, tokens saved, percentiles, unresolved requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(scenarios: DataFrame, supplied: DataFrame) -> DataFrame:
    """(scenario_id, recall, missing) of scenarios (scenario_id, required: array) and what was supplied (scenario_id,
    symbol). ``missing`` keeps the scenario's order; a scenario that requires nothing has recall 1."""
    wanted = scenarios.select("scenario_id", F.posexplode("required").alias("at", "symbol"))
    lost = wanted.join(supplied.select("scenario_id", "symbol").distinct(), ["scenario_id", "symbol"], "left_anti")
    lost = lost.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("all"))
    missing = F.coalesce(F.transform("all", lambda s: s["symbol"]), F.array().cast("array<string>"))
    both = scenarios.join(lost, "scenario_id", "left").select("scenario_id", "required", missing.alias("missing"))
    share = (F.size("required") - F.size("missing")) / F.greatest(F.size("required"), F.lit(1))
    return both.select("scenario_id", F.when(F.size("required") == 0, 1.0).otherwise(share).alias("recall"), "missing")


def reduction(before, after):
    """The share of ``before`` that ``after`` saves, in per cent to two places; 0 of nothing."""
    return F.when(before == 0, 0.0).otherwise(F.round(100 * (before - after) / before, 2))


def summary(results: DataFrame, group: str | None = None) -> DataFrame:
    """(before, after, reduction, whole) of results (before, after, recall): sums, the weighted saving, and whether all
    that was required was there."""
    sums = [F.sum("before").alias("before"), F.sum("after").alias("after"), F.bool_and(F.col("recall") == 1).alias("whole")]
    found = (results.groupBy(group) if group else results.groupBy()).agg(*sums)
    return found.select(*([group] if group else []), "before", "after", reduction(F.col("before"), F.col("after")).alias("reduction"), "whole")


def context_metrics(selected: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, raw_tokens, context_tokens, avoided, reduction, files, symbols, sources) of selected symbols
    (request_id, file, representation, tokens) against whole files (file, tokens)."""
    chosen = selected.groupBy("request_id").agg(F.sum("tokens").alias("context_tokens"), F.count("*").alias("symbols"), F.count_if(F.col("representation") == "source").alias("sources"))
    whole = selected.select("request_id", "file").distinct().join(files.select("file", F.col("tokens").alias("raw")), "file")
    whole = whole.groupBy("request_id").agg(F.sum("raw").alias("raw_tokens"), F.count("*").alias("files"))
    both = chosen.join(whole, "request_id", "left").withColumn("raw_tokens", F.coalesce("raw_tokens", F.lit(0)))
    avoided = F.greatest(F.col("raw_tokens") - F.col("context_tokens"), F.lit(0))
    return both.select("request_id", "raw_tokens", "context_tokens", avoided.alias("avoided"), reduction(F.col("raw_tokens"), F.col("context_tokens")).alias("reduction"), F.coalesce("files", F.lit(0)).alias("files"), "symbols", "sources")


def percentiles(times: DataFrame, value: str, group: str, shares: dict[str, float]) -> DataFrame:
    """The value at place floor(n * share) of each group's sorted values, for each named share."""
    from pyspark.sql.window import Window

    order = F.row_number().over(Window.partitionBy(group).orderBy(value)) - 1
    placed = times.select(group, F.col(value).alias("_v"), order.alias("_at"), F.count("*").over(Window.partitionBy(group)).alias("_n"))
    at = lambda s: F.least(F.floor(F.col("_n") * F.lit(s)), F.col("_n") - 1)
    return placed.groupBy(group).agg(*[F.max(F.when(F.col("_at") == at(s), F.col("_v"))).alias(name) for name, s in shares.items()])


def unresolved(requests: DataFrame, links: DataFrame, key: str = "request_id", group: str = "service") -> DataFrame:
    """(``group``, requests, unresolved): how many requests no link serves."""
    served = links.select(key).distinct().withColumn("_served", F.lit(1))
    return requests.join(served, key, "left").groupBy(group).agg(F.count("*").alias("requests"), F.count_if(F.col("_served").isNull()).alias("unresolved"))
