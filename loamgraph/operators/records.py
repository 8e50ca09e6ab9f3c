"""Small stored tables beside the graph: metadata, runs, semantic facts, a run log, and versions of their layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.mutations import latest, semantic_dependencies, upsert

RUNS_KEPT = 100
FACTS_LISTED = 1000
LAYOUT = 3


def get_meta(metadata: DataFrame, *keys: str) -> DataFrame:
    """(key, value) of some keys, or of all."""
    return metadata.where(F.col("key").isin(list(keys))) if keys else metadata


def set_meta(metadata: DataFrame, new: DataFrame) -> DataFrame:
    """``metadata`` (key, value) with the values of ``new`` in place of those of equal keys."""
    return upsert(metadata, new, ["key"])


def finish_run(runs: DataFrame, metadata: DataFrame, run: DataFrame, keep: int = RUNS_KEPT) -> tuple[DataFrame, DataFrame]:
    """The last ``keep`` runs (id, revision, ...), ``run`` among them, and the metadata that name its revision and it."""
    kept = latest(runs.unionByName(run.select(runs.columns)), "id", keep)
    own = run.select(F.col("revision").cast("string").alias("value"), F.to_json(F.struct(*run.columns)).alias("all"))
    facts = own.select(F.explode(F.create_map(F.lit("revision"), F.col("value"), F.lit("lastIndex"), F.col("all"))).alias("key", "value"))
    return kept, set_meta(metadata, facts)


def put_facts(facts: DataFrame, dependencies: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (id, ..., hashes) with ``new`` ones in place of equal ids, and their (fact_id, path) likewise."""
    ids = new.select(F.col("id").alias("fact_id")).distinct()
    left = dependencies.join(ids, "fact_id", "left_anti")
    return upsert(facts, new, ["id"]), left.unionByName(semantic_dependencies(new).select(left.columns))


def facts_of(facts: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Facts of some symbols (symbol_id), or the first ``FACTS_LISTED`` by id."""
    if symbols is None:
        return facts.orderBy("id").limit(FACTS_LISTED)
    return facts.join(symbols.select("symbol_id").distinct(), "symbol_id", "left_semi").select(facts.columns)


def append_log(run: DataFrame, path: str) -> None:
    """Add runs as lines of JSON to a log folder."""
    run.write.mode("append").json(path)


def migrate(tables: dict[str, DataFrame], version: int, steps: dict[int, Callable[[dict], dict]], to: int = LAYOUT) -> tuple[dict[str, DataFrame], int]:
    """Tables of a layout ``version`` brought to ``to`` by one step a version; a newer layout is an error."""
    if version > to:
        raise ValueError(f"the tables have layout {version}, this library knows {to}")
    while version < to:
        tables, version = steps[version](dict(tables)), version + 1
    return tables, version
