"""Packing under token budgets: one grouped task per request, whose input is bounded by the budget's own limits."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_BUDGET = 32_000


def best_choice(groups: list[list[tuple[int, float]]], budget: int) -> list[tuple[int, int]]:
    """(group, option) of the greatest total utility within ``budget``, at most one option (cost, utility) a group.

    Among equal totals the earlier option holds, and none before any.
    """
    if not 0 <= budget <= MOST_BUDGET:
        raise ValueError("the budget is out of range")
    best = np.zeros(budget + 1)
    taken = np.full((len(groups), budget + 1), -1, np.int16)
    for g, options in enumerate(groups):
        after = best.copy()
        for k, (cost, utility) in enumerate(options):
            if cost < 1 or not np.isfinite(utility) or utility < 0:
                raise ValueError("a cost below 1 or an invalid utility")
            if cost > budget:
                continue
            total = best[: budget + 1 - cost] + utility
            better = total > after[cost:] + 1e-9
            after[cost:][better] = total[better]
            taken[g, cost:][better] = k
        best = after
    out, left = [], budget
    for g in range(len(groups) - 1, -1, -1):
        if (k := int(taken[g, left])) >= 0:
            out.append((g, k))
            left -= groups[g][k][0]
    return out[::-1]


def optimize_budget(options: DataFrame, budgets: DataFrame) -> DataFrame:
    """(request_id, symbol_id, representation) chosen of options (request_id, symbol_id, representation, cost,
    utility, position) under budgets (request_id, budget)."""

    def choose(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["position"], r["symbol_id"], r["cost"], r["representation"]))
        by: dict[str, list[dict]] = {}
        for r in rows:
            by.setdefault(r["symbol_id"], []).append(r)
        groups = list(by.values())
        picked = best_choice([[(r["cost"], r["utility"]) for r in g] for g in groups], rows[0]["budget"])
        chosen = [groups[g][k] for g, k in picked]
        return pa.table([pa.array([r[c] for r in chosen], t.schema.field(c).type) for c in ("request_id", "symbol_id", "representation", "cost")], names=["request_id", "symbol_id", "representation", "cost"])

    given = options.select("request_id", "symbol_id", "representation", F.col("cost").cast("int").alias("cost"), F.col("utility").cast("double").alias("utility"), F.col("position").cast("int").alias("position"))
    given = given.join(budgets.select("request_id", F.col("budget").cast("int").alias("budget")), "request_id")
    kind = given.schema["request_id"].dataType.simpleString()
    return given.groupBy("request_id").applyInArrow(choose, f"request_id {kind}, symbol_id string, representation string, cost int")


# How much a representation is worth, times its symbol's score: in general, and for a primary symbol.
UTILITY = {"summary": 0.45, "signature": 1.0, "skeleton": 1.2, "excerpt": 1.25, "source": 1.45}
PRIMARY_UTILITY = {"excerpt": 1.9, "source": 2.4}


def representations(symbols: DataFrame, count: Callable[[str], object]) -> DataFrame:
    """Options of symbols (request_id, symbol_id, score, position, is_primary, and texts named as representations)."""
    texts = [n for n in UTILITY if n in symbols.columns]
    worth = lambda n: F.when(F.col("is_primary"), PRIMARY_UTILITY.get(n, UTILITY[n])).otherwise(UTILITY[n])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("representation"), F.col(n).alias("text"), (F.col("score") * worth(n)).alias("utility")) for n in texts])).alias("o")
    rows = symbols.select("request_id", "symbol_id", "position", each).select("request_id", "symbol_id", "position", "o.*").where("text is not null and text <> ''")
    return rows.withColumn("cost", F.greatest(F.lit(1), count("text")))


def count_tokens(text: str):
    """The default token count: words, numbers and single marks; exchangeable for any Column function."""
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}_]+|\p{N}+|[^\s\p{L}\p{N}_]"), F.lit(0)))


def serialize_within(value: object, most: int, count: Callable[[str], int]) -> str:
    """JSON of ``value`` within ``most`` tokens: the longest of its arrays lose their last items until it fits."""
    text = json.dumps(value)
    if count(text) <= most:
        return text
    if isinstance(value, list):
        low, high = 0, len(value)  # the longest beginning that fits
        render = lambda n: json.dumps({"items": value[:n], "truncated": True})
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if count(render(middle)) <= most else (low, middle - 1)
        if count(render(low)) <= most:
            return render(low)
    elif isinstance(value, dict):
        data = {k: list(v) if isinstance(v, list) else v for k, v in value.items()} | {"truncated": True}
        while any(isinstance(v, list) and v for v in data.values()):
            longest = max((v for v in data.values() if isinstance(v, list)), key=len)
            longest.pop()
            if count(text := json.dumps(data)) <= most:
                return text
    return json.dumps({"error": "The result does not fit into the budget."})


def prefix_within(rows: DataFrame, request: str, order: list[str], cost: str, budgets: DataFrame) -> DataFrame:
    """The longest beginning of each request's rows, in order, whose costs stay within its budget."""
    spent = F.sum(cost).over(Window.partitionBy(request).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_spent", spent).join(budgets, request).where("_spent <= budget").drop("_spent", "budget")


def round_robin(rows: DataFrame, project: str, order: list, limit: int | None = None) -> DataFrame:
    """Rows by local rank, then project, so that every project has its turn; ``local_rank`` from 1."""
    ranked = rows.withColumn("local_rank", F.row_number().over(Window.partitionBy(project).orderBy(*order)))
    return ranked if limit is None else ranked.orderBy("local_rank", project).limit(limit)


def receipt_delta(current: DataFrame, receipt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (request_id, symbol_id, body) that a receipt has with the same body, and the rest."""
    key = ["request_id", "symbol_id", "body"]
    return current.join(receipt.select(key), key, "left_semi"), current.join(receipt.select(key), key, "left_anti")


def reserve(options: DataFrame, budgets: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The dearest option that fits each request's share of the budget, for symbols of the roles in ``shares``.

    options: (request_id, symbol_id, role, representation, cost, utility).
    """
    part = F.coalesce(*[F.when(F.col("role") == r, F.lit(s)) for r, s in shares.items()])
    fits = options.join(budgets, "request_id").withColumn("_part", part).where(F.col("cost") <= F.col("budget") * F.col("_part"))
    best = F.row_number().over(Window.partitionBy("request_id", "role", "symbol_id").orderBy(F.desc("utility"), "cost"))
    return fits.withColumn("_n", best).where("_n = 1").drop("_n", "_part", "budget")


def without_covered(chosen: DataFrame) -> DataFrame:
    """Chosen symbols (request_id, qualified_name, representation, ...) without whole sources whose member is there too."""
    members = chosen.where("representation = 'source'").select("request_id", F.col("qualified_name").alias("_m"))
    holds = (chosen.request_id == members.request_id) & F.col("_m").startswith(F.concat("qualified_name", F.lit(".")))
    parents = chosen.where("representation = 'source'").join(members, holds, "left_semi").select("request_id", "qualified_name").distinct()
    return chosen.join(parents, ["request_id", "qualified_name"], "left_anti")


def pack_greedily(rows: DataFrame, request: str, order: list[str], cost: str, budgets: DataFrame) -> DataFrame:
    """``rows`` that are taken when each, in order, is added to its request if it still fits and passed over if not.

    budgets: (request, budget), of what remains after a package's fixed parts. A request's rows meet in one task: they are
    the paths, tests or additions of one package.
    """
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(request).orderBy(*order)))
    thin = numbered.select(request, "_at", F.col(cost).cast("long").alias("_cost")).join(budgets.select(request, F.col("budget").cast("long").alias("_left")), request)

    def take(t: pa.Table) -> pa.Table:
        at, costs = t.column("_at").to_numpy(), t.column("_cost").to_numpy()
        left, taken = t.column("_left")[0].as_py(), []
        for i in np.argsort(at):
            if costs[i] <= left:
                left -= costs[i]
                taken.append(i)
        return t.select([request, "_at"]).take(pa.array(taken, pa.int64()))

    kind = thin.schema[request].dataType.simpleString()
    chosen = thin.groupBy(request).applyInArrow(take, f"`{request}` {kind}, _at int")
    return numbered.join(chosen, [request, "_at"], "left_semi").drop("_at")


def shrink(rows: DataFrame, request: str, order: list[str], cost: str, protected: str, budgets: DataFrame) -> DataFrame:
    """``rows`` without the last unprotected ones of each request until what is left costs no more than its budget."""
    mine = Window.partitionBy(request)
    kept = F.coalesce(F.sum(F.when(F.col(protected), F.col(cost))).over(mine), F.lit(0))
    running = F.sum(F.when(F.col(protected), 0).otherwise(F.col(cost))).over(mine.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    spent = rows.withColumn("_spent", kept + running).join(budgets, request)
    return spent.where(F.col(protected) | (F.col("_spent") <= F.col("budget"))).drop("_spent", "budget")


def self_counting(render: Callable[[int], str], count: Callable[[str], int], most: int = 8) -> tuple[str, int]:
    """A text that states its own token count, and that count: ``render`` is called until the count stands."""
    n = 0
    for _ in range(most):
        text = render(n)
        now = count(text)
        if now == n:
            break
        n = now
    return render(n), n
