"""Several projects at a time: the same question to each, indexing all of them, and one package of theirs."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.budget import pack_greedily, round_robin
from loamgraph.operators.context import context
from loamgraph.plans.catalog import Catalog
from loamgraph.schema import Graph
from loamgraph.streaming.watch import Language, index
from loamgraph.tools import Workbench

LEAST_BUDGET, MOST_BUDGET, WHOLE_BUDGET = 256, 6000, 32_000
MOST_PROJECTS, CACHED = 64, 32


def error_message(error: BaseException) -> str:
    """What to show of an error: its own text, or its kind."""
    return str(error).strip() or type(error).__name__


def share(projects: int) -> int:
    """The token budget of each of so many projects."""
    return max(LEAST_BUDGET, min(MOST_BUDGET, WHOLE_BUDGET // max(1, projects)))


def fan_out(benches: dict[str, Workbench], tool: str, **given) -> list[dict]:
    """The text that a tool gives for each project within its share of the budget; an error stands beside the results."""
    if len(benches) > MOST_PROJECTS:
        raise ValueError(f"at most {MOST_PROJECTS} projects")
    out = []
    for project, bench in benches.items():
        try:
            out.append({"project": project, "status": "ok", "result": bench.text(tool, share(len(benches)), **given)})
        except Exception as e:  # one project's failure is a result of its own
            out.append({"project": project, "status": "error", "result": error_message(e)})
    return out


def index_all(catalogs: dict[str, Catalog], read: Callable[[str], DataFrame], language: Language) -> list[dict]:
    """Bring every project's catalog up to the files that ``read`` gives for it; a summary of each."""
    out = []
    for project, catalog in catalogs.items():
        try:
            out.append({"project": project, "status": "ok", "revision": index(catalog, read(project), language)})
        except Exception as e:  # the others are indexed all the same
            out.append({"project": project, "status": "error", "message": error_message(e)})
    return out


def workspace_context(graphs: dict[str, Graph], requests: DataFrame) -> DataFrame:
    """(request_id, project, symbol_id, representation, cost): one package of all projects for each request (request_id,
    task, max_tokens): their own packages, a symbol of each in turn, as far as the budget goes."""
    own = [context(g, requests).withColumn("project", F.lit(p)) for p, g in graphs.items()]
    rows = reduce(DataFrame.unionByName, own).withColumn("_turn", F.concat_ws("\x1f", "request_id", "project"))
    turns = round_robin(rows, "_turn", [F.desc("cost"), F.asc("symbol_id")])
    budgets = requests.select("request_id", F.col("max_tokens").alias("budget"))
    return pack_greedily(turns, "request_id", ["local_rank", "project"], "cost", budgets).select("request_id", "project", "symbol_id", "representation", "cost")


class ContextCache:
    """The last ``CACHED`` texts by request; the oldest goes first."""

    def __init__(self, size: int = CACHED):
        self.size, self.held, self.hits = size, OrderedDict(), 0

    def get(self, key: tuple, make: Callable[[], str]) -> str:
        if key in self.held:
            self.hits += 1
        else:
            self.held[key] = make()
            if len(self.held) > self.size:
                self.held.popitem(last=False)
        return self.held[key]
