"""Context packages: what to read for a task, within a token budget, for many requests in one job.

Terms of each task are searched by their stems, and identifiers that the task names are resolved; candidates are scored
by their signals; the best are expanded along the graph, level by level, keeping the direction of the first step; what is
eligible gets representations. The primary symbol, a test and named symbols have shares of the budget kept for them; of
the rest a knapsack per request takes the most useful.

Nodes, edges, requests and candidates all grow, and Spark estimates their compressed files far too small: their joins are
merged, so that none is broadcast through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.functions.text import classify_task, query_terms, stems, words
from loamgraph.operators.adjacency import neighbors, resolve, skeleton
from loamgraph.operators.budget import count_tokens, optimize_budget, prefix_within, representations, reserve, without_covered
from loamgraph.operators.metrics import recall, reduction
from loamgraph.operators.search import candidate_score, exact_identifiers, rank_score, stemmed_index, stemmed_search
from loamgraph.operators.views import omission
from loamgraph.plans.storage import forget, store
from loamgraph.schema import Graph

CANDIDATES = 500
# Candidates kept by budget (tokens up to, number).
SHORTLIST = ((600, 6), (1500, 14), (4000, 25), (1 << 31, 40))
LEAST_SCORE, LEAST_SHARE = 0.1, 0.3
SEEDS, QUEUE, FANOUT = 5, 60, 50
# The edge types that are followed, those that carry on, what they pass down, and containers.
FOLLOWED = ("CALLS", "REFERENCES", "IMPLEMENTS", "EXTENDS", "ACCEPTS", "RETURNS", "CONFIGURED_BY", "ROUTED_FROM", "READS", "CREATES", "UPDATES", "EMITS", "CONSUMES", "CONTAINS")
FLOW = ("CALLS", "IMPLEMENTS", "EXTENDS", "ROUTED_FROM", "READS", "CREATES", "UPDATES", "EMITS", "CONSUMES", "CONTAINS")
FLOW_DECAY, OTHER_DECAY = 0.7, 0.35
CONTAINERS = ("class", "service", "controller", "interface")
# Shares of the budget kept for roles, and how many named symbols have one.
SHARES = {"primary": 0.55, "test": 0.25, "exact": 0.15}
MOST_EXACT = 4


def _facts(requests: DataFrame) -> DataFrame:
    """(request_id, task, terms, plain, plain_stems, strategy, depth) of requests."""
    rows = requests.select("request_id", "task", query_terms("task").alias("terms"), F.array_distinct(words("task")).alias("plain"), classify_task("task").alias("strategy"))
    return rows.withColumn("plain_stems", stems("plain")).withColumn("depth", F.when(F.col("strategy") == "locate", 1).otherwise(2))


def _steps(graph: Graph) -> DataFrame:
    """(_at, way, type, id, kind of ``_at``) of edges that are followed, in both directions; containment outwards from
    containers only; the first ``FANOUT`` of a node and direction by type and id."""
    kinds = graph.nodes.select(F.col("id").alias("_at"), F.col("kind").alias("_kind"))
    edges = graph.edges_of(FOLLOWED)
    out = edges.select(F.col("source").alias("_at"), F.lit("out").alias("way"), "type", F.col("target").alias("id"))
    back = edges.where("type <> 'CONTAINS'").select(F.col("target").alias("_at"), F.lit("in").alias("way"), "type", F.col("source").alias("id"))
    both = out.unionByName(back).distinct().join(kinds.hint("merge"), "_at").where((F.col("type") != "CONTAINS") | F.col("_kind").isin(*CONTAINERS))
    first = F.row_number().over(Window.partitionBy("_at", "way").orderBy("type", "id"))
    return both.withColumn("_n", first).where(F.col("_n") <= FANOUT).select("_at", "way", "type", "id")


def candidates(graph: Graph, requests: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(request_id, id, score, distance, exact) of searched, named and expanded nodes, scores between 0 and 1."""
    fields = {n: c for n, c in (("identity", "qualified_name"), ("signature", "signature"), ("documentation", "documentation")) if c in graph.nodes.columns}
    index = store(stemmed_index(graph.nodes, "id", fields), "terms")
    facts = store(_facts(requests), "facts")
    asked = facts.select(F.col("request_id").alias("query_id"), F.array_join("terms", " ").alias("query"))
    hits = stemmed_search(index, asked, CANDIDATES).select(F.col("query_id").alias("request_id"), "id", "rank")
    named = exact_identifiers(requests, "request_id", "task").withColumnRenamed("id", "request_id").hint("merge")
    found = resolve(graph, named.select(F.col("identifier").alias("query")))
    exact = store(named.join(found.select(F.col("query").alias("identifier"), "id"), "identifier").select("request_id", "id").distinct(), "exact")
    text = lambda c: words(F.coalesce(F.col(c), F.lit("")))
    nodes = graph.nodes.withColumns({"_name": text("qualified_name"), "_path": text("file"), "_signature": text("signature") if "signature" in graph.nodes.columns else F.array().cast("array<string>")})
    nodes = nodes.withColumn("_stem", F.get(stems(F.array(F.lower("name"))), F.lit(0)))
    nodes = store(nodes.select("id", "kind", "name", "file", "exported", "entry_point", "_name", "_path", "_signature", "_stem"), "named")

    def scored(rows: DataFrame, distance: Column) -> DataFrame:
        """rows: (request_id, id, inherited) as candidates; those that do not belong in a context are left out."""
        mine = exact.withColumn("exact", F.lit(True)).hint("merge")
        # the thin join first and the requests' texts last: wide rows are dealt out once
        rows = rows.join(mine, ["request_id", "id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
        rows = rows.join(nodes.hint("merge"), "id").join(facts.hint("merge"), "request_id")
        rank = lambda d: rank_score("terms", "_name", "_path", "_signature", d, F.col("entry_point"), F.col("kind"), F.col("strategy"), F.col("exported"), weights=weights)
        is_named, is_stem = F.array_contains("plain", F.lower("name")), F.coalesce(F.array_contains("plain_stems", F.col("_stem")), F.lit(False))
        score = candidate_score(F.col("inherited"), rank(distance), rank(F.lit(None).cast("double")), distance, F.col("kind"), F.col("exact"), is_named, is_stem)
        why = omission(F.col("kind"), F.col("name"), F.col("file"), F.col("exact"), F.col("plain"), F.col("task"), F.lit(None).cast("string"))
        return rows.where(why.isNull()).select("request_id", "id", score.alias("score"), distance.alias("distance"), "exact", "depth")

    lexical = 0.48 / (1 + (F.col("rank") - 1) / 10)
    direct = hits.select("request_id", "id", lexical.alias("inherited")).unionByName(exact.withColumn("inherited", F.lit(0.0)))
    direct = store(scored(direct.groupBy("request_id", "id").agg(F.max("inherited").alias("inherited")), F.lit(0)), "direct")
    top = lambda n: F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "id")) <= n
    frontier = direct.withColumn("_top", top(SEEDS)).where("_top").select("request_id", F.col("id").alias("_at"), F.col("score").alias("_from"), F.lit(None).cast("string").alias("_way"), "depth")
    step, levels = store(_steps(graph), "steps"), [direct]
    for distance in (1, 2):
        near = frontier.where(F.col("depth") >= distance).join(step.hint("merge"), "_at")
        near = near.where(F.col("_way").isNull() | (F.col("_way") == F.col("way")) | (F.col("type") == "IMPLEMENTS"))
        flow = F.col("type").isin(*FLOW)
        near = near.withColumn("inherited", F.col("_from") * F.when(flow, FLOW_DECAY).otherwise(OTHER_DECAY)).withColumn("_flow", flow)
        near = store(near.select("request_id", "id", "inherited", "_flow", F.coalesce("_way", "way").alias("way")), "near")
        best = near.groupBy("request_id", "id").agg(F.max("inherited").alias("inherited"))
        level = store(scored(best, F.lit(distance)), "level")
        levels.append(level)
        onward = near.where("_flow").select("request_id", "id", "way").distinct().join(level.hint("merge"), ["request_id", "id"])
        frontier = onward.withColumn("_top", top(QUEUE)).where("_top").select("request_id", F.col("id").alias("_at"), F.col("score").alias("_from"), F.col("way").alias("_way"), "depth")
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    once = whole.groupBy("request_id", "id").agg(F.max("score").alias("score"), F.min("distance").alias("distance"), F.bool_or("exact").alias("exact"))
    once = once.withColumn("_top", top(CANDIDATES)).where("_top").drop("_top")
    out = store(once, "candidates")
    forget(index, facts, exact, nodes, step, near, *levels)
    return out


def eligible(found: DataFrame, graph: Graph, requests: DataFrame) -> DataFrame:
    """Candidates at or above a tenth, and three tenths of the best, without those that hold an eligible member unless
    the task names them, shortlisted by budget; ``position`` from 1."""
    best = F.max("score").over(Window.partitionBy("request_id"))
    kept = found.withColumn("_best", best).where((F.col("score") >= LEAST_SCORE) & (F.col("score") >= F.col("_best") * LEAST_SHARE))
    held = graph.edges_of(("CONTAINS",)).select(F.col("source").alias("id"), F.col("target").alias("_member")).distinct().hint("merge")
    parents = kept.select("request_id", F.col("id").alias("_member")).join(held, "_member").select("request_id", "id").distinct().withColumn("_parent", F.lit(True))
    kept = kept.join(parents.hint("merge"), ["request_id", "id"], "left").where(F.col("exact") | F.col("_parent").isNull())
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "id"))
    most = None
    for tokens, n in SHORTLIST:
        test = F.col("max_tokens") <= tokens
        most = F.when(test, n) if most is None else most.when(test, n)
    ranked = kept.withColumn("position", rank).join(requests.select("request_id", "max_tokens").hint("merge"), "request_id")
    return ranked.where(F.col("position") <= most).select("request_id", "id", "score", "distance", "exact", "position")


def roles(short: DataFrame) -> DataFrame:
    """``short`` (with ``kind``) with ``role``: the first is primary, the first test a test, then the first named ones."""
    nth = lambda c: F.row_number().over(Window.partitionBy("request_id", c).orderBy("position"))
    rows = short.withColumn("_test", F.col("kind") == "test").withColumn("_exact", F.col("exact") & (F.col("position") > 1) & ~F.col("_test"))
    role = F.when(F.col("position") == 1, "primary").when(F.col("_test") & (nth("_test") == 1), "test").when(F.col("_exact") & (nth("_exact") <= MOST_EXACT), "exact")
    return rows.withColumn("role", role).drop("_test", "_exact")


def context(graph: Graph, requests: DataFrame, sources: DataFrame | None = None, weights: dict[str, float] | None = None, count=count_tokens) -> DataFrame:
    """(request_id, symbol_id, representation, cost): a package for each request (request_id, task, max_tokens).

    ``sources`` (id, source) adds whole sources to signatures and outlines.
    """
    short = eligible(candidates(graph, requests, weights), graph, requests)
    texts = graph.nodes.select("id", "kind", "qualified_name", F.concat_ws(" ", "kind", "name").alias("summary"), F.concat_ws(" ", "kind", "qualified_name", F.col("file")).alias("signature"))
    symbols = roles(short.join(texts.hint("merge"), "id"))
    if sources is not None:
        symbols = symbols.join(sources.select("id", "source").hint("merge"), "id", "left")
    symbols = store(symbols.withColumn("is_primary", F.col("position") == 1).withColumnRenamed("id", "symbol_id"), "symbols")
    budgets = requests.select("request_id", F.least("max_tokens", F.lit(32_000)).alias("budget")).hint("merge")
    options = store(representations(symbols, count).select("request_id", "symbol_id", "representation", "cost", "utility", "position"), "options")

    with_role = options.join(symbols.where("role is not null").select("request_id", "symbol_id", "role").hint("merge"), ["request_id", "symbol_id"])
    order = F.array_position(F.array(*[F.lit(r) for r in SHARES]), F.col("role")).alias("_order")
    kept = prefix_within(reserve(with_role, budgets, SHARES).select("*", order), "request_id", ["_order", "position", "symbol_id"], "cost", budgets)
    kept = store(kept.select("request_id", "symbol_id", "representation", "cost"), "reserved")
    spent = kept.groupBy("request_id").agg(F.sum("cost").alias("_spent"))
    left = budgets.join(spent, "request_id", "left").select("request_id", (F.col("budget") - F.coalesce("_spent", F.lit(0))).cast("int").alias("budget"))
    rest = options.join(kept.select("request_id", "symbol_id").hint("merge"), ["request_id", "symbol_id"], "left_anti")
    chosen = kept.select("request_id", "symbol_id", "representation", F.col("cost").cast("int").alias("cost")).unionByName(optimize_budget(rest, left.hint("merge")))
    names = symbols.select("request_id", "symbol_id", "qualified_name").hint("merge")
    return without_covered(chosen.join(names, ["request_id", "symbol_id"])).select("request_id", "symbol_id", "representation", "cost")


SEMANTIC_CHARS, SEMANTIC_RELATIONS = 6000, 15


def semantic_input(graph: Graph, seeds: DataFrame, files: DataFrame) -> DataFrame:
    """(seed, outline, relations, hashes): what a description of each symbol (seed) may be written from: its outline cut to
    ``SEMANTIC_CHARS``, its first ``SEMANTIC_RELATIONS`` outgoing relations, and the digests of the files (path, hash)
    that these come from."""
    own = graph.nodes.select(F.col("id").alias("seed"), "name", F.col("file").alias("path")).join(seeds.select("seed").distinct(), "seed")
    outline = own.join(skeleton(graph, seeds), "seed", "left").select("seed", "path", F.substring(F.coalesce("outline", "name"), 1, SEMANTIC_CHARS).alias("outline"))
    near = neighbors(graph, seeds, "out", None, SEMANTIC_RELATIONS).join(graph.nodes.select("id", "qualified_name", "file"), "id")
    told = near.groupBy("seed").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "type", "qualified_name"))).alias("relations"), F.collect_set("file").alias("_files"))
    both = outline.join(told, "seed", "left").withColumn("_paths", F.array_distinct(F.concat(F.array("path"), F.coalesce("_files", F.array().cast("array<string>")))))
    digests = both.select("seed", F.explode("_paths").alias("path")).join(files.select("path", "hash"), "path").groupBy("seed").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "hash")))).alias("hashes"))
    return both.join(digests, "seed", "left").select("seed", "outline", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"), "hashes")


def benchmark(graph: Graph, scenarios: DataFrame, files: DataFrame, count=count_tokens) -> DataFrame:
    """(scenario_id, before, after, reduction, recall, missing) of scenarios (id, task, baselineFiles, requiredSymbols,
    maxTokens) against whole files (path, content): tokens of the files that would be read, of the package, and which
    required symbols it lacks."""
    chosen = store(context(graph, scenarios.select(F.col("id").alias("request_id"), "task", F.col("maxTokens").alias("max_tokens")), count=count), "packages")
    after = chosen.groupBy(F.col("request_id").alias("scenario_id")).agg(F.sum("cost").alias("after"))
    sizes = files.select("path", count("content").alias("_tokens"))
    before = scenarios.select(F.col("id").alias("scenario_id"), F.explode("baselineFiles").alias("path")).join(sizes, "path").groupBy("scenario_id").agg(F.sum("_tokens").alias("before"))
    names = chosen.join(graph.nodes.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("symbol")), "symbol_id")
    found = recall(scenarios.select(F.col("id").alias("scenario_id"), F.col("requiredSymbols").alias("required")), names.select(F.col("request_id").alias("scenario_id"), "symbol"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = found.join(before, "scenario_id", "left").join(after, "scenario_id", "left").select("scenario_id", zero("before"), zero("after"), "recall", "missing")
    return rows.withColumn("reduction", reduction(F.col("before"), F.col("after")))
