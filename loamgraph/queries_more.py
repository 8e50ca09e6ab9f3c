"""Further registered queries: changes of tables, views, figures, budgets, sources and addresses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.functions import urls as U
from loamgraph.operators import budget as B
from loamgraph.operators import history as H
from loamgraph.operators import metrics as X
from loamgraph.operators import mutations as M
from loamgraph.operators import records as R
from loamgraph.operators import search as S
from loamgraph.operators import topology as P
from loamgraph.operators import traversal as V
from loamgraph.operators import views as W
from loamgraph.plans.projection import activity_graph, relational_graph
from loamgraph.plans.storage import table
from loamgraph.queries import IMPACT, WORDS_SQL, on_activity, on_graph, query, states
from loamgraph.sources import files as S_files


# Changes of tables


def _order_edges(spark, d):
    """Edges of the graph by the old rule, and new ones for finished orders."""
    old = relational_graph(spark, d).edges.where("type = 'CREATES'").select("source", "target", "type", "owner", "confidence", "evidence")
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("target"))
    new = old.join(done, "target").withColumn("evidence", F.lit("seen")).withColumn("confidence", F.lit(0.5))
    more = new.withColumn("type", F.lit("UPDATES"))
    return old, new.unionByName(more)


EDGE_SETS = """old AS (SELECT source, target, type, 1.0 AS confidence FROM edges WHERE type = 'CREATES'),
done AS (SELECT 'order:' || o_orderkey AS target FROM orders WHERE o_orderstatus = 'F'),
fresh AS (SELECT source, target, type, 0.5 AS confidence FROM old JOIN done USING (target) UNION ALL SELECT source, target, 'UPDATES', 0.5 FROM old JOIN done USING (target))"""


@query(on_graph(f", {EDGE_SETS} SELECT type, confidence::DOUBLE AS confidence, count(*) AS n FROM (SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.source = old.source AND f.target = old.target AND f.type = old.type)) GROUP BY 1, 2"))
def edge_upsert(spark, d):
    return M.put_edges(*_order_edges(spark, d)).groupBy("type", "confidence").agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS path, CASE WHEN c_acctbal < 0 THEN 'new' ELSE 'old' END AS hash FROM customer UNION ALL SELECT 'extra:' || s_suppkey, 'new' FROM supplier")
def file_upsert(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit("old").alias("hash"))
    changed = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("path"), F.lit("new").alias("hash"))
    added = table(spark, d, "supplier").select(F.concat(F.lit("extra:"), F.col("s_suppkey").cast("string")).alias("path"), F.lit("new").alias("hash"))
    return M.put_files(stored, changed.unionByName(added))


@query(on_graph("SELECT id, CASE WHEN kind = 'service' THEN 'queue' ELSE kind END AS kind FROM nodes UNION ALL SELECT 'new:' || n_nationkey, 'feature' FROM nation"))
def node_upsert(spark, d):
    nodes = relational_graph(spark, d).nodes.select("id", "kind")
    added = table(spark, d, "nation").select(F.concat(F.lit("new:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("feature").alias("kind"))
    return M.put_nodes(nodes, nodes.where("kind = 'service'").withColumn("kind", F.lit("queue")).unionByName(added))


GONE = "gone AS (SELECT 'week:' || user_id || ':' || floor(epoch(ts) / 604800)::BIGINT AS path FROM events WHERE event_type = 'error')"


@query(on_activity(f", {GONE}, lost AS (SELECT id FROM nodes WHERE file IN (SELECT path FROM gone)) SELECT type, count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM lost) AND target NOT IN (SELECT id FROM lost) GROUP BY type"))
def files_removed(spark, d):
    graph = activity_graph(spark, d)
    paths = graph.nodes.where("kind = 'test'").select(F.col("file").alias("path"))
    files = graph.nodes.select(F.col("file").alias("path")).distinct()
    return M.remove_files(graph, files, paths)[1].edges.groupBy("type").agg(F.count("*").alias("n"))


@query(on_activity("SELECT source, target, type FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE entry_point)"))
def owned_edges_removed(spark, d):
    graph = activity_graph(spark, d)
    owners = graph.nodes.where("entry_point").select(F.col("id").alias("owner"))
    return M.remove_owned_edges(graph.edges, owners).select("source", "target", "type")


@query(on_activity("SELECT id FROM nodes n WHERE file IS NULL OR kind <> 'test' OR file NOT IN (SELECT file FROM nodes WHERE kind = 'service' AND file IS NOT NULL)"))
def nodes_pruned(spark, d):
    nodes = activity_graph(spark, d).nodes
    busy = nodes.where("kind = 'service'").select("file").distinct()
    return M.prune_nodes(nodes, nodes.join(busy, "file", "left_semi").where("kind <> 'test'").select("file", "id")).select("id")


@query("SELECT n_name AS key, CASE WHEN s.n IS NULL THEN n_nationkey::VARCHAR ELSE s.n::VARCHAR END AS value FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def metadata_set(spark, d):
    nation = table(spark, d, "nation")
    metadata = nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").cast("string").alias("value"))
    return R.get_meta(R.set_meta(metadata, nation.join(counts, "n_nationkey").select(F.col("n_name").alias("key"), "value")))


@query("SELECT event_id AS id, user_id AS revision FROM events ORDER BY event_id DESC LIMIT 100")
def runs_kept(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("revision"))
    last = runs.orderBy(F.desc("id")).limit(1)
    metadata = spark.createDataFrame([], "key string, value string")
    return R.finish_run(runs.join(last, "id", "left_anti"), metadata, last)[0]


def _facts(spark, d):
    hashes = F.create_map(F.concat(F.lit("brand:"), "p_brand"), F.sha2("p_brand", 256), F.concat(F.lit("type:"), "p_type"), F.sha2("p_type", 256))
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("symbol_id"), hashes.alias("hashes"))


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE right(p_brand, 1) <> '3' AND length(p_type) % 2 = 0")
def facts_current(spark, d):
    part = table(spark, d, "part")
    brands = part.select(F.concat(F.lit("brand:"), "p_brand").alias("path"), F.when(F.substring("p_brand", -1, 1) == "3", "changed").otherwise(F.sha2("p_brand", 256)).alias("hash"))
    types = part.where(F.length("p_type") % 2 == 0).select(F.concat(F.lit("type:"), "p_type").alias("path"), F.sha2("p_type", 256).alias("hash"))
    return M.current_facts(_facts(spark, d), brands.unionByName(types).distinct()).select("id")


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE right(p_brand, 1) <> '3'")
def facts_invalidated(spark, d):
    paths = table(spark, d, "part").where(F.substring("p_brand", -1, 1) == "3").select(F.concat(F.lit("brand:"), "p_brand").alias("path"))
    return M.invalidate_semantic(_facts(spark, d), paths).select("id")


@query("SELECT 'brand:' || CASE WHEN p_size > 25 THEN 'moved' ELSE p_brand END AS path, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'type:' || p_type, count(*) FROM part WHERE p_size <= 25 GROUP BY 1")
def facts_put(spark, d):
    facts = _facts(spark, d)
    large = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("id"))
    new = facts.join(large, "id").withColumn("hashes", F.create_map(F.lit("brand:moved"), F.lit("x")))
    return R.put_facts(facts, M.semantic_dependencies(facts), new)[1].groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def facts_of_symbols(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("symbol_id"))
    return R.facts_of(_facts(spark, d), wanted).select("id")


# Views


@query(on_activity("SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY id)::INT AS position FROM nodes WHERE file IS NOT NULL"))
def nodes_in_files(spark, d):
    return W.nodes_in_files(activity_graph(spark, d)).select("file", "id", "position")


@query(on_activity("SELECT id FROM nodes WHERE file IS NOT NULL AND kind IN ('function', 'method', 'service', 'interface')"))
def comparable_nodes(spark, d):
    nodes = activity_graph(spark, d).nodes
    return nodes.where(W.comparable(F.col("kind"), F.col("exported"), F.lit(None).cast("string"), F.col("file"))).select("id")


def _documents_as_nodes(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("qualified_name"), F.col("lang").alias("kind"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("file"), F.lit(1).alias("start_line"),
        T.line_count("text").alias("end_line"), F.substring("text", 1, 1200).alias("signature"), F.col("source").alias("prov_source"), F.col("lang").alias("evidence"),
    )


@query("SELECT doc_id::VARCHAR AS id, source AS symbol, lang AS kind, CASE WHEN doc_id % 3 > 0 THEN source || ':1-' || len(string_split(text, chr(10))) END AS at, text[1:1200] AS signature FROM documents")
def compact_nodes(spark, d):
    return W.compact(_documents_as_nodes(spark, d))


@query("""SELECT '["' || lang || '","' || doc_id || '"]' AS id, source[1:200] AS label, lang AS kind, lang AS root_id, doc_id::VARCHAR AS symbol_id, text[1:1000] || chr(10) || source || ': ' || lang AS detail FROM documents""")
def explorer_view(spark, d):
    return W.explorer_nodes(_documents_as_nodes(spark, d), F.col("kind"))


@query(
    on_graph("""SELECT id, CASE WHEN kind IN ('package') THEN 'declaration kind excluded from context' WHEN NOT coalesce(starts_with(file, 'nation:1/') OR starts_with(file, 'customer:1/'), false) AND file IS DISTINCT FROM 'x' THEN 'outside scope' END AS reason FROM nodes""")
)
def context_omissions(spark, d):
    nodes = relational_graph(spark, d).nodes
    reason = W.omission(F.col("kind"), F.col("name"), F.col("file"), F.lit(False), F.array(F.lit("part")), F.lit("find the part"), F.lit("nation:1/"))
    return nodes.select("id", reason.alias("reason"))


@query(
    """SELECT conv_id AS request_id, '# Context' || chr(10) || chr(10) || 'task ' || conv_id || chr(10) || chr(10) || 'Strategy: locate | Tokens: ' || sum(length(text)) || '/' || 1000 || chr(10) || chr(10)
    || string_agg('## ' || turn || ' [lines 1-' || length(text) || '; source]' || chr(10) || 'Selected: ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id"""
)
def rendered_contexts(spark, d):
    c = table(spark, d, "conversations")
    packages = c.groupBy(F.col("conv_id").alias("request_id")).agg(F.sum(F.length("text")).alias("tokens"))
    packages = packages.select("request_id", F.concat(F.lit("task "), "request_id").alias("task"), F.lit("locate").alias("strategy"), "tokens", F.lit(1000).alias("budget"))
    symbols = c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), F.col("turn").alias("symbol_id"), F.lit(1).alias("first_line"), F.length("text").alias("last_line"), F.lit("source").alias("representation"), F.col("role").alias("reason"), "text")
    return W.render_context(packages, symbols)


@query("SELECT o_orderkey AS path_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))")
def valid_paths(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("suppliers"))
    step = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    orders = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    c = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    steps = F.coalesce(F.transform("suppliers", lambda s: step(c, F.concat(F.lit("s"), s.cast("string")))), F.array(step(c, c)))
    failed = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("project"))
    failed = failed.unionByName(table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("project")))
    return W.valid_paths(orders.select(F.col("o_orderkey").alias("path_id"), steps.alias("steps")), failed).select("path_id")


# Figures


@query("SELECT l_orderkey AS scenario_id, (count(DISTINCT l_partkey) FILTER (p_size <= 25))::DOUBLE / count(DISTINCT l_partkey) AS recall, coalesce(string_agg(DISTINCT CASE WHEN p_size > 25 THEN l_partkey::VARCHAR END, ',' ORDER BY CASE WHEN p_size > 25 THEN l_partkey::VARCHAR END), '') AS missing FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def scenario_recall(spark, d):
    key = F.col("l_partkey").cast("string")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), "l_partkey")
    required = lines.groupBy("scenario_id").agg(F.array_sort(F.collect_set(key)).alias("required"))
    small = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    got = X.recall(required, lines.join(small, "l_partkey").select("scenario_id", key.alias("symbol")))
    return got.select("scenario_id", "recall", F.array_join("missing", ",").alias("missing"))


@query("SELECT lang, sum(n_chars)::BIGINT AS before, sum(least(n_chars, 1000))::BIGINT AS after, round(100.0 * (sum(n_chars) - sum(least(n_chars, 1000))) / sum(n_chars), 2)::DOUBLE AS reduction, bool_and(n_chars <= 1000) AS whole FROM documents GROUP BY 1")
def reduction_totals(spark, d):
    results = table(spark, d, "documents").select("lang", F.col("n_chars").alias("before"), F.least("n_chars", F.lit(1000)).alias("after"), F.when(F.col("n_chars") <= 1000, 1.0).otherwise(0.5).alias("recall"))
    return X.summary(results, "lang")


@query(
    """WITH s AS (SELECT l_orderkey AS request_id, l_suppkey AS file, l_linenumber, l_quantity::BIGINT AS tokens FROM lineitem), f AS (SELECT s_suppkey AS file, 500 + s_nationkey AS tokens FROM supplier),
    w AS (SELECT request_id, sum(f.tokens)::BIGINT AS raw, count(*) AS files FROM (SELECT DISTINCT request_id, file FROM s) JOIN f USING (file) GROUP BY 1)
    SELECT request_id, raw AS raw_tokens, sum(tokens)::BIGINT AS context_tokens, greatest(raw - sum(tokens), 0)::BIGINT AS avoided, round(100.0 * (raw - sum(tokens)) / raw, 2)::DOUBLE AS reduction, any_value(files) AS files, count(*) AS symbols, count(*) FILTER (l_linenumber = 1) AS sources FROM s JOIN w USING (request_id) GROUP BY request_id, raw"""
)
def context_figures(spark, d):
    chosen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("file"), F.when(F.col("l_linenumber") == 1, "source").otherwise("signature").alias("representation"), F.col("l_quantity").cast("long").alias("tokens"))
    whole = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_nationkey") + 500).alias("tokens"))
    return X.context_metrics(chosen, whole)


@query("SELECT event_type, list_sort(list(value))[least(floor(count(*) * 0.5)::BIGINT, count(*) - 1) + 1] AS p50, list_sort(list(value))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return X.percentiles(table(spark, d, "events"), "value", "event_type", {"p50": 0.5, "p95": 0.95})


@query("SELECT o_orderstatus AS service, count(*) AS requests, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS unresolved FROM orders GROUP BY 1")
def unresolved_requests(spark, d):
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("service"))
    return X.unresolved(requests, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("request_id")))


# History


@query(
    """WITH c AS (SELECT 'part:' || l_partkey AS target, 'order:' || l_orderkey AS node, min(l_linestatus) AS s, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2),
    b AS (SELECT target, node, q FROM c WHERE s = 'F' OR q > 20), a AS (SELECT target, node, CASE WHEN q > 40 THEN q + 1 ELSE q END AS q FROM c WHERE s = 'O' OR q < 45)
    SELECT snapshot, count(*) AS n FROM (SELECT CASE WHEN b.q IS NULL THEN 'after' WHEN a.q IS NULL THEN 'before' ELSE 'both' END AS snapshot FROM b FULL JOIN a ON a.target = b.target AND a.node = b.node AND a.q = b.q) GROUP BY 1"""
)
def consumers_merged(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("node")).agg(F.min("l_linestatus").alias("s"), F.min("l_quantity").cast("long").alias("q"))
    side = lambda rows, q: rows.select("target", "node", F.lit(None).cast("string").alias("signature"), q.cast("string").alias("hash"), F.lit(False).alias("dispatch"), F.array("target", "node").alias("path"))
    before = side(lines.where("s = 'F' or q > 20"), F.col("q"))
    after = side(lines.where("s = 'O' or q < 45"), F.when(F.col("q") > 40, F.col("q") + 1).otherwise(F.col("q")))
    return H.merge_consumers(before, after).groupBy("snapshot").agg(F.count("*").alias("n"))


REVIEW = """b AS (SELECT o_custkey::VARCHAR AS file, o_orderkey::VARCHAR AS q, o_orderpriority AS kind, floor(o_totalprice)::BIGINT AS hash, floor(o_totalprice / 50)::BIGINT AS masked FROM orders WHERE o_orderstatus <> 'O'),
    a AS (SELECT o_custkey::VARCHAR AS file, o_orderkey::VARCHAR AS q, o_orderpriority AS kind, floor(o_totalprice)::BIGINT + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS hash, floor(o_totalprice / 50)::BIGINT AS masked FROM orders WHERE o_orderstatus <> 'F'),
    gone AS (SELECT * FROM b WHERE q NOT IN (SELECT q FROM a)), come AS (SELECT * FROM a WHERE q NOT IN (SELECT q FROM b)),
    m AS (SELECT g.q AS old, c.q AS new FROM (SELECT kind, hash, min(q) AS q FROM gone GROUP BY 1, 2 HAVING count(*) = 1) g JOIN (SELECT kind, hash, min(q) AS q FROM come GROUP BY 1, 2 HAVING count(*) = 1) c USING (kind, hash)),
    g2 AS (SELECT * FROM gone WHERE q NOT IN (SELECT old FROM m)), c2 AS (SELECT * FROM come WHERE q NOT IN (SELECT new FROM m)),
    n AS (SELECT g.q AS old, c.q AS new FROM (SELECT kind, masked, min(q) AS q FROM g2 GROUP BY 1, 2 HAVING count(*) = 1) g JOIN (SELECT kind, masked, min(q) AS q FROM c2 GROUP BY 1, 2 HAVING count(*) = 1) c USING (kind, masked))"""


@query(
    f"""WITH {REVIEW} SELECT 'move' AS change, new AS qualified_name, old AS from_name FROM m UNION ALL SELECT 'rename', new, old FROM n
    UNION ALL SELECT 'removed', q, NULL FROM g2 WHERE q NOT IN (SELECT old FROM n) UNION ALL SELECT 'added', q, NULL FROM c2 WHERE q NOT IN (SELECT new FROM n)
    UNION ALL SELECT 'modified', q, NULL FROM b JOIN a USING (q) WHERE b.hash <> a.hash"""
)
def history_review(spark, d):
    o = table(spark, d, "orders")
    price = F.floor("o_totalprice")
    side = lambda rows, price: rows.select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").cast("string").alias("qualified_name"), F.col("o_orderpriority").alias("kind"), price.alias("hash"), F.floor(F.col("o_totalprice") / 50).alias("masked"), F.col("o_orderpriority").alias("header"))
    before, after = side(o.where("o_orderstatus <> 'O'"), price), side(o.where("o_orderstatus <> 'F'"), price + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return H.review(before, after).select("change", "qualified_name", "from_name")


# Search


@query(r"SELECT DISTINCT page_id AS id, unnest(regexp_extract_all(url, '[\w$]+(?:\.[\w$]+)+')) AS identifier FROM pages")
def exact_identifiers(spark, d):
    return S.exact_identifiers(table(spark, d, "pages"), "page_id", "url")


@query(
    """SELECT p_partkey AS id, round(least(1, greatest(p_size / 100.0, p_retailprice / 4000) * CASE WHEN p_size % 3 = 0 AND p_size % 5 > 0 THEN 0.4 ELSE 1 END + CASE WHEN p_size % 4 > 0 THEN 0.25 * p_size / 200 ELSE 0 END
    + CASE WHEN p_size % 5 = 0 THEN 0.5 WHEN p_size % 3 > 0 AND p_size % 2 = 0 THEN 0.2 WHEN p_size % 3 > 0 AND p_size % 7 = 0 THEN 0.08 ELSE 0 END), 9)::DOUBLE AS score FROM part"""
)
def candidate_scores(spark, d):
    size = F.col("p_size")
    score = S.candidate_score(size / 100, F.col("p_retailprice") / 4000, size / 200, size % 4, F.when(size % 3 == 0, "property").otherwise("method"), size % 5 == 0, size % 2 == 0, size % 7 == 0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(score, 9).alias("score"))


@query()
def search_stemmed(spark, d):
    """Benchmark passages as documents, by the stems of what conversations ask; SQL has no stemmer."""
    index = S.stemmed_index(table(spark, d, "benchmark"), "item_id", {"documentation": "text"})
    asked = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    return S.stemmed_search(index, asked, 10)


@query(
    r"""SELECT user_id AS id, 1 AS frame, 'run' || event_type AS function, '/src/' || event_type || '.ts' AS file, event_id::INT AS line, (event_id % 50)::INT AS col FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1"""
)
def trace_frames(spark, d):
    first = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.min_by(F.struct("event_type", "event_id"), "event_id").alias("e"))
    line = F.concat(F.lit("Error: it failed\n    at run"), "e.event_type", F.lit(" (file:///src/"), "e.event_type", F.lit(".ts:"), "e.event_id", F.lit(":"), F.col("e.event_id") % 50, F.lit(")\nafter"))
    return S.trace_frames(first.select("id", line.alias("trace")), "id", "trace")


@query("SELECT doc_id AS id, 2 AS start, least(4, len(string_split(text, chr(10))))::INT AS end, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS content FROM documents")
def file_slices(spark, d):
    return S.file_slice(table(spark, d, "documents"), "doc_id", "text", 2, 4)


@query(
    f"""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT file, line::INT AS line, file || ':' || ((line - 1) // 4 * 4 + 1) AS id FROM l WHERE instr(lower(content), 'licen') > 0 AND (line - 1) % 4 < 3"""
)
def grep_symbols(spark, d):
    from loamgraph.queries import line_spans

    hits = S.text_search(table(spark, d, "documents"), "doc_id", "text", "licen").select(F.col("id").alias("file"), "line")
    return S.enclosing(hits, line_spans(spark, d).where("id not like '%:all'")).select("file", "line", "id")


STOPS = "['" + "','".join(T.STOP_WORDS) + "']"
SYNONYMS = "map {" + ", ".join(f"'{k}': {list(v)}" for k, v in T.SYNONYMS.items()) + "}"


@query(
    f"""WITH w AS (SELECT conv_id, turn, {WORDS_SQL.format('text')} AS ws FROM conversations), k AS (SELECT conv_id, turn, list_filter([x FOR x, i IN ws IF list_position(ws, x) = i], lambda x: NOT list_contains({STOPS}, x)) AS ks FROM w),
    m AS (SELECT conv_id, turn, ks || flatten([coalesce({SYNONYMS}[x], []) FOR x IN ks]) AS a FROM k)
    SELECT conv_id, turn, array_to_string([x FOR x, i IN a IF list_position(a, x) = i][1:24], ' ') AS terms FROM m"""
)
def task_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.query_terms("text"), " ").alias("terms"))


# Traversal orders


@query(on_activity(IMPACT + " SELECT seed, node, position::INT AS position FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS position FROM found) WHERE position <= 5"))
def impact_order(spark, d):
    from pyspark.sql.window import Window

    graph = activity_graph(spark, d)
    order = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))
    return V.impact(graph, states(graph)).withColumn("position", order).where("position <= 5").select("seed", "node", "position")


# Budgets


@query("SELECT p_brand, p_partkey, local_rank::INT AS local_rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS local_rank FROM part) ORDER BY local_rank, p_brand LIMIT 64")
def round_robin_turns(spark, d):
    return B.round_robin(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 64).select("p_brand", "p_partkey", "local_rank")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS spent FROM lineitem) WHERE spent <= 60")
def prefix_packed(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    budgets = lines.select("l_orderkey").distinct().withColumn("budget", F.lit(60))
    return B.prefix_within(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", budgets).select("l_orderkey", "l_linenumber")


@query(
    """SELECT o_orderkey AS symbol_id, x.representation, greatest(1, length(x.t))::INT AS cost, round((o_totalprice / 1000000) * x.w, 9)::DOUBLE AS utility FROM orders,
    LATERAL (SELECT unnest(['summary', 'signature', 'source']) AS representation, unnest([o_orderstatus, o_orderpriority, o_orderpriority || o_orderstatus]) AS t, unnest([0.45, 1.0, CASE WHEN o_orderstatus = 'F' THEN 2.4 ELSE 1.45 END]) AS w) x"""
)
def representation_options(spark, d):
    o = table(spark, d, "orders").select(F.lit(1).alias("request_id"), F.col("o_orderkey").alias("symbol_id"), F.lit(1).alias("position"), (F.col("o_orderstatus") == "F").alias("is_primary"), (F.col("o_totalprice") / 1000000).alias("score"), F.col("o_orderstatus").alias("summary"), F.col("o_orderpriority").alias("signature"), F.concat("o_orderpriority", "o_orderstatus").alias("source"))
    return B.representations(o, lambda c: F.length(c)).select("symbol_id", "representation", "cost", F.round("utility", 9).alias("utility"))


RECEIPT = "same AS (SELECT o_custkey AS request_id, o_orderkey::VARCHAR AS symbol_id, o_orderstatus AS body FROM orders)"


@query(f"WITH {RECEIPT} SELECT request_id, symbol_id, body = 'F' AS reused FROM same")
def receipt_reuse(spark, d):
    now = table(spark, d, "orders").select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").cast("string").alias("symbol_id"), F.col("o_orderstatus").alias("body"))
    before = now.withColumn("body", F.when(F.col("body") == "F", "F").otherwise("old"))
    reused, new = B.receipt_delta(now, before)
    return reused.select("request_id", "symbol_id", F.lit(True).alias("reused")).unionByName(new.select("request_id", "symbol_id", F.lit(False).alias("reused")))


@query(
    """WITH o AS (SELECT l_orderkey AS request_id, l_linenumber AS symbol_id, l_partkey, CASE WHEN l_linenumber = 1 THEN 'primary' ELSE 'test' END AS role, l_quantity::INT AS cost, l_discount AS utility, l_suppkey FROM lineitem)
    SELECT request_id, symbol_id, cost FROM (SELECT *, row_number() OVER (PARTITION BY request_id, role, symbol_id ORDER BY utility DESC, cost) AS r FROM o WHERE cost <= 60 * CASE role WHEN 'primary' THEN 0.55 ELSE 0.25 END) WHERE r = 1"""
)
def shares_reserved(spark, d):
    lines = table(spark, d, "lineitem")
    options = lines.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("symbol_id"), F.when(F.col("l_linenumber") == 1, "primary").otherwise("test").alias("role"), F.lit("source").alias("representation"), F.col("l_quantity").cast("int").alias("cost"), F.col("l_discount").alias("utility"))
    budgets = lines.select(F.col("l_orderkey").alias("request_id")).distinct().withColumn("budget", F.lit(60))
    return B.reserve(options, budgets, {"primary": 0.55, "test": 0.25}).select("request_id", "symbol_id", "cost")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS same, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) OVER (PARTITION BY l_orderkey) + sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS spent FROM lineitem) WHERE l_returnflag = 'R' OR spent <= 80")
def shrunk_packages(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_returnflag") == "R").alias("kept"))
    budgets = lines.select("l_orderkey").distinct().withColumn("budget", F.lit(80))
    return B.shrink(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", "kept", budgets).select("l_orderkey", "l_linenumber")


@query(
    """WITH RECURSIVE n AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
    t AS (SELECT l_orderkey, 0::BIGINT AS r, 0::BIGINT AS spent, NULL::INT AS l_linenumber, false AS taken FROM n WHERE r = 1
      UNION ALL SELECT n.l_orderkey, n.r, CASE WHEN spent + c <= 50 THEN spent + c ELSE spent END, n.l_linenumber, spent + c <= 50 FROM t JOIN n ON n.l_orderkey = t.l_orderkey AND n.r = t.r + 1)
    SELECT l_orderkey, l_linenumber FROM t WHERE taken"""
)
def greedy_packages(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    budgets = lines.select("l_orderkey").distinct().withColumn("budget", F.lit(50))
    return B.pack_greedily(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", budgets).select("l_orderkey", "l_linenumber")


@query()
def context_packages(spark, d):
    """A package for the first turn of every conversation over the graph of activity; SQL has no knapsack."""
    from loamgraph.operators.context import context

    asked = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("request_id"), F.concat(F.lit("why does purchase fail after signup? "), "text").alias("task"), F.lit(600).alias("max_tokens"))
    return context(activity_graph(spark, d), asked)


# Sources and addresses


@query(r"SELECT page_id, url LIKE 'http%' AND NOT regexp_matches(url, '[?#].') AS public FROM pages")
def public_endpoints(spark, d):
    return table(spark, d, "pages").select("page_id", U.public_endpoint("url").alias("public"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS address FROM pages")
def clean_addresses(spark, d):
    return table(spark, d, "pages").select("page_id", U.clean_address(F.col("url")).alias("address"))


@query("SELECT page_id, substr(sha256(url), 1, 24) AS project FROM pages")
def project_ids(spark, d):
    return table(spark, d, "pages").select("page_id", T.project_identity("url").alias("project"))


@query(
    """SELECT doc_id, lang || ':' || replace(p, '\\', '/') || ':' || source AS id, CASE WHEN doc_id % 3 = 0 THEN 'json' WHEN doc_id % 3 = 1 THEN 'javascript' ELSE 'typescript' END AS language
    FROM (SELECT *, 'a\\' || source || CASE doc_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.mjs' ELSE '.tsx' END AS p FROM documents)"""
)
def symbol_ids(spark, d):
    end = F.when(F.col("doc_id") % 3 == 0, ".json").when(F.col("doc_id") % 3 == 1, ".mjs").otherwise(".tsx")
    docs = table(spark, d, "documents").withColumn("p", F.concat(F.lit("a\\"), "source", end))
    return docs.select("doc_id", T.symbol_id("lang", "p", "source").alias("id"), T.language_of("p").alias("language"))


def _manifests(spark, d):
    """Nations as packages that depend on the nations their customers buy from."""
    trade = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).where("c_nationkey <> s_nationkey and l_quantity > 45")
    wants = trade.select("c_nationkey", F.concat(F.lit("pkg-"), F.col("s_nationkey").cast("string")).alias("name")).distinct().groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.map_from_entries(F.collect_list(F.struct("name", F.lit("1")))).alias("dependencies"))
    rows = table(spark, d, "nation").join(wants, "n_nationkey", "left")
    content = F.to_json(F.struct(F.concat(F.lit("pkg-"), F.col("n_nationkey").cast("string")).alias("name"), "dependencies"))
    return rows.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("/package.json")).alias("path"), content.alias("content"))


@query("SELECT DISTINCT 'n' || c_nationkey AS source, 'n' || s_nationkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey AND l_quantity > 45")
def package_dependencies(spark, d):
    return S_files.package_edges(S_files.packages(_manifests(spark, d)))


# Services


@query(
    """WITH a AS (SELECT l_orderkey AS request_id, l_suppkey::VARCHAR AS resource, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS k FROM lineitem WHERE l_linenumber <= 2),
    b AS (SELECT DISTINCT l_suppkey::VARCHAR AS resource, l_returnflag AS k FROM lineitem WHERE l_returnflag <> 'N'), m AS (SELECT DISTINCT request_id, a.resource || b.k AS provider_id FROM a JOIN b USING (resource) WHERE a.k IS NULL OR a.k = b.k)
    SELECT request_id, provider_id, CASE WHEN count(*) OVER (PARTITION BY request_id) > 1 THEN 0.5 ELSE 0.85 END::DOUBLE AS confidence FROM m"""
)
def channel_links(spark, d):
    lines = table(spark, d, "lineitem")
    fixed = [F.lit("web").alias("service"), F.lit("queue").alias("protocol"), F.col("l_suppkey").cast("string").alias("resource"), F.lit("jobs").alias("address")]
    senders = lines.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("request_id"), *fixed, F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("channel_kind"))
    receivers = lines.where("l_returnflag <> 'N'").select(F.concat(F.col("l_suppkey").cast("string"), "l_returnflag").alias("provider_id"), F.lit("p").alias("provider"), *fixed[1:], F.col("l_returnflag").alias("channel_kind")).distinct()
    return P.connect_channels(senders, receivers).select("request_id", "provider_id", "confidence")


@query(
    """SELECT s_nationkey::VARCHAR AS service, status, count(*) AS sites, array_to_string(list_sort(list(DISTINCT s_name))[1:2], ',') AS examples FROM (SELECT *, CASE WHEN s_acctbal < 0 THEN 'missing' WHEN s_acctbal < 5000 THEN 'dynamic' ELSE 'configured' END AS status FROM supplier) GROUP BY 1, 2
    ORDER BY CASE status WHEN 'missing' THEN 1 WHEN 'dynamic' THEN 2 ELSE 3 END, service LIMIT 100"""
)
def readiness_report(spark, d):
    status = F.when(F.col("s_acctbal") < 0, "missing").when(F.col("s_acctbal") < 5000, "dynamic").otherwise("configured")
    sites = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("service"), F.lit("http").alias("kind"), F.lit("URL").alias("setting"), status.alias("status"), F.col("s_name").alias("place"))
    return P.readiness(sites).select("service", "status", "sites", F.array_join("examples", ",").alias("examples"))


@query(
    on_activity(""", asked AS (SELECT id AS seed FROM nodes WHERE kind = 'interface'), step AS (SELECT DISTINCT target AS src, source AS dst, CASE WHEN type = 'CREATES' THEN 1 ELSE 0 END AS b FROM edges WHERE type <> 'CONTAINS'),
    walk AS (SELECT seed, seed AS node, 0 AS bridges, 0 AS distance FROM asked UNION SELECT w.seed, s.dst, w.bridges + s.b, w.distance + 1 FROM walk w JOIN step s ON s.src = w.node WHERE w.distance < 4 AND w.bridges + s.b <= 2),
    least AS (SELECT seed, node, bridges, min(distance) AS distance FROM walk GROUP BY 1, 2, 3)
    SELECT seed, node, min_by(bridges, distance * 10 + bridges)::INT AS bridges, min(distance)::INT AS distance FROM least GROUP BY 1, 2""")
)
def cross_service_impact(spark, d):
    graph = activity_graph(spark, d)
    back = graph.edges.where("type <> 'CONTAINS'").select(F.col("target").alias("src"), F.col("source").alias("dst"), "type")
    seeds = graph.nodes.where("kind = 'interface'").select(F.col("id").alias("seed"))
    return P.cross_service_impact(back.where("type <> 'CREATES'"), back.where("type = 'CREATES'"), seeds)
