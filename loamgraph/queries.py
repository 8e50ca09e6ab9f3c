"""The registered graph queries and the DuckDB SQL that checks them.

Each query runs over whole tables. Where a query answers for seeds, these are all nodes of a kind, or all that there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.functions import text as T
from loamgraph.functions.urls import route_matches
from loamgraph.operators import adjacency as A
from loamgraph.operators import history as H
from loamgraph.operators import search as S
from loamgraph.operators import topology as P
from loamgraph.operators import traversal as V
from loamgraph.operators.cycles import cycles, strong_components
from loamgraph.plans.projection import ACTIVITY_SQL, GRAPH_SQL, activity_graph, relational_graph
from loamgraph.plans.storage import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def on_graph(sql: str) -> str:
    return f"WITH RECURSIVE {GRAPH_SQL} {sql}"


DEPENDS = "('" + "','".join(A.DEPENDENCY_TYPES) + "')"


def seeds_of(graph, kind: str) -> DataFrame:
    return graph.nodes.where(F.col("kind") == kind).select(F.col("id").alias("seed"))


def on_activity(sql: str) -> str:
    return f"WITH RECURSIVE {ACTIVITY_SQL} {sql}"


def states(graph) -> DataFrame:
    """All nodes but those that hold others."""
    return graph.nodes.where("kind <> 'class'").select(F.col("id").alias("seed"))


STATES = "asked AS (SELECT id AS seed FROM nodes WHERE kind <> 'class')"


@query(on_graph("SELECT kind, count(*) AS n FROM nodes GROUP BY kind"))
def node_counts_by_kind(spark, d):
    return relational_graph(spark, d).nodes.groupBy("kind").agg(F.count("*").alias("n"))


@query(on_graph("SELECT type, count(*) AS n FROM edges GROUP BY type"))
def edge_counts_by_type(spark, d):
    return relational_graph(spark, d).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(on_graph("SELECT 'files' AS metric, count(DISTINCT file) AS n FROM nodes UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges"))
def graph_stats(spark, d):
    return A.stats(relational_graph(spark, d))


@query(
    on_graph(""", asked AS (SELECT n_name AS query FROM nation UNION SELECT 'part:' || p_partkey FROM part),
    hits AS (SELECT query, id, min(match) AS match FROM (
      SELECT query, id, 0 AS match FROM asked JOIN nodes ON id = query UNION ALL SELECT query, id, 1 FROM asked JOIN nodes ON qualified_name = query
      UNION ALL SELECT query, id, 2 FROM asked JOIN nodes ON name = query) GROUP BY 1, 2)
    SELECT query, id, match, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY match, id) AS rank FROM hits) WHERE rank <= 20""")
)
def resolve_symbol(spark, d):
    graph = relational_graph(spark, d)
    asked = table(spark, d, "nation").select(F.col("n_name").alias("query")).union(seeds_of(graph, "interface").select(F.col("seed").alias("query")))
    return A.resolve(graph, asked)


def _adjacent_sql(kind: str, near: str, far: str, types: str) -> str:
    return on_graph(f"SELECT DISTINCT e.{near} AS seed, n.id, n.kind, n.name FROM edges e JOIN nodes n ON n.id = e.{far} JOIN nodes s ON s.id = e.{near} WHERE s.kind = '{kind}' AND e.type IN ({types})")


@query(_adjacent_sql("service", "target", "source", "'CALLS'"))
def callers(spark, d):
    graph = relational_graph(spark, d)
    return A.callers(graph, seeds_of(graph, "service"))


@query(_adjacent_sql("test", "source", "target", "'CALLS'"))
def callees(spark, d):
    graph = relational_graph(spark, d)
    return A.callees(graph, seeds_of(graph, "test"))


@query(_adjacent_sql("interface", "target", "source", "'REFERENCES','ACCEPTS','RETURNS'"))
def references_of(spark, d):
    graph = relational_graph(spark, d)
    return A.references(graph, seeds_of(graph, "interface"))


@query(_adjacent_sql("interface", "target", "source", "'IMPLEMENTS'"))
def implementations_of(spark, d):
    graph = relational_graph(spark, d)
    return A.implementations(graph, seeds_of(graph, "interface"))


@query(
    on_graph("""SELECT seed, type, id FROM (SELECT e.target AS seed, e.type, e.source AS id, row_number() OVER (PARTITION BY e.target ORDER BY e.type, e.source) AS r
    FROM edges e JOIN nodes n ON n.id = e.target AND n.kind = 'service') WHERE r <= 5""")
)
def neighbors_capped(spark, d):
    graph = relational_graph(spark, d)
    return A.neighbors(graph, seeds_of(graph, "service"), "in", None, 5).select("seed", "type", "id")


MEMBERS = "members AS (SELECT id AS root, id AS seed FROM nodes WHERE kind = 'class' UNION SELECT source, target FROM edges JOIN nodes ON id = source AND kind = 'class' WHERE type = 'CONTAINS')"


@query(
    on_activity(f""", {MEMBERS}, asked AS (SELECT root, seed FROM members UNION ALL SELECT id, id FROM nodes WHERE kind = 'interface')
    SELECT DISTINCT root AS seed, target AS id FROM asked JOIN edges ON source = seed WHERE type = 'TESTED_BY'
    UNION SELECT root, source FROM asked JOIN edges ON target = seed JOIN nodes ON id = source AND kind = 'test' WHERE type IN ('CALLS', 'REFERENCES')""")
)
def tests_for(spark, d):
    graph = activity_graph(spark, d)
    return A.tests_for(graph, seeds_of(graph, "class").unionByName(seeds_of(graph, "interface")))


@query(
    on_graph(f""", {MEMBERS} SELECT DISTINCT m.root AS seed, e.target AS id FROM members m JOIN edges e ON e.source = m.seed
    WHERE e.type IN {DEPENDS} AND NOT EXISTS (SELECT 1 FROM members x WHERE x.root = m.root AND x.seed = e.target)""")
)
def dependencies_agg(spark, d):
    graph = relational_graph(spark, d)
    return A.dependencies(graph, seeds_of(graph, "class"))


@query(
    on_graph(f""", members AS (SELECT id AS root, id AS seed FROM nodes WHERE kind = 'service')
    SELECT DISTINCT m.root AS seed, e.source AS id FROM members m JOIN edges e ON e.target = m.seed WHERE e.type IN {DEPENDS} AND e.source <> m.root""")
)
def dependents_agg(spark, d):
    graph = relational_graph(spark, d)
    return A.dependents(graph, seeds_of(graph, "service"))


FILE_PAIRS = "pairs AS (SELECT DISTINCT t.file AS file, o.file AS dependent FROM edges e JOIN nodes t ON t.id = e.target JOIN nodes o ON o.id = e.source WHERE t.file <> o.file)"


@query(on_graph(f", {FILE_PAIRS} SELECT file, dependent FROM pairs"))
def dependent_files(spark, d):
    return A.dependent_files(relational_graph(spark, d))


@query(
    on_graph(f""", {FILE_PAIRS} SELECT n.file, count(*) AS declarations, coalesce(any_value(a.c), 0) AS depends_on, coalesce(any_value(b.c), 0) AS dependents FROM nodes n
    LEFT JOIN (SELECT dependent, count(*) AS c FROM pairs GROUP BY 1) a ON a.dependent = n.file
    LEFT JOIN (SELECT file, count(*) AS c FROM pairs GROUP BY 1) b ON b.file = n.file WHERE n.file IS NOT NULL GROUP BY n.file""")
)
def file_overview(spark, d):
    return A.file_overview(relational_graph(spark, d))


@query(
    on_graph("""SELECT s.id AS seed, count(*) AS members, s.name || ' { ' || string_agg(n.name, '; ' ORDER BY n.name) || ' }' AS outline
    FROM nodes s JOIN edges e ON e.source = s.id AND e.type = 'CONTAINS' JOIN nodes n ON n.id = e.target WHERE s.kind = 'class' GROUP BY s.id, s.name""")
)
def skeleton_members(spark, d):
    graph = relational_graph(spark, d)
    return A.skeleton(graph, seeds_of(graph, "class"))


@query(
    on_graph(""", entry AS (SELECT id FROM nodes WHERE entry_point ORDER BY id LIMIT 30)
    SELECT seed, type, id FROM (SELECT e.source AS seed, e.type, e.target AS id, row_number() OVER (PARTITION BY e.source ORDER BY e.type, e.target) AS r FROM edges e JOIN entry ON entry.id = e.source) WHERE r <= 10""")
)
def architecture_map(spark, d):
    return A.architecture(relational_graph(spark, d))


@query(on_graph("SELECT count(*) AS n FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)"))
def sound_edges(spark, d):
    return A.edges_with_nodes(relational_graph(spark, d)).agg(F.count("*").alias("n"))


IMPACT = f""", {STATES}, steps AS (
      SELECT DISTINCT target AS src, source AS dst, type = 'IMPLEMENTS' AS dispatch FROM edges WHERE type IN {DEPENDS}
      UNION SELECT source, target, type = 'IMPLEMENTS' FROM edges WHERE type IN ('TESTED_BY', 'IMPLEMENTS')
    ), walk AS (
      SELECT seed, seed AS node, false AS dispatch, 0 AS distance FROM asked
      UNION SELECT w.seed, s.dst, w.dispatch OR s.dispatch, w.distance + 1 FROM walk w JOIN steps s ON s.src = w.node WHERE w.distance < 3
    ), best AS (
      SELECT seed, node, min(distance) FILTER (NOT dispatch) AS sure, min(distance) AS any_way FROM walk GROUP BY 1, 2
    ), found AS (
      SELECT seed, node, sure IS NULL AS dispatch, coalesce(sure, any_way) AS distance FROM best
    )"""


@query(on_activity(IMPACT + " SELECT seed, node, distance::INT AS distance, round(1.0 / (distance + 1), 3)::DOUBLE AS score FROM found"))
def impact_distance(spark, d):
    graph = activity_graph(spark, d)
    return V.impact(graph, states(graph)).select("seed", "node", "distance", "score")


@query(on_activity(IMPACT + " SELECT seed, dispatch, count(*) AS n FROM found GROUP BY 1, 2"))
def impact_dispatch_flag(spark, d):
    graph = activity_graph(spark, d)
    return V.impact(graph, states(graph)).groupBy("seed", "dispatch").agg(F.count("*").alias("n"))


@query(
    on_activity(
        IMPACT
        + """ SELECT seed, CASE WHEN kind = 'test' THEN 'test' WHEN kind = 'route' OR entry_point THEN 'route' WHEN kind IN ('module', 'file', 'package') THEN 'module' WHEN exported THEN 'api' ELSE 'other' END AS surface,
    count(*) AS n FROM found JOIN nodes ON id = node GROUP BY 1, 2"""
    )
)
def impact_classified(spark, d):
    graph = activity_graph(spark, d)
    return V.impact(graph, states(graph)).groupBy("seed", "surface").agg(F.count("*").alias("n"))


@query(
    on_activity(f""", {STATES}, walk AS (SELECT seed, seed AS node, 0 AS distance FROM asked
      UNION SELECT w.seed, e.target, w.distance + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE w.distance < 8 AND e.type IN {V.PATH_TYPES})
    SELECT seed, node, min(distance)::INT AS distance FROM walk GROUP BY 1, 2""")
)
def shortest_path_len(spark, d):
    graph = activity_graph(spark, d)
    return V.shortest_paths(graph, states(graph)).select("seed", "node", "distance")


@query(
    on_activity(f""", {STATES}, walk AS (SELECT seed, [seed] AS path FROM asked
      UNION ALL SELECT w.seed, list_append(w.path, e.target) FROM walk w JOIN edges e ON e.source = w.path[-1] WHERE len(w.path) < 4 AND e.type IN {V.PATH_TYPES} AND NOT list_contains(w.path, e.target))
    SELECT seed, path[-1] AS node, array_to_string(min(path), '>') AS path FROM walk w WHERE len(path) = (SELECT min(len(x.path)) FROM walk x WHERE x.seed = w.seed AND x.path[-1] = w.path[-1]) GROUP BY 1, 2""")
)
def shortest_path_nodes(spark, d):
    graph = activity_graph(spark, d)
    return V.shortest_paths(graph, states(graph), 3).select("seed", "node", F.array_join("path", ">").alias("path"))


@query(
    on_activity(f""", {STATES}, steps AS (
      SELECT DISTINCT target AS src, source AS dst, type = 'IMPLEMENTS' AS dispatch FROM edges WHERE type IN ('CALLS', 'REFERENCES', 'IMPLEMENTS')
      UNION SELECT source, target, type = 'IMPLEMENTS' FROM edges WHERE type IN ('TESTED_BY', 'IMPLEMENTS')
    ), walk AS (
      SELECT seed, seed AS node, false AS dispatch, 0 AS distance FROM asked
      UNION SELECT w.seed, s.dst, w.dispatch OR s.dispatch, w.distance + 1 FROM walk w JOIN steps s ON s.src = w.node JOIN nodes n ON n.id = w.node AND n.kind <> 'test' WHERE w.distance < 4
    ), best AS (SELECT seed, node, min(distance) FILTER (NOT dispatch) AS sure, min(distance) AS any_way FROM walk GROUP BY 1, 2)
    SELECT seed, node, coalesce(sure, any_way)::INT AS distance, sure IS NULL AS dispatch FROM best JOIN nodes ON id = node AND kind = 'test'""")
)
def test_path_len(spark, d):
    graph = activity_graph(spark, d)
    return V.test_paths(graph, states(graph))


@query(
    on_activity(f""", {STATES}, near AS (SELECT seed, seed AS node FROM asked UNION SELECT seed, source FROM asked JOIN edges ON target = seed UNION SELECT seed, target FROM asked JOIN edges ON source = seed)
    SELECT DISTINCT a.seed, e.source, e.target, e.type FROM edges e JOIN near a ON a.node = e.source JOIN near b ON b.node = e.target AND b.seed = a.seed""")
)
def ego_network_edges(spark, d):
    graph = activity_graph(spark, d)
    return V.relationships(graph, states(graph), 1)


@query(
    on_activity(f""", {FILE_PAIRS}, walk AS (SELECT DISTINCT file AS seed, file AS node FROM nodes WHERE file IS NOT NULL
    UNION SELECT w.seed, p.dependent FROM walk w JOIN pairs p ON p.file = w.node) SELECT seed, node FROM walk""")
)
def reverse_closure(spark, d):
    graph = activity_graph(spark, d)
    return V.reverse_closure(A.dependent_files(graph), graph.nodes.where("file is not null").select(F.col("file").alias("seed")).distinct())


FLOW = """flow AS (SELECT DISTINCT source, target FROM edges WHERE type <> 'CONTAINS'),
    reach AS (SELECT source, target FROM flow UNION SELECT r.source, f.target FROM reach r JOIN flow f ON f.source = r.target),
    mutual AS (SELECT a.source AS id, a.target AS other FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source)"""


def flow(spark: SparkSession, d: str) -> DataFrame:
    return activity_graph(spark, d).edges.where("type <> 'CONTAINS'").select("source", "target").distinct()


@query(on_activity(f", {FLOW}, ids AS (SELECT source AS id FROM flow UNION SELECT target FROM flow) SELECT i.id, coalesce(min(least(m.id, m.other)), i.id) AS component FROM ids i LEFT JOIN mutual m ON m.id = i.id GROUP BY i.id"))
def scc_components(spark, d):
    return strong_components(flow(spark, d))


@query(
    on_activity(f""", {FLOW}, own AS (SELECT id, min(least(id, other)) AS component FROM mutual GROUP BY 1)
    SELECT component, count(*) AS size, string_agg(id, ',' ORDER BY id) AS members FROM own GROUP BY 1 HAVING count(*) > 1 ORDER BY size DESC, component LIMIT 30""")
)
def dependency_cycles(spark, d):
    return cycles(flow(spark, d)).withColumn("members", F.concat_ws(",", "members"))


WORDS_SQL = "regexp_extract_all(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+')"


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS_SQL.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.words("text"))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("df"))


PART_QUERIES = [(1, "blue steel"), (2, "small brass polished"), (3, "part red green"), (4, "promo")]
ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in PART_QUERIES) + ") t(query_id, query))"


def part_index(spark: SparkSession, d: str) -> DataFrame:
    return S.index_terms(table(spark, d, "part"), "p_partkey", {"identity": "p_name", "signature": "p_type", "effects": "p_brand"})


PART_TERMS = f"""fields AS (SELECT p_partkey AS id, 4.0 AS w, p_name AS t FROM part UNION ALL SELECT p_partkey, 1.0, p_type FROM part UNION ALL SELECT p_partkey, 2.0, p_brand FROM part),
    tokens AS (SELECT id, w, unnest({WORDS_SQL.format('t')}) AS term FROM fields)"""


@query(
    f"""WITH {ASKED}, {PART_TERMS}, lengths AS (SELECT id, count(*) AS len FROM tokens GROUP BY id), size AS (SELECT count(*) AS n, avg(len) AS mean FROM lengths),
    wanted AS (SELECT DISTINCT query_id, unnest({WORDS_SQL.format('query')}) AS wanted FROM asked),
    hits AS (SELECT query_id, wanted, id, sum(w) AS wtf FROM wanted JOIN tokens ON starts_with(term, wanted) GROUP BY 1, 2, 3),
    dfs AS (SELECT query_id, wanted, count(*) AS df FROM hits GROUP BY 1, 2),
    scores AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
      FROM hits JOIN dfs USING (query_id, wanted) JOIN lengths USING (id), size GROUP BY 1, 2)
    SELECT query_id::INT AS query_id, id, round(score, 4)::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 20"""
)
def bm25_topk(spark, d):
    asked = spark.createDataFrame(PART_QUERIES, "query_id int, query string")
    return S.bm25(part_index(spark, d), asked, 20).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query(
    f"""WITH {ASKED}, {PART_TERMS}, wanted AS (SELECT DISTINCT query_id, unnest({WORDS_SQL.format('query')}) AS term FROM asked)
    SELECT query_id::INT AS query_id, id, count(DISTINCT term) AS hits FROM wanted JOIN tokens USING (term) GROUP BY 1, 2"""
)
def term_coverage(spark, d):
    return S.term_coverage(part_index(spark, d), spark.createDataFrame(PART_QUERIES, "query_id int, query string"))


@query(
    on_graph(f""", asked AS (SELECT ['part', 'blue', 'brand'] AS terms), t AS (SELECT id, kind, exported, entry_point, {WORDS_SQL.format('qualified_name')} AS nt, {WORDS_SQL.format("coalesce(file, '')")} AS ft FROM nodes),
    o AS (SELECT t.*, len(list_filter(terms, lambda x: len(list_filter(nt, lambda y: starts_with(y, x))) > 0)) / 3.0 AS on_, len(list_filter(terms, lambda x: len(list_filter(ft, lambda y: starts_with(y, x))) > 0)) / 3.0 AS of_ FROM t, asked)
    SELECT id, round(greatest(0, least(1, 0.38 * on_ + 0.12 * of_ + CASE WHEN entry_point THEN 0.06 ELSE 0 END + CASE WHEN kind = 'test' THEN 0.03 ELSE 0 END + CASE WHEN exported THEN 0.03 ELSE 0 END)), 4)::DOUBLE AS score FROM o""")
)
def rank_signals(spark, d):
    nodes = relational_graph(spark, d).nodes
    terms = F.array(F.lit("part"), F.lit("blue"), F.lit("brand"))
    rows = nodes.withColumn("terms", terms).withColumn("nt", T.words("qualified_name")).withColumn("ft", T.words(F.coalesce("file", F.lit(""))))
    rows = rows.withColumn("none", F.array().cast("array<string>"))
    score = S.rank_score("terms", "nt", "ft", "none", F.lit(None).cast("double"), F.col("entry_point"), F.col("kind"), F.lit("locate"), F.col("exported"))
    return rows.select("id", score.alias("score"))


@query(
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\b(why|bug|fail|fails|failing|debug|error)\\b', 'i') THEN 'debug' WHEN regexp_matches(text, '\\b(test|tests|coverage)\\b', 'i') THEN 'tests'
    WHEN regexp_matches(text, '\\b(impact|rename|refactor|break)\\b', 'i') THEN 'impact' WHEN regexp_matches(text, '\\b(architecture|flow|explain|overview)\\b', 'i') THEN 'architecture'
    WHEN regexp_matches(text, '\\b(where|find|locate)\\b', 'i') THEN 'locate' ELSE 'change' END AS strategy FROM conversations"""
)
def task_strategy(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.classify_task("text").alias("strategy"))


@query(
    """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
    SELECT id, line::INT AS line, instr(lower(content), 'licen')::INT AS col, substr(trim(content, ' '), 1, 240) AS snippet FROM l WHERE instr(lower(content), 'licen') > 0"""
)
def text_grep(spark, d):
    return S.text_search(table(spark, d, "documents"), "doc_id", "text", "licen")


@query(
    """WITH p AS (SELECT user_id::VARCHAR AS file, event_id, floor(epoch(ts) / 3600)::BIGINT AS line FROM events),
    s AS (SELECT user_id::VARCHAR AS file, event_id AS id, floor(epoch(ts) / 3600)::BIGINT - 24 AS start_line, floor(epoch(ts) / 3600)::BIGINT + event_id % 48 AS end_line FROM events WHERE event_type = 'signup')
    SELECT event_id, id, span FROM (SELECT event_id, s.id, end_line - start_line AS span, row_number() OVER (PARTITION BY event_id ORDER BY end_line - start_line, s.id) AS r FROM p JOIN s USING (file) WHERE line BETWEEN start_line AND end_line) WHERE r = 1"""
)
def enclosing_interval(spark, d):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    e = table(spark, d, "events")
    points = e.select(F.col("user_id").cast("string").alias("file"), "event_id", hour.alias("line"))
    spans = e.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("id"), (hour - 24).alias("start_line"), (hour + F.col("event_id") % 48).alias("end_line"))
    return S.enclosing(points, spans).select("event_id", "id", "span")


@query(
    f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
    h AS (SELECT id, line, list_distinct(list_filter({WORDS_SQL.format('content')}, lambda x: x IN ('the', 'license', 'der', 'que'))) AS terms FROM l),
    d AS (SELECT id, term, count(*) AS df FROM (SELECT id, unnest(terms) AS term FROM h) GROUP BY 1, 2),
    w AS (SELECT h.id, h.line, coalesce(sum(1 / sqrt(df)), 0) AS weight FROM h LEFT JOIN (SELECT id, line, unnest(terms) AS term FROM h) t USING (id, line) LEFT JOIN d ON d.id = h.id AND d.term = t.term GROUP BY 1, 2),
    s AS (SELECT id, line, round(sum(weight) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 9) AS score FROM w)
    SELECT id, line::INT AS start_line, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, line) AS r FROM s) WHERE r = 1 AND score > 0"""
)
def excerpt_window(spark, d):
    return S.excerpt_window(table(spark, d, "documents"), "doc_id", "text", "the license der que", 5).select("id", "start_line", F.round("score", 6).alias("score"))


def order_commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits and their parts as files."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_idx"), F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).distinct()


COMMITS = "c AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS file FROM lineitem)"


@query(f"WITH {COMMITS} SELECT x.file AS a, y.file AS b, count(*) AS n FROM c x JOIN c y USING (commit) WHERE x.file <> y.file AND commit IN (SELECT commit FROM c GROUP BY 1 HAVING count(*) <= 30) GROUP BY 1, 2")
def cochange_pairs(spark, d):
    return H.cochange(order_commits(spark, d))


@query(f"WITH {COMMITS}, f AS (SELECT file, count(*) AS n FROM c GROUP BY 1) SELECT file, n, round(n / (SELECT greatest(max(n), 1) FROM f), 6) AS signal FROM f")
def frequency_signal(spark, d):
    return H.frequency(order_commits(spark, d))


@query(f"WITH {COMMITS} SELECT file, min(commit) AS commit FROM c GROUP BY 1")
def last_commit(spark, d):
    return H.last_commit(order_commits(spark, d))


CUT = "1997-01-01"


def order_files(spark: SparkSession, d: str, before: bool) -> DataFrame:
    """Customers as files; the digest covers their orders up to a date, or all."""
    o = table(spark, d, "orders")
    o = o.where(F.col("o_orderdate") < F.to_timestamp(F.lit(CUT))) if before else o.where("o_orderstatus <> 'P'")
    listed = F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))), ",")
    return o.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.sha2(listed, 256).alias("hash"))


ORDER_FILES = f"""a AS (SELECT o_custkey::VARCHAR AS path, sha256(string_agg(lpad(o_orderkey::VARCHAR, 12, '0'), ',' ORDER BY o_orderkey)) AS hash FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1),
    b AS (SELECT o_custkey::VARCHAR AS path, sha256(string_agg(lpad(o_orderkey::VARCHAR, 12, '0'), ',' ORDER BY o_orderkey)) AS hash FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"""


@query(f"WITH {ORDER_FILES} SELECT path, CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b USING (path) WHERE a.hash IS DISTINCT FROM b.hash")
def freshness_diff(spark, d):
    return H.freshness(order_files(spark, d, True), order_files(spark, d, False))


@query("SELECT r_name AS grp, sha256(string_agg(n_name || ':' || n_nationkey, chr(10) ORDER BY n_name || ':' || n_nationkey)) AS fingerprint FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def fingerprint(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("grp"), F.col("n_name").alias("path"), F.col("n_nationkey").cast("string").alias("hash"))
    return H.fingerprint(rows, "grp")


def line_spans(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files whose declarations are nested runs of lines, by a rule on their length."""
    n = T.line_count("text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), n.alias("n"))
    outer = docs.select("file", F.concat_ws(":", "file", F.lit("all")).alias("id"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"))
    inner = docs.select("file", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(4))).alias("start_line"), "n")
    return outer.unionByName(inner.select("file", F.concat_ws(":", "file", "start_line").alias("id"), "start_line", F.least(F.col("start_line") + 2, F.col("n")).alias("end_line")))


def line_hunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), T.line_count("text").alias("n"))
    one = docs.select("file", F.lit(1).alias("hunk_no"), F.expr("n div 2 + 1").alias("new_start"), F.expr("int(file % 3)").alias("new_count"))
    return one.unionByName(docs.select("file", F.lit(2).alias("hunk_no"), F.lit(1).alias("new_start"), F.lit(1).alias("new_count")))


@query(
    """WITH d AS (SELECT doc_id AS file, len(string_split(text, chr(10))) AS n FROM documents),
    s AS (SELECT file, file || ':all' AS id, 1 AS a, n AS b FROM d UNION ALL SELECT file, file || ':' || k, k, least(k + 2, n) FROM (SELECT file, n, unnest(range(1, n + 1, 4)) AS k FROM d)),
    h AS (SELECT file, 1 AS hunk_no, n // 2 + 1 AS ns, file % 3 AS nc FROM d UNION ALL SELECT file, 2, 1, 1 FROM d),
    m AS (SELECT h.file, hunk_no, id, a, b FROM h JOIN s USING (file) WHERE CASE WHEN nc = 0 THEN a <= ns AND b >= ns + 1 ELSE a <= ns + nc - 1 AND b >= ns END)
    SELECT file, hunk_no::INT AS hunk_no, id FROM m WHERE NOT EXISTS (SELECT 1 FROM m i WHERE i.file = m.file AND i.hunk_no = m.hunk_no AND m.a <= i.a AND m.b >= i.b AND m.b - m.a > i.b - i.a)"""
)
def hunk_to_declaration(spark, d):
    return H.changed_declarations(line_hunks(spark, d), line_spans(spark, d))


def snapshot(spark: SparkSession, d: str, before: bool) -> DataFrame:
    """Orders as declarations of their customers; the header is the priority, the digest covers the price too."""
    o = table(spark, d, "orders")
    o = o.where("o_orderstatus <> 'F' or o_orderkey % 5 > 0") if before else o.where("o_orderstatus <> 'P'")
    price = F.floor(F.col("o_totalprice") * (1 if before else F.when(F.col("o_orderstatus") == "O", 2).otherwise(1))).cast("long")
    header = F.when(F.lit(before) | (F.col("o_orderstatus") != "F"), F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1))
    header = header if before else F.when(F.col("o_custkey") % 2 == 0, header).otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").cast("string").alias("qualified_name"), header.alias("header"), F.concat_ws("|", header, price).alias("hash"), F.col("o_orderpriority").alias("kind"), price.alias("price"))


SNAPSHOTS = """b AS (SELECT o_custkey::VARCHAR AS file, o_orderkey::VARCHAR AS q, o_orderpriority AS header, o_orderpriority || '|' || floor(o_totalprice)::BIGINT AS hash FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 5 > 0),
    a0 AS (SELECT *, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus = 'F' THEN substr(o_orderpriority, 1, 1) ELSE o_orderpriority END AS header, floor(o_totalprice * CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END)::BIGINT AS price FROM orders WHERE o_orderstatus <> 'P'),
    a AS (SELECT o_custkey::VARCHAR AS file, o_orderkey::VARCHAR AS q, header, header || '|' || price AS hash FROM a0),
    changes AS (SELECT file, q AS qualified_name, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' WHEN b.header <> a.header THEN 'signature' ELSE 'modified' END AS change FROM b FULL JOIN a USING (file, q) WHERE b.hash IS DISTINCT FROM a.hash)"""


@query(f"WITH {SNAPSHOTS} SELECT * FROM changes")
def identity_diff(spark, d):
    return H.compare_declarations(snapshot(spark, d, True), snapshot(spark, d, False))


@query(f"WITH {SNAPSHOTS} SELECT change, count(*) AS n FROM changes GROUP BY 1")
def change_counts(spark, d):
    return identity_diff(spark, d).groupBy("change").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SNAPSHOTS} SELECT qualified_name, change, position::INT AS position FROM (SELECT *, row_number() OVER (ORDER BY CASE change WHEN 'removed' THEN 1 WHEN 'signature' THEN 2 WHEN 'rename' THEN 3 WHEN 'move' THEN 4 WHEN 'modified' THEN 5 ELSE 6 END, qualified_name) - 1 AS position FROM changes)
    WHERE position >= 50 AND position < 150"""
)
def change_page(spark, d):
    return H.change_page(identity_diff(spark, d), "qualified_name", 100, 50).select("qualified_name", "change", "position")


@query(
    """WITH gone AS (SELECT o_orderkey AS id, o_orderpriority AS kind, floor(o_totalprice / 100)::BIGINT AS hash FROM orders WHERE o_orderstatus = 'F'),
    come AS (SELECT o_orderkey AS id, o_orderpriority AS kind, floor(o_totalprice / 100)::BIGINT AS hash FROM orders WHERE o_orderstatus = 'O')
    SELECT g.id AS before, c.id AS after FROM (SELECT kind, hash, min(id) AS id FROM gone GROUP BY 1, 2 HAVING count(*) = 1) g JOIN (SELECT kind, hash, min(id) AS id FROM come GROUP BY 1, 2 HAVING count(*) = 1) c USING (kind, hash)"""
)
def move_candidates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.floor(F.col("o_totalprice") / 100).alias("hash"), "o_orderstatus")
    return H.move_candidates(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"))


@query(
    """WITH s AS (SELECT l_suppkey AS grp, floor(epoch(l_shipdate) / 86400)::BIGINT AS f, floor(epoch(l_shipdate) / 86400)::BIGINT + l_quantity::BIGINT % 5 AS l FROM lineitem),
    r AS (SELECT grp, f, max(l) OVER (PARTITION BY grp ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s)
    SELECT DISTINCT grp, r + 1 AS gap_start, f - 1 AS gap_end FROM r WHERE r + 1 < f"""
)
def interval_gaps(spark, d):
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000).cast("long")
    spans = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), day.alias("f"), (day + F.col("l_quantity").cast("long") % 5).alias("l"))
    return H.uncovered(spans, "grp", "f", "l")


URL_PATH = r"regexp_replace(regexp_replace(url, '^\w+://[^/]*/', ''), '[?#].*$', '')"


@query(
    f"""WITH p AS (SELECT page_id, {URL_PATH} AS path FROM pages), x AS (SELECT DISTINCT string_split(path, '/')[1] AS prefix FROM p UNION SELECT '.')
    SELECT page_id, prefix FROM (SELECT page_id, prefix, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN prefix = '.' THEN 0 ELSE length(prefix) END DESC) AS r FROM p JOIN x ON prefix = '.' OR path = prefix OR starts_with(path, prefix || '/')) WHERE r = 1"""
)
def service_longest_prefix(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", r"^\w+://[^/]*/", ""), r"[?#].*$", "")
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    prefixes = pages.select(F.get(F.split("path", "/", -1), F.lit(0)).alias("prefix")).union(spark.createDataFrame([(".",)], "prefix string")).distinct()
    return P.longest_prefix(pages, "path", prefixes, "prefix").select("page_id", "prefix")


@query(rf"SELECT page_id, regexp_full_match('/' || {URL_PATH}, '/[^/]+/[^/]+/?') AS two, regexp_full_match('/' || {URL_PATH}, '/en/[^/]*/?') AS english FROM pages")
def route_match(spark, d):
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", r"^\w+://[^/]*/", ""), r"[?#].*$", ""))
    return table(spark, d, "pages").select("page_id", route_matches(F.lit("/:lang/{id}"), path).alias("two"), route_matches(F.lit("/en/:id"), path).alias("english"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(\w+://[^/]*)', 1) AS origin, regexp_replace(regexp_extract(url, '^\w+://[^/]*(/[^?#]*)', 1), '/$', '') AS path FROM pages),
    r AS (SELECT DISTINCT origin, string_split(path, '/')[2] AS lang FROM p), s AS (SELECT origin FROM p GROUP BY 1 HAVING min(page_id) % 2 = 0),
    m AS (SELECT page_id, r.origin || '/' || lang AS provider_id FROM p JOIN r ON r.origin = p.origin AND len(string_split(p.path, '/')) = 3 AND string_split(p.path, '/')[2] = lang
      UNION ALL SELECT page_id, s.origin || '/*' FROM p JOIN s USING (origin) WHERE len(string_split(p.path, '/')) = 3)
    SELECT page_id AS request_id, provider_id, CASE WHEN count(*) OVER (PARTITION BY page_id) > 1 THEN 0.5 ELSE 0.85 END::DOUBLE AS confidence FROM m"""
)
def link_ambiguity(spark, d):
    pages = table(spark, d, "pages")
    origin, lang = F.regexp_extract("url", r"^(\w+://[^/]*)", 1), F.regexp_extract("url", r"^\w+://[^/]*/([^/?#]*)", 1)
    requests = pages.select(F.col("page_id").alias("request_id"), F.lit("web").alias("service"), F.lit("GET").alias("method"), F.lit("").alias("base"), F.col("url").alias("address"))
    some = pages.groupBy(origin.alias("origin")).agg(F.min("page_id").alias("first")).where("first % 2 = 0").select("origin", F.lit("*").alias("lang"), F.lit(":lang/:id").alias("route"))
    own = pages.select(origin.alias("origin"), lang.alias("lang")).distinct().withColumn("route", F.concat("lang", F.lit("/:id")))
    providers = own.unionByName(some).select(F.concat_ws("/", "origin", "lang").alias("provider_id"), F.col("origin").alias("provider"), F.lit("GET").alias("method"), "origin", "route")
    return P.connect_http(requests, providers).select("request_id", "provider_id", "confidence")


@query("SELECT s_nationkey::VARCHAR AS service, count(*) FILTER (s_acctbal < 0) AS missing, count(*) FILTER (s_acctbal >= 0 AND s_acctbal < 5000) AS dynamic, count(*) FILTER (s_acctbal >= 5000) AS configured FROM supplier GROUP BY 1")
def readiness_counts(spark, d):
    status = F.when(F.col("s_acctbal") < 0, "missing").when(F.col("s_acctbal") < 5000, "dynamic").otherwise("configured")
    return P.status_counts(table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("service"), status.alias("status")))


@query("SELECT doc_id, sha256(text) AS hash, len(string_split(text, chr(10)))::INT AS lines FROM documents")
def source_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sha256("text").alias("hash"), T.line_count("text").alias("lines"))
