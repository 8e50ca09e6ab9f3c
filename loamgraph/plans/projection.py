"""Property graphs of the relational test tables, as DataFrames and as SQL common table expressions.

A graph is built once for each state of its tables and kept as written tables, edges in folders by type, so queries
read the types they need and nothing is projected twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.plans.storage import forget, state_of, store, table
from loamgraph.schema import Graph

_KEPT: dict[tuple, tuple[tuple, Graph]] = {}


def _kept(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], build: Callable[[SparkSession, str], Graph]) -> Graph:
    """The graph that ``build`` makes of some tables, written once; anew if a table's files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
    state = tuple(state_of(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    before, graph = _KEPT.get(key, (None, None))
    if before != state:
        if graph is not None:
            forget(graph.nodes, graph.edges)
        fresh = build(spark, sf_dir)
        graph = Graph(store(fresh.nodes, "nodes"), store(fresh.edges, "edges", "type"))
        _KEPT[key] = (state, graph)
    return graph


STATE_KINDS = {"error": "test", "purchase": "service", "signup": "interface", "view": "function", "click": "method"}
STEP_TYPES = {"error": "TESTED_BY", "purchase": "CREATES", "signup": "IMPLEMENTS", "view": "REFERENCES", "click": "CALLS"}


def _id(kind: str, key: str):
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def relational_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of customers, orders, suppliers and parts."""
    return _kept(spark, sf_dir, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"), _relational)


def activity_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of what users did, week by week."""
    return _kept(spark, sf_dir, ("events",), _activity)


def _activity(spark: SparkSession, sf_dir: str) -> Graph:
    """A state is a kind of event of a user in a week; a user's next event, if of another state, is an edge whose type
    follows from its kind. Users contain their states, and a user's week is a file."""
    week = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 604_800_000_000).cast("long")
    file = F.concat_ws(":", F.lit("week"), "user_id", week)
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", file.alias("file"))
    e = e.withColumn("id", F.concat_ws(":", F.lit("state"), F.substring("file", 6, 1 << 20), "event_type"))
    following = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("next", F.lead("id").over(following)).withColumn("next_type", F.lead("event_type").over(following))
    look = lambda c, pairs: F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), c)
    states = e.select("id", look(F.col("event_type"), STATE_KINDS).alias("kind"), F.col("event_type").alias("name"), F.concat_ws("/", "file", "event_type").alias("qualified_name"), "file", F.col("event_type").isin("purchase", "signup").alias("exported"), (F.col("event_type") == "signup").alias("entry_point")).distinct()
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    users = e.select(user.alias("id")).distinct()
    users = users.select("id", F.lit("class").alias("kind"), F.substring("id", 6, 1 << 20).alias("name"), F.col("id").alias("qualified_name"), F.lit(None).cast("string").alias("file"), F.lit(False).alias("exported"), F.lit(False).alias("entry_point"))
    steps = e.where("next <> id").select(F.col("id").alias("source"), F.col("next").alias("target"), look(F.col("next_type"), STEP_TYPES).alias("type"))
    holds = e.select(user.alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("type"))
    edges = steps.unionByName(holds).distinct().withColumn("owner", F.col("source"))
    return Graph(states.unionByName(users), edges.withColumn("confidence", F.lit(1.0)).withColumn("evidence", F.lit("deterministic")))


def _relational(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions hold nations, nations hold customers and suppliers, customers create orders, orders call suppliers and
    reference parts, suppliers implement parts, and urgent orders test parts."""
    t = lambda name: table(spark, sf_dir, name)
    none, no = F.lit(None).cast("string"), F.lit(False)

    def nodes(df: DataFrame, key: str, prefix: str, kind, name: str, file, exported, entry) -> DataFrame:
        columns = [_id(prefix, key).alias("id"), kind.alias("kind"), F.col(name).cast("string").alias("name")]
        qualified = F.concat_ws("/", file, F.col(name).cast("string")).alias("qualified_name")
        return df.select(*columns, qualified, file.alias("file"), exported.alias("exported"), entry.alias("entry_point"))

    urgent = F.col("o_orderpriority").startswith("1-")
    all_nodes = [
        nodes(t("region"), "r_regionkey", "region", F.lit("package"), "r_name", none, F.lit(True), no),
        nodes(t("nation"), "n_nationkey", "nation", F.lit("module"), "n_name", _id("region", "n_regionkey"), F.lit(True), no),
        nodes(t("customer"), "c_custkey", "customer", F.lit("class"), "c_name", _id("nation", "c_nationkey"), F.col("c_acctbal") > 5000, no),
        nodes(t("supplier"), "s_suppkey", "supplier", F.lit("service"), "s_name", _id("nation", "s_nationkey"), F.col("s_acctbal") > 5000, F.col("s_acctbal") > 9000),
        nodes(t("part"), "p_partkey", "part", F.lit("interface"), "p_name", F.col("p_brand"), F.col("p_size") > 25, no),
        nodes(t("orders"), "o_orderkey", "order", F.when(urgent, "test").otherwise("method"), "o_orderkey", _id("customer", "o_custkey"), no, no),
    ]
    lines = t("lineitem")
    link = lambda df, a, ak, b, bk, kind: df.select(_id(a, ak).alias("source"), _id(b, bk).alias("target"), F.lit(kind).alias("type"))
    tests = lines.select("l_orderkey", "l_partkey").join(t("orders").where(urgent).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    all_edges = [
        link(t("nation"), "region", "n_regionkey", "nation", "n_nationkey", "CONTAINS"),
        link(t("customer"), "nation", "c_nationkey", "customer", "c_custkey", "CONTAINS"),
        link(t("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey", "CONTAINS"),
        link(t("orders"), "customer", "o_custkey", "order", "o_orderkey", "CONTAINS"),
        link(t("orders"), "customer", "o_custkey", "order", "o_orderkey", "CREATES"),
        link(lines.select("l_orderkey", "l_suppkey").distinct(), "order", "l_orderkey", "supplier", "l_suppkey", "CALLS"),
        link(lines.select("l_orderkey", "l_partkey").distinct(), "order", "l_orderkey", "part", "l_partkey", "REFERENCES"),
        link(lines.select("l_suppkey", "l_partkey").distinct(), "supplier", "l_suppkey", "part", "l_partkey", "IMPLEMENTS"),
        link(tests.distinct(), "part", "l_partkey", "order", "l_orderkey", "TESTED_BY"),
    ]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    edges = union(all_edges).withColumn("owner", F.col("source"))
    heuristic = F.col("type") == "IMPLEMENTS"
    edges = edges.withColumn("confidence", F.when(heuristic, 0.75).otherwise(1.0)).withColumn("evidence", F.when(heuristic, "heuristic").otherwise("deterministic"))
    return Graph(union(all_nodes), edges)


GRAPH_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'package' AS kind, r_name AS name, r_name AS qualified_name, NULL::VARCHAR AS file, true AS exported, false AS entry_point FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'module', n_name, 'region:' || n_regionkey || '/' || n_name, 'region:' || n_regionkey, true, false FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'class', c_name, 'nation:' || c_nationkey || '/' || c_name, 'nation:' || c_nationkey, c_acctbal > 5000, false FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'service', s_name, 'nation:' || s_nationkey || '/' || s_name, 'nation:' || s_nationkey, s_acctbal > 5000, s_acctbal > 9000 FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'interface', p_name, p_brand || '/' || p_name, p_brand, p_size > 25, false FROM part
  UNION ALL SELECT 'order:' || o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 'test' ELSE 'method' END, o_orderkey::VARCHAR, 'customer:' || o_custkey || '/' || o_orderkey, 'customer:' || o_custkey, false, false FROM orders
), edges AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CONTAINS' FROM orders
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CREATES' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'CALLS' FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'REFERENCES' FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'IMPLEMENTS' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'order:' || l_orderkey, 'TESTED_BY' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1-%'
)
"""

_CASES = lambda pairs: " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())
ACTIVITY_SQL = f"""
happened AS (
  SELECT user_id, ts, event_id, event_type, 'week:' || user_id || ':' || floor(epoch(ts) / 604800)::BIGINT AS file FROM events
), ordered AS (
  SELECT *, 'state:' || file[6:] || ':' || event_type AS id, lead('state:' || file[6:] || ':' || event_type) OVER w AS next, lead(event_type) OVER w AS next_type
  FROM happened WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), nodes AS (
  SELECT DISTINCT id, CASE event_type {_CASES(STATE_KINDS)} END AS kind, event_type AS name, file || '/' || event_type AS qualified_name, file,
         event_type IN ('purchase', 'signup') AS exported, event_type = 'signup' AS entry_point FROM ordered
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'class', user_id::VARCHAR, 'user:' || user_id, NULL::VARCHAR, false, false FROM ordered
), edges AS (
  SELECT DISTINCT id AS source, next AS target, CASE next_type {_CASES(STEP_TYPES)} END AS type FROM ordered WHERE next <> id
  UNION ALL SELECT DISTINCT 'user:' || user_id, id, 'CONTAINS' FROM ordered
)
"""
