"""Graph operators against plain Python models on small random graphs, and pinned behaviours."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import adjacency as A
from loamgraph.operators import traversal as V
from loamgraph.operators.cycles import cycles, strong_components
from loamgraph.schema import DEPENDENCY_TYPES, Graph

NODE = "id string, kind string, name string, qualified_name string, file string, exported boolean, entry_point boolean"
EDGE = "source string, target string, type string, owner string, confidence double, evidence string"


def graph_of(spark, nodes, edges):
    rows = [(i, k, i.split(".")[-1], i, f, e, False) for i, k, f, e in nodes]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame([(s, t, y, s, 1.0, "deterministic") for s, t, y in edges], EDGE))


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed string")


@pytest.fixture(scope="module")
def ledger(spark):
    nodes = [("Ledger", "interface", "a.ts", True), ("Ledger.save", "method", "a.ts", True), ("SqlLedger", "class", "b.ts", True), ("SqlLedger.save", "method", "b.ts", True), ("OtherLedger.save", "method", "c.ts", True)]
    nodes += [("direct", "test", "t.ts", False), ("injected", "test", "t.ts", False), ("service", "function", "s.ts", True), ("sql", "database_model", "d.ts", False)]
    edges = [("Ledger", "Ledger.save", "CONTAINS"), ("SqlLedger", "SqlLedger.save", "CONTAINS"), ("SqlLedger.save", "Ledger.save", "IMPLEMENTS"), ("OtherLedger.save", "Ledger.save", "IMPLEMENTS")]
    edges += [("direct", "SqlLedger.save", "CALLS"), ("service", "Ledger.save", "CALLS"), ("injected", "service", "CALLS"), ("SqlLedger.save", "sql", "READS")]
    return graph_of(spark, nodes, edges)


def test_implementations_and_tests(spark, ledger):
    got = A.implementations(ledger, seeds(spark, "Ledger.save")).collect()
    assert sorted(r.id for r in got) == ["OtherLedger.save", "SqlLedger.save"]
    paths = {r.node: (r.distance, r.dispatch) for r in V.test_paths(ledger, seeds(spark, "SqlLedger.save")).collect()}
    assert paths == {"direct": (1, False), "injected": (3, True)}
    assert [r.id for r in A.tests_for(ledger, seeds(spark, "SqlLedger")).collect()] == ["direct"]


def test_dependencies_leave_members_out(spark, ledger):
    assert sorted(r.id for r in A.dependencies(ledger, seeds(spark, "SqlLedger")).collect()) == ["Ledger.save", "sql"]
    assert sorted(r.id for r in A.dependents(ledger, seeds(spark, "Ledger")).collect()) == ["OtherLedger.save", "SqlLedger.save", "service"]


def test_resolve_is_case_sensitive(spark):
    graph = graph_of(spark, [("x.Login", "class", "f", True), ("x.login", "method", "f", True)], [])
    got = {(r.query, r.id) for r in A.resolve(graph, spark.createDataFrame([("Login",), ("login",)], "query string")).collect()}
    assert got == {("Login", "x.Login"), ("login", "x.login")}


def test_path(spark):
    graph = graph_of(spark, [(i, "method", "f", True) for i in "abcde"], [("a", "b", "CALLS"), ("b", "c", "CREATES"), ("a", "d", "CALLS"), ("d", "e", "CALLS"), ("e", "c", "CALLS"), ("c", "a", "REFERENCES")])
    got = V.shortest_paths(graph, seeds(spark, "a")).where("node = 'c'").first()
    assert (got.distance, got.path) == (2, ["a", "b", "c"])
    assert V.shortest_paths(graph, seeds(spark, "a"), 1).where("node = 'c'").count() == 0


def test_closure_is_not_capped(spark):
    edges = [(f"n{i}", "hub", "CALLS") for i in range(2105)]
    graph = graph_of(spark, [("hub", "function", "hub.ts", True)] + [(f"n{i}", "function", f"f{i}.ts", True) for i in range(2105)], edges)
    assert V.reverse_closure(A.dependent_files(graph), seeds(spark, "hub.ts")).count() == 2106


def model_impact(edges, seed, depth):
    """Two plain searches: without dispatch steps, and with."""

    def search(skip):
        found, level = {seed: 0}, [seed]
        for d in range(1, depth + 1):
            new = []
            for s, t, y in edges:
                if skip and y == "IMPLEMENTS":
                    continue
                for a, b, ok in ((t, s, y in DEPENDENCY_TYPES), (s, t, y in ("TESTED_BY", "IMPLEMENTS"))):
                    if ok and a in level and b not in found:
                        new.append(b)
            for b in new:
                found.setdefault(b, d)
            level = list(dict.fromkeys(new))
        return found

    sure, every = search(True), search(False)
    return {n: (sure.get(n, d), n not in sure) for n, d in every.items()}


@pytest.mark.parametrize("seed", range(3))
def test_impact_follows_the_model(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(14)]
    edges = list({(rng.choice(ids), rng.choice(ids), rng.choice(["CALLS", "REFERENCES", "IMPLEMENTS", "TESTED_BY", "CONTAINS"])) for _ in range(30)})
    graph = graph_of(spark, [(i, rng.choice(["method", "test"]), "f", True) for i in ids], edges)
    got = {}
    for r in V.impact(graph, seeds(spark, "n0", "n1"), 3).collect():
        got.setdefault(r.seed, {})[r.node] = (r.distance, r.dispatch)
    assert got == {s: model_impact(edges, s, 3) for s in ("n0", "n1")}


@pytest.mark.parametrize("seed", range(3))
def test_capped_order_is_a_queue(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02}" for i in range(20)]
    edges = list({(rng.choice(ids), rng.choice(ids), rng.choice("ab")) for _ in range(60)})
    queue, place = ["n00"], {"n00": 0}
    distance = {"n00": 0}
    for item in queue:
        if distance[item] >= 4:
            continue
        for _, dst in sorted((y, d) for s, d, y in edges if s == item)[:5]:
            if dst not in place and len(place) < 12:
                place[dst] = len(place)
                distance[dst] = distance[item] + 1
                queue.append(dst)
    got = V.capped_order(spark.createDataFrame(edges, "src string, dst string, type string"), "n00", 4, 12, 5).collect()
    assert {r.node: (r.position, r.distance) for r in got} == {n: (p, distance[n]) for n, p in place.items()}


@pytest.mark.parametrize("seed", range(3))
def test_strong_components(spark, seed, monkeypatch):
    from loamgraph.operators import cycles as module

    rng = random.Random(seed)
    edges = [(rng.randrange(15), rng.randrange(15)) for _ in range(22)]
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    df = spark.createDataFrame(edges, "source int, target int")
    assert {r.id: r.component for r in strong_components(df).collect()} == want
    if not seed:  # and by colouring, as beyond the bound of one task
        monkeypatch.setattr(module, "ONE_TASK", 0)
        assert {r.id: r.component for r in strong_components(df).collect()} == want


def test_cycles(spark):
    pairs = spark.createDataFrame([("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts"), ("src/b.ts", "src/c.ts")], "source string, target string")
    assert [(r.size, r.members) for r in cycles(pairs).collect()] == [(2, ["src/a.ts", "src/b.ts"])]


def test_relationships(spark, ledger):
    got = V.relationships(ledger, seeds(spark, "service"), 1).collect()
    assert sorted((r.source, r.target) for r in got) == [("injected", "service"), ("service", "Ledger.save")]


def test_skeleton_and_stats(spark, ledger):
    assert A.skeleton(ledger, seeds(spark, "Ledger")).first().outline == "Ledger { save }"
    assert {r.metric: r.n for r in A.stats(ledger).collect()} == {"files": 6, "nodes": 9, "edges": 8}
    assert A.edges_with_nodes(Graph(ledger.nodes.where("id <> 'sql'"), ledger.edges)).count() == 7
    assert A.neighbors(ledger, seeds(spark, "Ledger.save"), "in", None, 2).agg(F.count("*")).first()[0] == 2
