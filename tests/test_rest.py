"""Search, history, topology, budgets, sources, revisions and streaming."""

import itertools
import json
import math
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from loamgraph.functions.text import classify_task, overlap, porter_stem, query_terms, stems, words
from loamgraph.functions.urls import clean_address, join_route, request_url, route_matches
from loamgraph.operators import budget, history, mutations, search, topology
from loamgraph.operators import context as context_module
from loamgraph.operators.context import context
from loamgraph.plans.catalog import Catalog, StaleRevision
from loamgraph.schema import Graph
from loamgraph.sources import config, files, git, typescript
from loamgraph.streaming.watch import index, watch
from loamgraph.tools import Ambiguous, Workbench

AUTH = """import { TokenService } from "./token";
export interface Guard { allow(user: string): boolean; }
/** Logs users in. */
export class AuthService implements Guard {
  private readonly tokens: TokenService;
  constructor(tokens: TokenService) { this.tokens = tokens; }
  async login(user: string) {
    const key = process.env.AUTH_KEY;
    return this.tokens.issue(user + key);
  }
  allow(user: string): boolean { return user.length > 0; }
}
"""
TOKEN = """export class TokenService {
  issue(subject: string) { return sign(subject, "é𝄞"); }
}
export const sign = (text: string, salt: string) => text + salt;
function unused() { return 1; }
"""
SPEC = """import { TokenService } from "../src/token";
import { sign } from "../src/token";
describe("tokens", () => {
  it("signs", () => { new TokenService().issue("x"); sign("a", "b"); });
});
"""


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in {
        "src/auth.ts": AUTH, "src/token.ts": TOKEN, "test/token.spec.ts": SPEC, ".env": "X=1", "secrets.json": "{}", "node_modules/x/index.js": "x()",
        "package.json": json.dumps({"name": "root", "dependencies": {"lib": "1"}, "scripts": {"test": "t", "lint:fix": "l", "start": "s"}}),
        "lib/package.json": json.dumps({"name": "lib"}), "api/function.json": json.dumps({"bindings": [{"type": "httpTrigger", "methods": ["get", "post"], "route": "users/{id}"}, {"type": "queueTrigger", "queueName": "jobs", "connection": "Store"}, {"type": "serviceBus", "direction": "out", "topicName": "a;b"}]}),
        "host.json": json.dumps({"extensions": {"http": {"routePrefix": "v1"}}}),
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


@pytest.fixture(scope="module")
def found(spark, project):
    return files.discover(spark, str(project)).cache()


def test_discover(found):
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {"src/auth.ts", "src/token.ts", "test/token.spec.ts", "package.json", "lib/package.json", "api/function.json", "host.json"}
    assert rows["src/token.ts"].lines == TOKEN.count("\n") + 1 and rows["src/token.ts"].language == "typescript" and rows["package.json"].manifest


def test_globs():
    import re

    match = lambda g, p: bool(re.match(files.glob_to_regex(g), p))
    assert match("**/*", "a.ts") and match("**/*.ts", "x/y/a.ts") and match("src/*.{ts,js}", "src/a.js")
    assert not match("src/*.ts", "src/x/a.ts") and not match("*.ts", "axts")


def test_manifests(found):
    assert {(r.source, r.target) for r in files.package_edges(files.packages(found)).collect()} == {(".", "lib")}
    assert {r.script for r in files.repository_checks(found).collect()} == {"test", "lint:fix"}
    got = {(r.protocol, r.direction, r.method, r.address, r.setting) for r in files.function_bindings(found).collect()}
    assert got == {("http", "provide", "GET", "users/{id}", None), ("http", "provide", "POST", "users/{id}", None), ("storage-queue", "subscribe", None, "jobs", "Store"), ("service-bus", "publish", None, None, None)}
    assert files.host_prefixes(found).first().prefix == "v1"


def test_extract(spark, found):
    graph = typescript.extract(found)
    nodes = {r.qualified_name: r for r in graph.nodes.collect()}
    kinds = {q: r.kind for q, r in nodes.items()}
    for name, kind in {"AuthService": "class", "AuthService.login": "method", "AuthService.constructor": "constructor", "Guard": "interface", "Guard.allow": "method", "TokenService.issue": "method", "sign": "function", "unused": "function", "signs": "test", "AuthService.tokens": "property", "AUTH_KEY": "configuration"}.items():
        assert kinds.get(name) == kind, name
    assert nodes["sign"].exported and not nodes["unused"].exported
    token = nodes["TokenService"]
    assert TOKEN.encode("utf-16-le")[2 * token.start_offset : 2 * token.end_offset].decode("utf-16-le").endswith("}")
    named = {r.id: r.qualified_name for r in nodes.values()}
    edges = {(named[r.source], r.type, named[r.target]) for r in graph.edges.collect()}
    for e in [("AuthService", "IMPLEMENTS", "Guard"), ("AuthService.login", "CALLS", "TokenService.issue"), ("TokenService.issue", "CALLS", "sign"), ("signs", "CALLS", "sign"), ("signs", "CREATES", "TokenService"), ("TokenService.issue", "TESTED_BY", "signs"), ("src/auth.ts", "IMPORTS", "src/token.ts"), ("AuthService", "CONTAINS", "AuthService.login"), ("AuthService.login", "CONFIGURED_BY", "AUTH_KEY")]:
        assert e in edges, e
    bench = Workbench(spark, graph, found)
    assert [r.name for r in bench.call("callers", name="sign").collect()] == ["issue", "signs"] or {r.name for r in bench.call("callers", name="sign").collect()} == {"issue", "signs"}
    assert bench.call("path", source="AuthService.login", target="sign").first().distance == 2
    with pytest.raises(Ambiguous):
        bench.call("symbol", name="allow")
    with pytest.raises(KeyError):
        bench.call("symbol", name="nothing")
    assert bench.call("search", query="token", limit=5).count() == 5
    assert bench.call("search", query="uthServ", limit=5).count() >= 1
    assert "issue" in bench.call("slice", name="AuthService.login").first().source
    assert bench.call("file_slice", file="src/token.ts", start=1, end=2).first().content == "\n".join(TOKEN.split("\n")[:2])
    assert json.loads(bench.text("status"))
    assert bench.call("workflow", action="text", query="subject").count() == 1
    package = bench.call("context", task="why does login issue a token", max_tokens=200).collect()
    assert package and sum(r.cost for r in package) <= 200 and any("login" in r.symbol_id for r in package)


def test_context_budget_holds(spark, found):
    graph = typescript.extract(found)
    asked = spark.createDataFrame([(i, "sign the token for login", m) for i, m in enumerate((128, 300, 2000))], "request_id int, task string, max_tokens int")
    spent = {r.request_id: r.s for r in context(graph, asked).groupBy("request_id").agg(F.sum("cost").alias("s")).collect()}
    assert set(spent) == {0, 1, 2} and all(spent[i] <= m for i, m in enumerate((128, 300, 2000)))


def test_context_finds_forms_names_and_neighbours(spark, found):
    graph = typescript.extract(found)
    asked = spark.createDataFrame([(0, "explain how tokens are issued", 2000), (1, "what does AuthService.login do", 2000), (2, "where is signing", 2000)], "request_id int, task string, max_tokens int")
    got = {}
    for r in context_module.candidates(graph, asked).collect():
        got.setdefault(r.request_id, {})[r.id.split(":", 2)[-1]] = r
    assert "TokenService.issue" in got[0] and got[0]["TokenService.issue"].distance == 0  # a stem of "issued"
    assert got[1]["AuthService.login"].exact and got[1]["AuthService.login"].score == max(r.score for r in got[1].values())
    assert got[1]["TokenService.issue"].score > 0.3  # called by it
    assert all(r.distance <= 1 for r in got[2].values())  # locating stays near
    assert not any(name.endswith((".constructor", "<file>")) for rows in got.values() for name in rows)
    chosen = context(graph, asked.withColumn("max_tokens", F.lit(128)))
    assert all(r.s <= 128 for r in chosen.groupBy("request_id").agg(F.sum("cost").alias("s")).collect())


def test_greedy_packing_and_self_count(spark):
    rng = random.Random(2)
    rows = [(r, i, rng.randint(1, 30)) for r in range(20) for i in range(12)]
    budgets = spark.createDataFrame([(r, 60) for r in range(20)], "r int, budget int")
    df = spark.createDataFrame(rows, "r int, i int, c int")
    want = set()
    for r in range(20):
        left = 60
        for _, i, c in [x for x in rows if x[0] == r]:
            if c <= left:
                left -= c
                want.add((r, i))
    assert {(x.r, x.i) for x in budget.pack_greedily(df, "r", ["i"], "c", budgets).collect()} == want
    text, n = budget.self_counting(lambda n: f"{'x' * 95} {n}", len)
    assert len(text) == n


def test_words_and_terms(spark):
    row = spark.createDataFrame([("getUserName2Id ÉtéX-y_z", "where does authentication fail for retries")], "a string, b string").select(words("a").alias("w"), query_terms("b").alias("t"), classify_task("b").alias("c")).first()
    assert row.w == ["get", "user", "name2", "id", "étéx", "y", "z"]
    assert row.t == ["authentication", "fail", "retries", "auth", "login", "session", "token", "password", "retry"] and row.c == "debug"


def test_bm25_does_not_broadcast_its_index(spark, tmp_path):
    names = ["blue ring", "red ring", "blue steel bolt", "ring ring", "steelwork"]
    spark.createDataFrame(list(enumerate(names)), "id long, name string").write.parquet(f"{tmp_path}/part")
    terms = search.index_terms(spark.read.parquet(f"{tmp_path}/part"), "id", {"identity": "name"})
    asked = spark.createDataFrame([(1, "ring steel"), (2, "steel of the Ring"), (3, "nothing"), (4, "b"), (5, "")], "query_id int, query string")
    found = search.bm25(terms, asked, 3)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin \[(id|term)#", plan)
    mean = sum(len(n.split()) for n in names) / len(names)
    want = {}
    for q, wanted in ((1, ("ring", "steel")), (2, ("ring", "steel")), (4, ("b",))):
        scores = {}
        for w in wanted:
            tf = {i: n for i, x in enumerate(names) if (n := 4 * sum(t.startswith(w) for t in x.split()))}
            for i, n in tf.items():
                idf = math.log(1 + (len(names) - len(tf) + 0.5) / (len(tf) + 0.5))
                scores[i] = scores.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(names[i].split()) / mean))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:3]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in found.collect()} == want


def test_queries_with_the_same_matching_terms_are_searched_once(spark):
    def most_rows(plan):
        kind = plan.nodeName()
        below = plan.children()
        below = [plan.executedPlan()] if kind.startswith("AdaptiveSparkPlan") else [plan.plan()] if "QueryStage" in kind else [below.apply(i) for i in range(below.size())]
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])

    terms = search.index_terms(spark.range(100).withColumn("name", F.concat(F.lit("ring "), "id")), "id", {"identity": "name"})
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("which ring was it that x"), "id").alias("query"))
    found = search.bm25(terms, asked, 5)
    assert {tuple(r) for r in found.select("query_id", "id", "rank").collect()} == {(q, k, k + 1) for q in range(200) for k in range(5)}
    found.collect()
    assert most_rows(found._jdf.queryExecution().executedPlan()) < 5_000  # 200 queries meet 100 rows each


def test_context_broadcasts_neither_nodes_nor_requests_nor_candidates(spark, tmp_path, monkeypatch):
    joins, write = {}, context_module.store

    def store(df, name):
        plan = df._jdf.queryExecution().sparkPlan().toString()  # as estimated from files, before any runs
        joins.setdefault(name, []).extend(re.findall(r"(\w+Join) \[(\w+)#", plan))
        return write(df, name)

    monkeypatch.setattr(context_module, "store", store)
    n, name = 40, F.concat(F.lit("ring"), "id")
    node = lambda c: F.concat(F.lit("n"), c)
    fixed = [F.lit("class").alias("kind"), F.lit("").alias("file"), F.lit(True).alias("exported"), F.lit(False).alias("entry_point")]
    spark.range(n).select(node("id").alias("id"), name.alias("name"), name.alias("qualified_name"), *fixed).write.parquet(f"{tmp_path}/nodes")
    edge = lambda way: spark.range(n - 1).select(node("id").alias("source"), node(F.col("id") + 1).alias("target"), F.lit(way).alias("type"))
    edge("CALLS").unionByName(edge("CONTAINS")).write.parquet(f"{tmp_path}/edges")
    task = F.concat(F.lit("change ring"), "id", F.lit(" and a.b"))
    spark.range(10).select(F.col("id").alias("request_id"), task.alias("task"), F.lit(100).alias("max_tokens")).write.parquet(f"{tmp_path}/asked")
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}")
    store(context(Graph(read("nodes"), read("edges")), read("asked"), read("nodes").select("id", F.col("name").alias("source"))), "chosen")
    assert {"exact", "direct", "steps", "near", "level", "candidates", "symbols", "reserved", "chosen"} <= set(joins)
    sent = {(name, key) for name, found in joins.items() for how, key in found if how == "BroadcastHashJoin"}
    assert sent <= {("direct", "wanted"), ("direct", "_set")}, sent  # of bm25: products of joins, never estimated too small


def test_strategy_beyond_ascii_equals_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__

    said = ["testä x", "ätest", "ötestö", "test_", "_test", "test2", "éerror", "testo", "te\u017ft", "TEST\u017f x", "test\u017f\u00e4", "brea\u212a", "brea\u212aa", "fınd", "FİND", "fa\u0130l", "where", None, "", "why\nÉ", "ßfind", "中test中", "e\u0301xplain", "flow\u0301"]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(said)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = sorted(db.execute(__spark_entry__.oracle_sql()["task_strategy"]).fetchall())
    got = sorted(tuple(r) for r in __spark_entry__.queries()["task_strategy"](spark, str(tmp_path)).collect())
    assert got == want and {"tests", "change", "debug", "impact"} <= {r[2] for r in got}


def test_stems(spark):
    assert {porter_stem(w) for w in ("save", "saves", "saved", "saving")} == {"save"}
    for word, stem in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "sized": "size", "relational": "relat", "triplicate": "triplic", "formalize": "formal", "adjustment": "adjust", "controlling": "control", "happy": "happi", "sky": "sky", "id2": "id2"}.items():
        assert porter_stem(word) == stem, word
    df = spark.createDataFrame([(["saving", "budgets"],)], "w array<string>").select(stems("w").alias("s"))
    assert df.first().s == ["save", "budget"]
    df = spark.createDataFrame([(["get"], ["budget"]), (["bud"], ["budget"])], "t array<string>, w array<string>")
    assert [r[0] for r in df.select(overlap("t", "w")).collect()] == [0.0, 1.0]


def test_urls(spark):
    row = spark.range(1).select(
        route_matches(F.lit("/a/:id/"), F.lit("/a/7")).alias("a"), route_matches(F.lit("/a/{x}"), F.lit("/a/b/c")).alias("b"), join_route(F.lit("/api/"), F.lit(None), F.lit("x/y")).alias("c"),
        request_url(F.lit("https://h"), F.lit("/p")).alias("d"), request_url(F.lit("ftp://h"), F.lit("/p")).alias("e"), request_url(F.lit("https://u:p@h"), F.lit("/p")).alias("f"), clean_address(F.lit("https://u:p@h/x?q=1#z")).alias("g"), clean_address(F.lit("Endpoint=sb;k")).alias("h"),
    ).first()
    assert tuple(row) == (True, False, "api/x/y", "https://h/p", None, None, "https://h/x", None)


def test_enclosing_and_hunks(spark):
    rng = random.Random(0)
    spans = [("f", f"s{i}", a, a + rng.randrange(200)) for i, a in enumerate(rng.randrange(1, 500) for _ in range(40))]
    points = [("f", i) for i in range(1, 700, 9)]
    got = {r.line: r.id for r in search.enclosing(spark.createDataFrame(points, "file string, line int"), spark.createDataFrame(spans, "file string, id string, start_line int, end_line int")).collect()}
    want = {}
    for _, p in points:
        near = [(e - s, i) for _, i, s, e in spans if s <= p <= e]
        if near:
            want[p] = min(near)[1]
    assert got == want
    decls = spark.createDataFrame([("f", "outer", 1, 50), ("f", "inner", 10, 20), ("f", "next", 60, 70)], "file string, id string, start_line int, end_line int")
    hunks = spark.createDataFrame([("f", 1, 12, 1), ("f", 2, 15, 0), ("f", 3, 20, 0), ("f", 4, 45, 20), ("g", 1, 1, 1)], "file string, hunk_no int, new_start int, new_count int")
    got = {(r.hunk_no, r.id) for r in history.changed_declarations(hunks, decls).collect()}
    assert got == {(1, "inner"), (2, "inner"), (3, "outer"), (4, "outer"), (4, "next")}


def test_text_tools(spark):
    docs = spark.createDataFrame([("a", "one\nTwo two\n"), ("b", None)], "id string, t string")
    assert [(r.id, r.line, r.col) for r in search.text_search(docs, "id", "t", "two").collect()] == [("a", 2, 1)]
    assert [(r.line, r.col) for r in search.text_search(docs, "id", "t", "two", case_sensitive=True).collect()] == [(2, 5)]
    assert search.file_slice(docs, "id", "t", 2, 9).where("id = 'a'").first().content == "Two two\n"
    with pytest.raises(Exception, match="Stale index"):
        search.file_slice(docs.withColumn("h", F.lit("x")), "id", "t", 1, 1, expected="h").collect()
    trace = "Error: x\n    at run (/app/src/a.ts:3:7)\n    at async Foo.bar (file:///app/b.ts:10:1)\n    at /app/c.ts:1:2\nnoise"
    got = search.trace_frames(spark.createDataFrame([(1, trace)], "id int, t string"), "id", "t").orderBy("frame").collect()
    assert [(r["function"], r.file, r.line, r.col) for r in got] == [("run", "/app/src/a.ts", 3, 7), ("Foo.bar", "/app/b.ts", 10, 1), (None, "/app/c.ts", 1, 2)]


def test_history(spark):
    kind = "file string, qualified_name string, hash string, header string"
    before = spark.createDataFrame([("a", "x", "1", "h"), ("a", "y", "2", "h"), ("a", "z", "3", "h"), ("a", "d", "4", "h"), ("a", "d", "5", "h")], kind)
    after = spark.createDataFrame([("a", "x", "1", "h"), ("a", "y", "9", "g"), ("a", "w", "3", "h"), ("a", "d", "5", "h"), ("a", "d", "4", "h")], kind)
    changes = history.compare_declarations(before, after)
    assert {(r.qualified_name, r.change) for r in changes.collect()} == {("y", "signature"), ("z", "removed"), ("w", "added")}
    page = history.change_page(changes, "qualified_name", 2).collect()
    assert [(r.change, r.position) for r in sorted(page, key=lambda r: r.position)] == [("removed", 0), ("signature", 1)]
    gone = spark.createDataFrame([("z", "f", "3"), ("p", "f", "7"), ("q", "f", "7")], "id string, kind string, hash string")
    come = spark.createDataFrame([("w", "f", "3"), ("r", "f", "7")], "id string, kind string, hash string")
    assert [tuple(r) for r in history.move_candidates(gone, come).collect()] == [("z", "w")]
    commits = spark.createDataFrame([(0, "c1", "a"), (0, "c1", "b"), (1, "c0", "a")] + [(2, "big", f"f{i}") for i in range(31)], "commit_idx int, commit string, file string")
    assert {(r.a, r.b, r.n) for r in history.cochange(commits).collect()} == {("a", "b", 1), ("b", "a", 1)}
    assert {r.file: r.commit for r in history.last_commit(commits).where("file in ('a', 'b')").collect()} == {"a": "c1", "b": "c1"}
    gaps = history.uncovered(spark.createDataFrame([("g", 1, 10), ("g", 3, 5), ("g", 14, 20)], "k string, a int, b int"), "k", "a", "b").collect()
    assert [(r.gap_start, r.gap_end) for r in gaps] == [(11, 13)]


def test_topology(spark):
    items = spark.createDataFrame([(1, "services/a/x.ts"), (2, "services/ab/x.ts"), (3, "q.ts")], "id int, path string")
    prefixes = spark.createDataFrame([(".",), ("services/a",), ("services",), ("b",)], "prefix string")
    assert {r.id: r.prefix for r in topology.longest_prefix(items, "path", prefixes, "prefix").collect()} == {1: "services/a", 2: "services", 3: "."}
    requests = spark.createDataFrame([("r1", "a", "GET", "https://b", "/users/7"), ("r2", "a", "POST", "https://b", "/users/7"), ("r3", "a", "GET", None, "https://c/x")], "request_id string, service string, method string, base string, address string")
    providers = spark.createDataFrame([("p1", "b", "GET", "https://b", "users/:id"), ("p2", "b", "*", "https://b", "/users/{id}"), ("p3", "c", "GET", "https://c/base", "x")], "provider_id string, provider string, method string, origin string, route string")
    assert {(r.request_id, r.provider_id, r.confidence) for r in topology.connect_http(requests, providers).collect()} == {("r1", "p1", 0.5), ("r1", "p2", 0.5), ("r2", "p2", 0.85)}
    kind = "string, protocol string, resource string, address string, channel_kind string"
    send = spark.createDataFrame([("s1", "a", "service-bus", "ns1", "jobs", "queue"), ("s2", "a", "service-bus", None, "jobs", None)], f"request_id string, service {kind}")
    take = spark.createDataFrame([("t1", "b", "service-bus", "ns1", "jobs", None), ("t2", "b", "service-bus", "ns2", "jobs", "queue"), ("t3", "c", "service-bus", "ns1", "jobs", "topic"), ("t4", "c", "service-bus", None, "jobs", None)], f"provider_id string, provider {kind}")
    assert [(r.request_id, r.provider_id) for r in topology.connect_channels(send, take).collect()] == [("s1", "t1")]
    steps = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    got = topology.cross_service_impact(steps([("a1", "a2"), ("b1", "b2"), ("c1", "c2")]), steps([("a2", "b1"), ("b2", "c1"), ("c2", "d1")]), spark.createDataFrame([("a1",)], "seed string"), 8, 2).collect()
    assert {r.node: (r.bridges, r.distance) for r in got} == {"a1": (0, 0), "a2": (0, 1), "b1": (1, 2), "b2": (1, 3), "c1": (2, 4), "c2": (2, 5)}
    sites = spark.createDataFrame([("s", "url", "A", "missing", f"p{i}") for i in range(3)] + [("s", "url", "B", "configured", "q")], "service string, kind string, setting string, status string, place string")
    first = topology.readiness(sites).first()
    assert (first.setting, first.sites, first.examples) == ("A", 3, ["p0", "p1"])


def test_knapsack():
    assert budget.best_choice([[(3, 4.0), (5, 6.0)], [(2, 4.0)]], 5) == [(0, 0), (1, 0)]
    rng = random.Random(0)
    for _ in range(30):
        groups = [[(rng.randint(1, 9), rng.randint(0, 9)) for _ in range(rng.randint(1, 3))] for _ in range(4)]
        most = rng.randint(0, 20)
        best = max((sum(groups[g][k][1] for g, k in enumerate(pick) if k is not None) for pick in itertools.product(*[[None, *range(len(g))] for g in groups]) if sum(groups[g][k][0] for g, k in enumerate(pick) if k is not None) <= most), default=0)
        chosen = budget.best_choice(groups, most)
        assert sum(groups[g][k][0] for g, k in chosen) <= most and abs(sum(groups[g][k][1] for g, k in chosen) - best) < 1e-6
    with pytest.raises(ValueError):
        budget.best_choice([[(0, 1.0)]], 5)


def test_serialize_within():
    count = lambda t: len(t)
    for value in (list(range(100)), {"a": list(range(50)), "b": "x"}, "x" * 500):
        for most in (60, 100, 1000):
            text = budget.serialize_within(value, most, count)
            assert len(text) <= max(most, 60) and json.loads(text) is not None


def test_packs(spark):
    rows = spark.createDataFrame([(1, i, 10) for i in range(5)], "r int, i int, cost int")
    assert budget.prefix_within(rows, "r", ["i"], "cost", spark.createDataFrame([(1, 35)], "r int, budget int")).count() == 3
    got = budget.round_robin(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "p string, s int"), "p", [F.asc("s")], 2).collect()
    assert {r.p for r in got} == {"a", "b"}
    now = spark.createDataFrame([(1, "x", "1"), (1, "y", "2")], "request_id int, symbol_id string, body string")
    same, new = budget.receipt_delta(now, spark.createDataFrame([(1, "x", "1"), (1, "y", "0")], now.schema))
    assert (same.first().symbol_id, new.first().symbol_id) == ("x", "y")


def test_mutations(spark):
    kind = "source string, target string, type string, owner string, confidence double, evidence string"
    edges = spark.createDataFrame([("a", "b", "CALLS", "f", 1.0, "old"), ("a", "c", "CALLS", "f", 1.0, "old")], kind)
    got = mutations.put_edges(edges, spark.createDataFrame([("a", "b", "CALLS", "f", 0.5, "new")], kind)).collect()
    assert {(r.target, r.evidence) for r in got} == {("b", "new"), ("c", "old")}
    for bad in (("a", "b", "CALLED_BY", "f", 1.0, "x"), ("a", "b", "CALLS", "f", 1.5, "x")):
        with pytest.raises(Exception, match="Invalid edge"):
            mutations.put_edges(edges, spark.createDataFrame([bad], kind)).collect()
    nodes = spark.createDataFrame([("1", "f"), ("2", "f"), ("3", "g")], "id string, file string")
    assert {r.id for r in mutations.prune_nodes(nodes, spark.createDataFrame([("f", "1")], "file string, id string")).collect()} == {"1", "3"}
    facts = spark.createDataFrame([("x", {"a": "1"}), ("y", {"a": "1", "b": "2"})], "id string, hashes map<string,string>")
    assert [r.id for r in mutations.invalidate_semantic(facts, spark.createDataFrame([("b",)], "path string")).collect()] == ["x"]
    assert [r.id for r in mutations.current_facts(facts, spark.createDataFrame([("a", "1"), ("b", "9")], "path string, hash string")).collect()] == ["x"]
    replies = spark.createDataFrame([("s", '```json\n{"summary":"q","concepts":["c"],"constraints":[],"confidence":0.5}\n```'), ("t", '{"summary":"q","concepts":["c"],"constraints":[],"confidence":2}'), ("u", "no")], "symbol_id string, reply string")
    assert [r.symbol_id for r in mutations.parse_facts(replies).collect()] == ["s"]


def test_config():
    assert config.load('{"include": ["src/**"], "limits": {"max_files": 5}}').limits.max_files == 5
    for bad in ('{"nope": 1}', '{"token_budget": 5}', '{"weights": {"name": 11}}', '{"limits": {"max_files": 0}}'):
        with pytest.raises((ValueError, TypeError)):
            config.load(bad)


EDGE = ("source", "target", "type", "owner", "line", "confidence")


def edges_of(graph):
    return {tuple(r[c] for c in EDGE) for r in graph.edges.collect()}


def nodes_of(graph):
    return {(r.id, r.kind, r.file, r.start_line, r.end_line, r.signature) for r in graph.nodes.collect()}


def source_rows(spark, sources):
    rows = [(p, t) for p, t in sources.items()]
    df = spark.createDataFrame(rows, "path string, content string")
    return df.select("path", F.sha2("content", 256).alias("hash"), F.lit("typescript").alias("language"), F.length("content").cast("long").alias("bytes"), F.size(F.split("content", "\n", -1)).alias("lines"), "content", F.lit(False).alias("manifest"))


def test_catalog(spark, project, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "graph"))
    rows = files.discover(spark, str(project))
    assert catalog.revision() == 0
    assert index(catalog, rows, typescript.LANGUAGE) == 1
    assert index(catalog, rows, typescript.LANGUAGE) == 1  # nothing changed
    with pytest.raises(StaleRevision):
        catalog.commit({}, 0)
    # a writer that was overtaken between its check and its end
    one = spark.range(1).selectExpr("id as source", "id as target", "'CALLS' as type")
    slow = Catalog(spark, str(tmp_path / "graph"))
    slow.revision = lambda: 0
    with pytest.raises(StaleRevision):
        slow.commit({"edges": one}, 0)
    assert catalog.revisions() == [1] and edges_of(catalog.graph()) == edges_of(typescript.extract(rows))
    # a writer that died before its end
    (tmp_path / "graph" / "staged-dead").mkdir()
    assert catalog.revision() == 1
    assert index(catalog, rows.where("path <> 'src/auth.ts'"), typescript.LANGUAGE) == 2
    assert index(catalog, rows, typescript.LANGUAGE) == 3
    assert catalog.revisions() == [2, 3] and catalog.table("files", 2).count() == 6
    catalog.clean()
    assert catalog.revision() == 0 and not list((tmp_path / "graph").iterdir())


def test_edits_give_the_graph_of_a_whole_index(spark, tmp_path):
    sources = {
        "src/a.ts": 'import { b } from "./b";\nexport function a() { return b(); }\n',
        "src/b.ts": 'import { c } from "./c";\nexport function b() { return c(); }\n',
        "src/c.ts": "export function c() { return 1; }\n",
        "src/late.ts": 'import { soon } from "./soon";\nexport function late() { return soon(); }\n',
    }
    catalog = Catalog(spark, str(tmp_path / "graph"))
    index(catalog, source_rows(spark, sources), typescript.LANGUAGE)

    def check(revision):
        whole = typescript.extract(source_rows(spark, sources))
        assert catalog.revision() == revision
        assert edges_of(catalog.graph()) == edges_of(whole) and nodes_of(catalog.graph()) == nodes_of(whole)

    links = {(s, t) for s, t, kind, *_ in edges_of(catalog.graph()) if kind == "CALLS"}
    assert ("typescript:src/a.ts:a", "typescript:src/b.ts:b") in links
    sources["src/a.ts"] += "// an edit that changes nothing\n"
    index(catalog, source_rows(spark, {"src/a.ts": sources["src/a.ts"]}), typescript.LANGUAGE, whole=False)
    check(2)
    assert links == {(s, t) for s, t, kind, *_ in edges_of(catalog.graph()) if kind == "CALLS"}
    sources["src/soon.ts"] = "export function soon() { return 2; }\n"  # an older file waits for it
    index(catalog, source_rows(spark, {"src/soon.ts": sources["src/soon.ts"]}), typescript.LANGUAGE, whole=False)
    check(3)
    assert any(t.endswith("soon.ts:soon") and s.endswith("late.ts:late") for s, t, kind, *_ in edges_of(catalog.graph()) if kind == "CALLS")
    sources["src/c.ts"] = "export function renamed() { return 1; }\n"
    del sources["src/b.ts"]
    index(catalog, source_rows(spark, {"src/c.ts": sources["src/c.ts"]}), typescript.LANGUAGE, False, spark.createDataFrame([("src/b.ts",), ("src/none.ts",)], "path string"))
    check(4)
    sources["src/b.ts"] = 'import { renamed } from "./c";\nexport function b() { return renamed(); }\n'
    index(catalog, source_rows(spark, sources), typescript.LANGUAGE)
    check(5)


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    prepare = lambda raw: raw.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("hash"), F.lit("typescript").alias("language"), F.col("length").alias("bytes"), F.lit(1).alias("lines"), F.col("content").cast("string").alias("content"), F.lit(False).alias("manifest"))
    streamed = Catalog(spark, str(tmp_path / "streamed"))
    for name, other, count in (("one", "two", 1), ("two", "one", 2)):
        (folder / f"{name}.ts").write_text(f'import {{ {other} }} from "./{other}";\nexport function {name}() {{ return {other}(); }}\n')
        watch(spark, str(folder), streamed, typescript.LANGUAGE, prepare, str(tmp_path / "cp"), once=True).awaitTermination(60)
        assert streamed.graph().nodes.where("kind = 'function'").count() == count
    assert streamed.graph().edges.where("type = 'CALLS'").count() == 2  # the older file found the newer one


def test_command_line(spark, project, tmp_path, capsys):
    import shutil

    from loamgraph.tools import main

    root = tmp_path / "tree"
    shutil.copytree(project, root)
    git_of = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    git_of("init", "-q")
    git_of("add", ".")
    git_of("commit", "-qm", "one")
    catalog = str(tmp_path / "graph")

    def call(*arguments):
        assert main([catalog, "--root", str(root), *arguments]) == 0
        return json.loads(capsys.readouterr().out)

    assert call("index") == {"revision": 1}
    assert "issue" in call("slice", '{"name": "TokenService.issue"}')[0]["source"]
    assert call("file_slice", '{"file": "src/token.ts", "start": 1, "end": 1}')[0]["content"].startswith("export class")
    assert call("workflow", '{"action": "health"}') == []
    (root / "src/token.ts").write_text(TOKEN.replace("text + salt", "salt + text"))
    assert call("workflow", '{"action": "health"}')[0]["status"] == "modified"
    assert any("sign" in r["id"] for r in call("workflow", '{"action": "changes"}'))
    assert any(r["node"].endswith("TokenService.issue") for r in call("review_changes"))
    assert call("workflow", '{"action": "text", "query": "salt"}')


SITES = """import { jobs } from "./jobs";
@Controller("users")
export class UserController {
  @Get(":id") find(id: string) { return this.prisma.user.findUnique({ where: { id } }); }
  @Post() async add(body: Body) {
    if (!body) throw new BadRequest("body is missing");
    await db.user.create({ data: body });
    this.bus.emit("user.created", body);
    jobQueue.add("mail", body);
    return fetch(`${process.env.MAIL_URL}/send/1`, { method: "POST" });
  }
}
@Injectable()
export class Helper { run() { return axios.get("https://api.example.com/v1/users"); } }
export function health(req, res) { res.send("ok"); }
app.get("/health", guard, health);
bus.on("user.created", (x) => x);
"""
MAILER = """export function send(req, res) { return 1; }
app.post("/send/:id", send);
jobQueue.on("mail", send);
"""


def test_sites(spark):
    rows = source_rows(spark, {"web/u.ts": SITES, "mail/m.ts": MAILER})
    graph = typescript.extract(rows)
    nodes = {r.id: r for r in graph.nodes.collect()}
    kinds = {r.kind: r.name for r in nodes.values()}
    assert kinds["controller"] == "UserController" and kinds["service"] == "Helper" and kinds["database_model"] == "user" and kinds["queue"] == "mail"
    routes = {r.route for r in nodes.values() if r.kind == "route"}
    assert routes == {"GET /users/:id", "POST /users", "GET /health", "POST /send/:id"} and all(r.entry_point for r in nodes.values() if r.kind == "route")
    assert nodes["typescript:web/u.ts:UserController.add"].exceptions == ["body is missing"]
    edges = {(r.source.split(":", 2)[-1], r.target.split(":", 1 if r.target.startswith(("event", "queue", "database")) else 2)[-1], r.type) for r in graph.edges.collect()}
    assert {("UserController.find", "user", "READS"), ("UserController.add", "user", "CREATES"), ("UserController.add", "user.created", "EMITS"), ("UserController.add", "mail", "EMITS"), ("<file>", "user.created", "CONSUMES")} <= edges
    assert {("GET /health", "health", "CALLS"), ("health", "GET /health", "ROUTED_FROM"), ("GET /users/:id", "UserController.find", "CALLS"), ("POST /send/:id", "send", "CALLS")} <= edges


def test_service_map(spark):
    rows = typescript.endpoints(typescript.declarations(source_rows(spark, {"web/u.ts": SITES, "mail/m.ts": MAILER}))).withColumn("root", F.lit("r"))
    services = spark.createDataFrame([("r", "web", "web", "http://web"), ("r", "mail", "mail", "http://mail:8080")], "root string, path string, service string, origin string")
    settings = spark.createDataFrame([("web", "MAIL_URL", "http://mail:8080")], "service string, setting string, url string")
    links, left = topology.compose(rows, services, settings)
    assert {(r.service, r.provider, r.protocol) for r in links.collect()} == {("web", "mail", "http"), ("web", "web", "event"), ("web", "mail", "queue")}
    assert [r.address for r in left.collect()] == ["https://api.example.com/v1/users"]
    assert {(r.service, r.provider, r.protocol, r.links) for r in topology.service_map(links).collect()} == {("web", "mail", "http", 1), ("web", "mail", "queue", 1)}


def test_records(spark, tmp_path):
    from loamgraph.operators import records

    runs = spark.createDataFrame([(i, i) for i in range(1, 6)], "id long, revision long")
    metadata = spark.createDataFrame([("revision", "1"), ("x", "y")], "key string, value string")
    kept, after = records.finish_run(runs, metadata, spark.createDataFrame([(6, 6)], runs.schema), 3)
    assert [r.id for r in kept.orderBy("id").collect()] == [4, 5, 6]
    assert {r.key: r.value for r in after.collect()} == {"revision": "6", "x": "y", "lastIndex": '{"id":6,"revision":6}'}
    for n in (1, 2):
        records.append_log(spark.createDataFrame([(n, n)], runs.schema), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    add = lambda name: lambda t: t | {name: runs}
    tables, version = records.migrate({}, 1, {1: add("a"), 2: add("b")})
    assert set(tables) == {"a", "b"} and version == 3
    with pytest.raises(ValueError):
        records.migrate({}, 9, {})


def test_stemmed_search(spark):
    nodes = spark.createDataFrame([(1, "renewMembership", "Renews a lapsed membership"), (2, "issueToken", "Issues tokens for sessions"), (3, "other", "nothing here")], "id int, name string, doc string")
    index = search.stemmed_index(nodes, "id", {"identity": "name", "documentation": "doc"})
    asked = spark.createDataFrame([(0, "renewing memberships"), (1, "issued token")], "query_id int, query string")
    assert {(r.query_id, r.id) for r in search.stemmed_search(index, asked, 1).collect()} == {(0, 1), (1, 2)}
    assert search.stemmed_search(index, asked, 1).count() == 2


def test_limits_of_sources(spark, project, tmp_path):
    with pytest.raises(ValueError, match="more than the configuration"):
        files.discover(spark, str(project), config.load('{"limits": {"max_files": 2}}'))
    found = files.discover(spark, str(project))
    one = files.config_hash(found, config.Config()).first()[0]
    assert len(one) == 64 and one != files.config_hash(found, config.Config(token_budget=500)).first()[0]
    paths = ["secrets.prod/key.ts", "credentials.d/x.ts", "src/a.ts", "x.min.js"]
    got = spark.createDataFrame([(p,) for p in paths], "path string").where(files.admissible(F.col("path"))).collect()
    assert [r.path for r in got] == ["src/a.ts"]
    suite = tmp_path / "suite.json"
    good = {"id": "a", "category": "c", "task": "t", "baselineFiles": [], "baselineSearchCalls": 0, "requiredSymbols": ["x"], "maxTokens": 500}
    suite.write_text(json.dumps([good]))
    assert files.scenarios(spark, str(suite)).count() == 1
    suite.write_text(json.dumps([good | {"maxTokens": 5}]))
    with pytest.raises(ValueError):
        files.scenarios(spark, str(suite))
    folders = [("/a", "/real/a", True, None), ("/b", "/real/b1", True, "x"), ("/c", "/real/a", True, None), ("/d", "/real/d", False, None)]
    got = files.projects(spark.createDataFrame(folders, "path string, real_path string, is_repository boolean, child string")).collect()
    assert {r.path for r in got} == {"/a", "/b/x"} and all(len(r.project) == 24 for r in got)


def test_history_of_sources(spark):
    old = {"src/a.ts": "export function kept() { return 1; }\nexport function price(x: number) { return x * 2; }\nexport function gone() { return 3; }\n", "src/b.ts": 'import { price } from "./a";\nexport function total() { return price(2); }\nexport function checkout() { return total(); }\n'}
    new = {"src/a.ts": "export function kept() { return 1; }\nexport function cost(x: number) { return x * 2; }\n", "src/b.ts": old["src/b.ts"].replace("total() {", "total(y: string) {").replace("return total();", "return  total();"), "src/c.ts": "export function gone() { return 3; }\n"}
    before, after = (typescript.shapes(source_rows(spark, x)) for x in (old, new))
    got = {(r.change, r.file, r.qualified_name, r.from_file, r.from_name) for r in history.review(before, after.select(before.columns)).collect()}
    assert got == {("rename", "src/a.ts", "cost", "src/a.ts", "price"), ("move", "src/c.ts", "gone", "src/a.ts", "gone"), ("signature", "src/b.ts", "total", None, None), ("modified", "src/b.ts", "checkout", None, None)}
    targets = spark.createDataFrame([("typescript:src/a.ts:price",), ("typescript:src/b.ts:total",)], "target string")
    found = history.consumers(typescript.extract(source_rows(spark, old)), typescript.extract(source_rows(spark, new)), targets).collect()
    rows = {(r.target.split(":")[-1], r.node.split(":")[-1], r.snapshot) for r in found}
    assert {("price", "total", "before"), ("price", "checkout", "before"), ("total", "checkout", "both")} <= rows


def test_workspace(spark, tmp_path):
    from loamgraph import workspace

    trees = {"a": {"src/t.ts": TOKEN, "src/index.ts": 'export * from "./t";\n'}, "b": {"src/x.ts": "export function signToken() { return 1; }\n"}}
    catalogs = {p: Catalog(spark, str(tmp_path / p)) for p in [*trees, "c"]}
    done = workspace.index_all(catalogs, lambda p: source_rows(spark, trees[p]), typescript.LANGUAGE)
    assert [(d["project"], d["status"]) for d in done] == [("a", "ok"), ("b", "ok"), ("c", "error")] and "c" in done[2]["message"]
    graphs = {p: catalogs[p].graph() for p in trees}
    assert ("typescript:src/index.ts:<file>", "typescript:src/t.ts:<file>", "EXPORTS") in {(r.source, r.target, r.type) for r in graphs["a"].edges.collect()}
    asked = spark.createDataFrame([(0, "sign the token", 60)], "request_id int, task string, max_tokens int")
    got = workspace.workspace_context(graphs, asked).collect()
    assert {r.project for r in got} == {"a", "b"} and sum(r.cost for r in got) <= 60
    benches = {p: Workbench(spark, g, catalogs[p].table("files")) for p, g in graphs.items()}
    out = workspace.fan_out(benches, "symbol", name="TokenService.issue")
    assert [(r["project"], r["status"]) for r in out] == [("a", "ok"), ("b", "error")]
    assert workspace.share(1) == 6000 and workspace.share(64) == 500 and workspace.error_message(KeyError()) == "KeyError"
    cache = workspace.ContextCache(2)
    texts = [cache.get((k,), lambda k=k: f"t{k}") for k in (1, 2, 1, 3, 2, 1)]
    assert texts == ["t1", "t2", "t1", "t3", "t2", "t1"] and cache.hits == 2 and len(cache.held) == 2


def test_semantic_input_and_benchmark(spark):
    rows = source_rows(spark, {"src/auth.ts": AUTH, "src/token.ts": TOKEN})
    graph = typescript.extract(rows)
    seeds = spark.createDataFrame([("typescript:src/auth.ts:AuthService",), ("typescript:src/token.ts:sign",)], "seed string")
    got = {r.seed.split(":")[-1]: r for r in context_module.semantic_input(graph, seeds, rows).collect()}
    assert "login" in got["AuthService"].outline and any(x.startswith("CONTAINS") for x in got["AuthService"].relations) and set(got["AuthService"].hashes) == {"src/auth.ts"}
    assert got["sign"].relations == [] and set(got["sign"].hashes) == {"src/token.ts"}
    kind = "id string, task string, baselineFiles array<string>, requiredSymbols array<string>, maxTokens int"
    suite = spark.createDataFrame([("s", "how are tokens issued", ["src/auth.ts", "src/token.ts"], ["TokenService.issue", "Nothing"], 500)], kind)
    r = context_module.benchmark(graph, suite, rows).first()
    assert r.missing == ["Nothing"] and r.recall == 0.5 and r.before > r.after > 0


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.ts").write_text("1\n2\n3\n4\n")
    (tmp_path / "b.ts").write_text("1\n2\n3\n4\n")
    run("add", ".")
    run("commit", "-qm", "one")
    assert {(r.a, r.b) for r in history.cochange(git.commit_files(spark, str(tmp_path))).collect()} == {("a.ts", "b.ts"), ("b.ts", "a.ts")}
    (tmp_path / "a.ts").write_text("1\nx\ny\n3\n4\n")
    (tmp_path / "b.ts").unlink()
    (tmp_path / "c.ts").write_text("new")
    got = {(r.file, r.old_start, r.old_count, r.new_start, r.new_count) for r in git.change_hunks(spark, str(tmp_path)).collect()}
    assert got == {("a.ts", 2, 1, 2, 2), ("b.ts", 1, 4, 0, 0)}
    assert {(r.file, r.status) for r in git.changed_files(spark, str(tmp_path)).collect()} == {("a.ts", "M"), ("b.ts", "D"), ("c.ts", "?")}
    old = git.snapshot(spark, str(tmp_path), "HEAD").collect()
    assert {r.file for r in old} == {"a.ts", "b.ts"} and len({r.oid for r in old}) == 1
    with pytest.raises(ValueError):
        git.diff_arguments("branch", "--output=x")


def test_graph_frame(spark):
    g = Graph(spark.createDataFrame([], "id string"), spark.createDataFrame([("a", "b", "CALLS")], "source string, target string, type string"))
    assert g.edges_of(None).count() == 1 and g.edges_of(["READS"]).count() == 0
