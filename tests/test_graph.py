"""Graph operators on small graphs with answers worked out by hand or by plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quiltgraph.operators import aggregates as A
from quiltgraph.operators import graph as G
from quiltgraph.operators import joins as J
from quiltgraph.operators import traversal as T
from quiltgraph.plans import dsl

EDGE = "from_id string, to_id string, kind string, file_path string, line int, confidence double, origin string"
NODE = "id string, kind string, name string, file_path string, start_line int, end_line int, language string, repo_prefix string"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, "f", i, 1.0, "ast_resolved") for i, (a, b, k) in enumerate(rows)], EDGE)


def nodes(spark, rows):
    return spark.createDataFrame([(i, k, i, "f.go", 0, 0, "go", "r") for i, k in rows], NODE)


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id string")


def got(df):
    return {tuple(r) for r in df.collect()}


def random_graph(seed, n=14, m=30):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(n)]
    return names, sorted({(rng.choice(names), rng.choice(names)) for _ in range(m)})


def test_dead_code_candidates(spark):
    n = nodes(spark, [(x, "function") for x in ("AliveFunc", "DeadFunc", "ReadOnlyFunc", "Caller")] + [(x, "type") for x in ("AliveType", "DeadType")] + [(x, "method") for x in ("AliveMethod", "DeadMethod")])
    e = edges(spark, [("Caller", "AliveFunc", "calls"), ("Caller", "ReadOnlyFunc", "reads"), ("Caller", "AliveMethod", "calls"), ("Caller", "AliveType", "references")])
    usage = {"function": ["calls", "references"], "method": ["calls", "implements"], "type": ["references", "instantiates"]}
    assert {r.id for r in J.dead_code_candidates(n, e, usage).collect()} == {"Caller", "DeadFunc", "DeadMethod", "DeadType", "ReadOnlyFunc"}
    assert {r.id for r in J.dead_code_candidates(n, e, {"function": []}).collect()} == {"Caller", "DeadFunc"}


def test_coupling(spark):
    n = nodes(spark, [("a1", "function"), ("a2", "function"), ("b1", "function")])
    e = edges(spark, [("a1", "b1", "calls"), ("a2", "b1", "calls"), ("a1", "a2", "calls")])
    r = {x.unit: x for x in A.coupling(n, e, F.substring("id", 1, 1), ["calls"]).collect()}
    assert (r["a"].ca, r["a"].ce, r["a"].instability, r["a"].internal, r["a"].total) == (0, 1, 1.0, 1, 3)
    assert (r["b"].ca, r["b"].ce, r["b"].instability, r["b"].total) == (1, 0, 0.0, 2)


def test_reach_risk_and_hidden(spark):
    e = edges(spark, [("x", "y", "calls"), ("y", "z", "calls")])
    assert got(T.reach_index(e, ids(spark, "z"))) == {("z", 1, "y"), ("z", 2, "x")}
    assert got(T.reach_index(e, ids(spark, "z"), ids(spark, "y"))) == {("z", 2, "x")}
    d = spark.createDataFrame([(5, 0), (5, 20), (2, 0), (0, 0), (10, 0)], "a int, b int")
    assert [r[0] for r in d.select(G.risk(F.col("a"), F.col("b"))).collect()] == ["HIGH", "CRITICAL", "MEDIUM", "LOW", "CRITICAL"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_cores_against_python(spark, seed):
    names, es = random_graph(seed)
    n, p = ids(spark, *names), spark.createDataFrame(es, "src string, dst string")
    reach = {a: {a} for a in names}
    for _ in names:
        for a in names:
            reach[a] |= {d for s, d in es if s in reach[a]}
    strong = {a: min(b for b in names if b in reach[a] and a in reach[b]) for a in names}
    assert dict(got(G.strong_components(n, p))) == strong
    und = {a: {a} for a in names}
    for _ in names:
        for a in names:
            und[a] |= {x for s, d in es if s in und[a] or d in und[a] for x in (s, d)}
    assert dict(got(G.components(n, p))) == {a: min(und[a]) for a in names}
    simple = {frozenset(x) for x in es if x[0] != x[1]}
    core = dict.fromkeys(names, 0)
    for k in itertools.count(1):
        live = set(names)
        while drop := {a for a in live if sum(a in x and x <= live for x in simple) < k}:
            live -= drop
        if not live:
            break
        core.update(dict.fromkeys(live, k))
    assert dict(got(G.k_core(n, p))) == core


def test_k_core_of_triangle_and_pendant(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    assert got(G.k_core(ids(spark, *"abcd"), p)) == {("a", 2), ("b", 2), ("c", 2), ("d", 1)}


def test_pagerank_sums_to_one_and_betweenness(spark):
    names, es = random_graph(4)
    n = nodes(spark, [(a, "function") for a in names])
    e = edges(spark, [(a, b, "calls") for a, b in es])
    assert abs(G.pagerank(n, e, rounds=10).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    # plain shortest-path counts
    adj = {a: sorted({d for s, d in es if s == a}) for a in names}
    score = dict.fromkeys(names, 0.0)
    for s in names:
        paths, front = {s: [[s]]}, [s]
        seen = {s}
        while front:
            nxt = {}
            for u in front:
                for v in adj[u]:
                    if v not in seen:
                        nxt.setdefault(v, []).extend(p + [v] for p in paths[u])
            seen |= set(nxt)
            paths.update(nxt)
            front = list(nxt)
        for t, ps in paths.items():
            for p in ps:
                for x in p[1:-1]:
                    score[x] += 1 / len(ps)
    b = dict(got(G.betweenness(spark.createDataFrame(es, "src string, dst string"), ids(spark, *names), len(names))))
    for a in names:
        assert abs(b.get(a, 0.0) - score[a]) < 1e-9


def test_shortest_and_flow_paths(spark):
    e = edges(spark, [("a", "b", "calls"), ("a", "c", "calls"), ("b", "d", "calls"), ("c", "d", "calls"), ("d", "e", "calls")])
    r = T.shortest_path(e, "a", "e", k=5).collect()
    assert [x.path for x in r] == [["a", "b", "d", "e"], ["a", "c", "d", "e"]] and r[0].hops == 3
    assert T.shortest_path(e, "e", "a").count() == 0
    assert [x.path for x in T.shortest_path(e, "a", "a").collect()] == [["a"]]
    f = T.paths(e, ids(spark, "a"), ids(spark, "d", "e"), 3)
    assert {(r.sink, tuple(r.path), r.confidence) for r in f.collect()} == {("d", ("a", "b", "d"), 0.81), ("d", ("a", "c", "d"), 0.81), ("e", ("a", "b", "d", "e"), 0.729), ("e", ("a", "c", "d", "e"), 0.729)}


def test_cycle_walk_and_bfs(spark):
    e = edges(spark, [("a", "b", "calls"), ("b", "c", "imports"), ("c", "unresolved::x", "calls")])
    assert T.would_close_cycle(e, "c", "a") and not T.would_close_cycle(e, "a", "b")
    assert got(T.bfs(e, ids(spark, "a"), depth=None)) == {("a", 0), ("b", 1), ("c", 2)}
    assert T.budgeted_walk(e, "a", 17).count() == 2 and T.budgeted_walk(e, "a", 0).count() == 1


def test_co_change_diffusion_and_resolution(spark):
    c = spark.createDataFrame([("1", "f"), ("1", "g"), ("2", "f"), ("2", "g"), ("3", "f"), ("4", "f")], "commit string, file string")
    r = J.co_change_pairs(c).collect()
    assert [(x.a, x.b, x.together) for x in r] == [("f", "g", 2)] and abs(r[0].score - 1.0) < 1e-9  # commits of one file are left out
    p = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.9)], "a string, b string, sim double")
    assert [(x.a, x.c, round(x.score, 6)) for x in G.diffuse(p).collect()] == [("A", "C", 0.729)]
    impl = J.infer_implements(spark.createDataFrame([("t", "x"), ("t", "y"), ("u", "x")], "type_id string, name string"), spark.createDataFrame([("i", "x"), ("i", "y")], "iface_id string, name string"))
    assert got(impl) == {("t", "i")}


def test_communities_find_two_cliques(spark):
    es = [(a, b, 1.0) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("a", "w", 0.1)]
    p = spark.createDataFrame(es, "src string, dst string, w double")
    m = G.communities(ids(spark, *"abcdwxyz"), p, 12)
    d = dict(got(m))
    assert len({d[x] for x in "abcd"}) == 1 and len({d[x] for x in "wxyz"}) == 1 and d["a"] != d["w"]
    assert G.modularity(p, m) > 0.4


def test_pipeline_language(spark):
    n = nodes(spark, [("a", "function"), ("b", "method"), ("c", "method")])
    e = edges(spark, [("a", "b", "calls"), ("b", "c", "calls")])
    assert got(dsl.run("nodes kind=function | traverse out kind=calls depth=2 | filter kind=method name~^c", n, e).select("id")) == {("c",)}
    assert dsl.field_query("kind:a lang:go foo kind:b x:y") == ({"kind": "b", "lang": "go"}, "foo x:y")
    for bad in ("filter kind=a", "nodes | jump", " | ".join(["nodes"] * 6), "nodes |"):
        with pytest.raises(ValueError):
            dsl.parse(bad)


def test_empty_tables(spark):
    n, e = nodes(spark, []), edges(spark, [])
    assert J.dead_code_candidates(n, e).count() == 0
    assert G.components(ids(spark), e.selectExpr("from_id AS src", "to_id AS dst")).count() == 0
    assert G.strong_components(ids(spark), e.selectExpr("from_id AS src", "to_id AS dst")).count() == 0
    assert T.bfs(e, ids(spark, "a")).count() == 1


def test_whole_call_graph_is_analysed(spark):
    from types import SimpleNamespace

    from quiltgraph import catalog
    from quiltgraph.plans import graphs

    # a path a > b > c, closed to a triangle by a reference of low confidence
    rows = [("a", "b", "calls", 0.9), ("b", "c", "calls", 0.9), ("a", "c", "references", 0.5)]
    e = spark.createDataFrame([(s, d, k, c, "ast_resolved") for s, d, k, c in rows], "from_id string, to_id string, kind string, confidence double, origin string")
    n = spark.createDataFrame([(i, "type" if i == "c" else "function") for i in "abcd"], "id string, kind string")
    catalog.queries()
    made = SimpleNamespace(spark=spark, nodes=n, edges=e)
    assert got(graphs._calls(made)) == {("a", "b"), ("b", "c"), ("a", "c")}
    assert dict(got(graphs.G.k_core(n, graphs._calls(made)))) == {"a": 2, "b": 2, "c": 2, "d": 0}
    only = SimpleNamespace(edges=e.where("kind = 'calls'"), nodes=n, spark=spark)
    assert dict(got(graphs._between(only))) == {"b": 1.0}  # exact, scaled by nodes, not by pairs
