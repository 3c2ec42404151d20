"""Reranking, communities, source-code operators and whole-graph kernels against plain Python."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quiltgraph.operators import code as K
from quiltgraph.operators import community as C
from quiltgraph.operators import graph as G
from quiltgraph.operators import rerank as R
from quiltgraph.operators import traversal as T

NOW = dt.datetime(2024, 1, 31)
EDGE = "from_id string, to_id string, kind string, origin string"


def value(spark, f, *rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r.v for r in d.select("i", f(*[F.col(f"c{k}") for k in range(len(rows[0]))]).alias("v")).orderBy("i").collect()]


def test_query_shapes(spark):
    cases = {
        "parseConfig": "symbol", "MAX_SIZE": "symbol", "HTTP": "symbol", "a::b": "symbol", "internal/auth/token.go": "path", "load(x int)": "signature", "a -> b": "signature",
        "foo OR bar OR baz": "soup", "a, b, c": "soup", "how does login work": "concept", "widget": "concept", "": "concept", "  ": "concept",
    }
    got = value(spark, R.query_class, *[(q,) for q in cases])
    assert dict(zip(cases, got)) == cases
    assert [R.class_of(q) for q in cases] == list(cases.values())
    a = value(spark, R.alpha, ("parseConfig",), ("how does login work",), ("validateToken handler",), ("x/y.go",), ("f(x)",))
    assert a[0] == 0.3 and a[1] == 0.5 and 0.3 < a[2] < 0.5 and a[3] == 0.15 and a[4] == 0.35
    assert abs(a[2] - (0.5 - 0.2 * 0.5)) < 1e-9  # one identifier of two words


def test_path_penalty_and_stems(spark):
    cases = {"a/tests/x.go": 0.3, "a/x_test.go": 0.3, "web/a.spec.ts": 0.3, "legacy/a.go": 0.5, "examples/a.go": 0.5, "t/a.d.ts": 0.7, "include/a.h": 0.7, "src/index.js": 0.7, "src/a.go": 1.0, "": 1.0}
    assert value(spark, R.path_penalty, *[(p,) for p in cases]) == list(cases.values())
    assert value(spark, R.test_stem, ("TestLoad",), ("test_load_file",), ("load_test",), ("loadSpec",)) == ["load", "load_file", "load", "load"]
    bias = value(spark, R.definition_bias, ("loadFile", "function", "loadFile", "a/b.go"), ("loadFile", "function", "loadAll", "a/b.go"), ("loadFile", "function", "x", "a/loadfile.go"), ("load file", "function", "load file", "a.go"), ("loadFile", "file", "loadFile", "a.go"))
    assert bias == [1.0, 0.4, 0.6, 0.0, 0.0]


def test_signals_and_score(spark):
    rows = [  # query, id, text, vector, kind, name, signature, path, repo, churn, authored
        ("loadFile", "a", 0, 3, "function", "loadFile", "loadFile(path string)", "src/io.go", "r1", 7, NOW - dt.timedelta(30)),
        ("loadFile", "b", 1, None, "type", "File", None, "src/io.go", "r1", 0, None),
        ("loadFile", "c", None, 0, "function", "TestLoadFile", "TestLoadFile(t T)", "src/io_test.go", "r2", 3, NOW + dt.timedelta(2)),
        ("loadFile", "d", 2, None, "function", "other", "", None, None, None, NOW),
        ("other", "a", None, None, "function", "loadFile", None, "src/io.go", "r1", 7, None),
    ]
    c = spark.createDataFrame(rows, "query string, id string, text_rank int, vector_rank int, kind string, name string, signature string, file_path string, repo_prefix string, churn int, authored_at timestamp").withColumns({"qual_name": F.lit(""), "project_id": F.lit("")})
    e = spark.createDataFrame([("x", "a", "calls", "ast_resolved"), ("y", "a", "calls", "text_matched"), ("x", "b", "references", "lsp_resolved"), ("a", "b", "calls", "ast_resolved"), ("z", "a", "imports", "ast_resolved")], EDGE)
    extra = {
        "hits": spark.createDataFrame([("a", 0.25, 0.5)], "id string, hub double, authority double"),
        "community": spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2")], "id string, community string"),
        "feedback": spark.createDataFrame([("b", 0.4)], "id string, feedback double"),
        "frecency": spark.createDataFrame([("b", 1.3), ("a", 1.1)], "id string, boost double"),
        "combo": spark.createDataFrame([("loadFile", "a", 2.0)], "query string, id string, boost double"),
        "co_change": spark.createDataFrame([("src/io.go", "src/io_test.go", 0.5), ("src/io_test.go", "src/io.go", 0.5), ("src/io.go", "far.go", 0.9)], "a string, b string, score double"),
        "centrality": spark.createDataFrame([("loadFile", "a", 1.0), ("loadFile", "b", 0.3)], "query string, id string, score double"),
        "similar": spark.createDataFrame([("a", "c", 0.8), ("c", "a", 0.8), ("a", "far", 0.9)], "a string, b string, sim double"),
    }
    s = R.signals(c, e, NOW, extra, home_repo="r2")
    assert len([x for x in s.columns if x.startswith("s_")]) == 19 == len(R.WEIGHTS)
    got = {(r.query, r.id): r for r in R.score(s).collect()}
    a, b, t, d = (got["loadFile", x] for x in "abcd")
    near = lambda x, y: abs(x - y) < 1e-9
    assert near(a.s_bm25, 1) and near(b.s_bm25, 61 / 62) and t.s_bm25 == 0 and near(a.s_semantic, 61 / 64) and near(t.s_semantic, 1)
    assert near(a.s_fan_in, 1) and near(b.s_fan_in, math.log1p(2) / math.log1p(3)) and d.s_fan_in == 0 and near(a.s_fan_out, 1)
    assert near(a.s_hits, 0.5 / 1.25) and b.s_hits == 0
    assert near(a.s_churn, 1) and near(t.s_churn, math.log1p(3) / math.log1p(7)) and d.s_churn == 0
    assert near(a.s_co_change, 0.5) and near(t.s_co_change, 0.5) and d.s_co_change == 0
    assert near(a.s_community, 1) and near(t.s_community, 1) and d.s_community == 0  # t by its repository
    assert near(a.s_minhash, 0.8) and b.s_minhash == 0
    assert near(a.s_api_signature, 1) and b.s_api_signature == 0 and near(t.s_type_signature, 0)
    assert near(a.s_recency, 0.5) and b.s_recency == 0 and near(t.s_recency, 1)
    assert near(a.s_feedback, 0.5) and near(b.s_feedback, 0.6)
    sums = {"src/io.go": 61 / 61 + 61 / 64 + 61 / 62, "src/io_test.go": 1}
    assert near(a.s_file_coherence, 1) and t.s_file_coherence == 0 and sums["src/io.go"] > 1
    assert a.s_path_penalty == 1 and t.s_path_penalty == 0.3 and d.s_path_penalty == 1
    assert a.s_definition_bias == 1 and t.s_definition_bias == 0 and a.s_source_bias == 1 and t.s_source_bias == 0 and b.s_source_bias == 0
    assert near(a.s_provenance, (0.75 - 0.5) / 0.5) and near(b.s_provenance, ((0.6 + 1.0) / 2 - 0.5) / 0.5)
    assert a.s_proximity == 1 and near(b.s_proximity, 0.3)
    part = (0.5 - 0.3) / (0.5 - 0.15)
    mult = {"bm25": 1 + part * 0.25, "semantic": 1 - part * 0.55, "proximity": 1.3 + part * (0.4 - 1.3)}
    for r in (a, b, t, d):
        assert near(r.score, round(sum(w * mult.get(k, 1) * r[f"s_{k}"] for k, w in R.WEIGHTS.items()), 9)) or abs(r.score - sum(w * mult.get(k, 1) * r[f"s_{k}"] for k, w in R.WEIGHTS.items())) < 1e-8
    order = sorted((a, b, t, d), key=lambda r: -r.score)
    assert [r["rank"] for r in order] == [1, 2, 3, 4] and got["other", "a"]["rank"] == 1
    # a batch without any table, and none at all
    assert R.score(R.signals(c, e, NOW), continuous=False).count() == 5 and R.score(R.signals(c.limit(0), e, NOW)).count() == 0


def test_refine_reset_and_completion(spark):
    r = spark.createDataFrame([("q", "a", 1, 0.1), ("q", "b", 2, None), ("q", "c", 3, 0.9), ("q", "d", 4, 1.0)], "list string, id string, rank int, cosine double")
    assert [x.id for x in R.head_refine(r, 3).orderBy("refined").collect()] == ["c", "a", "b", "d"]
    seeds = spark.createDataFrame([("q", "a", 0), ("q", "b", 1)], "query string, id string, rank int")
    e = spark.createDataFrame([("a", "b", "calls", ""), ("a", "x", "calls", ""), ("b", "x", "calls", ""), ("b", "y", "calls", ""), ("b", "gone", "calls", ""), ("a", "z", "imports", "")], EDGE)
    n = spark.createDataFrame([(x,) for x in "abxyz"], "id string")
    got = {(x.id, x.is_seed) for x in R.graph_completion(seeds, e, n, ["calls"]).collect()}
    assert got == {("a", True), ("b", True), ("x", False), ("y", False)}
    assert [x.id for x in R.graph_completion(seeds, e, n, ["calls"], limit=3).collect()].count("y") == 0


def cliques(k, size, seed=0):
    """k cliques in a ring."""
    names = [[f"n{c:02d}_{i}" for i in range(size)] for c in range(k)]
    rows = [(a, b, 1.0) for c in names for x, a in enumerate(c) for b in c[x + 1 :]]
    rows += [(names[c][0], names[(c + 1) % k][1], 1.0) for c in range(k)]
    random.Random(seed).shuffle(rows)
    return names, rows


def test_communities_of_a_ring_of_cliques(spark):
    names, rows = cliques(12, 5)
    pairs = spark.createDataFrame(rows, "src string, dst string, w double")
    nodes = spark.createDataFrame([(x,) for c in names for x in c] + [("alone",)], "id string")
    for refined in (True, False):
        got = {r.id: r.community for r in C.communities(nodes, pairs, refined).collect()}
        assert got["alone"] == "alone" and len(got) == 61
        assert all(len({got[x] for x in c}) == 1 for c in names)  # no clique is cut
        assert all(got[x] == min(y for y in got if got[y] == got[x]) for x in got)
    # contraction by label moves first, as for a graph that is too large
    small = {r.id: r.community for r in C.communities(nodes, pairs, limit=40).collect()}
    assert all(len({small[x] for x in c}) == 1 for c in names)
    q = lambda d: G.modularity(pairs, spark.createDataFrame(list(d.items()), "id string, community string"))
    moved = {r.id: r.community for r in G.communities(nodes, pairs).collect()}
    assert q(got) >= q(moved) - 1e-9 and q(got) > 0.7


def test_leiden_communities_are_connected_and_beat_louvain_or_tie():
    rng = np.random.default_rng(4)
    for trial in range(5):
        n = 120
        group = rng.integers(0, 6, n)
        src, dst = np.triu_indices(n, 1)
        keep = rng.random(len(src)) < np.where(group[src] == group[dst], 0.25, 0.02)
        g = C.Weighted(n, src[keep], dst[keep], np.ones(keep.sum()))
        a, b = C.optimise(g), C.optimise(g, refined=False)
        assert g.modularity(a) > 0.35 and g.modularity(a) > g.modularity(b) - 0.02
        for c in np.unique(a):  # connected inside
            members = set(np.flatnonzero(a == c).tolist())
            seen, todo = set(), [min(members)]
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += [j for j in g.around(i)[0].tolist() if j in members]
            assert seen == members
        # modularity from its definition
        m = keep.sum()
        deg = np.bincount(np.r_[src[keep], dst[keep]], minlength=n)
        same = a[:, None] == a[None, :]
        adj = np.zeros((n, n))
        adj[src[keep], dst[keep]] = adj[dst[keep], src[keep]] = 1
        assert abs(g.modularity(a) - ((adj - deg[:, None] * deg[None, :] / (2 * m)) * same).sum() / (2 * m)) < 1e-9


def test_incremental_communities(spark):
    names, rows = cliques(6, 5)
    nodes = spark.createDataFrame([(x,) for c in names for x in c], "id string")
    before = C.communities(nodes, spark.createDataFrame(rows, "src string, dst string, w double"))
    # one node leaves its clique for another
    moved = names[0][4]
    rows = [r for r in rows if moved not in r[:2]] + [(moved, x, 1.0) for x in names[3]]
    after = {r.id: r.community for r in C.communities(nodes, spark.createDataFrame(rows, "src string, dst string, w double"), before=before, changed=spark.createDataFrame([(moved,)], "id string")).collect()}
    assert after[moved] == after[names[3][0]] and after[moved] != after[names[0][0]]
    was = {r.id: r.community for r in before.collect()}
    rest = [x for c in names for x in c if x != moved]
    assert all((was[x] == was[y]) == (after[x] == after[y]) for x in rest for y in rest)


def test_kernels_and_joins_agree(spark):
    rng = random.Random(3)
    ids = [f"v{i}" for i in range(30)]
    e = spark.createDataFrame([(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "references"]), rng.choice(["ast_resolved", "text_matched"])) for _ in range(90)] + [("v1", "outside", "calls", "ast_resolved")], EDGE)
    n = spark.createDataFrame([(x,) for x in ids], "id string")
    seeds = n.where("id IN ('v1', 'v2')")
    pairs = e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).where("dst <> 'outside'")
    small = [G.pagerank(n, e, rounds=7).collect(), G.pagerank(n, e, rounds=7, seeds=seeds).collect(), G.hits(n, e, rounds=5).collect(), G.strong_components(n, pairs).collect()]
    limit, G.LOCAL_ROWS = G.LOCAL_ROWS, 0
    try:
        large = [G.pagerank(n, e, rounds=7).collect(), G.pagerank(n, e, rounds=7, seeds=seeds).collect(), G.hits(n, e, rounds=5).collect(), G.strong_components(n, pairs).collect()]
    finally:
        G.LOCAL_ROWS = limit
    for a, b in zip(small[:3], large[:3]):
        x, y = ({r.id: tuple(r)[1:] for r in rs} for rs in (a, b))
        assert x.keys() == y.keys() and all(np.allclose(x[k], y[k], atol=1e-12) for k in x)
    x, y = ({r.id: r.component for r in rs} for rs in (small[3], large[3]))
    assert all((x[a] == x[b]) == (y[a] == y[b]) for a in ids for b in ids)
    reach = {a: {a} for a in ids}
    step = {}
    for r in pairs.collect():
        step.setdefault(r.src, set()).add(r.dst)
    for a in ids:
        todo = [a]
        while todo:
            for b in step.get(todo.pop(), ()):
                if b not in reach[a]:
                    reach[a].add(b)
                    todo.append(b)
    assert all((x[a] == x[b]) == (b in reach[a] and a in reach[b]) for a in ids for b in ids)


def test_cycles_have_a_class(spark):
    e = spark.createDataFrame([("a", "b", "imports"), ("b", "a", "calls"), ("c", "d", "calls"), ("d", "c", "calls"), ("e", "f", "calls"), ("f", "e", "calls"), ("a", "c", "calls")], "src string, dst string, kind string")
    n = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    unit = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u"), ("d", "w"), ("e", "z"), ("f", "z")], "id string, community string")
    got = {(r.component, r.size, r["class"], r.severity) for r in G.cycles(n, e, unit).collect()}
    assert got == {("a", 2, "import", 3), ("c", 2, "cross_community", 2), ("e", 2, "call", 1)}


def test_betweenness_scale(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    got = {r.id: r.score for r in G.betweenness(e, n, 5).collect()}
    assert got == {"b": 3.0, "c": 4.0, "d": 3.0}  # a directed path


def test_paths_keep_to_sinks_and_rank(spark):
    e = spark.createDataFrame([("s", "a", "calls", "ast_resolved"), ("s", "b", "calls", "text_matched"), ("a", "t", "calls", "ast_resolved"), ("b", "t", "calls", "ast_resolved"), ("a", "b", "calls", "ast_resolved"), ("a", "dead", "calls", "ast_resolved"), ("t", "s", "calls", "ast_resolved")], EDGE)
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    got = [("".join(r.path), r.hops) for r in T.paths(e, one("s"), one("t"), 8).orderBy("hops", F.desc("confidence")).collect()]
    assert got == [("sat", 2), ("sbt", 2), ("sabt", 3)]
    assert T.paths(e, one("s"), one("t"), 8, 1).count() == 1


def test_shortest_path_count(spark):
    e = spark.createDataFrame([("s", "a", "calls", ""), ("s", "b", "calls", ""), ("a", "c", "calls", ""), ("b", "c", "calls", ""), ("c", "t", "calls", ""), ("c", "u", "calls", ""), ("u", "t", "calls", ""), ("x", "s", "calls", "")], EDGE)
    got = T.shortest_path_count(e, "s", "t").first()
    assert (got.hops, got.paths, got["first"]) == (3, 2, "s>a>c>t")
    assert T.shortest_path_count(e, "s", "x").first().hops == -1 and T.shortest_path_count(e, "s", "s").first().hops == 0
    assert T.shortest_path(e, "s", "t", 24, 10).count() == 2


def test_lines_meet_symbols_across_bins(spark):
    from quiltgraph.operators import joins as J

    rng = random.Random(2)
    nodes = [(f"n{i}", f"f{i % 3}", a, a + rng.choice((0, 5, 300, 900))) for i in range(60) for a in [rng.randrange(0, 1500)]]
    n = spark.createDataFrame(nodes, "id string, file_path string, start_line int, end_line int")
    pts = sorted({(f"f{rng.randrange(3)}", rng.randrange(0, 2000)) for _ in range(200)})
    got = {(r.file_path, r.line): r.id for r in J.innermost_at(spark.createDataFrame(pts, "file_path string, line int"), n).collect()}
    want = {}
    for f, x in pts:
        hit = [(e - s, i) for i, g, s, e in nodes if g == f and s > 0 and s <= x <= e]
        if hit:
            want[f, x] = min(hit)[1]
    assert got == want
    hunks = [(f"f{rng.randrange(3)}", a, a + rng.choice((0, 3, 600))) for _ in range(40) for a in [rng.randrange(1, 1800)]]
    got = sorted((r.file_path, r.h_start, r.h_end, r.id) for r in J.range_overlap(spark.createDataFrame(hunks, "file_path string, h_start int, h_end int"), n).collect())
    assert got == sorted((f, a, b, i) for f, a, b in hunks for i, g, s, e in nodes if g == f and s > 0 and s <= b and e >= a)


def test_resolution_needs_evidence(spark):
    from quiltgraph.operators import joins as J

    refs = spark.createDataFrame([("r1", "f", "a/x.go", "A"), ("r2", "g", "a/x.go", "A"), ("r3", "g", "a/y.go", "A")], "ref_id string, name string, file_path string, repo_prefix string")
    defs = spark.createDataFrame([("d1", "f", "b/z.go", "B"), ("d2", "f", "a/w.go", "A"), ("d3", "g", "b/z.go", "B")], "id string, name string, file_path string, repo_prefix string")
    got = {r.ref_id: (r.def_id, r["rank"], r.candidates) for r in J.resolve_across(refs, defs, spark.createDataFrame([("a/x.go", "B")], "file_path string, repo_prefix string")).collect()}
    assert got == {"r1": ("d2", 0, 1), "r2": ("d3", 1, 1)}
    assert {r.ref_id for r in J.resolve_files(refs, defs, spark.createDataFrame([("a/y.go",)], "file_path string")).collect()} == {"r3"}


def test_clone_tokens_and_index(spark):
    body = 'func load(p string) { x := "a b" + \'c\'; return 12 }'
    d = spark.createDataFrame([(1, body), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.ts for r in d.select("id", K.clone_tokens(F.col("t")).alias("ts")).collect()}
    assert got[1] == ["func", "v", "(", "v", "v", ")", "{", "v", ":=", "s", "+", "s", ";", "return", "0", "}"] and got[2] == got[3] == []
    sig = spark.createDataFrame([(i, [(j if i % 2 else -j) + (1000 * i if j % 4 == 3 and i > 3 else 0) for j in range(64)]) for i in range(1, 6)], "id long, sig array<bigint>")
    full = K.band_rows(sig)
    kept = K.index_add(K.index_remove(full, sig.where("id = 3")), sig.where("id = 3"))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, kept.collect()))
    found = {(r.id, r.other): r.shared for r in K.probe(full, sig.where("id = 1").select("id")).collect()}
    assert found == {(1, 3): 16}
    assert K.probe(K.index_remove(full, sig.where("id = 3")), sig.where("id = 1").select("id")).count() == 0


def test_rules(spark):
    f = spark.createDataFrame([("a.go", "go", 'x\npanic("no") // TODO it'), ("b.py", "python", "panic(1)\nfrom os import *"), ("c", "", None)], "path string, language string, text string")
    got = {(r.path, r.line_no, r.rule) for r in K.run_rules(f).collect()}
    assert got == {("a.go", 2, "go-panic"), ("a.go", 2, "todo"), ("b.py", 2, "wildcard-import")}
    mine = K.load_rules("- id: one\n  pattern: 'pan[i]c'\n  severity: low\n# note\n- rule: two\n  pattern: it''s\n")
    assert [r[0] for r in mine] == ["one", "two"] and mine[0][3] == "low"
    assert {(r.path, r.rule) for r in K.run_rules(f, mine).collect()} == {("a.go", "one"), ("b.py", "one")}
    assert K.load_rules('[{"id": "x", "pattern": "y"}]') == [("x", "user", "", "medium", "", "y")]
    assert K.run_rules(f, categories=["none"]).count() == 0
    for bad in ("- id: x\n", "- pattern: y\n"):
        try:
            K.load_rules(bad)
            raise AssertionError("accepted")
        except ValueError:
            pass


def test_signature_check(spark):
    rows = [("a", "f(x int) error", "f(x int) error"), ("b", "f(x int)", "g(x int)"), ("c", "f(x int, y int)", "f(x int)"), ("d", "f(x int)", "f(x int, y int)"), ("e", "f(x int)", "f(x int, y = 1)"), ("f", "f(x int)", "f(x long)"), ("g", "f() int", "f() string"), ("h", "f()", None)]
    e = spark.createDataFrame([("u", "c", "calls", ""), ("v", "c", "calls", ""), ("v", "c", "references", ""), ("w", "c", "implements", "")], EDGE)
    got = {r.id: (r.breaking, r.reasons, r.callers, r.implementors) for r in K.signature_check(spark.createDataFrame(rows, "id string, old string, new string"), e).collect()}
    assert got["a"] == (False, [], 0, 0) and got["c"] == (True, ["removed_parameter"], 2, 1) and not got["e"][0]
    assert {k: v[1] for k, v in got.items() if k in "bdfgh"} == {"b": ["renamed"], "d": ["required_parameter_added"], "f": ["parameter_changed"], "g": ["result_changed"], "h": ["removed"]}


def test_cells_find_nine_of_ten(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000, [0.0] * 16)], "id long, vec array<double>")
    c = K.fit_cells(v, 38)
    index = K.in_cells(v, c)
    assert index.count() == 1501  # every row is in the index
    got = K.search_cells(index, v.where("id % 50 = 0 AND id < 1500"), c, 10, 12).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        want = set(np.argsort(1 - u @ u[q], kind="stable")[:10].tolist())
        hits += len(want & {r.id for r in got if r.query == q})
    assert hits / 300 >= 0.9
    assert K.search_cells(index, v.limit(0), c, 3, 2).count() == 0


def test_token_vectors(spark):
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 4.0])], "token string, vec array<double>")
    d = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, ["zz"]), (3, ["a", "a"])], "id long, tokens array<string>")
    got = {r.id: r.vec for r in K.token_vectors(d, v).collect()}
    assert np.allclose(got[1], [0.6, 0.8]) and got[2] == [0.0, 0.0] and np.allclose(got[3], [1.0, 0.0])


def test_taint_pattern(spark):
    n = spark.createDataFrame([("x::Read", "Read", "src/a.go", "function"), ("y::readAll", "readAll", "lib/b.go", "method")], "id string, name string, file_path string, kind string")
    got = lambda p: sorted(r.name for r in n.where(K.taint_pattern(p)).collect())
    assert got("read") == ["Read", "readAll"] and got("name=Read") == ["Read"] and got("exact:y::readAll") == ["readAll"]
    assert got("name:all kind:method") == ["readAll"] and got("path:src/ read") == ["Read"] and got("read kind:type") == []


def test_sketch(spark):
    from quiltgraph.operators import aggregates as A

    words = [f"w{i % 97}" for i in range(3000)] + ["hot"] * 500
    d = spark.createDataFrame([(w,) for w in words], "term string")
    exact = d.groupBy("term").agg(F.count("*").alias("n"))
    s = A.count_min_merge(A.count_min(d, "term"), A.count_min(d.where("term = 'hot'"), "term"), -1)
    got = {r.term: (r.n, r.estimate) for r in A.count_min_estimate(s, exact, "term").collect()}
    assert got["hot"][1] == 0 and all(e >= n for t, (n, e) in got.items() if t != "hot")
    assert sum(e == n for t, (n, e) in got.items() if t != "hot") > 90
