"""Term passes, analyses by edge kind and framework synthesis on small inputs."""

from collections import Counter

from pyspark.sql import functions as F

from quiltgraph.operators import kinds as A
from quiltgraph.operators import synthesis as K
from quiltgraph.operators import terms as T

# Examples of Porter's paper, by step.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "filing": "file", "happy": "happi", "relational": "relat", "valenci": "valenc", "digitizer": "digit", "operator": "oper",
    "decisiveness": "decis", "hopefulness": "hope", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "ids": "ids", "utf8": "utf8", "größen": "größen",
}


def test_stems_and_stop_words(spark):
    rows = [(w, i, 2) for i, w in enumerate(STEMS)] + [("the", 1, 5), ("operators", 14, 1), (None, 3, 1), ("operating", 900, 1)]
    out = T.normalised_postings(spark.createDataFrame(rows, "term string, id long, n long"))
    want = Counter()
    for w, i, n in rows:
        if w is not None and w not in T.STOP_WORDS:
            want[(STEMS.get(w, "oper"), i)] += n
    assert Counter({(r.term, r.id): r.n for r in out.collect()}) == want
    assert T.normalised_postings(spark.createDataFrame([], "term string, id long, n long")).count() == 0


def _pieces(token, at):
    cuts = [0]
    for i in range(1, len(token)):
        if token[i - 1 : i + 1] in at and i - cuts[-1] >= 3 and len(token) - i >= 3:
            cuts.append(i)
    parts = [token[a:b] for a, b in zip(cuts, cuts[1:] + [len(token)])]
    return [p for p in dict.fromkeys(parts) if p != token] if len(token) >= 5 else []


def test_grams_and_seams(spark):
    words = ["validate", "aaaaaa", "abc", "abcd", "", "handlequery", "größeres", "x1y2z3", "validatequery", "handlevalidate", "zq", "query", "validate"]
    d = spark.createDataFrame([(w,) for w in words], "token string")
    for r in d.select("token", T.sparse_grams(F.col("token")).alias("g")).collect():
        w = r.token
        want = dict.fromkeys(w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)) if len(w) > 3 else {}
        assert r.g == [g for g in want if g != w], w
    pairs = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1) if w[i : i + 2].isascii() and w[i : i + 2].isalpha())
    ranked = sorted(pairs, key=lambda p: (pairs[p], p))
    at = T.seams(d)
    assert at == ranked[: len(ranked) // 4]
    for seams in (at, ["eq", "ev", "da", "aa"]):
        for r in d.select("token", T.seam_grams(F.col("token"), seams).alias("g")).collect():
            assert r.g == _pieces(r.token, seams), (r.token, seams)
    assert T.seams(d.where("token IN ('abc', 'zq')")) == []
    assert d.where("token = 'abcd'").select(T.seam_grams(F.col("token"), [])).first()[0] == ["abc", "bcd"]


def test_concepts(spark):
    names = ["parseToken", "token_parser parse", "parse token stream", "TokenParse", None, "", "stream", "streamParse parse", "a bc"]
    out = T.concepts(spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, out.collect())) == [("parse", 1, "token", 4), ("token", 1, "parse", 4)]
    assert T.concepts(spark.createDataFrame([], "name string")).count() == 0


EDGES = "from_id string, to_id string, kind string, mode string, op string, method string, level string, origin string, orm string, table_name string, derivation string"


def _edges(spark, rows):
    return spark.createDataFrame([(a, b, k, *[more.get(c) for c in ("mode", "op", "method", "level", "origin", "orm", "table_name", "derivation")]) for a, b, k, more in rows], EDGES)


def test_analyses_of_kinds(spark):
    many = [(f"f{i}", "ch", "sends", {}) for i in range(9)] + [("f1", "ch", "sends", {}), ("r", "ch", "recvs", {}), (None, "ch", "sends", {}), ("r", None, "recvs", {})]
    row = A.channel_ops(_edges(spark, many)).collect()
    assert [tuple(r) for r in row] == [("ch", 10, 1, ["f0", "f1", "f2", "f3", "f4"], ["r"])]
    e = _edges(spark, [("a", "g", "spawns", {"mode": None}), ("b", "g", "spawns", {"mode": None}), ("a", "g", "spawns", {"mode": "async"})])
    assert sorted((r.target, r.mode or "", r.spawns, tuple(r.spawners)) for r in A.goroutine_spawns(e).collect()) == [("g", "", 2, ("a", "b")), ("g", "async", 1, ("a",))]
    strings = spark.createDataFrame([("s1", "log_message", "hi"), ("s2", "error_msg", "bad")], "id string, context string, value string")
    e = _edges(spark, [("a", "s1", "emits", {"method": "Warnf"}), ("a", "s1", "emits", {"level": "info"}), ("b", "s1", "emits", {"level": "info"}), ("b", "s2", "emits", {}), ("b", "err", "throws", {}), ("b", "err", "throws", {}), ("c", "err", "throws", {})])
    assert sorted((r.level, r.emits, r.emitters) for r in A.log_events(e, strings).collect()) == [("info", 2, ["a", "b"]), ("warn", 1, ["a"])]
    nodes = spark.createDataFrame([("b", "B", "b.go"), ("c", "C", "c.go")], "id string, name string, file_path string")
    assert sorted((r.symbol, r.throws, r.kinds, r.errors, r.messages) for r in A.error_surface(e, nodes, strings).collect()) == [("b", 2, 1, ["err"], ["bad"]), ("c", 1, 1, ["err"], [])]
    e = _edges(spark, [("b", "t1", "queries", {"op": "write"}), ("b", "t2", "queries", {}), ("c", "t1", "queries", {"op": "read"})])
    assert sorted((r.symbol, r.queries, r.reads, r.writes, r.tables) for r in A.sql_call_sites(e, nodes).collect()) == [("b", 2, 1, 1, ["t1", "t2"]), ("c", 1, 1, 0, ["t1"])]
    contracts = spark.createDataFrame([("h", "http", "GET", "/x", None, None, None, None), ("g", "grpc", "Do", None, "Svc", None, None, None), ("t", "topic", None, None, None, "jobs", None, None), ("q", "graphql", None, None, None, None, "query", "user")], "id string, type string, method string, path string, service string, topic string, operation string, field string")
    e = _edges(spark, [("f", i, "handles_route", {}) for i in ("h", "g", "t", "q", "none")])
    assert sorted((r.route, r.method, r.path) for r in A.routes(e, contracts).collect()) == [("g", "Do", "Svc"), ("h", "GET", "/x"), ("q", "query", "user"), ("t", "", "jobs")]
    tables = spark.createDataFrame([("t1", "users")], "id string, name string")
    e = _edges(spark, [("m", "t1", "models_table", {"orm": "x"}), ("n", "t2", "models_table", {"orm": "x", "table_name": "n2"}), ("o", "t3", "models_table", {"orm": "y"})])
    assert sorted((r.model, r.table_name) for r in A.models(e, tables).collect()) == [("m", "users"), ("n", "n2"), ("o", "t3")]


def test_analyses_of_nothing(spark):
    none = _edges(spark, [])
    nodes = spark.createDataFrame([("b", "B", "b.go")], "id string, name string, file_path string")
    assert A.channel_ops(none).count() == A.components(none, nodes).count() == A.tests_as_edges(none, nodes).count() == 0
    assert A.k8s_resources(none, nodes.select("id", "name")).first().depends_on == 0


def test_framework_calls(spark):
    stubs = spark.createDataFrame([("c", "S", "Do", "r1"), ("d", "S", "Do", "r9"), ("e", "S", "Go", "r1"), ("f", "Z", "Do", "r1"), ("g", "", "Do", "r1"), ("h", "L", "Do", None)], "from_id string, service string, method string, repo string")
    types = spark.createDataFrame([("t1", "Impl", "type", "r1", "p"), ("t2", "Impl", "type", "r2", "q"), ("t3", "Late", "type", "r3", "p"), ("u", "UnimplementedL", "type", "r3", "p"), ("i", "LServer", "interface", "r3", "p"), ("j", "Server", "interface", "r3", "p")], "id string, name string, kind string, repo string, dir string")
    reg = spark.createDataFrame([("S", "Impl", "r2", "x"), ("S", "Impl", "r1", "x"), ("Z", "Nobody", "r1", "p")], "service string, impl string, repo string, dir string")
    members = spark.createDataFrame([("t1", "m1", "Do", "r1"), ("t2", "m2", "Do", "r2"), ("t2", "m2b", "Go", "r2"), ("t3", "m3", "Do", "r3"), ("u", "m4", "Do", "r3")], "type_id string, id string, name string, repo string")
    impl = spark.createDataFrame([("t3", "i"), ("u", "i"), ("t1", "j")], "from_id string, to_id string")
    got = {r.from_id: (r.to_id, r.origin, r.confidence) for r in K.grpc_calls(stubs, reg, types, members, impl).collect()}
    # c: own repository; d: two candidates elsewhere; e: the only one anywhere; f: nothing serves it; h: by the interface
    assert got == {"c": ("m1", "ast_resolved", 0.9), "d": ("unresolved::grpc::S::Do", None, None), "e": ("m2b", "ast_resolved", 0.9), "f": ("unresolved::grpc::Z::Do", None, None), "h": ("m3", "ast_inferred", 0.7)}
    starts = spark.createDataFrame([("a", "activity", "Pay", "r1"), ("b", "workflow", "Pay", "r1")], "from_id string, role string, name string, repo string")
    workers = spark.createDataFrame([("w", "activity", "Pay", "r2"), ("w", "activity", "Pay", "r2")], "id string, role string, name string, repo string")
    assert {r.from_id: r.to_id for r in K.workflow_calls(starts, workers).collect()} == {"a": "w", "b": "unresolved::temporal::workflow::Pay"}
    sql = spark.createDataFrame([("x", "com.app.UserMapper", "find", "r1"), ("y", "com.app.UserMapper", "drop", "r1"), ("z", "UserMapper", "find", "r2")], "from_id string, namespace string, statement string, repo string")
    daos = spark.createDataFrame([("m", "UserMapper", "find", "r1"), ("n", "UserMapper", "find", "r3")], "id string, receiver string, name string, repo string")
    assert {r.from_id: r.to_id for r in K.mapper_calls(sql, daos).collect()} == {"x": "m", "y": "unresolved::mybatis::com.app.UserMapper::drop", "z": "unresolved::mybatis::UserMapper::find"}
