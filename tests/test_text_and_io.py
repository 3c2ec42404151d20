"""Search, scalar functions, sources, exports and streaming on small inputs."""

import datetime as dt
import json
import math

import numpy as np
from pyspark.sql import functions as F

from quiltgraph.functions import scalar as S
from quiltgraph.operators import search as X
from quiltgraph.operators import synthesis as K
from quiltgraph.sources import formats as I
from quiltgraph.streaming import changes as C


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_scalars(spark):
    s = lambda e: one(spark, e)
    assert s(S.http_path(F.lit("/a/:id/<x>/{y}/${z}/$w"))) == "/a/{param}/{param}/{param}/{param}/{param}"
    assert s(S.package_of(F.lit("a/b/c/d.go"), 2)) == "a/b" and s(S.package_of(F.lit("x.go"), 2)) == ""
    assert s(S.index_tokens(F.lit("parseHTTPRequest a_bc"))) == ["parse", "http", "request", "bc"]
    assert s(S.query_tokens(F.lit("getUser a"))) == ["getuser", "a"]
    assert s(S.stub_kind(F.lit("repo/unresolved::x"))) == "unresolved" and not s(S.is_stub(F.lit("a.go::x")))
    assert s(S.sql_tables(F.lit('SELECT * FROM "Users" u JOIN orders o; UPDATE users'))) == ["users", "orders"]
    assert s(S.todo_fields(F.lit("// TODO(amy): fix AB-12"))) == ("TODO", "amy", "AB-12")
    assert s(S.spdx(F.lit("// SPDX-License-Identifier: MIT"))) == "MIT"
    assert s(S.redact(F.lit("mail a.b@c.org password=hunter2"))) == "mail <email> <secret>"
    assert s(S.enclosing_id(F.lit("a.go::T.m"))) == "a.go::T" and s(S.file_of(F.lit("a.go::T.m"))) == "a.go"
    assert s(S.gcx_row(F.lit("a\tb"), F.lit("c\\\r\n"))) == "a\\tb\tc\\\\\\n"
    assert s(S.cpp_type(F.lit("const struct Foo & "))) == "Foo"
    assert abs(s(S.recency(F.lit(30.0))) - 0.5) < 1e-12
    assert s(S.confidence_label(F.lit(0.0))) == "AMBIGUOUS" and s(S.tier_label(F.lit("ast_inferred"))) == "ast"
    assert s(S.default_origin(F.lit(""), F.lit("calls"), F.lit(0.6))) == "ast_inferred"


def test_bm25_and_fusion(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "d")], "id long, text string")
    r = {x.id: x.score for x in X.bm25(d, ["a", "a"], F.split("text", " ")).collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert set(r) == {1} and abs(r[1] - 2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))) < 1e-6
    a = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int")
    b = spark.createDataFrame([("b", 0), ("a", 1)], "id string, rank int")
    assert {x.score for x in X.rrf(a, b).collect()} == {round(1 / 61 + 1 / 62, 9)}


def test_pack_grep_and_classes(spark):
    p = spark.createDataFrame([("q", 0, 1, 5), ("q", 1, 2, 9), ("q", 2, 3, 3)], "list string, rank long, id long, tokens long")
    assert sorted(x.id for x in X.greedy_pack(p, 8).collect()) == [1, 3]
    d = spark.createDataFrame([(1, "x\nfoo 1\nfoo")], "id long, text string")
    assert [(x.line_no, x.line) for x in X.grep(d, F.col("text"), regex="foo [0-9]").collect()] == [(1, "foo 1")]
    assert [X.query_class(q) for q in ("getUser", "a/b.go", "f(x)", "a OR b", "how it works")] == ["symbol", "path", "signature", "soup", "concept"]
    assert X.soup_terms("a OR b, c") == ["a", "b", "c"]


def test_knn_minhash(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<float>")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(1 - n[:5] @ n.T, axis=1)[:, :4]
    r = X.knn_join(d, d.where("id < 5"), 4, block=2).collect()
    assert {(x.query, x.id) for x in r} == {(q, int(i)) for q in range(5) for i in want[q]}
    t = spark.createDataFrame([(1, list("abcdefgh")), (2, list("abcdefgh")), (3, list("zyxwvuts"))], "id long, ts array<string>")
    s = {x.id: x.sig for x in X.minhash(t).collect()}
    assert s[1] == s[2] and sum(a == b for a, b in zip(s[1], s[3])) < 10


def test_sources(spark, tmp_path):
    (tmp_path / "cover.out").write_text("mode: set\na/b.go:3.4,5.6 2 1\na/b.go:7.1,9.2 3 0\n")
    assert [tuple(r) for r in I.coverage_profile(spark, str(tmp_path / "cover.out")).orderBy("start").collect()] == [("a/b.go", 3, 5, 2, 1), ("a/b.go", 7, 9, 3, 0)]
    (tmp_path / "log").write_bytes(b"k1|amy|100\na.go\nb.go\n\0k2|bo|200\na.go\n\0")
    assert {(r.commit, r.file) for r in I.git_log(spark, str(tmp_path / "log")).collect()} == {("k1", "a.go"), ("k1", "b.go"), ("k2", "a.go")}
    (tmp_path / "OWNERS").write_text("# all\n* core\n/lib/* team-lib other\n")
    assert [(r.prefix, r.owner) for r in I.codeowners(spark, str(tmp_path / "OWNERS")).orderBy("rule_no").collect()] == [("", "core"), ("lib/", "team-lib other")]
    (tmp_path / "d.diff").write_text("diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12 @@\n+b\n")
    assert [tuple(r) for r in I.diff_hunks(spark, str(tmp_path / "d.diff")).orderBy("h_start").collect()] == [("x.go", 3, 6), ("x.go", 12, 12)]
    sha = "a" * 40
    (tmp_path / "blame").write_text(f"{sha} 1 7 1\nauthor Amy\nauthor-mail <a>\nauthor-time 100\nfilename x\n\tcode\n")
    assert [(r.line, r.author) for r in I.blame_porcelain(spark, str(tmp_path / "blame")).collect()] == [(7, "Amy")]


def test_graph_round_trip_and_manifests(spark, tmp_path):
    n = spark.createDataFrame([("a", "type", "A'1"), ("b", "file", "B")], "id string, kind string, name string")
    e = spark.createDataFrame([("a", "b", "calls")], "from_id string, to_id string, kind string")
    I.write_graph(n, e, str(tmp_path / "g"))
    n2, e2 = I.read_graph(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in n2.select("id", "kind", "name").collect()} == {tuple(r) for r in n.collect()} and e2.count() == 1
    assert any("'A\\'1'" in r.line for r in I.cypher(n, e).collect())
    m = lambda *x: spark.createDataFrame(list(x), "file_path string, sha string")
    assert {tuple(r) for r in I.changed_files(m(("a", "1"), ("b", "1")), m(("b", "2"), ("c", "1"))).collect()} == {("a", "deleted"), ("b", "modified"), ("c", "created")}
    t1, t2 = I.merkle(m(("x/a", "1"), ("x/b", "2")), 2), I.merkle(m(("x/b", "2"), ("x/a", "1")), 2)
    assert {tuple(r) for r in t1.collect()} == {tuple(r) for r in t2.collect()}


def test_maintenance_stream(spark, tmp_path):
    events, out = tmp_path / "events", str(tmp_path / "table")
    events.mkdir()
    load = lambda paths: paths.select("file_path", F.upper("file_path").alias("v"))

    def push(name, rows):
        (events / name).write_text("\n".join(json.dumps({"path": p, "kind": k, "ts": f"2024-01-01T00:00:{s:02}Z"}) for p, k, s in rows))
        C.maintain(C.file_events(spark, str(events)), load, out, str(tmp_path / "state")).awaitTermination()
        return {tuple(r) for r in C.current(spark, out).collect()}

    assert push("1.json", [("a", "created", 1), ("b", "created", 2)]) == {("a", "A"), ("b", "B")}
    assert push("2.json", [("a", "modified", 3), ("a", "deleted", 4), ("c", "created", 5)]) == {("b", "B"), ("c", "C")}


def test_debounce_and_upserts(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    e = spark.createDataFrame([("a", "created", t(0)), ("a", "modified", t(1)), ("a", "deleted", t(30))], "path string, kind string, ts timestamp")
    assert {(r.kind, r.n) for r in C.debounce(e, "5 seconds").collect()} == {("modified", 2), ("deleted", 1)}
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    assert {tuple(r) for r in C.upsert_rows(rows, spark.createDataFrame([("2", "z"), ("3", "w")], "id string, v string"), ["id"]).collect()} == {("1", "x"), ("2", "z"), ("3", "w")}


def test_synthesis(spark):
    a = spark.createDataFrame([("e1", "c"), ("e2", "d")], "id string, channel string")
    b = spark.createDataFrame([("l1", "c"), ("l2", "c")], "id string, channel string")
    assert {(r.from_id, r.to_id) for r in K.by_key(a, b, "channel", "calls", "event").collect()} == {("e1", "l1"), ("e1", "l2")}
    o = spark.createDataFrame([("k", "f1", ["int"], ["int", "str"]), ("k", "f2", ["int", "str"], ["int", "str"])], "call string, id string, args array<string>, hint array<string>")
    assert K.overload_rank(o).first().id == "f2"
    r = K.Registry()
    r.add("x", lambda: 1)
    assert r.names() == ["x"]
