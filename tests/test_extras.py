"""Smaller operators on inputs with known answers."""

import itertools

import pytest
from pyspark.sql import functions as F

from quiltgraph.operators import extras as X


def test_packing_strategies(spark):
    r = spark.createDataFrame([("q", 0, 1, "a", 1.0, 5), ("q", 1, 2, "b", 9.0, 6), ("q", 2, 3, "a", 1.0, 3)], "list string, rank long, id long, file_path string, score double, tokens long")
    ids = lambda s: sorted(x.id for x in X.pack(r, 8, s).collect())
    assert ids("rank") == [1, 3] and ids("density") == [2] and ids("file") == [2]


def test_rank_drift(spark):
    rows = lambda xs: spark.createDataFrame([("q", x, i) for i, x in enumerate(xs)], "query string, id string, rank int")
    same = X.rank_drift(rows("abc"), rows("abc"), 3).first()
    assert (same.tau, same.changed, same.top1_differs) == (1.0, 0, False)
    other = X.rank_drift(rows("abcd"), rows("cbae"), 4).first()
    assert (other.tau, other.changed, other.top1_differs) == (-1.0, 2, True)


def test_diagnosis_and_kinds(spark):
    n = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    e = spark.createDataFrame([("a", "b", "calls"), ("c", "d", "calls"), ("d", "unresolved::z", "calls"), ("e", "f", "calls")], "from_id string, to_id string, kind string").withColumn("origin", F.lit("ast_resolved"))
    why = lambda a, b: X.why_unreachable(n, e, a, b)
    assert [why("a", "b"), why("b", "a"), why("z", "a"), why("a", "e"), why("c", "b"), why("a", "f")] == ["reachable", "source_has_no_out_edges", "source_missing", "target_has_no_in_edges", "unresolved_boundary", "disconnected"]
    assert X.edge_kinds("calls, reads") == ["calls", "reads"]
    with pytest.raises(ValueError):
        X.edge_kinds("calls,nope")


def test_processes(spark):
    n = spark.createDataFrame([(x,) for x in "mabz"], "id string")
    e = spark.createDataFrame([("m", "a", "calls"), ("m", "b", "calls"), ("a", "b", "calls")], "from_id string, to_id string, kind string")
    assert {tuple(r) for r in X.processes(n, e).collect()} == {("m", "m", 0), ("m", "a", 1), ("m", "b", 1)}


def test_spectral_cuts_between_cliques(spark):
    es = [(a, b) for g in ("abcdefghij", "ABCDEFGHIJ") for a, b in itertools.combinations(g, 2)] + [("a", "A")]
    m = spark.createDataFrame([(x, "A") for x in "abcdefghijABCDEFGHIJ"] + [("z", "z")], "id string, component string")
    d = {r.id: r.community for r in X.spectral(m, spark.createDataFrame(es, "src string, dst string"), 16).collect()}
    assert len(d) == 21 and len({d[x] for x in "abcdefghij"}) == 1 and len({d[x] for x in "ABCDEFGHIJ"}) == 1 and d["a"] != d["A"]


def test_stratified_pairs(spark):
    sig = list(range(64))
    rows = [(1, sig, 60), (2, [*sig[:-1], 99], 70), (3, [*sig[:-1], 98], 700), (4, [*sig[:-1], 97], None)]
    p = {tuple(r) for r in X.stratified_pairs(spark.createDataFrame(rows, "id long, sig array<long>, n_tokens int")).collect()}
    assert p == {(1, 2), (1, 4), (2, 4), (3, 4)}


def test_text_pieces(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(X.sql_columns(F.lit("SELECT DISTINCT u.Name, id AS x, count(*) FROM t"))) == ["name", "id", "count"]
    t = one(X.ddl_tables(F.lit("CREATE TABLE IF NOT EXISTS Users (id INT, price DECIMAL(10, 2), PRIMARY KEY (id)); create table b (x text)")))
    assert [(r.name, r.columns) for r in t] == [("users", ["id", "price"]), ("b", ["x"])]
    d = spark.createDataFrame([(1, "a b c d e")], "id long, text string")
    assert [r.part for r in X.chunks(d, 3, 1).orderBy("chunk").collect()] == ["a b c", "c d e"]
    assert {r.pair: r.n for r in X.rune_pairs(spark.createDataFrame([("aba",), ("x",)], "t string"), F.col("t")).collect()} == {"ab": 1, "ba": 1}


def test_manifests(spark):
    files = [("p/package.json", '{"dependencies": {"x": "^1"}}'), ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"), ("requirements.txt", "# c\nnumpy>=1.2\n"), ("Cargo.toml", '[dependencies]\nserde = {version = "1"}\n'), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>2</version></dependency>"), ("package.json", "broken")]
    got = {(r.module, r.version) for r in X.manifest(spark.createDataFrame(files, "file_path string, content string")).collect()}
    assert got == {("x", "^1"), ("github.com/a/b", "v1.2.3"), ("numpy", ">=1.2"), ("serde", "1"), ("g:a", "2")}
