"""Snapshots, notes, overlays and reviews on small tables."""

from pyspark.sql import functions as F

from quiltgraph.operators import sessions as P

LAYERS = "branch string, seq int, file_path string, content string, deleted boolean"


def test_overlays(spark):
    rows = [("main", 1, "a", "a1", False), ("main", 2, "a", "a2", False), ("main", 1, "b", "b1", False), ("dev", 1, "b", "bd", False), ("dev", 2, "c", "cd", False), ("fix", 1, "c", None, True), ("other", 9, "z", "z", False)]
    layers = spark.createDataFrame(rows, LAYERS)
    parents = {"main": None, "dev": "main", "fix": "dev", "other": "main"}
    view = lambda x, b: {r.file_path: r.content for r in P.overlay_view(x, parents, b).collect()}
    assert view(layers, "main") == {"a": "a2", "b": "b1"} and view(layers, "dev") == {"a": "a2", "b": "bd", "c": "cd"}
    assert view(layers, "fix") == {"a": "a2", "b": "bd"}  # c is deleted there
    merged = P.overlay_merge(layers, "fix", "dev")
    assert view(merged, "dev") == {"a": "a2", "b": "bd"} and view(merged, "main") == view(layers, "main")
    assert [r.file_path for r in P.overlay_conflicts(layers, "dev", "fix").collect()] == ["c"]
    assert P.overlay_view(layers.limit(0), parents, "fix").count() == 0
    assert view(layers, "nowhere") == {}


def test_notes_and_snapshots(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "old plan", ["x"], False), (1, 2, "new PLAN b", ["x"], False), (2, 1, "plan", ["y"], False), (2, 5, "plan", ["y"], True), (3, 1, None, None, False)], "id int, ts int, text string, tags array<string>, deleted boolean")
    assert [(r.id, r.hits) for r in P.find_notes(log, ["plan", "b"]).collect()] == [(1, 2)]
    assert P.find_notes(log, ["plan"], "y").count() == 0 and P.current(log).count() == 2
    n, e = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b")], "from_id string, to_id string")
    root = f"file://{tmp_path}"
    P.save_snapshot(n, e, root, "r", "main", "c1")
    P.save_snapshot(n.limit(1), e, root, "r", "main", "c2")
    P.save_snapshot(n, e, root, "r", "main", "c2")
    assert sorted(map(tuple, P.list_snapshots(spark, root).collect())) == [("r", "main", "c1", 2), ("r", "main", "c2", 2)]
    assert P.load_snapshot(spark, root, "r", "main", "c1")[1].count() == 1


def test_reviews(spark):
    found = spark.createDataFrame([("p", 1, "r1", "high"), ("p", 2, "r2", "low"), ("q", 1, "r2", "low"), ("q", 2, "r3", "medium"), ("q", 3, "r3", "medium")], "path string, line_no int, rule string, severity string")
    off = spark.createDataFrame([("p", "r1"), (None, "r9")], "path string, rule string")
    left = P.unsuppressed(found, off)
    assert left.count() == 4 and P.unsuppressed(found, spark.createDataFrame([(None, "r2")], "path string, rule string")).count() == 3
    changes = spark.createDataFrame([("c1", "p"), ("c2", "q"), ("c2", "q"), ("c3", "none")], "change string, path string")
    got = {r.change: (r.high, r.medium, r.low, r.verdict) for r in P.verdicts(changes, left).collect()}
    assert got == {"c1": (0, 0, 1, "approve"), "c2": (0, 2, 1, "comment"), "c3": (0, 0, 0, "approve")}
    assert {r.verdict for r in P.verdicts(changes, found).where("change = 'c1'").collect()} == {"block"}
    assert P.top_per(found, "rule", 1).count() == 3


def test_releases_and_triage(spark):
    files = spark.createDataFrame([("a", 1), ("a", 9), ("b", 5), ("c", 99)], "file string, ts int")
    tags = spark.createDataFrame([("v1", 2), ("v2", 5)], "tag string, ts int")
    assert {(r.tag, r.files, r["first"]) for r in P.releases(files, tags).collect()} == {("v1", 1, "a"), ("v2", 1, "b"), ("unreleased", 1, "c")}
    c = spark.createDataFrame([("x", "s1"), ("x", "s1"), ("x", "s2"), ("y", "s3")], "change string, symbol string")
    fan = spark.createDataFrame([("s1", 40), ("s2", 2)], "symbol string, fan_in int")
    got = {r.change: (r.symbols, r.reach) for r in P.triage(c, fan).collect()}
    assert got == {"x": (2, 42), "y": (1, 0)}
    q = {(r.change, r.question, r.n) for r in P.questions(c, fan, spark.createDataFrame([("s1",)], "symbol string"), 30).collect()}
    assert q == {("x", "hub", 1), ("x", "untested", 1), ("y", "untested", 1)}
    assert P.triage(c, fan).select(F.max("score")).first()[0] > 0
