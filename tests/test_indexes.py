"""Symbol indexes: both encodings, and the edges they prove."""

import json

import pytest

from quiltgraph.sources import indexes as I


def _int(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def _field(number, value):
    if isinstance(value, int):
        return _int(number << 3) + _int(value)
    value = value.encode() if isinstance(value, str) else value
    return _int(number << 3 | 2) + _int(len(value)) + value


def _wire(index):
    """The protobuf form of an index given as JSON fields, with fields no reader needs in between."""
    out = _field(1, _field(2, "tool"))
    for d in index["documents"]:
        doc = _field(4, "go") + _field(1, d["relative_path"])
        for o in d["occurrences"]:
            doc += _field(2, _field(1, b"".join(_int(v) for v in o["range"])) + _field(2, o["symbol"]) + (_field(3, o["symbol_roles"]) if o["symbol_roles"] else b""))
        for s in d["symbols"]:
            rel = b"".join(_field(4, _field(1, r["symbol"]) + _field(3, int(r["is_implementation"]))) for r in s["relationships"])
            doc += _field(3, _field(1, s["symbol"]) + b"".join(_field(3, t) for t in s["documentation"]) + rel)
        out += _field(2, doc)
    return out


INDEX = {
    "documents": [
        {
            "relative_path": "a.go",
            "occurrences": [
                {"range": [0, 5, 9], "symbol": "go m a/Caller().", "symbol_roles": 1},
                {"range": [1, 5, 9], "symbol": "go m b/Callee().", "symbol_roles": 0},
                {"range": [2, 5, 9], "symbol": "go m b/Callee().", "symbol_roles": 8},
                {"range": [2, 5, 9], "symbol": "go m b/Face#", "symbol_roles": 0},
                {"range": [300, 5, 9], "symbol": "go m b/Face#", "symbol_roles": 0},
                {"range": [1, 0, 1], "symbol": "go m c/Nowhere#", "symbol_roles": 0},
            ],
            "symbols": [],
        },
        {
            "relative_path": "b.go",
            "occurrences": [
                {"range": [9, 0, 3], "symbol": "go m b/Callee().", "symbol_roles": 1},
                {"range": [70, 0, 3], "symbol": "go m b/Face#", "symbol_roles": 1},
                {"range": [49, 0, 3], "symbol": "go m b/Impl#", "symbol_roles": 1},
            ],
            "symbols": [{"symbol": "go m b/Impl#", "documentation": ["type Impl struct", "größer"], "relationships": [{"symbol": "go m b/Face#", "is_implementation": True}, {"symbol": "go m b/Callee().", "is_implementation": False}]}],
        },
    ]
}


def test_index_in_both_encodings(spark, tmp_path):
    (tmp_path / "json").mkdir()
    (tmp_path / "wire").mkdir()
    (tmp_path / "json" / "x").write_text(json.dumps(INDEX))
    (tmp_path / "wire" / "x").write_bytes(_wire(INDEX))
    (tmp_path / "wire" / "empty").write_bytes(b"")
    a, b = ({tuple(r) for r in I.symbol_index(spark, str(tmp_path / k)).drop("path").collect()} for k in ("json", "wire"))
    assert a == b and len(a) == 11
    assert ("b.go", "symbol", "go m b/Impl#", None, None, None, "type Impl struct\n\ngrößer") in a
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x").write_bytes(_wire(INDEX)[:-3])
    with pytest.raises(Exception, match="is no symbol index"):
        I.symbol_index(spark, str(tmp_path / "bad")).count()


def test_index_edges(spark, tmp_path):
    (tmp_path / "x").write_bytes(_wire(INDEX))
    nodes = spark.createDataFrame(
        [("f", "file", "a.go", "a.go", 1, 900), ("caller", "function", "Caller", "a.go", 1, 20), ("callee", "function", "Callee", "b.go", 10, 20), ("face", "interface", "Face", "b.go", 30, 40), ("impl", "type", "Impl", "b.go", 50, 60)],
        "id string, kind string, name string, file_path string, start_line int, end_line int",
    )
    edges = spark.createDataFrame([("caller", "callee", "calls")], "from_id string, to_id string, kind string")
    out = I.index_edges(I.symbol_index(spark, str(tmp_path)), nodes, edges)
    got = {(r.from_id, r.to_id, r.kind, r.file_path, r.line, r.action) for r in out.collect()}
    # the interface's definition is found by name, its use outside of every node proves nothing
    assert got == {("caller", "callee", "calls", "a.go", 2, "confirmed"), ("caller", "face", "references", "a.go", 3, "added"), ("impl", "face", "implements", "b.go", 50, "added")}
    assert I.index_edges(I.symbol_index(spark, str(tmp_path)), nodes, edges.where("false")).where("action = 'confirmed'").count() == 0
