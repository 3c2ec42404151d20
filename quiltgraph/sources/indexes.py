"""Import of compiler-made symbol indexes (SCIP, the public protobuf schema or the same fields as JSON) and the edges they prove."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import innermost_at

ROWS = "path string, document string, entry string, symbol string, line int, roles int, other string, text string"

# Field numbers of the public schema. Fixed values.
_INDEX = {2: "documents"}
_DOCUMENT = {1: "relative_path", 2: "occurrences", 3: "symbols"}
_OCCURRENCE = {1: "range", 2: "symbol", 3: "symbol_roles"}
_SYMBOL = {1: "symbol", 3: "documentation", 4: "relationships"}
_RELATIONSHIP = {1: "symbol", 3: "is_implementation"}
_NESTED = {"documents": _DOCUMENT, "occurrences": _OCCURRENCE, "symbols": _SYMBOL, "relationships": _RELATIONSHIP}
_REPEATED = {"documents", "occurrences", "symbols", "relationships", "documentation", "range"}


def _varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _message(data, fields: dict[int, str]) -> dict:
    """Named fields of one protobuf message; unknown fields are passed over."""
    out: dict = {n: [] for n in fields.values() if n in _REPEATED}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        name, wire = fields.get(tag >> 3), tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise IndexError("field beyond the end")
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
            continue
        else:
            raise ValueError(f"wire type {wire}")
        if name is None:
            continue
        if name in _NESTED:
            value = _message(value, _NESTED[name])
        elif name == "range" and wire == 2:
            packed, i, value = value, 0, []
            while i < len(packed):
                v, i = _varint(packed, i)
                value.append(v)
        elif wire == 2:
            value = bytes(value).decode("utf-8", "replace")
        if name == "range" and wire == 2:
            out[name] += value
        elif name in _REPEATED:
            out[name].append(value)
        else:
            out[name] = value
    return out


def _entries(path: str, data: bytes) -> Iterator[tuple]:
    try:
        index = json.loads(data)
    except ValueError:
        index = _message(memoryview(data), _INDEX)
    for d in index.get("documents") or ():
        at = (path, d.get("relative_path", ""))
        for o in d.get("occurrences") or ():
            yield *at, "occurrence", o.get("symbol", ""), (o.get("range") or [-1])[0] + 1, o.get("symbol_roles", 0), None, None
        for s in d.get("symbols") or ():
            yield *at, "symbol", s.get("symbol", ""), None, None, None, "\n\n".join(s.get("documentation") or ()) or None
            for r in s.get("relationships") or ():
                if r.get("is_implementation"):
                    yield *at, "implements", s.get("symbol", ""), None, None, r.get("symbol", ""), None


def symbol_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, entry, symbol, line, roles, other, text) of every index file under a path.

    entry is occurrence (line from 1, 0 for none; roles), symbol (text is its documentation) or implements (other is what the symbol
    implements). A file is one task's row, so an index of more than 2 GB must be made in parts; a broken file is an error that
    names it.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                rows = []
                try:
                    for e in _entries(p, bytes(data)):
                        rows.append(e)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names).astype({"line": "Int32", "roles": "Int32"})
                            rows = []
                except (IndexError, ValueError, AttributeError, TypeError) as e:
                    raise ValueError(f"{p} is no symbol index") from e
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"line": "Int32", "roles": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, ROWS)


def symbol_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, id): where definitions stand among nodes(id, kind, name, file_path, start_line): at their line, else by name in their file; the smallest id of several."""
    n = nodes.where("kind NOT IN ('file', 'import')").select("id", "name", "file_path", "start_line")
    last = F.element_at(F.split(F.trim("symbol"), r"\s+"), -1)
    name = F.regexp_extract(F.regexp_replace(last, r"[().#]+$", ""), r"([^/.#]*)$", 1)
    d = rows.where("entry = 'occurrence' AND roles & 1 = 1 AND symbol <> ''").select("symbol", F.col("document").alias("file_path"), F.col("line").alias("start_line"), name.alias("name")).distinct()
    at = n.groupBy("file_path", "start_line").agg(F.min("id").alias("by_line"))
    named = n.groupBy("file_path", "name").agg(F.min("id").alias("by_name"))
    j = d.join(at, ["file_path", "start_line"], "left").join(named, ["file_path", "name"], "left")
    return j.groupBy("symbol").agg(F.min(F.coalesce("by_line", "by_name")).alias("id")).where("id IS NOT NULL")


def index_edges(rows: DataFrame, nodes: DataFrame, edges: DataFrame, provider: str = "scip") -> DataFrame:
    """(from_id, to_id, kind, file_path, line, action, origin, confidence, provider) of what an index proves.

    A use inside a node, of a symbol that a node defines, confirms the edge between them (its first kind) where there is one, and
    else adds a call of a function or method, or a reference to anything else. An implements relation does the same for its
    own kind. Uses of one pair make one row, at the first line.
    """
    known = symbol_nodes(rows, nodes)
    inside = nodes.where("kind NOT IN ('file', 'import')")
    used = rows.where("entry = 'occurrence' AND roles & 1 = 0 AND symbol <> ''").select("symbol", F.col("document").alias("file_path"), "line")
    around = innermost_at(used.select("file_path", "line").distinct(), inside).withColumnRenamed("id", "from_id")
    pairs = used.join(around, ["file_path", "line"]).join(known.withColumnRenamed("id", "to_id"), "symbol").groupBy("from_id", "to_id").agg(F.min(F.struct("file_path", "line")).alias("at"))
    there = edges.groupBy("from_id", "to_id").agg(F.min("kind").alias("known_kind"))
    kind = F.when(F.col("kind").isin("function", "method"), "calls").otherwise("references")
    uses = pairs.join(nodes.select(F.col("id").alias("to_id"), "kind"), "to_id").join(there, ["from_id", "to_id"], "left")
    uses = uses.select("from_id", "to_id", F.coalesce("known_kind", kind).alias("kind"), "at.file_path", "at.line", F.col("known_kind").isNotNull().alias("known"))
    r = rows.where("entry = 'implements'").select("symbol", F.col("other")).distinct()
    ends = r.join(known.withColumnRenamed("id", "from_id"), "symbol").join(known.select(F.col("symbol").alias("other"), F.col("id").alias("to_id")), "other").select("from_id", "to_id").distinct()
    said = edges.where("kind = 'implements'").select("from_id", "to_id", F.lit(True).alias("said")).distinct()
    impl = ends.join(nodes.select(F.col("id").alias("from_id"), "file_path", F.col("start_line").alias("line")), "from_id").join(said, ["from_id", "to_id"], "left")
    impl = impl.select("from_id", "to_id", F.lit("implements").alias("kind"), "file_path", "line", F.coalesce("said", F.lit(False)).alias("known"))
    return uses.unionByName(impl).select("from_id", "to_id", "kind", "file_path", "line", F.when(F.col("known"), "confirmed").otherwise("added").alias("action"), F.lit("lsp_resolved").alias("origin"), F.lit(1.0).alias("confidence"), F.lit(provider).alias("provider"))
