"""The pipeline language: ``nodes kind=... | traverse out kind=... depth=2 | filter name~...``.

A query compiles to chained DataFrame operators; at most five stages; every stage keeps
all its nodes, or the first ``limit`` by id where a caller asks for that. Also the field clauses of free-text queries.
"""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scans, traversal

MAX_STAGES = 5


@dataclass
class Stage:
    verb: str
    args: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)


def parse(query: str) -> list[Stage]:
    stages = []
    for part in query.split("|"):
        words = shlex.split(part)
        if not words:
            raise ValueError("empty stage")
        s = Stage(words[0])
        if s.verb not in ("nodes", "traverse", "filter"):
            raise ValueError(f"unknown verb {s.verb!r}")
        for w in words[1:]:
            m = re.match(r"(\w+)([=~])(.*)$", w)
            if m:
                s.options[m[1] + ("~" if m[2] == "~" else "")] = m[3]
            else:
                s.args.append(w)
        stages.append(s)
    if len(stages) > MAX_STAGES:
        raise ValueError(f"more than {MAX_STAGES} stages")
    if stages[0].verb != "nodes":
        raise ValueError("a query starts with nodes")
    return stages


def run(query: str, nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes that are left after the last stage."""
    now = nodes
    for s in parse(query):
        if s.verb in ("nodes", "filter"):
            now = scans.matching(now, s.options.get("kind"), s.options.get("name~"), s.options.get("path"), s.options.get("lang"))
        else:
            kinds = s.options["kind"].split(",") if "kind" in s.options else None
            got = traversal.bfs(edges, now.select("id"), s.args[0] if s.args else "out", kinds, int(s.options.get("depth", 1)))
            now = nodes.join(got.select("id"), "id", "left_semi")
        if limit is not None:
            now = now.orderBy("id").limit(limit)
    return now


def field_query(text: str) -> tuple[dict[str, str], str]:
    """(clauses, rest): kind: lang: path: repo: project: are lifted out, the last of a kind wins; other words stay."""
    clauses, rest = {}, []
    for w in text.split():
        m = re.match(r"(kind|lang|path|repo|project):(.+)$", w)
        if m:
            clauses[m[1]] = m[2]
        else:
            rest.append(w)
    return clauses, " ".join(rest)


def apply_fields(nodes: DataFrame, clauses: dict[str, str]) -> DataFrame:
    out = nodes
    if "kind" in clauses:
        out = out.where(F.col("kind").isin(clauses["kind"].split(",")))
    if "lang" in clauses:
        out = out.where(F.lower("language") == clauses["lang"].lower())
    if "path" in clauses:
        out = out.where(F.contains("file_path", F.lit(clauses["path"])))
    if "repo" in clauses:
        out = out.where(F.col("repo_prefix") == clauses["repo"])
    return out.where(F.col("project_id") == clauses["project"]) if "project" in clauses else out
