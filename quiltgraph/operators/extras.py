"""Smaller operators: packing strategies, rank drift, path diagnosis, processes, bisection, stratified clone bands, manifests and SQL text."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut
from . import traversal as T


def pack(ranked: DataFrame, budget: int, strategy: str = "rank") -> DataFrame:
    """Rows of each list that fit its budget, overflow skipped; ranked(list, rank, id, file_path, score, tokens).

    rank: in rank order. density: by score a token. file: files by summed score, then rank. A list is one response, so small.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if strategy == "density":
            f = f.assign(_k=-f["score"] / f["tokens"].clip(lower=1)).sort_values(["_k", "id"])
        elif strategy == "file":
            f = f.assign(_k=-f.groupby("file_path")["score"].transform("sum")).sort_values(["_k", "file_path", "rank", "id"])
        else:
            f = f.sort_values(["rank", "id"])
        left, keep = budget, []
        for t in f["tokens"]:
            keep.append(t <= left)
            left -= t if t <= left else 0
        return f[keep][[c for c in f.columns if c != "_k"]]

    return ranked.groupBy("list").applyInPandas(run, ranked.schema)


def rank_drift(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(query, tau, changed, top1_differs) of two rankings (query, id, rank): Kendall's tau over shared ids of the first k, and ids in one alone. Pairs are within k ids."""
    a, b = before.where(F.col("rank") < k), after.where(F.col("rank") < k)
    j = a.select("query", "id", F.col("rank").alias("r")).join(b.select("query", "id", F.col("rank").alias("s")), ["query", "id"], "full_outer")
    g = j.groupBy("query").agg(
        F.collect_list(F.when(F.col("r").isNotNull() & F.col("s").isNotNull(), F.struct("r", "s"))).alias("l"), F.count_if(F.col("r").isNull() | F.col("s").isNull()).alias("changed"),
        F.max(F.when(F.col("r") == 0, F.col("id"))).alias("x"), F.max(F.when(F.col("s") == 0, F.col("id"))).alias("y"),
    )
    sign = F.aggregate("l", F.lit(0), lambda t, p: t + F.aggregate("l", F.lit(0), lambda u, q: u + F.when((p["r"] < q["r"]) & (p["s"] < q["s"]), 1).when((p["r"] < q["r"]) & (p["s"] > q["s"]), -1).otherwise(0)))
    n = F.size("l")
    return g.select("query", F.when(n > 1, F.round(2.0 * sign / (n * (n - 1)), 6)).otherwise(1.0).alias("tau"), "changed", (~F.col("x").eqNullSafe(F.col("y"))).alias("top1_differs"))


EDGE_KINDS = {"calls", "references", "imports", "implements", "extends", "composes", "overrides", "member_of", "defines", "reads", "writes", "instantiates", "returns", "typed_as", "throws", "annotated", "tests", "spawns", "sends", "recvs", "emits", "listens_on", "queries", "value_flow", "arg_of", "returns_to", "depends_on", "provides", "consumes", "similar_to", "handles_route", "renders_child", "accesses_field"}


def edge_kinds(csv: str) -> list[str]:
    """Kinds of a comma-separated list; an unknown one is an error."""
    kinds = [k.strip() for k in csv.split(",") if k.strip()]
    if bad := sorted(set(kinds) - EDGE_KINDS):
        raise ValueError(f"unknown edge kinds: {', '.join(bad)}")
    return kinds


def why_unreachable(nodes: DataFrame, edges: DataFrame, source: str, target: str, depth: int = 24) -> str:
    """What stands between two symbols: reachable, or the first reason that holds."""
    spark = edges.sparkSession
    has = lambda df: bool(df.limit(1).count())
    for x, name in ((source, "source"), (target, "target")):
        if not has(nodes.where(F.col("id") == x)):
            return f"{name}_missing"
    if not has(edges.where(F.col("from_id") == source)):
        return "source_has_no_out_edges"
    if not has(edges.where(F.col("to_id") == target)):
        return "target_has_no_in_edges"
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    cone = T.bfs(edges, one(source), "out", None, depth)
    if has(cone.where(F.col("id") == target)):
        return "reachable"
    if has(T.bfs(edges, one(target), "out", None, depth).where(F.col("id") == source)):
        return "only_in_reverse"
    ends = edges.join(cone.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    if has(ends.where(F.contains("to_id", F.lit("unresolved::")))):
        return "unresolved_boundary"
    return "external_boundary" if has(ends.where(F.col("to_id").startswith("external::"))) else "disconnected"


def processes(nodes: DataFrame, edges: DataFrame, top: int = 50, depth: int = 15) -> DataFrame:
    """(entry, id, step): walks from the likeliest entry points, those that call much and are called by little."""
    calls = edges.where("kind = 'calls'")
    out = calls.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("o"))
    into = calls.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("i"))
    s = nodes.select("id").join(out, "id").join(into, "id", "left").withColumn("score", F.col("o") / (F.col("o") + F.coalesce("i", F.lit(0)) + 1.0))
    entry = s.where("score > 0.5").orderBy(F.desc("score"), F.desc("o"), "id").limit(top).select("id")
    pairs = cut(calls.select(F.col("from_id").alias("at"), F.col("to_id").alias("id")).where("at <> id").distinct())
    seen = cut(entry.select(F.col("id").alias("entry"), "id", F.lit(0).alias("step")))
    for d in range(1, depth + 1):
        front = seen.where(F.col("step") == d - 1).select("entry", F.col("id").alias("at"))
        new = cut(front.join(pairs, "at").select("entry", "id").distinct().join(seen.select("entry", "id"), ["entry", "id"], "left_anti").withColumn("step", F.lit(d)))
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
    return seen


def fiedler_split(names: list[str], pairs: list[tuple[str, str]], rounds: int = 150) -> list[bool]:
    """The side of each name, by the sign of the second eigenvector, from power iterations on a shifted Laplacian."""
    at = {n: i for i, n in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for s, d in pairs:
        if s != d:
            a[at[s], at[d]] = a[at[d], at[s]] = 1
    lap = np.diag(a.sum(1)) - a
    m = np.eye(len(names)) * (2 * a.sum(1).max() + 1e-9) - lap
    v = np.cos(np.arange(len(names)) + 1.0)
    for _ in range(rounds):
        v -= v.mean()
        v = m @ v
        v /= np.linalg.norm(v) or 1.0
    return (v - v.mean() >= 0).tolist()


def spectral(membership: DataFrame, pairs: DataFrame, largest: int = 16, max_component: int = 4000) -> DataFrame:
    """(id, community): components(id, component) cut in two again and again until none is over ``largest``; components over max_component stay whole."""
    e = pairs.join(membership.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst")
    small = membership.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(largest + 1, max_component))
    rows = membership.join(small, "component", "left_semi").select("component", "id", F.lit(None).cast("string").alias("dst")).unionByName(e.join(small, "component", "left_semi").select("component", F.col("src").alias("id"), "dst"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names = sorted(f[f["dst"].isna()]["id"])
        es = [(s, d) for s, d in zip(f["id"], f["dst"]) if isinstance(d, str)]
        done, todo = [], [names]
        while todo:
            part = todo.pop()
            keep = set(part)
            side = fiedler_split(part, [(s, d) for s, d in es if s in keep and d in keep]) if len(part) > largest else None
            if side is None or all(side) or not any(side):
                done.append(part)
            else:
                todo += [[n for n, x in zip(part, side) if x], [n for n, x in zip(part, side) if not x]]
        return pd.DataFrame([(n, min(p)) for p in done for n in p], columns=["id", "community"])

    cutup = rows.groupBy("component").applyInPandas(run, "id string, community string")
    return cutup.unionByName(membership.join(small, "component", "left_anti").select("id", F.col("component").alias("community")))


# Overlapping classes of token counts.
LENGTH_CLASSES = ((0, 80), (50, 160), (100, 320), (200, 640), (400, 1 << 30))


def length_classes(n: Column) -> Column:
    """Classes that a token count falls into; an unknown count is in all."""
    hits = [F.when(n.isNull() | ((n >= lo) & (n < hi)), F.lit(i)) for i, (lo, hi) in enumerate(LENGTH_CLASSES)]
    return F.array_compact(F.array(*hits))


def stratified_pairs(signatures: DataFrame, bands: int = 16, rows: int = 4) -> DataFrame:
    """(a, b) that share a band and a length class; signatures(id, sig, n_tokens). Equal signatures fold to one id first."""
    one = signatures.groupBy("sig").agg(F.min("id").alias("id"), F.min("n_tokens").alias("n"))
    keys = one.select("id", F.explode(length_classes(F.col("n"))).alias("class"), "sig").select("id", "class", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))).alias("band", "key"))
    return keys.withColumnRenamed("id", "a").join(keys.withColumnRenamed("id", "b"), ["class", "band", "key"]).where("a < b").select("a", "b").distinct()


def rune_pairs(texts: DataFrame, text: Column) -> DataFrame:
    """(pair, n): adjacent character pairs, counted over all texts."""
    p = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return texts.select(F.explode(p).alias("pair")).where(F.length("pair") == 2).groupBy("pair").agg(F.count("*").alias("n"))


def chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(id, chunk, part): pieces of size words that overlap; texts(id, text)."""
    ws = F.split("text", r"\s+")
    starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return texts.select("id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, size), " "))).alias("chunk", "part"))


def sql_columns(text: Column) -> Column:
    """Names in the select list of a statement, aliases and table prefixes left out."""
    body = F.regexp_extract(text, r"(?is)\bselect\s+(?:distinct\s+)?(.*?)\bfrom\b", 1)
    items = F.transform(F.split(body, ","), lambda x: F.regexp_extract(F.trim(x), r"(?i)^(?:[A-Za-z_][\w]*\.)?([A-Za-z_]\w*|\*)", 1))
    return F.array_distinct(F.filter(F.transform(items, F.lower), lambda x: x != ""))


def ddl_tables(text: Column) -> Column:
    """array<struct(name, columns)> of CREATE TABLE statements."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?\w+[\"`]?\s*\((?:[^()]|\([^()]*\))*\)"), F.lit(0))
    name = lambda s: F.lower(F.regexp_extract(s, r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?(\w+)", 1))
    body = lambda s: F.regexp_replace(F.regexp_extract(s, r"(?s)\((.*)\)", 1), r"\([^()]*\)", "")
    cols = lambda s: F.filter(F.transform(F.split(body(s), ","), lambda c: F.lower(F.regexp_extract(F.trim(c), r"^[\"`]?(\w+)", 1))), lambda c: ~c.isin("primary", "foreign", "unique", "constraint", "check", "") & c.isNotNull())
    return F.transform(found, lambda s: F.struct(name(s).alias("name"), cols(s).alias("columns")))


def manifest(files: DataFrame) -> DataFrame:
    """(file_path, module, version): dependencies in package.json, go.mod, requirements, pyproject, Cargo and pom files; files(file_path, content)."""

    def read(path: str, text: str) -> list[tuple[str, str]]:
        name = path.rsplit("/", 1)[-1].lower()
        if name == "package.json":
            try:
                d = json.loads(text)
            except ValueError:
                return []
            return [(k, str(v)) for part in ("dependencies", "devDependencies", "peerDependencies") for k, v in (d.get(part) or {}).items()]
        if name == "go.mod":
            return re.findall(r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", text)
        if name.startswith("requirements"):
            return [(m[1], m[2] or "") for m in re.finditer(r"(?m)^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*((?:[=<>~!]=?[^#;\n]*)?)", text) if m[1]]
        if name in ("cargo.toml", "pyproject.toml"):
            import tomllib

            try:
                d = tomllib.loads(text)
            except ValueError:
                return []
            rows = [(k, v if isinstance(v, str) else str((v or {}).get("version", ""))) for part in ("dependencies", "dev-dependencies") for k, v in (d.get(part) or {}).items()]
            return rows + [tuple(re.match(r"([A-Za-z0-9._-]+)\s*(.*)", x).groups()) for x in (d.get("project") or {}).get("dependencies", [])]
        if name == "pom.xml":
            return [(f"{g}:{a}", v or "") for g, a, v in re.findall(r"(?s)<dependency>.*?<groupId>(.*?)</groupId>.*?<artifactId>(.*?)</artifactId>(?:.*?<version>(.*?)</version>)?.*?</dependency>", text)]
        return []

    def run(frames):
        for f in frames:
            rows = [(p, m, v.strip()) for p, t in zip(f["file_path"], f["content"]) for m, v in read(p, t or "")]
            yield pd.DataFrame(rows, columns=["file_path", "module", "version"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, module string, version string")


def latest_version(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))).where("_n = 1").drop("_n")
