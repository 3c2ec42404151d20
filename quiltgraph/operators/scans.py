"""Scans, lookups, predicates and projections over nodes and edges.

Small key lists are literals (pushed to the scan); key tables are semi joins, which
Spark broadcasts by their measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def by_id(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ids(id); repeats and empty ids there change nothing."""
    return nodes.join(ids.where("id <> ''").select("id"), "id", "left_semi")


def by_qual_names(nodes: DataFrame, names: list[str]) -> DataFrame:
    return nodes.where(F.col("qual_name").isin([n for n in names if n]))


def by_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) with the ids of all nodes of that name, sorted."""
    return nodes.join(names.select("name").distinct(), "name").groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def by_name(nodes: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    out = nodes.where(F.col("name") == name)
    return out if repo is None else out.where(F.col("repo_prefix") == repo)


def name_contains(nodes: DataFrame, part: str, limit: int = 0) -> DataFrame:
    """Case-insensitive; the first rows by id if there is a limit."""
    out = nodes.where(F.contains(F.lower("name"), F.lit(part.lower())))
    return out.orderBy("id").limit(limit) if limit > 0 else out


def of_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path)


def of_repo(nodes: DataFrame, repo: str) -> DataFrame:
    return nodes.where(F.col("repo_prefix") == repo)


def edges_of_repo(nodes: DataFrame, edges: DataFrame, repo: str) -> DataFrame:
    """Edges whose source node is in the repository."""
    return edges.join(of_repo(nodes, repo).select(F.col("id").alias("from_id")), "from_id", "left_semi")


def of_kinds(rows: DataFrame, kinds: list[str]) -> DataFrame:
    return rows.where(F.col("kind").isin(sorted(set(kinds)))) if kinds else rows.limit(0)


def ids_of_kinds(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    return of_kinds(nodes, kinds).select("id")


def in_files(nodes: DataFrame, paths: DataFrame, kinds: list[str]) -> DataFrame:
    return of_kinds(nodes, kinds).join(paths.select("file_path"), "file_path", "left_semi")


def file_symbol_names(nodes: DataFrame, paths: DataFrame, kinds: list[str]) -> DataFrame:
    return in_files(nodes, paths, kinds).select("file_path", "name").distinct()


def unresolved_targets(edges: DataFrame) -> DataFrame:
    return edges.where(S.is_unresolved(F.col("to_id")))


def external_call_candidates(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin("calls", "references") & (S.stub_kind(F.col("to_id")).isin("external", "stdlib", "module")))


def adjacency(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """Edges at any of ids(id)."""
    end = "from_id" if direction == "out" else "to_id"
    return edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")


def path_prefix(nodes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Any prefix, whole segments only."""
    keep = F.lit(False)
    for p in prefixes:
        p = p.rstrip("/")
        keep = keep | (F.col("file_path") == p) | F.col("file_path").startswith(p + "/")
    return nodes.where(keep)


def in_scope(nodes: DataFrame, workspace: str | None = None, project: str | None = None, repos: list[str] | None = None) -> DataFrame:
    """Workspace is a hard boundary, project a soft one; an empty field stands for the repository."""
    out = nodes
    if workspace:
        out = out.where(F.coalesce(F.nullif(F.col("workspace_id"), F.lit("")), F.col("repo_prefix")) == workspace)
    if project:
        out = out.where(F.coalesce(F.nullif(F.col("project_id"), F.lit("")), F.col("repo_prefix")) == project)
    return out.where(F.col("repo_prefix").isin(repos)) if repos else out


def min_tier(edges: DataFrame, origin: str) -> DataFrame:
    rank = S.origin_rank(S.default_origin(F.col("origin"), F.col("kind"), F.col("confidence")))
    return edges.where(rank >= S.ORIGIN_RANK.get(origin, 0))


def without_speculative(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("origin") != "speculative")


def subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are among nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def project(rows: DataFrame, fields: str) -> DataFrame:
    """Listed columns that exist, in their own order."""
    want = {x.strip() for x in fields.split(",")}
    return rows.select(*[c for c in rows.columns if c in want])


def matching(nodes: DataFrame, kind: str | None = None, name_regex: str | None = None, path: str | None = None, lang: str | None = None) -> DataFrame:
    out = nodes
    if kind:
        out = out.where(F.col("kind").isin([k.strip() for k in kind.split(",")]))
    if name_regex:
        out = out.where(F.col("name").rlike(name_regex))
    if path:
        out = out.where(F.col("file_path").startswith(path))
    return out.where(F.lower("language") == lang.lower()) if lang else out
