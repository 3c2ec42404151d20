"""Registered scalar functions, sources, packing and index queries, each beside its DuckDB SQL where there is one.

Sources are registered over files that the query first writes from the tables, so a reader is held against the rows its file was made of.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import extras as E
from ..operators import joins as J
from ..operators import search as X
from ..sources import formats as I
from .adapter import Graph
from .relational import graph, table
from .tables import shared_folder

# Scalars over whole tables
_TIER = "CASE WHEN starts_with(origin, 'lsp_') THEN 'lsp' WHEN starts_with(origin, 'ast_') THEN 'ast' ELSE 'heuristic' END"
graph("h10_tier_label", lambda g: g.edges.groupBy("kind", S.tier_label(F.col("origin")).alias("tier")).agg(F.count("*").alias("n")), f"SELECT kind, {_TIER} AS tier, count(*) AS n FROM edges GROUP BY 1, 2")
graph("h14_confidence_label", lambda g: g.edges.groupBy("kind", S.confidence_label(F.round(F.col("confidence"), 6)).alias("label")).agg(F.count("*").alias("n")), "SELECT kind, CASE WHEN round(confidence, 6) >= 0.9 THEN 'EXTRACTED' WHEN round(confidence, 6) > 0 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS label, count(*) AS n FROM edges GROUP BY 1, 2")
graph("h15_reference_context", lambda g: J.endpoints(g.nodes, g.typed.select("from_id", "to_id", "kind"), ["kind"]).groupBy("kind", S.reference_context(F.col("kind"), F.col("from_kind")).alias("context")).agg(F.count("*").alias("n")), "SELECT t.kind, CASE WHEN t.kind = 'calls' THEN 'call' WHEN t.kind = 'annotated' THEN 'attribute' WHEN t.kind = 'returns' THEN 'return_type' WHEN t.kind IN ('reads', 'writes') THEN 'value' ELSE 'type' END AS context, count(*) AS n FROM typed t JOIN nodes a ON from_id = a.id JOIN nodes b ON to_id = b.id GROUP BY 1, 2", typed=True)
graph("h16_edge_identity", lambda g: g.edges.select("from_id", "to_id", "kind", "line", S.edge_identity(F.col("from_id"), F.col("to_id"), F.col("kind"), F.col("line")).alias("identity")), "SELECT from_id, to_id, kind, line, md5(from_id || chr(1) || to_id || chr(1) || kind || chr(1) || line) AS identity FROM edges")
_LINE = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '// SPDX-License-Identifier: MIT' WHEN 1 THEN '# SPDX-License-Identifier:  Apache-2.0' WHEN 2 THEN '// ' || p_name ELSE '* SPDX-License-Identifier: GPL-3.0-or-later ' || p_brand END AS line, 'const ' || p_type || ' & ' || p_brand AS cpp, 'SELECT t.' || lower(p_type) || ', ' || split_part(p_name, ' ', 1) || ' FROM x' AS sql, 'CREATE TABLE ' || lower(p_type) || ' (id INT, ' || split_part(p_name, ' ', 2) || ' TEXT, PRIMARY KEY (id))' AS ddl FROM part"


def _lines(spark: SparkSession, t) -> DataFrame:
    return spark.sql(_LINE.replace("FROM part", "FROM {part}"), part=t("part"))


table("h23_spdx", lambda spark, t: _lines(spark, t).select("id", S.spdx(F.col("line")).alias("spdx")), f"SELECT id, regexp_extract(line, 'SPDX-License-Identifier:\\s*([A-Za-z0-9.+-]+)', 1) AS spdx FROM ({_LINE})")
table("h28_cpp_type", lambda spark, t: _lines(spark, t).select("id", S.cpp_type(F.col("cpp")).alias("type")), "SELECT p_partkey AS id, p_type || ' ' || p_brand AS type FROM part")
table("h3_h4_sql_columns", lambda spark, t: _lines(spark, t).select("id", F.array_join(E.sql_columns(F.col("sql")), ",").alias("columns")), "SELECT p_partkey AS id, lower(p_type) || CASE WHEN lower(p_type) = split_part(p_name, ' ', 1) THEN '' ELSE ',' || split_part(p_name, ' ', 1) END AS columns FROM part")
table("h5_ddl_tables", lambda spark, t: _lines(spark, t).select("id", F.explode(E.ddl_tables(F.col("ddl"))).alias("t")).select("id", "t.name", F.array_join("t.columns", ",").alias("columns")), "SELECT p_partkey AS id, lower(p_type) AS name, 'id,' || split_part(p_name, ' ', 2) AS columns FROM part")
table("g5_rune_pairs", lambda spark, t: E.rune_pairs(t("part"), F.col("p_name")), "SELECT pair, count(*) AS n FROM (SELECT substr(p_name, i, 2) AS pair FROM (SELECT p_name, unnest(range(1, length(p_name))) AS i FROM part)) WHERE length(pair) = 2 GROUP BY 1")
table("g42_chunks", lambda spark, t: E.chunks(t("conversations").where("text IS NOT NULL").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text"), 40, 10).select("id", "chunk", F.length("part").cast("long").alias("chars")), "WITH w AS (SELECT conv_id || ':' || turn AS id, regexp_split_to_array(text, '\\s+') AS ws FROM conversations WHERE text IS NOT NULL), c AS (SELECT id, ws, unnest(range(0, greatest(len(ws) - 10 - 1, 0) + 1, 30)) AS s FROM w) SELECT id, (s // 30)::INT AS chunk, length(array_to_string(ws[s + 1:s + 40], ' '))::BIGINT AS chars FROM c")


def _drift(spark: SparkSession, t) -> DataFrame:
    o = t("orders")
    by = lambda c: o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(c), "o_orderkey")) - 1).alias("rank"))
    return E.rank_drift(by("o_totalprice"), by("o_orderdate"), 10)


table("c29_rank_drift", _drift, None)
graph("e30_processes", lambda g: E.processes(g.nodes, g.edges_of("calls")).groupBy("entry", "step").agg(F.count("*").alias("n")), None)
graph("e23_why_unreachable", lambda g: g.spark.createDataFrame([(a, b, E.why_unreachable(g.nodes, g.edges_of("calls"), a, b)) for a, b in (("fn::c10", "fn::p3"), ("fn::p3", "fn::c10"), ("none", "fn::p3"), ("type::1", "fn::p3"))], "source string, target string, reason string"), None)


def _packs(spark: SparkSession, t) -> DataFrame:
    """Three packing strategies over one list a source."""
    d = t("documents").select(F.coalesce("source", F.lit("")).alias("list"), F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("file_path"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    rows = d.select("list", (F.row_number().over(Window.partitionBy("list").orderBy("id")) - 1).alias("rank"), "id", "file_path", (1000.0 / (1 + F.col("n"))).alias("score"), F.ceil(F.col("n") / 4.0).cast("long").alias("tokens"))
    out = None
    for s in ("rank", "density", "file"):
        part = E.pack(rows, 20_000, s).select("list", "id", F.lit(s).alias("strategy"))
        out = part if out is None else out.unionByName(part)
    return out


table("d7_d8_packs", _packs, None)


# Sources: files made of the tables, read back
def _written(spark: SparkSession, lines: DataFrame, sep: str = "\n") -> str:
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    lines.write.option("lineSep", sep).text(path)
    return path


_PROFILE = "SELECT lower(p_type) || '/' || lower(p_brand) || '.go' AS file_path, CAST(p_partkey AS INT) AS start, CAST(p_partkey + p_size AS INT) AS \"end\", CAST(1 + p_size % 5 AS INT) AS statements, CAST(p_partkey % 3 AS INT) AS count FROM part"


def _profile(spark: SparkSession, t) -> DataFrame:
    p = t("part").select(F.format_string("%s/%s.go:%d.2,%d.9 %d %d", F.lower("p_type"), F.lower("p_brand"), "p_partkey", F.col("p_partkey") + F.col("p_size"), 1 + F.col("p_size") % 5, F.col("p_partkey") % 3).alias("value"))
    return I.coverage_profile(spark, _written(spark, p.unionByName(spark.range(1).select(F.lit("mode: set").alias("value")))))


table("i13_coverage_profile", _profile, _PROFILE)


def _log(spark: SparkSession, t) -> DataFrame:
    files = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda p: F.concat(F.lit("lib/"), p.cast("string"), F.lit(".go"))), "\n").alias("fs"))
    rec = files.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("k"), "l_orderkey", F.lit("|dev"), "o_custkey", F.lit("|"), F.unix_timestamp("o_orderdate"), F.lit("\n"), "fs").alias("value"))
    return I.git_log(spark, _written(spark, rec, "\0"))


table("i15_git_log", _log, "SELECT DISTINCT 'k' || l_orderkey AS commit, 'dev' || o_custkey AS author, to_timestamp(epoch(date_trunc('second', o_orderdate)))::TIMESTAMP AS ts, 'lib/' || l_partkey || '.go' AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
table("i18_jsonl_events", lambda spark, t: I.jsonl_events(spark, _written(spark, t("events").select(F.to_json(F.struct("event_id", "event_type", "user_id")).alias("value"))), "event_id long, event_type string, user_id long"), "SELECT event_id, event_type, user_id FROM events")


def _manifests(t) -> tuple[DataFrame, DataFrame]:
    of = lambda keep, salt: t("pages").where(keep).select(F.concat(F.lit("p"), "page_id").alias("file_path"), F.md5(F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 5 == salt, "x").otherwise("")).cast("binary")).alias("sha"))
    return of("page_id % 7 <> 1", 9), of("page_id % 7 <> 2", 0)


table("i3_changed_files", lambda spark, t: I.changed_files(*_manifests(t)), "SELECT 'p' || page_id AS file_path, CASE WHEN page_id % 7 = 1 THEN 'created' WHEN page_id % 7 = 2 THEN 'deleted' ELSE 'modified' END AS change FROM pages WHERE page_id % 7 IN (1, 2) OR page_id % 5 = 0")

# Resolution
_REFS = "kind = 'function'"


def _refs(g: Graph, where: str) -> DataFrame:
    return g.nodes.where(where).select(F.col("id").alias("ref_id"), "name", "file_path", "repo_prefix")


def resolve_sql(refs: str, tail: str = "") -> str:
    folder = "regexp_replace({c}, '/?[^/]*$', '')"
    return f"SELECT ref_id, def_id, rank, candidates FROM (SELECT r.id AS ref_id, d.id AS def_id, CASE WHEN d.file_path = r.file_path THEN 0 WHEN {folder.format(c='d.file_path')} = {folder.format(c='r.file_path')} THEN 1 WHEN d.repo_prefix = r.repo_prefix THEN 2 ELSE 3 END AS rank, count(*) OVER (PARTITION BY r.id) AS candidates, row_number() OVER (PARTITION BY r.id ORDER BY rank, d.id) AS k FROM nodes r JOIN nodes d ON r.name = d.name WHERE d.kind = 'method' AND {refs}) WHERE k = 1{tail}"


graph("b23_incremental_resolution", lambda g: J.resolve_files(_refs(g, _REFS), g.nodes.where("kind = 'method'"), g.spark.createDataFrame([("lib/economy/brand2.go",)], "file_path string")), resolve_sql("r.kind = 'function' AND r.file_path = 'lib/economy/brand2.go'"))
_TYPES = "SELECT 't' || l_suppkey || ':' || l_partkey AS ref_id, p_name AS name, lower(r_name) || '/x.go' AS file_path, r_name AS repo_prefix FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_EVIDENCE = "SELECT DISTINCT lower(r_name) || '/x.go' AS file_path, 'LIB' AS repo_prefix FROM region WHERE r_regionkey % 2 = 0"
graph("b26_cross_repo_resolution", lambda g: J.resolve_across(g._sql(_TYPES), g.nodes.where("kind = 'method'"), g._sql(_EVIDENCE)), f", r AS MATERIALIZED ({_TYPES}), e AS ({_EVIDENCE}), c AS (SELECT ref_id, d.id AS def_id, CASE WHEN d.repo_prefix = r.repo_prefix THEN 0 ELSE 1 END AS rank FROM r JOIN nodes d ON r.name = d.name WHERE d.kind = 'method' AND (d.repo_prefix = r.repo_prefix OR (r.file_path, d.repo_prefix) IN (SELECT file_path, repo_prefix FROM e))) SELECT ref_id, def_id, rank, candidates FROM (SELECT *, count(*) OVER (PARTITION BY ref_id, rank) AS candidates, row_number() OVER (PARTITION BY ref_id ORDER BY rank, def_id) AS k FROM c) WHERE k = 1")


# Index forms of search
def _trigram(spark: SparkSession, t) -> DataFrame:
    index = X.trigram_index(t("documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"))
    return X.trigram_lookup(index, "License")


table("g10_trigram_index", _trigram, "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'lic') AND contains(lower(text), 'ice') AND contains(lower(text), 'cen') AND contains(lower(text), 'ens') AND contains(lower(text), 'nse')")


def _bundle(g: Graph) -> DataFrame:
    return X.search_bundle(g.nodes, g.edges, "wid", 20)


graph("g8_search_bundle", _bundle, ", h AS (SELECT id, name, row_number() OVER (ORDER BY len(list_filter(string_split(lower(name), ' '), lambda x: starts_with(x, 'wid')))::DOUBLE / len(string_split(lower(name), ' ')) DESC, id) AS rank FROM nodes WHERE len(list_filter(string_split(lower(name), ' '), lambda x: starts_with(x, 'wid'))) > 0 QUALIFY rank <= 20) SELECT h.id, h.name, h.rank, (SELECT count(*) FROM edges WHERE from_id = h.id) AS n_out, (SELECT count(*) FROM edges WHERE to_id = h.id) AS n_in FROM h")
