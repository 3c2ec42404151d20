"""Registered analyses, each beside its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import analyze as L
from ..operators import joins as J
from .adapter import Graph
from .relational import _COVERED, _FANS, _LJ, _LINES, _SEGMENTS, graph, table

graph("analyze_indirect_mutations", lambda g: L.indirect_mutations(g.typed), "SELECT to_id AS field, count(*) AS n, min(from_id) AS via FROM typed WHERE kind = 'accesses_field' AND flag = 'true' GROUP BY 1", typed=True)
graph("analyze_speculative", lambda g: L.speculative(g.typed), "SELECT kind, label, count(*) AS n, count(DISTINCT to_id) AS targets FROM typed WHERE origin = 'text_matched' GROUP BY 1, 2", typed=True)
graph("analyze_race_writes", lambda g: L.race_writes(g.typed), "SELECT from_id AS writer, to_id AS field, count(*) AS n FROM typed WHERE kind = 'writes' AND from_id IN (SELECT from_id FROM typed WHERE kind = 'spawns') AND (from_id, to_id) NOT IN (SELECT from_id, to_id FROM typed WHERE kind = 'accesses_field' AND flag = 'true') GROUP BY 1, 2", typed=True)
graph("analyze_unclosed_channels", lambda g: L.unclosed_channels(g.typed), "SELECT channel, sends, recvs, CASE WHEN recvs = 0 THEN 'high' WHEN recvs < sends THEN 'medium' ELSE 'low' END AS risk FROM (SELECT to_id AS channel, count(*) FILTER (kind = 'sends') AS sends, count(*) FILTER (kind = 'recvs') AS recvs, max(CASE WHEN kind = 'recvs' THEN flag END) AS closed FROM typed WHERE kind IN ('sends', 'recvs') GROUP BY 1) WHERE sends > 0 AND coalesce(closed, 'false') <> 'true'", typed=True)
graph("analyze_orphan_tables", lambda g: L.orphan_tables(g.typed), "SELECT to_id AS id, count(*) AS n FROM typed WHERE kind = 'queries' AND to_id NOT IN (SELECT to_id FROM typed WHERE kind = 'provides') GROUP BY 1", typed=True)
graph("analyze_unreferenced_tables", lambda g: L.unreferenced_tables(g.typed), "SELECT to_id AS id, count(*) AS n FROM typed WHERE kind = 'provides' AND to_id NOT IN (SELECT to_id FROM typed WHERE kind = 'queries') GROUP BY 1", typed=True)
graph("analyze_stale_flags", lambda g: L.stale_flags(g.typed, dt.datetime(1999, 1, 1)), "SELECT to_id AS flag, max(ts) AS last_ts, count(*) AS n FROM typed WHERE kind = 'toggles_flag' GROUP BY 1 HAVING max(ts) < TIMESTAMP '1999-01-01'", typed=True)
graph("analyze_edge_audit", lambda g: L.edge_audit(g.edges), "SELECT origin, count(*) AS n, count(*) FILTER (kind = 'calls') AS calls FROM edges GROUP BY 1")
graph("analyze_untested_targets", lambda g: L.untested_targets(g.typed), "SELECT DISTINCT to_id FROM typed WHERE kind = 'tests' AND to_id NOT IN (SELECT to_id FROM typed WHERE kind <> 'tests')", typed=True)
graph("analyze_resolution_outcomes", lambda g: L.resolution_outcomes(g.typed), "SELECT kind, CASE WHEN origin = 'text_matched' THEN 'ambiguous_name' WHEN confidence < 0.95 THEN 'low_confidence' ELSE 'resolved' END AS reason, count(*) AS n FROM typed GROUP BY 1, 2", typed=True)
graph("analyze_cross_repo", lambda g: L.cross_repo(g.typed, g.nodes), "SELECT a.repo_prefix AS from_repo, b.repo_prefix AS to_repo, replace(t.kind, 'cross_repo_', '') AS kind, count(*) AS n, min(from_id) AS first FROM typed t JOIN nodes a ON from_id = a.id JOIN nodes b ON to_id = b.id WHERE starts_with(t.kind, 'cross_repo_') GROUP BY 1, 2, 3", typed=True)
graph("analyze_blame", lambda g: J.blame(g._sql(_LINES), g.nodes).select("id", "last_ts", "authors"), f"SELECT id, max(ts) AS last_ts, count(DISTINCT author) AS authors FROM {_LJ} GROUP BY id")
graph("analyze_stale_code", lambda g: L.stale_code(J.blame(g._sql(_LINES), g.nodes).select("id", F.col("last_ts").alias("ts")), dt.datetime(2000, 1, 1)), f"SELECT id, max(ts) AS last_ts FROM {_LJ} GROUP BY id HAVING max(ts) < TIMESTAMP '2000-01-01'")
graph("analyze_coverage_gaps", lambda g: L.coverage_gaps(J.coverage(g._sql(_SEGMENTS), g.nodes), 0, 60).select("id", "coverage_pct"), f"SELECT id, coverage_pct FROM ({_COVERED}) WHERE coverage_pct >= 0 AND coverage_pct < 60")


def _role(g: Graph) -> DataFrame:
    f = A.fans(g.nodes, g.edges, ["calls", "references"], ["calls"])
    unit = g.nodes.select("id", F.col("file_path").alias("u"))
    e = g.edges.where("kind IN ('calls', 'references')").join(unit.select(F.col("id").alias("from_id"), F.col("u").alias("a")), "from_id").join(unit.select(F.col("id").alias("to_id"), F.col("u").alias("b")), "to_id").where("a <> b")
    return L.role(f.join(e.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out_of_unit")), "id", "left").join(e.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("into_unit")), "id", "left").fillna(0))


graph("analyze_role", _role, f"SELECT id, CASE WHEN fan_in = 0 AND fan_out = 0 THEN 'dead' WHEN fan_in = 0 THEN 'entry' WHEN coalesce(o, 0) > 0 AND coalesce(i, 0) > 0 AND fan_in <= 3 THEN 'adapter' WHEN fan_out = 0 THEN CASE WHEN fan_in >= 10 THEN 'utility' ELSE 'leaf' END ELSE 'core' END AS role FROM ({_FANS}) f LEFT JOIN (SELECT from_id, count(*) AS o FROM edges e JOIN nodes a ON from_id = a.id JOIN nodes b ON to_id = b.id WHERE e.kind IN ('calls', 'references') AND a.file_path <> b.file_path GROUP BY 1) x ON f.id = x.from_id LEFT JOIN (SELECT to_id, count(*) AS i FROM edges e JOIN nodes a ON from_id = a.id JOIN nodes b ON to_id = b.id WHERE e.kind IN ('calls', 'references') AND a.file_path <> b.file_path GROUP BY 1) y ON f.id = y.to_id")
graph("analyze_missing_fields", lambda g: L.missing_fields(g.typed.where("kind = 'reads'").select(F.col("from_id").alias("type_id"), F.col("label").alias("field")), g.typed.where("kind = 'writes'").select(F.col("from_id").alias("type_id"), F.col("label").alias("field"))).select("type_id", F.array_join("missing", ",").alias("missing")), "SELECT type_id, string_agg(field, ',' ORDER BY field) AS missing FROM (SELECT DISTINCT from_id AS type_id, label AS field FROM typed WHERE kind = 'reads') d WHERE type_id IN (SELECT from_id FROM typed WHERE kind = 'writes') AND (type_id, field) NOT IN (SELECT from_id, label FROM typed WHERE kind = 'writes') GROUP BY 1", typed=True)
table("analyze_retrieval_log", lambda spark, t: L.retrieval_log(t("events").select(F.col("event_type").alias("tool"), F.col("value").alias("ms"), F.floor("value").alias("results"))), "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (floor(value) = 0) AS empty, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
table("analyze_fixes_history", lambda spark, t: L.fixes_history(t("orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("subject")), "(?i)urgent|high"), "SELECT o_custkey AS file, count(*) AS fixes, min(o_orderpriority) AS first FROM orders WHERE regexp_matches(o_orderpriority, '(?i)urgent|high') GROUP BY 1")


def _health(g: Graph) -> DataFrame:
    cov = J.coverage(g._sql(_SEGMENTS), g.nodes).select("id", F.col("coverage_pct").alias("cov"))
    fan = A.fans(g.nodes, g.edges, ["calls", "references"], ["calls"]).select("id", (100.0 / (1 + F.col("fan_out"))).alias("simple"))
    h = g.nodes.where("kind IN ('function', 'method')").select("id", "repo_prefix", "file_path").join(cov, "id", "left").join(fan, "id", "left")
    s = h.withColumn("score", F.round(A.weighted_mean([(F.col("cov"), 2.0), (F.col("simple"), 1.0)]), 4))
    return s.rollup("repo_prefix", "file_path").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("score") * 10000).cast("long")) / F.count("*") / 10000, 6).alias("mean"))


graph("analyze_health_score", _health, f"SELECT repo_prefix, file_path, count(*) AS n, round(sum(round(score * 10000)::BIGINT)::DOUBLE / count(*) / 10000, 6) AS mean FROM (SELECT repo_prefix, file_path, round((coalesce(coverage_pct, 0.0) * 2.0::DOUBLE + 100.0::DOUBLE / (1 + fan_out)) / (CASE WHEN coverage_pct IS NULL THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END + 1.0::DOUBLE), 4) AS score FROM nodes n LEFT JOIN ({_COVERED}) c ON n.id = c.id LEFT JOIN ({_FANS}) f ON n.id = f.id WHERE kind IN ('function', 'method')) GROUP BY ROLLUP (repo_prefix, file_path)")
graph("analyze_bottlenecks", lambda g: L.bottlenecks(g.edges, g.nodes.where("kind IN ('function', 'method')").select("id", F.lit(1).alias("loops")), 2), ", c AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'calls'), f AS (SELECT id FROM nodes WHERE kind IN ('function', 'method')), d1 AS (SELECT id, 1 + CASE WHEN id IN (SELECT from_id FROM c JOIN f ON to_id = id) THEN 1 ELSE 0 END AS depth FROM f), d2 AS (SELECT f.id, 1 + coalesce(max(d1.depth), 0) AS depth FROM f LEFT JOIN c ON f.id = from_id LEFT JOIN d1 ON to_id = d1.id GROUP BY f.id) SELECT id, depth, (SELECT count(*) FROM c x JOIN c y ON x.from_id = y.to_id AND x.to_id = y.from_id WHERE x.from_id = d2.id AND x.from_id <> x.to_id) AS mutual FROM d2")
graph("analyze_external_calls", lambda g: g.typed.where("kind = 'depends_on'").join(g.nodes.select(F.col("id").alias("to_id"), F.split_part("file_path", F.lit("/"), F.lit(2)).alias("module")), "to_id").groupBy("module").agg(F.count("*").alias("n"), F.countDistinct("from_id").alias("callers")), "SELECT split_part(n.file_path, '/', 2) AS module, count(*) AS n, count(DISTINCT from_id) AS callers FROM typed t JOIN nodes n ON to_id = n.id WHERE t.kind = 'depends_on' GROUP BY 1", typed=True)
