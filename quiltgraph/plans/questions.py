"""Registered composed questions, each beside its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import tools as M
from .relational import _FANS, _HUNKS, _LINES, graph, table

_TEST = "regexp_matches(file_path, '(_test\\.[a-z]+|\\.test\\.[a-z]+|\\.spec\\.[a-z]+)$') OR regexp_matches(file_path, '(^|/)(tests?|__tests__)/')"
_USE = "kind IN ('calls', 'references', 'implements')"
graph("m_repo_outline", lambda g: M.outline(g.nodes, g.edges), f"SELECT repo_prefix, kind, count(*) AS n, string_agg(CASE WHEN k <= 5 THEN id END, ',' ORDER BY k) AS most_used FROM (SELECT *, row_number() OVER (PARTITION BY repo_prefix, kind ORDER BY coalesce(c, 0) DESC, id) AS k FROM nodes LEFT JOIN (SELECT to_id, count(*) AS c FROM edges WHERE {_USE} GROUP BY 1) ON id = to_id) GROUP BY 1, 2")
graph("m_winnow", lambda g: M.winnow(g.nodes, g.edges, ["function", "method"], "go", "lib/", 5, 1), f"SELECT id, fan_in, fan_out, round(ln(1 + fan_in) + 0.5::DOUBLE * ln(1 + fan_out), 6) AS score FROM ({_FANS}) JOIN nodes USING (id) WHERE kind IN ('function', 'method') AND language = 'go' AND starts_with(file_path, 'lib/') AND fan_in >= 5 AND fan_out >= 1 ORDER BY score DESC, id LIMIT 50")
graph("m_untested_symbols", lambda g: M.untested(g.nodes, g.edges_of("calls")), f"SELECT to_id AS id, count(*) AS fan_in FROM edges WHERE kind = 'calls' AND to_id IN (SELECT id FROM nodes WHERE kind IN ('function', 'method') AND NOT ({_TEST})) AND to_id NOT IN (SELECT to_id FROM edges WHERE kind = 'calls' AND from_id IN (SELECT id FROM nodes WHERE {_TEST})) GROUP BY 1")
graph("m_knowledge_gaps", lambda g: M.knowledge_gaps(g.nodes, g.edges, 8), f", s AS MATERIALIZED (SELECT file_path AS unit, count(*) AS n FROM nodes WHERE kind NOT IN ('file', 'package') GROUP BY 1) SELECT 'thin' AS gap, unit, n FROM s WHERE n < 8 UNION ALL SELECT 'unreferenced', unit, n FROM s WHERE unit NOT IN (SELECT file_path FROM edges e JOIN nodes ON to_id = id WHERE e.{_USE})".replace("SELECT file_path FROM edges e JOIN nodes ON to_id = id", "SELECT nodes.file_path FROM edges e JOIN nodes ON to_id = id"))
graph("m_surprising_connections", lambda g: M.surprising(g.nodes, g.edges, 60), "SELECT a.repo_prefix AS from_repo, b.repo_prefix AS to_repo, e.kind, count(*) AS n FROM edges e JOIN nodes a ON from_id = a.id JOIN nodes b ON to_id = b.id WHERE a.repo_prefix <> b.repo_prefix GROUP BY 1, 2, 3 HAVING count(*) <= 60")
graph("m_suggest_reviewers", lambda g: M.reviewers(g._sql(_HUNKS), g._sql(_LINES)), f"SELECT * FROM (SELECT file_path, author, count(*) AS lines, row_number() OVER (PARTITION BY file_path ORDER BY count(*) DESC, author) AS rank FROM ({_LINES}) WHERE file_path IN (SELECT file_path FROM ({_HUNKS})) GROUP BY 1, 2) WHERE rank <= 3")
graph("m_change_impact", lambda g: M.change_impact(g.edges, g.nodes.where("kind = 'interface'").select("id")), f"SELECT to_id AS id, count(DISTINCT from_id) AS direct, count(*) AS users, CASE WHEN count(DISTINCT from_id) >= 10 THEN 'CRITICAL' WHEN count(DISTINCT from_id) >= 5 THEN 'HIGH' WHEN count(DISTINCT from_id) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM edges WHERE {_USE} AND to_id IN (SELECT id FROM nodes WHERE kind = 'interface') GROUP BY 1")
graph("m_editing_context", lambda g: M.editing_context(g.nodes, g.edges_of("calls", "references", "implements"), "lib/economy/brand2.go"), f"SELECT DISTINCT id, role FROM (SELECT id, 'symbol' AS role FROM nodes WHERE file_path = 'lib/economy/brand2.go' UNION ALL SELECT to_id, 'uses' FROM edges WHERE {_USE} AND from_id IN (SELECT id FROM nodes WHERE file_path = 'lib/economy/brand2.go') UNION ALL SELECT from_id, 'used_by' FROM edges WHERE {_USE} AND to_id IN (SELECT id FROM nodes WHERE file_path = 'lib/economy/brand2.go'))")
graph("m_find_declaration", lambda g: M.declaration(g.nodes, "^(small|red) ", "lib/").select("id", "name"), "SELECT id, name FROM nodes WHERE regexp_matches(name, '^(small|red) ') AND starts_with(file_path, 'lib/')")
graph("m_index_health", lambda g: M.index_health(g.nodes, g.edges), "SELECT count(*) AS edges, count(*) FILTER (to_id NOT IN (SELECT id FROM nodes)) AS dangling, count(*) FILTER (origin = '') AS no_origin FROM edges")
table("m_memories", lambda spark, t: M.memories(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderdate").alias("ts")), ["urgent", "1", "high"], dt.datetime(2002, 1, 1), 3000.0), "SELECT id, round(hits * exp(-ln(2.0::DOUBLE) / 3000.0::DOUBLE * age), 6) AS score FROM (SELECT o_orderkey AS id, contains(lower(o_orderpriority), 'urgent')::INT + contains(o_orderpriority, '1')::INT + contains(lower(o_orderpriority), 'high')::INT AS hits, (epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 86400.0::DOUBLE AS age FROM orders) WHERE hits > 0")
