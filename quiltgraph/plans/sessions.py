"""Registered queries of snapshots, notes, overlays and reviews, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code as K
from ..operators import sessions as P
from .adapter import Graph
from .relational import graph, table
from .tables import shared_folder


def _snapshots(g: Graph) -> DataFrame:
    root = f"{shared_folder(g.spark)}/snapshots-{uuid.uuid4().hex}"
    P.save_snapshot(g.nodes, g.edges, root, "tpch", "main", "c1")
    P.save_snapshot(g.nodes.where("kind <> 'type'"), g.edges, root, "tpch", "main", "c2")
    return P.list_snapshots(g.spark, root)


graph("i6_snapshots", _snapshots, "SELECT 'tpch' AS repo, 'main' AS branch, 'c1' AS commit, count(*) AS nodes FROM nodes UNION ALL SELECT 'tpch', 'main', 'c2', count(*) FROM nodes WHERE kind <> 'type'")
_NOTES = "SELECT o_custkey AS id, o_orderkey AS ts, o_orderpriority AS text, o_orderkey % 11 = 0 AS deleted, o_orderstatus AS tag FROM orders"


def _notes(spark: SparkSession, t) -> DataFrame:
    return spark.sql(_NOTES.replace("FROM orders", "FROM {orders}"), orders=t("orders")).withColumn("tags", F.array("tag")).drop("tag")


table("m93_m97_m119_notes", lambda spark, t: P.find_notes(_notes(spark, t), ["urgent", "high"], "O"), f"SELECT id, ts, text, CAST(contains(lower(text), 'urgent') AS INT) + CAST(contains(lower(text), 'high') AS INT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM ({_NOTES})) WHERE k = 1 AND NOT deleted AND tag = 'O' AND (contains(lower(text), 'urgent') OR contains(lower(text), 'high'))")
_LAYERS = "SELECT CASE l_suppkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' WHEN 2 THEN 'fix' ELSE 'other' END AS branch, l_orderkey AS seq, 'f' || l_partkey AS file_path, 'v' || l_orderkey || ':' || l_linenumber AS content, l_returnflag = 'A' AND l_linestatus = 'F' AS deleted FROM lineitem WHERE l_linenumber = 1"
_PARENTS = {"main": None, "dev": "main", "fix": "dev", "other": "main"}


def _layers(spark: SparkSession, t) -> DataFrame:
    return spark.sql(_LAYERS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t("lineitem"))


_LAST = "SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY near, seq DESC) AS k FROM (SELECT *, CASE branch WHEN 'fix' THEN 1 WHEN 'dev' THEN 2 ELSE 3 END AS near FROM l WHERE branch IN ('fix', 'dev', 'main'))"
table("m98_m104_overlay_view", lambda spark, t: P.overlay_view(_layers(spark, t), _PARENTS, "fix"), f"WITH l AS ({_LAYERS}) SELECT file_path, content FROM ({_LAST}) WHERE k = 1 AND NOT deleted")
table("m105_overlay_merge", lambda spark, t: P.overlay_view(P.overlay_merge(_layers(spark, t), "other", "fix"), _PARENTS, "fix"), f"WITH l AS ({_LAYERS}), o AS (SELECT file_path, content, deleted FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seq DESC) AS k FROM l WHERE branch = 'other') WHERE k = 1) SELECT file_path, content FROM o WHERE NOT deleted UNION ALL SELECT file_path, content FROM ({_LAST}) WHERE k = 1 AND NOT deleted AND file_path NOT IN (SELECT file_path FROM o)")
table("m14_overlay_conflicts", lambda spark, t: P.overlay_conflicts(_layers(spark, t), "dev", "other"), f"WITH l AS ({_LAYERS}), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch, file_path ORDER BY seq DESC) AS k FROM l) WHERE k = 1) SELECT a.file_path FROM e a JOIN e b ON a.file_path = b.file_path AND a.branch = 'dev' AND b.branch = 'other' WHERE a.content <> b.content OR a.deleted <> b.deleted")

# Changes are orders; the symbols that they touch are parts, the files conversations by number
_CHANGES = "SELECT l_orderkey AS change, 'fn::p' || l_partkey AS symbol FROM lineitem"
_FAN = "SELECT to_id AS symbol, count(*) AS fan_in FROM edges WHERE kind = 'calls' GROUP BY 1"


def _fan_in(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'calls'").groupBy(F.col("to_id").alias("symbol")).agg(F.count("*").alias("fan_in"))


graph("m158_triage", lambda g: P.triage(g._sql(_CHANGES), _fan_in(g)), f", f AS MATERIALIZED ({_FAN}), g AS (SELECT change, count(*) AS symbols, sum(coalesce(fan_in, 0))::BIGINT AS reach FROM (SELECT DISTINCT change, symbol FROM ({_CHANGES})) LEFT JOIN f USING (symbol) GROUP BY 1), s AS (SELECT *, round(100.0::DOUBLE * reach / (reach + 50.0::DOUBLE) + 100.0::DOUBLE * symbols / (symbols + 5.0::DOUBLE), 6) AS score FROM g) SELECT change, symbols, reach, score, CASE WHEN score >= 120 THEN 'first' WHEN score >= 80 THEN 'next' ELSE 'later' END AS bucket FROM s")
graph("m151_review_questions", lambda g: P.questions(g._sql(_CHANGES), _fan_in(g), g.edges.where("kind = 'calls' AND from_id LIKE 'fn::c%'").select(F.col("to_id").alias("symbol")), 30), f", f AS MATERIALIZED ({_FAN}), t AS MATERIALIZED (SELECT DISTINCT change, symbol FROM ({_CHANGES})) SELECT change, 'hub' AS question, count(*) AS n FROM t JOIN f USING (symbol) WHERE fan_in >= 30 GROUP BY 1 UNION ALL SELECT change, 'untested', count(*) FROM t WHERE symbol NOT IN (SELECT to_id FROM edges WHERE kind = 'calls' AND starts_with(from_id, 'fn::c')) GROUP BY 1")
_BAD = "WITH l AS (SELECT doc_id AS path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), r AS (" + " UNION ALL ".join(f"SELECT path, line_no, '{r}' AS rule, '{s}' AS severity FROM l WHERE regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}')" for r, c, lang, s, w, p in K.RULES if not lang) + ")"


def _findings(t) -> DataFrame:
    return K.run_rules(t("documents").select(F.col("doc_id").alias("path"), F.lit("").alias("language"), "text")).select("path", "line_no", "rule", "severity")


def _review(spark: SparkSession, t) -> DataFrame:
    """A change is a source; findings of rule license-line are suppressed everywhere, those of email in a tenth of the files."""
    d = t("documents")
    off = spark.createDataFrame([(None, "license-line")], "path long, rule string").unionByName(d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("path"), F.lit("email").alias("rule")))
    changes = d.select(F.floor(F.col("doc_id") / 5).alias("change"), F.col("doc_id").alias("path"))
    return P.verdicts(changes, P.unsuppressed(_findings(t), off))


table("m126_m152_review", _review, _BAD + ", k AS (SELECT * FROM r WHERE rule <> 'license-line' AND NOT (rule = 'email' AND path % 10 = 0)), c AS (SELECT DISTINCT (doc_id // 5) AS change, doc_id AS path FROM documents), g AS (SELECT change, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM c LEFT JOIN k USING (path) GROUP BY 1) SELECT *, CASE WHEN high > 0 THEN 'block' WHEN medium + low >= 3 THEN 'comment' ELSE 'approve' END AS verdict FROM g")
table("m128_inspections", lambda spark, t: P.top_per(_findings(t), "rule", 25), _BAD + " SELECT path, line_no, rule, severity FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line_no) AS k FROM r) WHERE k <= 25")


def _releases(g: Graph) -> DataFrame:
    li = g.tables["lineitem"]
    tags = li.select(F.date_trunc("quarter", "l_shipdate").alias("ts")).distinct().select("ts", F.concat(F.lit("v"), F.date_format("ts", "yyyy-MM")).alias("tag"))
    return P.releases(li.select(F.concat(F.lit("p"), "l_partkey").alias("file"), F.col("l_shipdate").alias("ts")), tags)


graph("i16_l12_releases", _releases, ", t AS (SELECT DISTINCT date_trunc('quarter', l_shipdate)::TIMESTAMP AS ts FROM lineitem), f AS (SELECT 'p' || l_partkey AS file, min(l_shipdate) AS ts FROM lineitem GROUP BY 1), j AS (SELECT file, (SELECT min(t.ts) FROM t WHERE t.ts >= f.ts) AS tag FROM f) SELECT coalesce('v' || strftime(tag, '%Y-%m'), 'unreleased') AS tag, count(*) AS files, min(file) AS first FROM j GROUP BY 1")
