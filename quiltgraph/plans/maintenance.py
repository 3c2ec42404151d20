"""Registered incremental, synthesis and export queries, each beside its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import synthesis as K
from ..sources import formats as I
from ..streaming import changes as C
from .relational import graph, table


def _events(t) -> DataFrame:
    return t("events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("kind"), "ts", "event_id")


_SESS = "WITH e AS (SELECT 'u' || user_id AS path, event_type AS kind, ts FROM events), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY path ORDER BY ts) AS prev FROM e))"
table("j2_debounce", lambda spark, t: C.debounce(_events(t), "6 hours"), _SESS + " SELECT path, arg_max(kind, ts) AS kind, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY path, k")
table("j3_storms", lambda spark, t: C.storms(_events(t), "2 hours", "1 hour", 30), "SELECT start, start + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start HAVING count(*) > 30")
table("j4_drain", lambda spark, t: C.drain(_events(t)), "SELECT path, kind, ts FROM (SELECT 'u' || user_id AS path, event_type AS kind, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) WHERE k = 1")
graph("j5_j6_evict", lambda g: C.evict(g.nodes, g.nodes.where("repo_prefix = 'ASIA'").select("file_path")).groupBy("repo_prefix").agg(F.count("*").alias("n")), "SELECT repo_prefix, count(*) AS n FROM nodes WHERE file_path NOT IN (SELECT file_path FROM nodes WHERE repo_prefix = 'ASIA') GROUP BY 1")
graph("j7_upsert", lambda g: C.upsert_rows(g.nodes.select("id", "name"), g.nodes.where("kind = 'method'").select("id", F.upper("name").alias("name")), ["id"]), "SELECT id, CASE WHEN kind = 'method' THEN upper(name) ELSE name END AS name FROM nodes")
graph("j8_retarget", lambda g: C.retarget(g.edges_of("imports").select("from_id", "to_id", "kind"), g.nodes.where("kind = 'file'").select(F.col("id").alias("to_id"), F.concat(F.col("id"), F.lit("#2")).alias("new_to_id"))), "SELECT from_id, to_id || '#2' AS to_id, kind FROM edges WHERE kind = 'imports'")
graph("j9_raise_origin", lambda g: C.raise_origin(g.edges.select("from_id", "to_id", "kind", "line", "origin"), g.edges.where("kind = 'implements'").select("from_id", "to_id", "kind", F.lit("lsp_resolved").alias("new_origin")).distinct(), S.origin_rank).groupBy("kind", "origin").agg(F.count_if("changed").alias("n")), "SELECT kind, CASE WHEN kind = 'implements' THEN 'lsp_resolved' ELSE origin END AS origin, count(*) FILTER (kind = 'implements') AS n FROM edges GROUP BY 1, 2")
graph("j10_affected", lambda g: C.affected(g.nodes, g.edges, g.nodes.where("name = 'NATION_9'").select("file_path")), "SELECT id FROM nodes WHERE kind IN ('type', 'interface') AND file_path IN (SELECT file_path FROM nodes WHERE name = 'NATION_9' UNION ALL SELECT file_path FROM nodes WHERE id IN (SELECT from_id FROM edges WHERE kind = 'imports' AND to_id IN (SELECT id FROM nodes WHERE file_path IN (SELECT file_path FROM nodes WHERE name = 'NATION_9'))))")
table("j11_feed", lambda spark, t: C.feed(_events(t), dt.datetime(2024, 1, 25)).select("event_id", "kind"), "SELECT event_id, event_type AS kind FROM events WHERE ts > TIMESTAMP '2024-01-25'")
graph("j13_stale_references", lambda g: C.stale_references(g.edges, g.nodes.where("kind = 'interface'").select("id")), "SELECT to_id, count(*) AS n FROM edges WHERE to_id IN (SELECT id FROM nodes WHERE kind = 'interface') GROUP BY 1")
table("j15_live_overlays", lambda spark, t: C.live(t("events").groupBy("user_id").agg(F.max("ts").alias("touched")), dt.datetime(2024, 1, 31), 86400).select("user_id"), "SELECT user_id FROM events GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts))) <= 86400")
table("i4_merkle", lambda spark, t: I.merkle(t("pages").select(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("#"), F.col("page_id")).alias("file_path"), F.sha2("html", 256).alias("sha")), 1), "SELECT regexp_replace(name, '/?[^/]*$', '') AS dir, 0 AS level, sha256(string_agg(name || ':' || sha, chr(10) ORDER BY name || ':' || sha)) AS sha FROM (SELECT regexp_replace(url, '^[a-z]+://', '') || '#' || page_id AS name, sha256(html) AS sha FROM pages) GROUP BY 1")
graph("i7_cypher", lambda g: I.cypher(g.nodes, g.edges.select("from_id", "to_id", "kind").distinct()), "SELECT 'CREATE (:' || kind || ' {id: ''' || id || ''', name: ''' || name || '''});' AS line FROM nodes UNION ALL SELECT 'MATCH (a {id: ''' || from_id || '''}), (b {id: ''' || to_id || '''}) CREATE (a)-[:' || upper(kind) || ']->(b);' FROM (SELECT DISTINCT from_id, to_id, kind FROM edges)")
graph("i8_graphml", lambda g: I.graphml(g.nodes, g.edges_of("imports")), "SELECT '<node id=\"' || id || '\"><data key=\"kind\">' || kind || '</data></node>' AS line FROM nodes UNION ALL SELECT '<edge source=\"' || from_id || '\" target=\"' || to_id || '\"><data key=\"kind\">' || kind || '</data></edge>' FROM edges WHERE kind = 'imports'")
graph("i9_mermaid", lambda g: I.mermaid(g.edges_of("imports")), "SELECT '  n' || substr(md5(from_id), 1, 8) || '[\"' || from_id || '\"] -->|imports| n' || substr(md5(to_id), 1, 8) || '[\"' || to_id || '\"]' AS line FROM edges WHERE kind = 'imports'")
graph("i10_dot", lambda g: I.dot(g.edges_of("imports")), "SELECT '  \"' || from_id || '\" -> \"' || to_id || '\" [label=\"imports\"];' AS line FROM edges WHERE kind = 'imports'")
graph("k11_k16_synthesis", lambda g: K.by_key(g.typed.where("kind = 'emits'").select(F.col("from_id").alias("id"), F.col("to_id").alias("channel")), g.typed.where("kind = 'listens_on'").select(F.col("from_id").alias("id"), F.col("to_id").alias("channel")), "channel", "calls", "event_channel"), "SELECT DISTINCT a.from_id, b.from_id AS to_id, 'calls' AS kind, 'event_channel' AS synthesizer FROM typed a JOIN typed b ON a.to_id = b.to_id WHERE a.kind = 'emits' AND b.kind = 'listens_on' AND a.from_id <> b.from_id", typed=True)
graph("k18_speculative", lambda g: K.speculative_dispatch(g.nodes.where("kind = 'method'").select(F.col("id").alias("from_id"), F.col("file_path").alias("name")), g.nodes.where("kind = 'interface'").select("id", F.col("file_path").alias("name")).unionByName(g.nodes.where("kind = 'method'").select("id", F.col("file_path").alias("name"))), 20), "SELECT a.id AS from_id, b.id AS to_id, 'calls' AS kind, 'speculative' AS origin FROM nodes a JOIN nodes b ON a.file_path = b.file_path WHERE a.kind = 'method' AND b.kind IN ('interface', 'method') AND b.file_path IN (SELECT file_path FROM nodes WHERE kind IN ('interface', 'method') GROUP BY 1 HAVING count(*) <= 20)")
graph("k20_test_edges", lambda g: K.test_edges(g.nodes, g.edges_of("calls"), S.is_test_file(F.col("file_path"))), "SELECT DISTINCT from_id, to_id, 'tests' AS kind FROM edges e JOIN nodes a ON from_id = a.id JOIN nodes b ON to_id = b.id WHERE e.kind = 'calls' AND a.file_path LIKE '%\\_test.go' ESCAPE '\\' AND b.file_path NOT LIKE '%\\_test.go' ESCAPE '\\'")
graph("k21_capability_edges", lambda g: K.capability_edges(g.edges_of("calls"), {"reads_env": "^fn::p1", "executes_process": "^fn::p2"}).distinct(), "SELECT DISTINCT from_id, to_id, CASE WHEN starts_with(to_id, 'fn::p1') THEN 'reads_env' ELSE 'executes_process' END AS kind FROM edges WHERE kind = 'calls' AND regexp_matches(to_id, '^fn::p[12]')")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream through debounce, to the end of what is there."""
    from .tables import shared_folder

    import uuid

    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.write.parquet(f"{where}/in")
    events = spark.readStream.schema(src.schema).parquet(f"{where}/in").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("kind"), "ts")
    q = events.groupBy("kind").agg(F.count("*").alias("n")).writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out")


from ..catalog import register  # noqa: E402

register("j1_j12_stream_counts", _stream, "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
