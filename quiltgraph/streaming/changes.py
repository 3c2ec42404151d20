"""Incremental maintenance of the graph with Structured Streaming.

Sinks write whole files of a table by version: a batch reads the current version,
applies its changes and writes the next one, so a replayed batch (same id) gives the
same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import latest


def file_events(spark: SparkSession, path: str, schema: str = "path string, kind string, ts timestamp") -> DataFrame:
    """Change events as JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def debounce(events: DataFrame, gap: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """(path, kind, first_ts, last_ts, n): a burst of events at one path becomes one, of the last kind. Works on streams and tables."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("path", F.session_window("ts", gap)).agg(F.max_by("kind", "ts").alias("kind"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return g.select("path", "kind", "first_ts", "last_ts", "n")


def storms(events: DataFrame, window: str, slide: str, threshold: int, late: str = "1 minute") -> DataFrame:
    """(start, end, n) of windows with more events than the threshold."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("n")).where(F.col("n") > threshold).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def drain(events: DataFrame) -> DataFrame:
    """The last kind for each path of a storm."""
    return latest(events, ["path"], [F.desc("ts"), F.desc("kind")]).select("path", "kind", "ts")


def evict(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*rows.columns)


def upsert_files(rows: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those of changed or deleted files, and the new ones."""
    return evict(rows, new.select("file_path").union(gone.select("file_path"))).unionByName(new.select(*rows.columns))


def upsert_rows(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins by key; new wins over rows."""
    both = rows.withColumn("_v", F.lit(0)).unionByName(new.select(*rows.columns).withColumn("_v", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_v")))).where("_n = 1").drop("_n", "_v")


def retarget(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges whose target is in moves(to_id, new_to_id) point to the new one."""
    j = edges.join(moves, "to_id", "left")
    return j.select(*[F.coalesce("new_to_id", "to_id").alias("to_id") if c == "to_id" else c for c in edges.columns])


def raise_origin(edges: DataFrame, better: DataFrame, rank) -> DataFrame:
    """Edges with the higher of their origin and that of better(from_id, to_id, kind, new_origin); changed marks a new revision."""
    j = edges.join(better, ["from_id", "to_id", "kind"], "left")
    up = F.col("new_origin").isNotNull() & (rank(F.col("new_origin")) > rank(F.col("origin")))
    return j.select(*[F.when(up, F.col("new_origin")).otherwise(F.col("origin")).alias("origin") if c == "origin" else c for c in edges.columns], F.coalesce(up, F.lit(False)).alias("changed"))


def affected(nodes: DataFrame, edges: DataFrame, stale: DataFrame) -> DataFrame:
    """Types and interfaces in stale files, and those of files that import them."""
    s = nodes.join(stale.select("file_path"), "file_path", "left_semi")
    importing = edges.where("kind = 'imports'").join(s.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    files = nodes.join(importing, "id", "left_semi").select("file_path").union(stale.select("file_path")).distinct()
    return nodes.where("kind IN ('type', 'interface')").join(files, "file_path", "left_semi").select("id")


def stale_references(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """(to_id, n): removed targets that something still refers to."""
    return edges.join(removed.select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy("to_id").agg(F.count("*").alias("n"))


def feed(events: DataFrame, since) -> DataFrame:
    return events.where(F.col("ts") > F.lit(since))


def live(overlays: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Overlay sessions touched within the time to live."""
    return overlays.where(F.unix_timestamp(F.lit(now)) - F.unix_timestamp("touched") <= ttl_seconds)


def maintain(events: DataFrame, load, table: str, checkpoint: str, key: str = "file_path"):
    """Start a stream that applies each batch of file events to a versioned table.

    load(paths DataFrame) gives the new rows of changed files. Version n holds the table after batch n.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = drain(batch)
        changed, gone = last.where("kind <> 'deleted'"), last.where("kind = 'deleted'")
        now = current(spark, table, n)
        new = load(changed.select(F.col("path").alias(key)))
        out = new if now is None else upsert_files(now, new, gone.select(F.col("path").alias(key)))
        out.write.mode("overwrite").parquet(f"{table}/version={n}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table (below ``before``)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    found = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(p) if x.getPath().getName().startswith("version=")]
    found = [v for v in found if before is None or v < before]
    return spark.read.parquet(f"{table}/version={max(found)}") if found else None
