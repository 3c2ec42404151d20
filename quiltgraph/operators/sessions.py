"""Tables that a session keeps: snapshots, notes, overlays of branches, suppressed findings, reviews of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Snapshots


def save_snapshot(nodes: DataFrame, edges: DataFrame, root: str, repo: str, branch: str, commit: str) -> None:
    """The graph of one commit as Parquet under root, in partitions repo, branch and commit; a second save of a commit replaces the first."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{root}/{name}/repo={repo}/branch={branch}/commit={commit}")


def load_snapshot(spark: SparkSession, root: str, repo: str, branch: str, commit: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{root}/{name}/repo={repo}/branch={branch}/commit={commit}") for name in ("nodes", "edges"))


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(repo, branch, commit, nodes): what is saved, with the number of nodes of each."""
    return spark.read.option("basePath", f"{root}/nodes").parquet(f"{root}/nodes").groupBy("repo", "branch", "commit").agg(F.count("*").alias("nodes"))


# Notes


def current(log: DataFrame) -> DataFrame:
    """The last version of each note that is not deleted; log(id, ts, text, tags, deleted), only ever appended to."""
    last = log.groupBy("id").agg(F.max(F.struct("ts", "text", "tags", "deleted")).alias("m"))
    return last.select("id", "m.ts", "m.text", "m.tags", "m.deleted").where("NOT deleted").drop("deleted")


def find_notes(log: DataFrame, words: list[str], tag: str | None = None) -> DataFrame:
    """Current notes (id, ts, text, hits) that hold any of the words, and the tag if one is asked for."""
    hits = F.lit(0)
    for w in words:
        hits = hits + F.contains(F.lower("text"), F.lit(w.lower())).cast("int")
    n = current(log)
    if tag is not None:
        n = n.where(F.array_contains("tags", tag))
    return n.withColumn("hits", hits).where("hits > 0").select("id", "ts", "text", "hits")


# Overlays


def overlay_view(layers: DataFrame, branches: dict[str, str | None], branch: str) -> DataFrame:
    """(file_path, content) as a branch sees them: its own last write of a file, else that of the nearest branch it was forked from; deleted files are gone.

    layers(branch, seq, file_path, content, deleted); branches names the parent of each.
    """
    chain, at = [], branch
    while at is not None and at not in chain:
        chain.append(at)
        at = branches.get(at)
    near = F.array_position(F.array(*[F.lit(b) for b in chain]), F.col("branch"))
    rows = layers.where(F.col("branch").isin(chain))
    top = rows.groupBy("file_path").agg(F.max(F.struct((-near).alias("near"), "seq", "content", "deleted")).alias("m"))
    return top.where("NOT m.deleted").select("file_path", "m.content")


def overlay_merge(layers: DataFrame, source: str, target: str) -> DataFrame:
    """layers with every last write of ``source`` put on top of ``target``; files that both wrote take the source's."""
    last = layers.where(F.col("branch") == source).groupBy("file_path").agg(F.max(F.struct("seq", "content", "deleted")).alias("m"))
    top = layers.where(F.col("branch") == target).groupBy("file_path").agg(F.max("seq").alias("top"))
    moved = last.join(top, "file_path", "left").select(F.lit(target).alias("branch"), (F.coalesce("top", F.lit(0)) + 1).cast(layers.schema["seq"].dataType).alias("seq"), "file_path", "m.content", "m.deleted")
    return layers.unionByName(moved)


def overlay_conflicts(layers: DataFrame, a: str, b: str) -> DataFrame:
    """(file_path) that two branches both wrote, with different ends."""
    end = lambda x, c: layers.where(F.col("branch") == x).groupBy("file_path").agg(F.max(F.struct("seq", "content", "deleted")).alias("m")).select("file_path", F.struct("m.content", "m.deleted").alias(c))
    return end(a, "x").join(end(b, "y"), "file_path").where(~F.col("x").eqNullSafe(F.col("y"))).select("file_path")


# Reviews


def unsuppressed(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """findings(path, rule, ...) without those that are suppressed(path, rule); a null path there means everywhere."""
    everywhere = suppressed.where("path IS NULL").select("rule").distinct()
    return findings.join(everywhere, "rule", "left_anti").join(suppressed.where("path IS NOT NULL").select("path", "rule").distinct(), ["path", "rule"], "left_anti").select(*findings.columns)


def verdicts(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """(change, high, medium, low, verdict) of changes(change, path): block with a high finding, comment with three others, else approve."""
    one = changes.select("change", "path").distinct().join(findings.select("path", "severity"), "path", "left")
    n = lambda s: F.count_if(F.col("severity") == s)
    g = one.groupBy("change").agg(n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"))
    return g.withColumn("verdict", F.when(F.col("high") > 0, "block").when(F.col("medium") + F.col("low") >= 3, "comment").otherwise("approve"))


def triage(changes: DataFrame, fan_in: DataFrame) -> DataFrame:
    """(change, symbols, reach, score, bucket): changes(change, symbol) by the fan-in of what they touch."""
    g = changes.select("change", "symbol").distinct().join(fan_in, "symbol", "left").groupBy("change").agg(F.count("*").alias("symbols"), F.sum(F.coalesce("fan_in", F.lit(0))).alias("reach"))
    s = g.withColumn("score", F.round(100.0 * F.col("reach") / (F.col("reach") + 50.0) + 100.0 * F.col("symbols") / (F.col("symbols") + 5.0), 6))
    return s.withColumn("bucket", F.when(F.col("score") >= 120, "first").when(F.col("score") >= 80, "next").otherwise("later"))


def questions(changes: DataFrame, fan_in: DataFrame, tested: DataFrame, hub: int) -> DataFrame:
    """(change, question, n): what a reviewer should ask, by category: hubs that a change touches, and symbols without a test."""
    t = changes.select("change", "symbol").distinct()
    hubs = t.join(fan_in.where(F.col("fan_in") >= hub), "symbol").groupBy("change").agg(F.count("*").alias("n")).select("change", F.lit("hub").alias("question"), "n")
    bare = t.join(tested.select("symbol").distinct(), "symbol", "left_anti").groupBy("change").agg(F.count("*").alias("n")).select("change", F.lit("untested").alias("question"), "n")
    return hubs.unionByName(bare)


def releases(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, files, first): files(file, ts) by the first release tag(tag, ts) at or after their first appearance. A repository's tags are a bounded list."""
    born = files.groupBy("file").agg(F.min("ts").alias("ts"))
    listed = tags.agg(F.array_sort(F.collect_list(F.struct("ts", "tag"))).alias("tags"))
    with_tags = born.join(F.broadcast(listed), F.lit(True))  # listed: one row
    tag = F.get(F.filter("tags", lambda t: t["ts"] >= F.col("ts")), F.lit(0))["tag"]
    return with_tags.select(F.coalesce(tag, F.lit("unreleased")).alias("tag"), "file").groupBy("tag").agg(F.count("*").alias("files"), F.min("file").alias("first"))


def top_per(findings: DataFrame, per: str, k: int) -> DataFrame:
    """At most k rows of each inspection, by path."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy("path", "line_no"))).where(F.col("_n") <= k).drop("_n")
