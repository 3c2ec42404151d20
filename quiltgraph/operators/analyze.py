"""Analyses over typed edges and their side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indirect_mutations(edges: DataFrame) -> DataFrame:
    """(field, n, via): flagged field accesses by field, with the first method they go through."""
    return edges.where("kind = 'accesses_field' AND flag = 'true'").groupBy(F.col("to_id").alias("field")).agg(F.count("*").alias("n"), F.min("from_id").alias("via"))


def speculative(edges: DataFrame) -> DataFrame:
    return edges.where("origin = 'text_matched'").groupBy("kind", "label").agg(F.count("*").alias("n"), F.countDistinct("to_id").alias("targets"))


def race_writes(edges: DataFrame) -> DataFrame:
    """(writer, field, n): writes by what runs concurrently and takes no lock. spawns edges name concurrent functions."""
    spawned = edges.where("kind = 'spawns'").select("from_id").distinct()
    locked = edges.where("kind = 'accesses_field' AND flag = 'true'").select("from_id", "to_id").distinct()
    w = edges.where("kind = 'writes'").join(spawned, "from_id", "left_semi").join(locked, ["from_id", "to_id"], "left_anti")
    return w.groupBy(F.col("from_id").alias("writer"), F.col("to_id").alias("field")).agg(F.count("*").alias("n"))


def unclosed_channels(edges: DataFrame) -> DataFrame:
    """(channel, sends, recvs, risk) of channels that get sends and no close (a flagged receive)."""
    c = edges.where("kind IN ('sends', 'recvs')").groupBy(F.col("to_id").alias("channel")).agg(F.count_if(F.col("kind") == "sends").alias("sends"), F.count_if(F.col("kind") == "recvs").alias("recvs"), F.max(F.when(F.col("kind") == "recvs", F.col("flag"))).alias("closed"))
    risk = F.when(F.col("recvs") == 0, "high").when(F.col("recvs") < F.col("sends"), "medium").otherwise("low")
    return c.where("sends > 0 AND coalesce(closed, 'false') <> 'true'").select("channel", "sends", "recvs", risk.alias("risk"))


def orphan_tables(edges: DataFrame) -> DataFrame:
    """(id, n): tables that are queried and provided by nothing."""
    provided = edges.where("kind = 'provides'").select("to_id").distinct()
    return edges.where("kind = 'queries'").join(provided, "to_id", "left_anti").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n"))


def unreferenced_tables(edges: DataFrame) -> DataFrame:
    queried = edges.where("kind = 'queries'").select("to_id").distinct()
    return edges.where("kind = 'provides'").join(queried, "to_id", "left_anti").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n"))


def stale_flags(edges: DataFrame, before) -> DataFrame:
    """(flag, last_ts, n): flags whose latest toggling caller is older than a day."""
    return edges.where("kind = 'toggles_flag'").groupBy(F.col("to_id").alias("flag")).agg(F.max("ts").alias("last_ts"), F.count("*").alias("n")).where(F.col("last_ts") < F.lit(before))


def stale_code(symbols: DataFrame, before) -> DataFrame:
    return symbols.groupBy("id").agg(F.max("ts").alias("last_ts")).where(F.col("last_ts") < F.lit(before))


def coverage_gaps(covered: DataFrame, low: float, high: float) -> DataFrame:
    return covered.where((F.col("coverage_pct") >= low) & (F.col("coverage_pct") < high))


def edge_audit(edges: DataFrame) -> DataFrame:
    """(origin, n, calls): how far each tier carries the graph."""
    return edges.groupBy("origin").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "calls").alias("calls"))


def untested_targets(edges: DataFrame) -> DataFrame:
    """Targets reached from tests only."""
    t = edges.where("kind = 'tests'").select("to_id").distinct()
    return t.join(edges.where("kind <> 'tests'").select("to_id").distinct(), "to_id", "left_anti")


def resolution_outcomes(edges: DataFrame) -> DataFrame:
    why = F.when(F.col("origin") == "text_matched", "ambiguous_name").when(F.col("confidence") < 0.95, "low_confidence").otherwise("resolved")
    return edges.groupBy("kind", why.alias("reason")).agg(F.count("*").alias("n"))


def cross_repo(edges: DataFrame, repo_of: DataFrame) -> DataFrame:
    """(from_repo, to_repo, kind, n, first) of cross_repo_ edges, under their base kind."""
    e = edges.where(F.col("kind").startswith("cross_repo_"))
    j = e.join(repo_of.select(F.col("id").alias("from_id"), F.col("repo_prefix").alias("from_repo")), "from_id").join(repo_of.select(F.col("id").alias("to_id"), F.col("repo_prefix").alias("to_repo")), "to_id")
    return j.groupBy("from_repo", "to_repo", F.regexp_replace("kind", "^cross_repo_", "").alias("kind")).agg(F.count("*").alias("n"), F.min("from_id").alias("first"))


def role(degree: DataFrame) -> DataFrame:
    """(id, role) by what comes in and goes out; degree(id, fan_in, fan_out, out_of_unit, into_unit)."""
    i, o = F.col("fan_in"), F.col("fan_out")
    r = F.when((i == 0) & (o == 0), "dead").when(i == 0, "entry").when((F.col("out_of_unit") > 0) & (F.col("into_unit") > 0) & (i <= 3), "adapter").when(o == 0, F.when(i >= 10, "utility").otherwise("leaf")).otherwise("core")
    return degree.select("id", r.alias("role"))


def missing_fields(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(type_id, missing): declared fields that a constructor never sets."""
    d = declared.groupBy("type_id").agg(F.collect_set("field").alias("d"))
    u = used.groupBy("type_id").agg(F.collect_set("field").alias("u"))
    return d.join(u, "type_id").select("type_id", F.sort_array(F.array_except("d", "u")).alias("missing")).where(F.size("missing") > 0)


def rule_hits(texts: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(rule, category, n, docs): lines of texts(id, text) that match each rule's pattern; every text is read once."""
    lines = texts.select("id", F.explode(F.split("text", "\n")).alias("line"))
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(c).alias("category"))) for n, (c, p) in rules.items()]))
    return lines.select("id", F.inline(hit)).groupBy("rule", "category").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


def retrieval_log(log: DataFrame) -> DataFrame:
    """(tool, calls, empty, p50, p95) of log(tool, ms, results)."""
    return log.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(F.col("results") == 0).alias("empty"), F.round(F.expr("percentile(ms, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(ms, 0.95)"), 6).alias("p95"))


def fixes_history(commits: DataFrame, pattern: str) -> DataFrame:
    """(file, fixes, first) of commits(file, subject) whose subject tells of a fix."""
    return commits.where(F.col("subject").rlike(pattern)).groupBy("file").agg(F.count("*").alias("fixes"), F.min("subject").alias("first"))


def bottlenecks(edges: DataFrame, own: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, depth, mutual): loop depth carried up the calls for a few rounds, and calls that go both ways; own(id, loops)."""
    from ..plans.tables import cut

    calls = cut(edges.where("kind = 'calls'").select("from_id", "to_id").distinct())
    d = cut(own.select("id", F.col("loops").alias("depth")))
    for _ in range(rounds):
        below = calls.join(d, calls.to_id == d.id).groupBy(F.col("from_id").alias("id")).agg(F.max("depth").alias("m"))
        d = cut(own.join(below, "id", "left").select("id", (F.col("loops") + F.coalesce("m", F.lit(0))).alias("depth")))
    both = calls.join(calls.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("from_id")), ["from_id", "to_id"]).where("from_id <> to_id").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("mutual"))
    return d.join(both, "id", "left").fillna(0, ["mutual"])
