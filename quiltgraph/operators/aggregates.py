"""Counts, degrees, coupling and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import endpoints


def graph_stats(nodes: DataFrame) -> DataFrame:
    """(kind, language, n) over one pass: by both, by each, and in all; null marks what is summed over."""
    return nodes.groupingSets([["kind", "language"], ["kind"], ["language"], []], "kind", "language").agg(F.count("*").alias("n"))


def repo_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("repo_prefix").agg(F.count("*").alias("n_nodes"), F.countDistinct("kind").alias("n_kinds"), F.countDistinct("language").alias("n_languages"))
    e = edges.join(nodes.select(F.col("id").alias("from_id"), "repo_prefix"), "from_id").groupBy("repo_prefix").agg(F.count("*").alias("n_edges"))
    return n.join(e, "repo_prefix", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def in_degree(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.where(F.col("kind").isin(kinds)).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_in"))


def degrees(nodes: DataFrame, edges: DataFrame, usage: list[str]) -> DataFrame:
    """(id, n_in, n_out, n_usage), zero-filled for every node; one pass over edges."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("u")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("kind").isin(usage).cast("int").alias("u")))))
    d = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.sum("u").alias("n_usage"))
    return nodes.select("id").join(d, "id", "left").fillna(0, ["n_in", "n_out", "n_usage"])


def fans(nodes: DataFrame, edges: DataFrame, in_kinds: list[str], out_kinds: list[str]) -> DataFrame:
    """(id, fan_in, fan_out) with a set of kinds for each side."""
    e = edges.where(F.col("kind").isin(sorted({*in_kinds, *out_kinds})))
    ends = e.select(F.inline(F.array(F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.col("kind").isin(out_kinds).cast("int").alias("o")), F.struct(F.col("to_id").alias("id"), F.col("kind").isin(in_kinds).cast("int").alias("i"), F.lit(0).alias("o")))))
    d = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(d, "id", "left").fillna(0, ["fan_in", "fan_out"])


def file_import_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports by target file; a target without a file counts under its id."""
    key = F.coalesce(F.nullif("file_path", F.lit("")), "to_id").alias("file")
    t = nodes.select(F.col("id").alias("to_id"), "file_path")
    return edges.where("kind = 'imports'").select("to_id").join(t, "to_id", "left").groupBy(key).agg(F.count("*").alias("n"))


def cross_repo_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = endpoints(nodes, edges.where(F.col("kind").startswith("cross_repo_")), ["repo_prefix"])
    return e.groupBy("kind", F.col("from_repo_prefix").alias("from_repo"), F.col("to_repo_prefix").alias("to_repo")).agg(F.count("*").alias("n"))


def community_crossings(edges: DataFrame, membership: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, crossings): out-edges into another community; membership(id, community)."""
    e = edges.where(F.col("kind").isin(kinds)).join(membership.select(F.col("id").alias("from_id"), F.col("community").alias("a")), "from_id").join(membership.select(F.col("id").alias("to_id"), F.col("community").alias("b")), "to_id")
    return e.where("a <> b AND a <> '' AND b <> ''").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("crossings"))


def extract_candidates(nodes: DataFrame, edges: DataFrame, min_lines: int, min_callers: int, min_callees: int) -> DataFrame:
    lines = (F.col("end_line") - F.col("start_line") + 1).alias("line_count")
    calls = edges.where("kind = 'calls'")
    callers = calls.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("callers")).where(F.col("callers") >= min_callers)
    callees = calls.groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("callees")).where(F.col("callees") >= min_callees)
    return nodes.select("id", lines).where(F.col("line_count") >= min_lines).join(callers, "id").join(callees, "id")


def coupling(nodes: DataFrame, edges: DataFrame, unit: Column, kinds: list[str]) -> DataFrame:
    """(unit, ca, ce, instability, internal, total): distinct units that come in and that it goes out to."""
    u = nodes.select("id", unit.alias("u"))
    e = edges.where(F.col("kind").isin(kinds)).select("from_id", "to_id").join(u.select(F.col("id").alias("from_id"), F.col("u").alias("a")), "from_id").join(u.select(F.col("id").alias("to_id"), F.col("u").alias("b")), "to_id")
    flows = e.groupBy("a", "b").agg(F.count("*").alias("n"))  # partial sums first: the rest is over pairs of units
    sides = flows.select(F.inline(F.array(F.struct(F.col("a").alias("unit"), F.when(F.col("a") != F.col("b"), F.col("b")).alias("goes"), F.lit(None).cast("string").alias("comes"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("inner"), F.col("n").alias("n")), F.struct(F.col("b").alias("unit"), F.lit(None).cast("string").alias("goes"), F.when(F.col("a") != F.col("b"), F.col("a")).alias("comes"), F.lit(0).cast("long").alias("inner"), F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0).alias("n")))))
    g = sides.groupBy("unit").agg(F.countDistinct("comes").alias("ca"), F.countDistinct("goes").alias("ce"), F.sum("inner").alias("internal"), F.sum("n").alias("total"))
    return g.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 6)).otherwise(0.0))


def connectivity(degree: DataFrame) -> DataFrame:
    """One row: isolated, leaf, source-only and sink-only nodes and their share; degree(id, n_in, n_out)."""
    i, o = F.col("n_in"), F.col("n_out")
    return degree.agg(
        F.count("*").alias("nodes"), F.count_if((i == 0) & (o == 0)).alias("isolated"), F.count_if(i + o == 1).alias("leaf"),
        F.count_if((i == 0) & (o > 0)).alias("source_only"), F.count_if((i > 0) & (o == 0)).alias("sink_only"),
    ).withColumn("isolated_ratio", F.round(F.col("isolated") / F.col("nodes"), 6))


def ownership(symbols: DataFrame, min_symbols: int) -> DataFrame:
    """(author, symbols, files, first_ts, last_ts) of symbols(id, file_path, author, ts)."""
    return symbols.groupBy("author").agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where(F.col("symbols") >= min_symbols)


def coverage_summary(covered: DataFrame) -> DataFrame:
    """By folder: symbols, unweighted mean, full, none, partial; covered(file_path, coverage_pct)."""
    p = F.col("coverage_pct")
    return covered.groupBy(F.regexp_replace("file_path", "/?[^/]*$", "").alias("dir")).agg(
        F.count("*").alias("symbols"), F.round(F.avg(p), 4).alias("avg_pct"), F.count_if(p == 100).alias("full"), F.count_if(p == 0).alias("none"), F.count_if((p > 0) & (p < 100)).alias("partial")
    )


def weighted_mean(axes: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the axes that are not null; null without any."""
    top = sum((F.coalesce(a, F.lit(0.0)) * w for a, w in axes), F.lit(0.0))
    weight = sum((F.when(a.isNotNull(), w).otherwise(0.0) for a, w in axes), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def distribution(scores: DataFrame, by: str) -> DataFrame:
    """Mean, median, population deviation and Gini of score by group; ranks are per group."""
    w = Window.partitionBy(by).orderBy("score", "id")
    r = scores.withColumn("r", F.row_number().over(w))
    g = r.groupBy(by).agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.expr("percentile(score, 0.5)").alias("med"), F.stddev_pop("score").alias("sd"), F.sum(F.col("r") * F.col("score")).alias("rs"), F.sum("score").alias("s"))
    gini = F.when(F.col("s") > 0, 2 * F.col("rs") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    return g.select(by, "n", F.round("m", 6).alias("mean"), F.round("med", 6).alias("median"), F.round("sd", 6).alias("stddev"), F.round(gini, 6).alias("gini"))


def time_buckets(events: DataFrame, now) -> DataFrame:
    """By tool: calls and sums of today, of seven days and of all time; events(tool, ts, value)."""
    day = F.to_date("ts")
    today = F.to_date(F.lit(now))
    week = day > F.date_sub(today, 7)
    return events.groupBy("tool").agg(
        F.count_if(day == today).alias("calls_today"), F.count_if(week).alias("calls_week"), F.count("*").alias("calls"),
        F.round(F.sum(F.when(day == today, F.col("value")).otherwise(0.0)), 4).alias("value_today"), F.round(F.sum(F.when(week, F.col("value")).otherwise(0.0)), 4).alias("value_week"), F.round(F.sum("value"), 4).alias("value"),
    )


def cohesion(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, cohesion): weight inside over all weight at it; edges(from_id, to_id, weight)."""
    e = edges.join(membership.select(F.col("id").alias("from_id"), F.col("community").alias("a")), "from_id").join(membership.select(F.col("id").alias("to_id"), F.col("community").alias("b")), "to_id")
    s = e.groupBy("a", "b").agg(F.sum("weight").alias("w")).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("community"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("i"), "w")
    return s.groupBy("community").agg(F.round(F.sum("i") / F.sum("w"), 6).alias("cohesion"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """(query, ndcg): linear gain; ranked(query, rank from 0, grade). 0 where nothing is relevant."""
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"))) - 1
    r = ranked.withColumn("best", best)
    gain = lambda at: F.sum(F.when(F.col(at) < k, F.col("grade") / F.log2(F.col(at) + 2.0)).otherwise(0.0))
    return r.groupBy("query").agg(gain("rank").alias("d"), gain("best").alias("i")).select("query", F.round(F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(0.0), 6).alias("ndcg"))


def recall_mrr(first_hits: DataFrame) -> DataFrame:
    """By tier: recall at 1, 5 and 20 and mean reciprocal rank; first_hits(query, tier, rank from 1 or null)."""
    r = F.col("rank")
    at = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6)
    return first_hits.groupBy("tier").agg(F.count("*").alias("queries"), at(1).alias("r1"), at(5).alias("r5"), at(20).alias("r20"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"))


def _slots(terms: DataFrame, term_col: str, rows: int, width: int) -> DataFrame:
    """terms with a row for each sketch row: (row, slot) from 28 bits of the term's MD5 (four rows at most)."""
    h = F.md5(F.col(term_col).cast("binary"))
    slot = lambda r: F.pmod(F.conv(F.substring(h, 1 + 7 * r, 7), 16, 10).cast("long"), F.lit(width).cast("long"))
    return terms.select("*", F.inline(F.array(*[F.struct(F.lit(r).alias("row"), slot(r).alias("slot")) for r in range(rows)])))


def count_min(terms: DataFrame, term_col: str, rows: int = 4, width: int = 4096) -> DataFrame:
    """(row, slot, n): a count-min sketch of a column, at most rows * width rows whatever the input."""
    counted = terms.groupBy(term_col).agg(F.count("*").alias("n"))
    return _slots(counted, term_col, rows, width).groupBy("row", "slot").agg(F.sum("n").alias("n"))


def count_min_merge(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """The sketch of both inputs, or with sign -1 of a without b."""
    return a.unionByName(b.withColumn("n", F.col("n") * sign)).groupBy("row", "slot").agg(F.sum("n").alias("n"))


def count_min_estimate(sketch: DataFrame, terms: DataFrame, term_col: str, rows: int = 4, width: int = 4096) -> DataFrame:
    """terms with estimate: the smallest count of a term's slots, never below the true one."""
    s = F.broadcast(sketch.select("row", "slot", F.col("n").alias("_n")))  # rows * width rows at most
    found = _slots(terms, term_col, rows, width).join(s, ["row", "slot"], "left").groupBy(*terms.columns).agg(F.coalesce(F.min(F.coalesce("_n", F.lit(0))), F.lit(0)).cast("long").alias("estimate"))
    return found
