"""Questions that put several operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import aggregates as A
from . import graph as G
from . import joins as J
from .traversal import bfs


def outline(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(repo_prefix, kind, n, most_used): counts by repository and kind, with the most referred-to names."""
    used = A.in_degree(edges, ["calls", "references", "implements"])
    w = Window.partitionBy("repo_prefix", "kind").orderBy(F.desc("n_in"), "id")
    r = nodes.join(used, "id", "left").fillna(0, ["n_in"]).withColumn("_n", F.row_number().over(w))
    return r.groupBy("repo_prefix", "kind").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= top, F.struct("_n", "id")))), lambda x: x["id"]), ",").alias("most_used"))


def winnow(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, language: str | None = None, path: str | None = None, min_fan_in: int = 0, min_fan_out: int = 0, limit: int = 50) -> DataFrame:
    """(id, fan_in, fan_out, score) of nodes that meet every constraint, by their weight in the graph."""
    n = nodes if kinds is None else nodes.where(F.col("kind").isin(kinds))
    n = n if language is None else n.where(F.lower("language") == language.lower())
    n = n if path is None else n.where(F.col("file_path").startswith(path))
    f = A.fans(n, edges, ["calls", "references"], ["calls"]).where((F.col("fan_in") >= min_fan_in) & (F.col("fan_out") >= min_fan_out))
    return f.withColumn("score", F.round(F.log1p("fan_in") + 0.5 * F.log1p("fan_out"), 6)).orderBy(F.desc("score"), "id").limit(limit)


def untested(nodes: DataFrame, edges: DataFrame, min_fan_in: int = 1) -> DataFrame:
    """(id, fan_in): functions and methods that are called, though by no test."""
    code = nodes.where(F.col("kind").isin("function", "method") & ~S.is_test_file(F.col("file_path")))
    calls = edges.where("kind = 'calls'")
    tests = nodes.where(S.is_test_file(F.col("file_path"))).select(F.col("id").alias("from_id"))
    tested = calls.join(tests, "from_id", "left_semi").select(F.col("to_id").alias("id"))
    return A.in_degree(calls, ["calls"]).where(F.col("n_in") >= min_fan_in).join(code.select("id"), "id", "left_semi").join(tested, "id", "left_anti").withColumnRenamed("n_in", "fan_in")


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, min_members: int) -> DataFrame:
    """(gap, unit, n): files of few symbols, and files nothing refers to."""
    size = nodes.where("kind NOT IN ('file', 'package')").groupBy(F.col("file_path").alias("unit")).agg(F.count("*").alias("n"))
    used = edges.where("kind IN ('calls', 'references', 'implements')").join(nodes.select(F.col("id").alias("to_id"), F.col("file_path").alias("unit")), "to_id").select("unit").distinct()
    return size.where(F.col("n") < min_members).select(F.lit("thin").alias("gap"), "unit", "n").unionByName(size.join(used, "unit", "left_anti").select(F.lit("unreferenced").alias("gap"), "unit", "n"))


def surprising(nodes: DataFrame, edges: DataFrame, rare: int) -> DataFrame:
    """(from_repo, to_repo, kind, n): edges between repositories that are rare for their kind and pair."""
    e = J.endpoints(nodes, edges, ["repo_prefix"]).where("from_repo_prefix <> to_repo_prefix")
    return e.groupBy(F.col("from_repo_prefix").alias("from_repo"), F.col("to_repo_prefix").alias("to_repo"), "kind").agg(F.count("*").alias("n")).where(F.col("n") <= rare)


def reviewers(changed: DataFrame, blame: DataFrame, top: int = 3) -> DataFrame:
    """(file_path, author, lines, rank): who wrote most of each changed file; blame(file_path, author, ...) a row a line."""
    g = blame.join(changed.select("file_path").distinct(), "file_path", "left_semi").groupBy("file_path", "author").agg(F.count("*").alias("lines"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("lines"), "author"))).where(F.col("rank") <= top)


def change_impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, direct, users): callers and referrers of each changed symbol, and the files they sit in."""
    e = edges.where("kind IN ('calls', 'references', 'implements')").join(changed.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return e.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("direct"), F.count("*").alias("users")).withColumn("risk", G.risk(F.col("direct"), F.lit(0)))


def editing_context(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(id, role): a file's symbols, what they use and what uses them."""
    mine = nodes.where(F.col("file_path") == path).select("id")
    e = edges.where("kind IN ('calls', 'references', 'implements')")
    out = e.join(mine.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"), F.lit("uses").alias("role"))
    back = e.join(mine.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id"), F.lit("used_by").alias("role"))
    return mine.withColumn("role", F.lit("symbol")).unionByName(out).unionByName(back).distinct()


def declaration(nodes: DataFrame, name_regex: str, path: str | None = None) -> DataFrame:
    n = nodes.where(F.col("name").rlike(name_regex))
    return n if path is None else n.where(F.col("file_path").startswith(path))


def index_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes, dangling ends and edges of no known origin."""
    ends = edges.select("from_id", "to_id", "origin").join(nodes.select(F.col("id").alias("to_id"), F.lit(1).alias("t")), "to_id", "left")
    return ends.agg(F.count("*").alias("edges"), F.count_if(F.col("t").isNull()).alias("dangling"), F.count_if(F.col("origin") == "").alias("no_origin"))


def memories(notes: DataFrame, words: list[str], now, half_life_days: float = 30.0) -> DataFrame:
    """(id, score): notes(id, text, ts) by shared words and age."""
    hit = sum((F.contains(F.lower("text"), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("ts")) / 86400.0
    return notes.select("id", hit.alias("hits"), age.alias("age")).where("hits > 0").select("id", F.round(F.col("hits") * S.recency(F.col("age"), half_life_days), 6).alias("score"))


def conflicts(touched: DataFrame, least: int) -> DataFrame:
    """(a, b, shared): open changes that touch at least so many symbols in common; touched(pr, symbol). Pairs form from each symbol's list of changes."""
    t = touched.select("pr", "symbol").distinct()
    # a change with fewer symbols than asked for can be in no pair
    t = t.join(t.groupBy("pr").agg(F.count("*").alias("n")).where(F.col("n") >= least), "pr", "left_semi")
    b = t.select(F.col("pr").alias("b"), "symbol")
    return t.withColumnRenamed("pr", "a").join(b, "symbol").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def context_closure(edges: DataFrame, seeds: DataFrame, cost: DataFrame, budget: int, kinds: list[str], depth: int = 3) -> DataFrame:
    """(id, depth, total): what seeds reach, nearest first, while the running sum of cost(id, tokens) is within the budget."""
    reached = bfs(edges, seeds, "out", kinds, depth).join(cost, "id")
    w = Window.orderBy("depth", "id")  # the answer to one question: bounded by its budget once packed
    return reached.withColumn("total", F.sum("tokens").over(w).cast("long")).where(F.col("total") <= budget).select("id", "depth", "total")


def response_stats(texts: DataFrame) -> DataFrame:
    """(id, lines, bytes, tokens) of texts(id, text)."""
    return texts.select("id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.octet_length("text").cast("long").alias("bytes"), F.ceil(F.length("text") / 4.0).cast("long").alias("tokens"))


def source_lines(files: DataFrame, spans: DataFrame, around: int = 0) -> DataFrame:
    """(path, start, end, source): lines start to end, from 1, of each span(path, start, end) with so many lines around."""
    lines = F.split("text", "\n")
    first = F.greatest(F.lit(1), F.col("start") - around)
    return spans.join(files, "path").select("path", "start", "end", F.array_join(F.slice(lines, first, F.col("end") + around - first + 1), "\n").alias("source"))


def citations(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found, line): whether a cited span(path, span) is in its file, and on which line it starts."""
    j = claims.where("span <> ''").join(files, "path", "left")
    at = F.call_function("instr", F.coalesce("text", F.lit("")), F.col("span"))
    return j.select("path", (at > 0).alias("found"), F.size(F.split(F.call_function("substring", F.coalesce("text", F.lit("")), F.lit(1), F.greatest(at, F.lit(1))), "\n")).cast("long").alias("line"))


def api_impact(edges: DataFrame) -> DataFrame:
    """(route, handlers, consumers, risk) of routes with a handler."""
    of = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("from_id")))
    g = edges.where("kind IN ('handles_route', 'consumes')").groupBy(F.col("to_id").alias("route")).agg(of("handles_route").alias("handlers"), of("consumes").alias("consumers")).where("handlers > 0")
    c = F.col("consumers")
    return g.withColumn("risk", F.when(c >= 10, "CRITICAL").when(c >= 5, "HIGH").when(c >= 2, "MEDIUM").otherwise("LOW"))


def architecture(nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """(part, name, n): the largest units, the most used symbols and the busiest entry points."""
    calls = edges.where("kind = 'calls'")
    unit = nodes.groupBy(F.col("file_path").alias("name")).agg(F.count("*").alias("n")).select(F.lit("unit").alias("part"), "name", "n")
    hub = edges.where("kind IN ('calls', 'references')").groupBy(F.col("to_id").alias("name")).agg(F.count("*").alias("n")).select(F.lit("hub").alias("part"), "name", "n")
    entry = calls.join(calls.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_anti").groupBy(F.col("from_id").alias("name")).agg(F.count("*").alias("n")).select(F.lit("entry").alias("part"), "name", "n")
    best = lambda d: d.orderBy(F.desc("n"), "name").limit(top)
    return best(unit).unionByName(best(hub)).unionByName(best(entry))


def models(edges: DataFrame) -> DataFrame:
    """(model, materialised, upstream, exposed) of transformation models."""
    of = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("to_id")))
    g = edges.where("kind IN ('depends_on', 'exposes')").groupBy(F.col("from_id").alias("model"))
    return g.agg(F.when(F.bool_or(F.col("flag") == "true"), "table").otherwise("view").alias("materialised"), of("depends_on").alias("upstream"), of("exposes").alias("exposed"))
