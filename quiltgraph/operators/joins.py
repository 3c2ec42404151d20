"""Joins between nodes, edges and side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut

#: Parts that the types of one name set are dealt to.
SHARES = 64
STRUCTURAL = ["extends", "implements", "composes"]


def endpoints(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """edges with the listed node columns of both ends, as from_<column> and to_<column>."""
    ends = nodes.select("id", *columns)
    f = ends.select(F.col("id").alias("from_id"), *[F.col(c).alias(f"from_{c}") for c in columns])
    t = ends.select(F.col("id").alias("to_id"), *[F.col(c).alias(f"to_{c}") for c in columns])
    return edges.join(f, "from_id").join(t, "to_id")


def importers(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Nodes that import the file, or a node in it."""
    e = endpoints(nodes, edges.where("kind = 'imports'"), ["file_path", "name"])
    return e.where((F.col("to_file_path") == path) | (F.col("to_id") == path)).select("from_id", "from_file_path", "to_id")


def adjacency_of_kinds(nodes: DataFrame, edges: DataFrame, edge_kinds: list[str], node_kinds: list[str]) -> DataFrame:
    ids = nodes.where(F.col("kind").isin(node_kinds)).select("id")
    e = edges.where(F.col("kind").isin(edge_kinds)).select("from_id", "to_id")
    return e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def cross_repo_candidates(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges whose ends lie in different, non-empty repositories."""
    e = endpoints(nodes, edges.where(F.col("kind").isin(kinds)), ["repo_prefix"])
    return e.where("from_repo_prefix <> '' AND to_repo_prefix <> '' AND from_repo_prefix <> to_repo_prefix")


def cross_repo_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges, and beside each call, implementation or extension between repositories a parallel cross_repo_ edge."""
    more = cross_repo_candidates(nodes, edges, ["calls", "implements", "extends"]).withColumn("kind", F.concat(F.lit("cross_repo_"), "kind"))
    return edges.unionByName(more.select(*edges.columns))


#: Edge kinds that count as use, by node kind. Fixed values.
USAGE = {"function": ["calls", "references"], "method": ["calls", "implements"], "type": ["references", "instantiates", "implements"], "interface": ["references", "implements"]}


def dead_code_candidates(nodes: DataFrame, edges: DataFrame, usage: dict[str, list[str]] | None = None) -> DataFrame:
    """Nodes of the listed kinds that no edge of their usage kinds reaches; an empty list means any kind."""
    usage = USAGE if usage is None else usage
    spark = nodes.sparkSession
    pairs = spark.createDataFrame([(k, e) for k, es in usage.items() for e in es] or [("", "")], "node_kind string, edge_kind string")
    of = nodes.where(F.col("kind").isin(list(usage)))
    # a target counts once a kind however many edges reach it
    ends = edges.select(F.col("to_id").alias("id"), F.col("kind").alias("edge_kind"))
    if all(usage.values()):
        ends = ends.where(F.col("edge_kind").isin(sorted({e for es in usage.values() for e in es})))
    ends = ends.distinct()
    used = of.select("id", F.col("kind").alias("node_kind")).join(ends, "id").join(F.broadcast(pairs), ["node_kind", "edge_kind"]).select("id")  # pairs: a few literal rows
    any_kinds = [k for k, es in usage.items() if not es]
    if any_kinds:
        used = used.unionByName(of.where(F.col("kind").isin(any_kinds)).select("id").join(ends.select("id"), "id", "left_semi"))
    return of.join(used, "id", "left_anti")


def members_by_type(nodes: DataFrame, edges: DataFrame, member_kinds: list[str]) -> DataFrame:
    """(type_id, members): sorted distinct member ids of each type."""
    m = nodes.where(F.col("kind").isin(member_kinds)).select(F.col("id").alias("from_id"))
    return edges.where("kind = 'member_of'").join(m, "from_id", "left_semi").groupBy(F.col("to_id").alias("type_id")).agg(F.sort_array(F.collect_set("from_id")).alias("members"))


def structural_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return adjacency_rows(nodes, edges, STRUCTURAL, ["type", "interface"])


def adjacency_rows(nodes: DataFrame, edges: DataFrame, edge_kinds: list[str], node_kinds: list[str]) -> DataFrame:
    e = endpoints(nodes, edges.where(F.col("kind").isin(edge_kinds)), ["kind"])
    return e.where(F.col("from_kind").isin(node_kinds) & F.col("to_kind").isin(node_kinds)).select("from_id", "to_id", "kind", "origin")


def infer_implements(members: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(type_id, iface_id): types whose method names contain all of an interface's. members(type_id, name), interfaces(iface_id, name)."""
    sets = lambda d, c: d.distinct().groupBy(c).agg(F.sort_array(F.collect_set("name")).alias("names"))
    of, want = cut(sets(members, "type_id")), cut(sets(interfaces, "iface_id"))
    # equal name sets fold into one before anything is paired
    kinds, needs = cut(of.select("names").distinct()), cut(want.select("names").distinct())
    met = kinds.select("names", F.explode("names").alias("name")).join(needs.select(F.col("names").alias("need"), F.explode("names").alias("name")), "name")
    fits = met.groupBy("names", "need").agg(F.count("*").alias("have")).where(F.col("have") == F.size("need")).select("names", "need")
    # a class holds most types and another most interfaces: pairs are written out by shares of the types
    dealt = of.select("type_id", "names", F.pmod(F.xxhash64("type_id"), F.lit(SHARES)).alias("_share"))
    asked = fits.join(want.select("iface_id", F.col("names").alias("need")), "need").select("names", "iface_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("_share"))
    return dealt.join(asked, ["names", "_share"]).where("type_id <> iface_id").select("type_id", "iface_id")


def infer_overrides(members: DataFrame, parents: DataFrame) -> DataFrame:
    """(method, overridden, origin): same name in a direct parent. members(type_id, method_id, name), parents(from_id, to_id, origin)."""
    c = members.select(F.col("type_id").alias("from_id"), F.col("method_id").alias("method"), "name")
    p = members.select(F.col("type_id").alias("to_id"), F.col("method_id").alias("overridden"), "name")
    # a method meets a parent once, however many of its types have it, and then only that parent's members of its name
    met = parents.join(c, "from_id").select("method", "name", "to_id", "origin").distinct()
    return met.join(p, ["to_id", "name"]).where("method <> overridden").select("method", "overridden", "origin").distinct().groupBy("method", "overridden").agg(F.max("origin").alias("origin"))


def contract_match(contracts: DataFrame) -> DataFrame:
    """(ws, proj, contract_id, provider, consumer, cross_repo): every consumer with every provider, orphans with a null side."""
    ws = F.coalesce(F.nullif("workspace_id", F.lit("")), "repo_prefix").alias("ws")
    proj = F.coalesce(F.nullif("project_id", F.lit("")), "repo_prefix").alias("proj")
    keys = ["ws", "proj", "contract_id"]
    p = contracts.where("role = 'provider'").select(ws, proj, "contract_id", F.col("symbol_id").alias("provider"), F.col("repo_prefix").alias("p_repo"))
    c = contracts.where("role = 'consumer'").select(ws, proj, "contract_id", F.col("symbol_id").alias("consumer"), F.col("repo_prefix").alias("c_repo"))
    return p.join(c, keys, "full_outer").select(*keys, "provider", "consumer", (F.col("p_repo") != F.col("c_repo")).alias("cross_repo"))


#: Lines that share a bin in joins of lines with symbols.
BIN = 256


def _binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows with a copy for each bin of lines that they touch: files of many symbols join by (file, bin), not by file alone."""
    return rows.select("*", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.greatest(F.col(start), F.col(end)) / BIN))).alias("_bin"))


def around_lines(points: DataFrame, nodes: DataFrame, line: str) -> DataFrame:
    """points(file_path, <line>, ...) with every symbol (id, start_line, end_line) around each."""
    n = _binned(nodes.where("start_line > 0").select("id", "file_path", "start_line", "end_line"), "start_line", "end_line")
    return points.withColumn("_bin", F.floor(F.col(line) / BIN)).join(n, ["file_path", "_bin"]).where(F.col(line).between(F.col("start_line"), F.col("end_line"))).drop("_bin")


def range_overlap(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols whose lines a diff hunk (file_path, h_start, h_end) touches, joined by file and bin of lines; a pair that shares several bins counts in the first."""
    h, n = _binned(hunks, "h_start", "h_end"), _binned(nodes.where("start_line > 0"), "start_line", "end_line")
    both = h.join(n, ["file_path", "_bin"]).where("start_line <= h_end AND end_line >= h_start")
    return both.where(F.col("_bin") == F.floor(F.greatest("h_start", "start_line") / BIN)).drop("_bin")


def innermost_at(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points(file_path, line) with the shortest symbol around each; ties by id."""
    hit = around_lines(points, nodes, "line")
    return hit.groupBy("file_path", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id")).alias("m")).select("file_path", "line", F.col("m.id").alias("id"))


def coverage(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, total, hit, coverage_pct): segments(file_path, start, statements, count) belong to the symbols around their first line."""
    j = around_lines(segments, nodes, "start")
    g = j.groupBy("id").agg(F.sum("statements").alias("total"), F.sum(F.when(F.col("count") > 0, F.col("statements")).otherwise(0)).alias("hit"))
    return g.where("total > 0").withColumn("coverage_pct", F.round(100.0 * F.col("hit") / F.col("total"), 2))


def blame(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, last_author, last_ts, commits, authors) from lines(file_path, line, author, commit, ts)."""
    j = around_lines(lines, nodes, "line")
    return j.groupBy("id").agg(
        F.max(F.struct("ts", "author")).alias("m"), F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors")
    ).select("id", F.col("m.author").alias("last_author"), F.col("m.ts").alias("last_ts"), "commits", "authors")


def churn(lines: DataFrame, nodes: DataFrame, now) -> DataFrame:
    """(id, commits, first_ts, age_days, per_month)."""
    j = around_lines(lines, nodes, "line")
    g = j.groupBy("id").agg(F.countDistinct("commit").alias("commits"), F.min("ts").alias("first_ts"))
    age = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp("first_ts")) / 86400).cast("long")
    return g.withColumn("age_days", age).withColumn("per_month", F.round(F.col("commits") / F.greatest(F.lit(1.0), F.col("age_days") / 30.0), 4))


def owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(file_path) with the owner of the last rule(rule_no, prefix, owner) that fits; the rule list is a small file."""
    hit = paths.join(rules, F.col("file_path").startswith(F.col("prefix")))
    return hit.groupBy("file_path").agg(F.max_by("owner", "rule_no").alias("owner"))


def co_change_pairs(commits: DataFrame, min_files: int = 2, max_files: int = 40, min_count: int = 2) -> DataFrame:
    """(a, b, together, score) of files that change in one commit; commits(commit, file). Commits outside the size range say nothing."""
    c = commits.select("commit", "file").distinct()
    sized = c.join(c.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(min_files, max_files)), "commit", "left_semi")
    touches = sized.groupBy("file").agg(F.count("*").alias("t"))
    # pairs leave a commit as combinations of its sorted, bounded file list: no self-join
    lists = sized.groupBy("commit").agg(F.sort_array(F.collect_list("file")).alias("fs"))
    a = lists.select(F.posexplode("fs").alias("i", "a"), "fs")
    pairs = a.select("a", F.explode(F.expr("slice(fs, i + 2, size(fs))")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= min_count)
    return (
        pairs.join(touches.select(F.col("file").alias("a"), F.col("t").alias("ta")), "a").join(touches.select(F.col("file").alias("b"), F.col("t").alias("tb")), "b")
        .select("a", "b", "together", F.round(F.least(F.lit(1.0), F.col("together") / F.sqrt(F.col("ta") * F.col("tb"))), 6).alias("score"))
    )


def resolve(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """refs(ref_id, name, file_path, repo_prefix) with their best definition: same file, then same folder, then same repository; ties by id."""
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    d = defs.select("name", "id", "file_path", folder("file_path").alias("folder"), "repo_prefix")
    # definitions fold to one row a name and place first: references never meet all definitions of their name
    j = refs.select("ref_id", "name", "file_path", folder("file_path").alias("folder"), "repo_prefix").join(d.groupBy("name").agg(F.min("id").alias("d3"), F.count("*").alias("n")), "name")
    for i, place in enumerate(("file_path", "folder", "repo_prefix")):
        j = j.join(d.groupBy("name", place).agg(F.min("id").alias(f"d{i}"), F.lit(True).alias(f"is{i}")), ["name", place], "left")
    rank = F.when(F.col("is0"), 0).when(F.col("is1"), 1).when(F.col("is2"), 2).otherwise(3)
    best = j.select("ref_id", F.struct(rank.alias("rank"), F.when(F.col("is0"), F.col("d0")).when(F.col("is1"), F.col("d1")).when(F.col("is2"), F.col("d2")).otherwise(F.col("d3")).alias("def_id")).alias("m"), "n")
    return best.groupBy("ref_id").agg(F.min("m").alias("m"), F.sum("n").alias("candidates")).select("ref_id", F.col("m.def_id").alias("def_id"), F.col("m.rank").alias("rank"), "candidates")


def resolve_files(refs: DataFrame, defs: DataFrame, changed: DataFrame) -> DataFrame:
    """:func:`resolve` for the references of changed files (file_path) alone, against definitions with their names alone."""
    mine = refs.join(changed.select("file_path").distinct(), "file_path", "left_semi").select(*refs.columns)
    return resolve(mine, defs.join(mine.select("name").distinct(), "name", "left_semi").select(*defs.columns))


def resolve_across(refs: DataFrame, defs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(ref_id, def_id, rank, candidates): a definition in the reference's own repository (rank 0), else in another one that its file imports (rank 1).

    evidence(file_path, repo_prefix) says which repositories a file imports: without it no reference leaves its repository.
    """
    # one row a name and repository: references never meet all definitions of their name
    d = defs.groupBy("name", F.col("repo_prefix").alias("d_repo")).agg(F.min("id").alias("def_id"), F.count("*").alias("n"))
    at_home = refs.join(d, (refs.name == d.name) & (refs.repo_prefix == d.d_repo)).select("ref_id", "def_id", F.lit(0).alias("rank"), "n")
    allowed = refs.select("ref_id", "name", "file_path", F.col("repo_prefix").alias("r_repo")).join(evidence.select("file_path", F.col("repo_prefix").alias("d_repo")).distinct(), "file_path").where("r_repo <> d_repo")
    away = allowed.join(d, ["name", "d_repo"]).select("ref_id", "def_id", F.lit(1).alias("rank"), "n")
    per = at_home.unionByName(away).groupBy("ref_id", "rank").agg(F.min("def_id").alias("def_id"), F.sum("n").alias("candidates"))
    return per.groupBy("ref_id").agg(F.min(F.struct("rank", "def_id", "candidates")).alias("m")).select("ref_id", "m.def_id", "m.rank", "m.candidates")


def overlay(base: DataFrame, changed: DataFrame, tombstones: DataFrame) -> DataFrame:
    """base rows with those of changed and deleted files replaced; tombstones(file_path)."""
    gone = changed.select("file_path").union(tombstones.select("file_path")).distinct()
    return base.join(gone, "file_path", "left_anti").select(*base.columns).unionByName(changed.select(*base.columns))


def band_pairs(signatures: DataFrame, bands: int = 16, rows: int = 4) -> DataFrame:
    """(a, b) of ids that share a band of their signature; signatures(id, sig array<bigint>). Exact copies fold first: only one id a signature is paired."""
    one = signatures.groupBy("sig").agg(F.min("id").alias("id"))
    keys = one.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))).alias("band", "key"))
    b = keys.withColumnRenamed("id", "b")
    return keys.withColumnRenamed("id", "a").join(b, ["band", "key"]).where("a < b").select("a", "b").distinct()


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the last by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
