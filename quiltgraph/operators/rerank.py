"""Nineteen-signal reranking of search candidates, and the query shapes that weigh its channels.

Candidates are rows (query, id, text_rank, vector_rank, kind, name, qual_name, signature, file_path, repo_prefix,
project_id, churn, authored_at); ranks count from 0 and are null where a channel did not find the row. ``signals``
adds one column a signal, each within 0 and 1, from windows over the batch of a query and from joins with edges and
optional tables; ``score`` adds them up. All of it is DataFrame code: nothing is collected, and a batch of a query is a window.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

# Weights of the signals.
WEIGHTS = {
    "bm25": 1.0, "semantic": 0.8, "fan_in": 0.6, "hits": 0.4, "fan_out": 0.2, "churn": 0.3, "co_change": 0.25, "community": 0.3, "minhash": 0.3,
    "api_signature": 0.45, "type_signature": 0.45, "recency": 0.3, "feedback": 0.5, "file_coherence": 0.3, "path_penalty": 0.4,
    "definition_bias": 0.6, "source_bias": 0.25, "provenance": 0.15, "proximity": 0.45,
}
# Multipliers of (bm25, semantic, proximity) by query class, and the vector share (alpha) of each class.
CLASS_WEIGHTS = {"concept": (1.0, 1.0, 1.3), "symbol": (1.2, 0.65, 0.55), "path": (1.25, 0.45, 0.4), "signature": (1.1, 0.8, 0.75), "soup": (1.2, 0.5, 0.6)}
ALPHA = {"symbol": 0.3, "concept": 0.5, "path": 0.15, "signature": 0.35, "soup": 0.3}
# Words that mark a question.
STOPWORDS = ["how", "does", "do", "the", "a", "an", "of", "to", "is", "are", "in", "on", "for", "and", "or", "with", "where", "what", "when", "why", "which", "this", "that", "from", "by", "as", "about", "into", "via"]
# Demotion of paths.
PATH_PENALTY = {"test": 0.3, "generated": 0.4, "compat": 0.5, "examples": 0.5, "type_decl": 0.7, "reexport": 0.7}
PATH_RULES = [
    ("test", r"(?i)(^|/)(__tests__|tests?|specs?|e2e|fixtures?|testdata)(/|$)|_(test|spec)\.[a-z]+$|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.(py|c|cc|cpp|cxx)$|tests?\.(swift|java|kt|scala|cs|php)$|_(tests|suite)\.erl$"),
    ("compat", r"(?i)(^|/)(compat|legacy|polyfills?|shims?|backports?|deprecated)(/|$)"),
    ("examples", r"(?i)(^|/)(examples?|demos?|samples?|sandbox|playground)(/|$)"),
    ("type_decl", r"(?i)\.(d\.[cm]?ts|pyi|hpp|hxx|hh)$|(^|/)include/.*\.h$"),
    ("reexport", r"(?i)(^|/)(index\.([cm]js|[jt]sx?)|__init__\.py|(mod|lib)\.rs)$"),
]
DEFINITIONS = ["function", "method", "type", "interface", "constant", "variable", "field", "enum_member"]
HALF_LIFE_DAYS, RANK_K, CENTRAL_SEEDS = 30.0, 60.0, 8


# Query shape


def is_symbol(q: Column) -> Column:
    """One token in the form of an identifier: qualified, snake or camel case, or all capitals."""
    q = F.trim(q)
    letters = F.regexp_replace(q, r"[^\p{L}]", "")
    joined = q.rlike(r"::|[./\\_]") & q.rlike(r"[\p{L}\p{Nd}]")
    camel = q.rlike(r"\p{Ll}\p{Lu}|\p{Lu}\p{Ll}")
    capitals = (F.length(q) >= 2) & (letters != "") & ~letters.rlike(r"[^\p{Lu}]")
    return (q != "") & ~q.rlike(r"\s") & (joined | camel | capitals)


def query_class(q: Column) -> Column:
    """soup, signature, path, symbol or concept."""
    t = F.trim(q)
    soup = t.rlike(r"\bOR\b.*\bOR\b|,[^,]*,|\|[^|]*\|")
    signature = t.rlike(r"[()]|->|=>")
    path = ~t.rlike(r"\s") & t.rlike(r"[/\\]") & t.rlike(r"[\p{L}\p{Nd}]")
    return F.when(t == "", "concept").when(soup, "soup").when(signature, "signature").when(path, "path").when(is_symbol(t), "symbol").otherwise("concept")


def identifier_score(q: Column) -> Column:
    """How much of a query reads like identifiers, 0 to 1; stop words and length count against it."""
    ts = F.filter(F.split(F.trim(q), r"\s+"), lambda x: x != "")
    n = F.size(ts)
    ids = F.size(F.filter(ts, is_symbol))
    stops = F.size(F.filter(ts, lambda x: F.lower(x).isin(STOPWORDS)))
    many = ids / n - stops / n - 0.12 * (n - 2)
    return F.when(n == 0, 0.0).when(n == 1, F.when(ids == 1, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), many)))


def alpha(q: Column) -> Column:
    """Share of the vector channel: pinned for soup, signature and path, else between symbol and concept by :func:`identifier_score`."""
    c = query_class(q)
    pinned = F.when(c == "soup", ALPHA["soup"]).when(c == "signature", ALPHA["signature"]).when(c == "path", ALPHA["path"])
    return F.coalesce(pinned, ALPHA["concept"] + identifier_score(q) * (ALPHA["symbol"] - ALPHA["concept"]))


def multipliers(a: Column) -> tuple[Column, Column, Column]:
    """Multipliers of bm25, semantic and proximity for a share alpha, from those of a concept down to those of a path."""
    part = (ALPHA["concept"] - F.greatest(F.lit(ALPHA["path"]), F.least(F.lit(ALPHA["concept"]), a))) / (ALPHA["concept"] - ALPHA["path"])
    return tuple(lo + part * (hi - lo) for lo, hi in zip(CLASS_WEIGHTS["concept"], CLASS_WEIGHTS["path"]))


# Signals


def by_rank(rank: Column) -> Column:
    return F.coalesce((RANK_K + 1) / (RANK_K + rank + 1), F.lit(0.0))


def of_top(n: Column, over) -> Column:
    """log1p of a count over that of the batch's largest."""
    top = F.max(n).over(over)
    return F.when((n > 0) & (top > 0), F.log1p(n) / F.log1p(top)).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Share of the different tokens of a that b holds."""
    one = F.array_distinct(a)
    return F.when(F.size(one) > 0, F.size(F.array_intersect(one, b)) / F.size(one)).otherwise(0.0)


def path_class(path: Column) -> Column:
    out = F.when(F.coalesce(path, F.lit("")) == "", F.lit(None).cast("string"))
    for name, pattern in PATH_RULES:
        out = out.when(path.rlike(pattern), name)
    return out


def path_penalty(path: Column) -> Column:
    c = path_class(path)
    out = F.lit(1.0)
    for name, v in PATH_PENALTY.items():
        out = F.when(c == name, v).otherwise(out)
    return out


def file_coherence(cands: DataFrame) -> DataFrame:
    """cands(query, id, file_path, text_rank, vector_rank) with coherence: a file's sum of rank scores over that of the batch's best file; a file with one candidate says nothing."""
    s = by_rank(F.col("text_rank")) + by_rank(F.col("vector_rank"))
    per_file = cands.groupBy("query", "file_path").agg(F.sum(s).alias("_sum"), F.count("*").alias("_n"))
    top = per_file.groupBy("query").agg(F.max("_sum").alias("_top"))
    j = cands.join(per_file, ["query", "file_path"], "left").join(top, "query", "left")
    good = (F.coalesce("file_path", F.lit("")) != "") & (F.col("_n") >= 2) & (F.col("_top") > 0)
    return j.withColumn("coherence", F.when(good, F.col("_sum") / F.col("_top")).otherwise(0.0)).drop("_sum", "_n", "_top")


def provenance(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, provenance): the mean weight of calls and references into a node, mapped to 0 and 1."""
    e = edges.where("kind IN ('calls', 'references')").select(F.col("to_id").alias("id"), S.provenance_weight(F.col("origin")).alias("w")).join(ids.select("id").distinct(), "id", "left_semi")
    low, high = S.PROVENANCE_RANGE
    mean = F.sum(F.round(F.col("w") * 1000).cast("long")) / F.count("*") / 1000  # whole numbers: no order of addition shows
    return e.groupBy("id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean - low) / (high - low))).alias("provenance"))


def test_stem(name: Column) -> Column:
    """The name that a test is for."""
    s = F.regexp_replace(F.lower(F.trim(name)), "^test_?", "")
    return F.regexp_replace(F.regexp_replace(s, "_?(test|spec)$", ""), "^_+|_+$", "")


def definition_bias(query: Column, kind: Column, name: Column, path: Column) -> Column:
    q, n = F.lower(F.trim(query)), F.lower(name)
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", "")) == q
    prefix = (F.length(n) >= 4) & (F.length(q) >= 4) & (F.substring(n, 1, 4) == F.substring(q, 1, 4))
    hit = F.when(n == q, 1.0).when(prefix & ~stem, 0.4).when(stem, 0.6).otherwise(0.0)
    return F.when(is_symbol(query) & kind.isin(DEFINITIONS), hit).otherwise(0.0)


def central_seeds(cands: DataFrame, k: int = CENTRAL_SEEDS) -> DataFrame:
    """(query, id) of the k candidates of best rank in either channel: the seeds of proximity."""
    far = F.lit(2**31 - 1)
    w = Window.partitionBy("query").orderBy(F.least(F.coalesce("text_rank", far), F.coalesce("vector_rank", far)), "id")
    return cands.select("query", "id", F.row_number().over(w).alias("_n")).where(F.col("_n") <= k).drop("_n")


def signals(cands: DataFrame, edges: DataFrame, now, extra: dict[str, DataFrame] | None = None, home_repo: str = "") -> DataFrame:
    """cands with a column s_<signal> for each of the 19.

    extra may hold: hits(id, hub, authority), community(id, community), feedback(id, feedback), frecency(id, boost),
    combo(query, id, boost), co_change(a, b, score) of files in both orders, centrality(query, id, score),
    similar(a, b, sim) in both orders. A signal without its table is 0.
    """
    extra = extra or {}
    batch = Window.partitionBy("query")
    ids = cands.select("id").distinct()
    count = lambda c, o: edges.select(F.col(c).alias("id")).join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias(o))
    c = cands.join(count("to_id", "_in"), "id", "left").join(count("from_id", "_out"), "id", "left").join(provenance(edges, ids), "id", "left")
    c = file_coherence(c).fillna(0, ["_in", "_out", "provenance"])

    def with_table(c, name, keys, columns):
        if name in extra:
            return c.join(extra[name].select(*keys, *columns), keys, "left")
        for x in columns:
            c = c.withColumn(x, F.lit(None).cast("string" if x == "community" else "double"))
        return c

    c = with_table(c, "hits", ["id"], ["hub", "authority"])
    c = with_table(c, "community", ["id"], ["community"])
    c = with_table(c, "feedback", ["id"], ["feedback"])
    frecent = {**extra, "frecency": extra["frecency"].withColumnRenamed("boost", "_frecency")} if "frecency" in extra else extra
    combos = {**frecent, "combo": extra["combo"].withColumnRenamed("boost", "_combo")} if "combo" in extra else frecent
    extra = combos
    c = with_table(c, "frecency", ["id"], ["_frecency"])
    c = with_table(c, "combo", ["query", "id"], ["_combo"])
    if "centrality" in extra:
        c = c.join(extra["centrality"].select("query", "id", F.col("score").alias("_central")), ["query", "id"], "left")
    else:
        c = c.withColumn("_central", F.lit(0.0))
    # files of the batch that change together with the row's file
    if "co_change" in extra:
        files = cands.where("coalesce(file_path, '') <> ''").select("query", "file_path").distinct()
        pairs = files.join(extra["co_change"].select(F.col("a").alias("file_path"), "b", "score"), "file_path").join(files.select("query", F.col("file_path").alias("b")), ["query", "b"]).where("score > 0 AND b <> file_path")
        c = c.join(pairs.groupBy("query", "file_path").agg(F.least(F.lit(1.0), F.avg("score")).alias("_together")), ["query", "file_path"], "left")
    else:
        c = c.withColumn("_together", F.lit(0.0))
    if "similar" in extra:
        rows = cands.select("query", "id").distinct()
        near = rows.join(extra["similar"].select(F.col("a").alias("id"), "b", "sim"), "id").join(rows.select("query", F.col("id").alias("b")), ["query", "b"]).where("sim > 0")
        c = c.join(near.groupBy("query", "id").agg(F.least(F.lit(1.0), F.avg("sim")).alias("_alike")), ["query", "id"], "left")
    else:
        c = c.withColumn("_alike", F.lit(0.0))
    # names of tests in the batch, and rows that they are for
    stems = cands.where(path_class(F.col("file_path")) == "test").select("query", test_stem(F.col("name")).alias("_low")).where("_low <> ''").distinct().withColumn("_tested", F.lit(True))
    c = c.withColumn("_low", F.lower("name")).join(stems, ["query", "_low"], "left")
    q = S.query_tokens(F.col("query"))
    tokens = lambda x: S.query_tokens(F.coalesce(F.col(x), F.lit("")))
    days = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("authored_at")) / 86400.0)
    members = F.count("community").over(Window.partitionBy("query", "community"))
    c = c.withColumn("_members", F.when(F.col("community").isNotNull(), members).otherwise(0))
    top = F.max("_members").over(batch)
    together = F.when((F.col("_members") > 1) & (top > 1), F.col("_members") / top).otherwise(0.0)
    home = F.when(F.lit(home_repo != "") & (F.col("repo_prefix") == home_repo), 1.0).otherwise(0.0)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))
    is_type = F.col("kind").isin("type", "interface", "enum_member", "field")
    is_code = F.col("kind").isin("function", "method") & (F.coalesce("signature", F.lit("")) != "")
    out = {
        "bm25": by_rank(F.col("text_rank")), "semantic": by_rank(F.col("vector_rank")),
        "fan_in": of_top(F.col("_in"), batch), "fan_out": of_top(F.col("_out"), batch),
        "hits": F.col("authority") / (1 + F.coalesce("hub", F.lit(0.0))), "churn": of_top(F.coalesce("churn", F.lit(0)), batch),
        "co_change": F.col("_together"), "community": F.greatest(together, home), "minhash": F.col("_alike"),
        "api_signature": F.when(is_code, overlap(q, F.concat(tokens("signature"), tokens("name")))).otherwise(0.0),
        "type_signature": F.when(is_type, overlap(q, F.concat(tokens("name"), tokens("signature"), tokens("qual_name")))).otherwise(0.0),
        "recency": F.when(F.col("authored_at").isNotNull(), F.exp(-F.log(F.lit(2.0)) / HALF_LIFE_DAYS * days)),
        "feedback": F.greatest(clamp(F.col("feedback")), clamp((F.col("_frecency") - 1) / 0.5), clamp((F.col("_combo") - 1) / 2.0)),
        "file_coherence": F.col("coherence"), "path_penalty": path_penalty(F.col("file_path")),
        "definition_bias": definition_bias(F.col("query"), F.col("kind"), F.col("name"), F.col("file_path")),
        "source_bias": F.when(F.col("_tested") & ~F.coalesce(path_class(F.col("file_path")) == "test", F.lit(False)) & (F.coalesce("file_path", F.lit("")) != ""), 1.0).otherwise(0.0),
        "provenance": F.col("provenance"), "proximity": F.col("_central"),
    }
    return c.select(*[f"`{x}`" for x in cands.columns], *[clamp(v).alias(f"s_{k}") for k, v in out.items()])


def score(rows: DataFrame, weights: dict[str, float] = WEIGHTS, continuous: bool = True) -> DataFrame:
    """rows of :func:`signals` with score and rank; ties by text rank (null last), then id."""
    if continuous:
        bm25, semantic, proximity = multipliers(alpha(F.col("query")))
    else:
        cls = query_class(F.col("query"))
        pick = lambda i: F.coalesce(*[F.when(cls == k, v[i]) for k, v in CLASS_WEIGHTS.items()])
        bm25, semantic, proximity = pick(0), pick(1), pick(2)
    by = {"bm25": bm25, "semantic": semantic, "proximity": proximity}
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + w * by.get(k, F.lit(1.0)) * F.col(f"s_{k}")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("text_rank"), "id")
    return rows.withColumn("score", F.round(total, 9)).withColumn("rank", F.row_number().over(order))


# Retrieval around it


def head_refine(ranked: DataFrame, head: int = 32) -> DataFrame:
    """ranked(list, id, rank, cosine) with refined: the first ``head`` rows by cosine, those without one after them, the tail as it was."""
    inside = F.col("rank") <= head
    order = [F.when(inside, 0).otherwise(1), F.when(inside & F.col("cosine").isNotNull(), 0).otherwise(1), F.when(inside, -F.col("cosine")), "rank"]
    return ranked.withColumn("refined", F.row_number().over(Window.partitionBy("list").orderBy(*order)))


def rank_reset(hits: DataFrame) -> DataFrame:
    """hits(list, channel, repo_prefix, id, rank) with the ranks of each channel counted from 0 inside each repository."""
    w = Window.partitionBy("list", "channel", "repo_prefix").orderBy("rank", "id")
    return hits.withColumn("rank", F.row_number().over(w) - 1)


def graph_completion(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, per_seed: int = 8, limit: int | None = None) -> DataFrame:
    """(query, id, is_seed): seeds(query, id, rank) and up to ``per_seed`` real neighbours of each that no earlier seed named."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    step = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).distinct().join(nodes.select(F.col("id").alias("other")), "other", "left_semi")
    new = seeds.join(step, "id").join(seeds.select("query", F.col("id").alias("other")), ["query", "other"], "left_anti")
    first = Window.partitionBy("query", "other").orderBy("rank", "id")
    owned = new.withColumn("_f", F.row_number().over(first)).where("_f = 1")
    per = Window.partitionBy("query", "id").orderBy("other")
    grown = owned.withColumn("_n", F.row_number().over(per)).where(F.col("_n") <= per_seed)
    out = seeds.select("query", "id", F.lit(True).alias("is_seed"), "rank", F.lit(0).alias("_n")).unionByName(grown.select("query", F.col("other").alias("id"), F.lit(False).alias("is_seed"), "rank", "_n"))
    if limit is None:
        return out.select("query", "id", "is_seed")
    w = Window.partitionBy("query").orderBy(F.desc("is_seed"), "rank", "_n", "id")
    return out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).select("query", "id", "is_seed")


#: Kept for callers that classify a single query on the driver.
def class_of(q: str) -> str:
    t = q.strip()
    if not t:
        return "concept"
    if re.search(r"\bOR\b.*\bOR\b|,[^,]*,|\|[^|]*\|", t):
        return "soup"
    if re.search(r"[()]|->|=>", t):
        return "signature"
    if not re.search(r"\s", t) and re.search(r"[/\\]", t) and re.search(r"\w", t):
        return "path"
    letters = [x for x in t if x.isalpha()]
    joined = re.search(r"::|[./\\_]", t) and any(x.isalnum() for x in t)
    camel = any(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in zip(t, t[1:]))
    capitals = len(t) >= 2 and letters and all(x.isupper() for x in letters)
    return "symbol" if not re.search(r"\s", t) and (joined or camel or capitals) else "concept"
