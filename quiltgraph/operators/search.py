"""Text and vector retrieval: postings, BM25, grep, nearest neighbours, fusion, clones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, id, tf, len) of docs(id, ...)."""
    d = docs.select("id", tokens.alias("ts"))
    return d.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], tokens: Column, k: int | None = None) -> DataFrame:
    """(id, score). A term that the query repeats counts each time. Statistics and scores come from one pass each over docs."""
    d = docs.select("id", tokens.alias("ts")).withColumn("len", F.size("ts"))
    terms = sorted(set(query))
    count = lambda t: F.size(F.filter("ts", lambda x: x == F.lit(t)))
    tf = {t: count(t) for t in terms}
    rows = d.select("id", "len", *[tf[t].alias(f"t{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = rows.where(" OR ".join(f"t{i} > 0" for i in range(len(terms))) or "false").join(F.broadcast(stats), F.lit(True))  # stats: one row
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        x = F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        score = score + query.count(t) * idf * x
    out = hit.select("id", F.round(score, 6).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def trigram_candidates(docs: DataFrame, text: Column, query: str) -> DataFrame:
    """Docs that hold every trigram of the query."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    keep = F.lit(True)
    for g in grams:
        keep = keep & F.contains(text, F.lit(g))
    return docs.where(keep)


def grep(docs: DataFrame, text: Column, literal: str | None = None, regex: str | None = None) -> DataFrame:
    """(id, line_no, line) of matching lines; the whole text is tested before it is cut into lines."""
    test = (lambda c: F.contains(c, F.lit(literal))) if literal is not None else (lambda c: c.rlike(regex))
    d = docs.select("id", text.alias("t")).where(F.contains("t", F.lit(literal)) if literal is not None else F.col("t").rlike(f"(?m){regex}"))
    return d.select("id", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line")).where(test(F.col("line")))


def bigram_rescue(names: DataFrame, query: str, least: int) -> DataFrame:
    """(id, shared) of names(id, name) that share at least so many bigrams with the query."""
    grams = F.array(*[F.lit(g) for g in sorted({query[i : i + 2] for i in range(len(query) - 1)})])
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))), lambda i: F.substring(F.lower("name"), i, F.lit(2))))
    return names.select("id", F.size(F.array_intersect(own, grams)).alias("shared")).where(F.col("shared") >= least)


def trigram_index(docs: DataFrame, text: Column) -> DataFrame:
    """(gram, id): the different trigrams of each lower-cased text; to be stored, sorted by gram."""
    t = F.lower(F.coalesce(text, F.lit("")))
    # characters as an array: a substring at a place would walk a long text from its start each time
    d = docs.select("id", F.split(t, "").alias("cs")).where(F.size("cs") >= 3)
    at = lambda i: F.get("cs", i)
    grams = F.transform(F.sequence(F.lit(0), F.size("cs") - 3), lambda i: F.concat(at(i), at(i + 1), at(i + 2)))
    return d.select("id", F.explode(F.array_distinct(grams)).alias("gram"))


def trigram_lookup(index: DataFrame, query: str) -> DataFrame:
    """(id) of the texts with every trigram of a query of three letters or more: its postings alone are read, and counted."""
    grams = sorted({query.lower()[i : i + 3] for i in range(len(query) - 2)})
    return index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def search_bundle(nodes: DataFrame, edges: DataFrame, prefix: str, k: int) -> DataFrame:
    """(id, name, rank, n_out, n_in): the k nodes whose names have the largest share of words with the prefix, with their edges counted."""
    ws = F.split(F.lower("name"), " ")
    share = F.size(F.filter(ws, lambda x: x.startswith(prefix))) / F.size(ws)
    hits = nodes.withColumn("share", share).where("share > 0").orderBy(F.desc("share"), "id").limit(k)  # k rows
    ranked = hits.select("id", "name", F.row_number().over(Window.orderBy(F.desc("share"), "id")).alias("rank"))
    near = lambda c, o: edges.select(F.col(c).alias("id")).join(F.broadcast(ranked.select("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias(o))
    return ranked.join(near("from_id", "n_out"), "id", "left").join(near("to_id", "n_in"), "id", "left").fillna(0, ["n_out", "n_in"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, distance): exact cosine; vectors of another length or of norm zero are skipped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
    d = vectors.where(F.size("vec") == len(query)).select("id", dot(F.col("vec"), q).alias("d"), norm.alias("n")).where("n > 0")
    qn = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    return d.select("id", F.abs(F.round(1 - F.col("d") / (F.col("n") * F.lit(qn)), 6)).alias("distance")).orderBy("distance", "id").limit(k)


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query, id, distance): k nearest for each query vector. Queries go to every task in blocks of bounded size; each task keeps k a query."""
    rows = queries.count()
    out = None
    blocks = max(1, -(-rows // block))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries
        q = part.select("id", "vec").toPandas()  # at most about block rows
        if not len(q):
            continue
        ids, m = q["id"].to_numpy(), np.stack(q["vec"].map(np.asarray)).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        def run(frames, ids=ids, m=m):
            best_d, best_i = np.full((len(ids), 0), 0.0), np.empty((len(ids), 0), np.int64)
            for f in frames:
                v = np.stack(f["vec"].map(np.asarray)).astype(np.float64)
                n = np.linalg.norm(v, axis=1)
                d = 1 - m @ (v / np.maximum(n, 1e-300)[:, None]).T
                d[:, n == 0] = np.inf
                best_d = np.concatenate([best_d, d], 1)
                best_i = np.concatenate([best_i, np.broadcast_to(f["id"].to_numpy(), d.shape)], 1)
                o = np.lexsort((best_i, best_d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(best_d, o, 1), np.take_along_axis(best_i, o, 1)
            yield pd.DataFrame({"query": np.repeat(ids, best_d.shape[1]), "id": best_i.ravel(), "distance": np.abs(np.round(best_d.ravel(), 6))})

        got = vectors.select("id", "vec").mapInPandas(run, "query bigint, id bigint, distance double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("query").orderBy("distance", "id")
    return out.where("distance < 'inf'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(text: DataFrame, vector: DataFrame, alpha: float | None = None) -> DataFrame:
    """(id, score) of two ranked lists (id, rank from 0); with alpha the vector list weighs alpha and the text list the rest."""
    a, b = (1.0, 1.0) if alpha is None else (1 - alpha, alpha)
    j = text.select("id", F.col("rank").alias("t")).join(vector.select("id", F.col("rank").alias("v")), "id", "full_outer")
    return j.select("id", F.round(F.coalesce(a / (RRF_K + F.col("t") + 1.0), F.lit(0.0)) + F.coalesce(b / (RRF_K + F.col("v") + 1.0), F.lit(0.0)), 9).alias("score"))


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """(id, <channel>_rank...): the best rank of each id in every channel."""
    out = None
    for name, df in channels.items():
        r = df.groupBy("id").agg(F.min("rank").alias(f"{name}_rank"))
        out = r if out is None else out.join(r, "id", "full_outer")
    return out


def diversify(ranked: DataFrame, per_file: int) -> DataFrame:
    """At most so many rows a file, in rank order."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("rank"))).where(F.col("_n") <= per_file).drop("_n")


def page(ranked: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return ranked.orderBy(*order).offset(offset).limit(limit)


def greedy_pack(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows of each list that fit its budget, taken in rank order, overflow skipped; ranked(list, rank, id, tokens). A list is one response, so small."""

    rest = [c for c in ranked.columns if c not in ("list", "rank", "id", "tokens")]
    row = F.struct("rank", "id", "tokens", *rest)
    held = ranked.groupBy("list").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # what is left of the budget after each row, then the rows that it fell at
    kind = "struct<left: bigint, kept: array<int>, at: int>"
    fits = lambda s, x: F.coalesce(x["tokens"] <= s["left"], F.lit(False))
    step = lambda s, x: F.struct((s["left"] - F.when(fits(s, x), x["tokens"]).otherwise(0)).cast("bigint").alias("left"), F.when(fits(s, x), F.array_append(s["kept"], s["at"])).otherwise(s["kept"]).alias("kept"), (s["at"] + 1).alias("at"))
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<int>").alias("kept"), F.lit(1).alias("at")).cast(kind)
    kept = held.select("list", "rows", F.aggregate("rows", start, step)["kept"].alias("kept"))
    picked = F.transform("kept", lambda i: F.element_at("rows", i))
    return kept.select("list", F.inline(picked)).select(*ranked.columns)


def normalised(count: Column, over: Window) -> Column:
    """log1p of a count over that of the largest in its batch, within 0 and 1."""
    top = F.max(count).over(over)
    return F.when((count <= 0) | (top <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.log1p(count) / F.log1p(top)))


def rerank(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, score): weighted sum of signals clamped to 0 and 1; ties by text rank, then id."""
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + w * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    return candidates.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "text_rank", "id")))


def frecency(log: DataFrame, now, half_life_days: float) -> DataFrame:
    """(id, score): decayed count of accesses(id, ts)."""
    days = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("ts")) / 86400.0
    return log.groupBy("id").agg(F.round(F.sum(F.exp(-F.log(F.lit(2.0)) / half_life_days * days)), 6).alias("score"))


def combo(log: DataFrame, min_hits: int, per_hit: float) -> DataFrame:
    """(query, id, hits, boost) of pairs chosen often enough."""
    g = log.groupBy("query", "id").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)
    return g.withColumn("boost", F.least(F.lit(3.0), 1 + (F.col("hits") - min_hits + 1) * per_hit))


def co_tokens(names: DataFrame, least: int, siblings: int) -> DataFrame:
    """(a, b, n): tokens that occur together in names(id, name); a name has few tokens, so pairs stay few. A token below ``least`` can be in no pair that often, so it goes first."""
    t = names.select("id", F.array_distinct(S.index_tokens(F.col("name"))).alias("ts"))
    top = t.select(F.explode("ts").alias("a")).groupBy("a").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    rows = t.select(F.explode("ts").alias("a"), "ts").join(top.select("a"), "a", "left_semi").select("a", F.explode("ts").alias("b")).where("a <> b").join(top.select(F.col("a").alias("b")), "b", "left_semi")
    g = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return g.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where(F.col("_n") <= siblings).drop("_n")


MOD = 4294967291


def minhash(docs: DataFrame, shingle: int = 3, slots: int = 64, seed: int = 1) -> DataFrame:
    """(id, sig array<bigint>) of docs(id, ts array<string>): minima of (a x + b) mod p over hashed shingles."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, MOD, slots, dtype=np.uint64), rng.integers(0, MOD, slots, dtype=np.uint64)
    hashes = docs.select("id", F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ts") - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("ts", i, shingle)))).alias("hs"))

    def run(frames):
        for f in frames:
            sigs = []
            for hs in f["hs"]:
                x = np.asarray(hs, np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
                low = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(x), 1 << 14):
                    low = np.minimum(low, ((x[at : at + (1 << 14), None] * a % np.uint64(MOD) + b) % np.uint64(MOD)).min(0))
                sigs.append(low.astype(np.int64))
            yield pd.DataFrame({"id": f["id"], "sig": sigs})

    return hashes.mapInPandas(run, "id bigint, sig array<bigint>")


def agreement(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def query_class(q: str) -> str:
    """symbol, path, signature, soup or concept."""
    import re

    if re.search(r"\b(AND|OR|NOT)\b", q) or q.count(",") >= 2:
        return "soup"
    if "(" in q and ")" in q:
        return "signature"
    if "/" in q or re.search(r"\.[a-z]{1,4}$", q):
        return "path"
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.:]*", q) and (re.search(r"[a-z][A-Z]|_|::|\.", q) or q[:1].isupper()):
        return "symbol"
    return "concept"


def soup_terms(q: str) -> list[str]:
    import re

    return [t.strip() for t in re.split(r",|\bOR\b|\bAND\b", q) if t.strip() and t.strip() != "NOT"]
