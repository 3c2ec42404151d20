"""Registered search, ranking, vector and clone queries, and scalar functions, each beside its DuckDB SQL where there is one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as G
from ..operators import joins as J
from ..operators import search as X
from .relational import table


def docs(t, name: str = "documents") -> DataFrame:
    return t(name).select(F.col("doc_id").alias("id"), "text")


_TOK = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^\p{L}\p{Nd}]+'), lambda x: length(x) >= 2)"
table("g1_index_tokens", lambda spark, t: docs(t).select(F.explode(S.index_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")), f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOK}) AS term FROM documents) GROUP BY term")
table("g2_query_tokens", lambda spark, t: t("conversations").select("conv_id", "turn", F.size(S.query_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n")), r"SELECT conv_id, turn, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}_]+'))::BIGINT AS n FROM conversations")
_LOWTOK = r"list_filter(regexp_split_to_array(lower(text), '[ \n.,]+'), lambda x: x <> '')"


def _low(c) -> object:
    return F.filter(F.split(F.lower(c), r"[ \n.,]+"), lambda x: x != "")


_QUERY = ["license", "version", "released", "license"]


def bm25_sql(query: list[str]) -> str:
    parts = []
    for q in sorted(set(query)):
        tf = f"len(list_filter(ts, lambda x: x = '{q}'))"
        df = f"(SELECT count(*) FROM d WHERE list_contains(ts, '{q}'))"
        parts.append(f"{query.count(q)} * ln((n - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE) + 1) * ({tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / av)))")
    return f"WITH d AS MATERIALIZED (SELECT doc_id AS id, {_LOWTOK} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM d) SELECT id, round({' + '.join(parts)}, 6) AS score FROM d, s WHERE list_has_any(ts, {sorted(set(query))!r})"


table("g6_bm25", lambda spark, t: X.bm25(docs(t), _QUERY, _low(F.col("text"))), bm25_sql(_QUERY))
table("g6_bm25_top", lambda spark, t: X.bm25(docs(t), _QUERY, _low(F.col("text")), 20), bm25_sql(_QUERY) + " ORDER BY score DESC, id LIMIT 20")
table("g6_postings", lambda spark, t: X.postings(docs(t), _low(F.col("text"))).select("term", "id", "tf", F.col("len").cast("long").alias("len")), f"SELECT term, id, count(*) AS tf, any_value(l)::BIGINT AS len FROM (SELECT id, unnest(ts) AS term, len(ts) AS l FROM (SELECT doc_id AS id, {_LOWTOK} AS ts FROM documents)) GROUP BY term, id")
table("g7_g8_prefix_search", lambda spark, t: docs(t).select("id", F.size(F.filter(_low(F.col("text")), lambda x: x.startswith("lic"))).cast("long").alias("hits")).where("hits > 0"), f"SELECT doc_id AS id, len(list_filter({_LOWTOK}, lambda x: starts_with(x, 'lic')))::BIGINT AS hits FROM documents WHERE len(list_filter({_LOWTOK}, lambda x: starts_with(x, 'lic'))) > 0")
table("g9_bigram_rescue", lambda spark, t: X.bigram_rescue(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "wigdet", 3), "SELECT p_partkey AS id, len(list_intersect(list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 2))), ['wi', 'ig', 'gd', 'de', 'et'])) AS shared FROM part WHERE len(list_intersect(list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 2))), ['wi', 'ig', 'gd', 'de', 'et'])) >= 3")
table("g10_trigrams", lambda spark, t: X.trigram_candidates(docs(t), F.col("text"), "License").select("id"), "SELECT doc_id AS id FROM documents WHERE contains(text, 'Lic') AND contains(text, 'ice') AND contains(text, 'cen') AND contains(text, 'ens') AND contains(text, 'nse')")
_LINES = "(SELECT doc_id AS id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
table("g11_grep", lambda spark, t: X.grep(docs(t), F.col("text"), "License"), f"SELECT * FROM {_LINES} WHERE contains(line, 'License')")
table("g12_regex_grep", lambda spark, t: X.grep(docs(t), F.col("text"), regex=r"Version [0-9.]+"), f"SELECT * FROM {_LINES} WHERE regexp_matches(line, 'Version [0-9.]+')")


def _expand(spark: SparkSession, t) -> DataFrame:
    classes = F.broadcast(spark.createDataFrame([("license", "licence"), ("license", "licensed"), ("version", "release")], "term string, same string"))
    return docs(t).select("id", F.explode(_low(F.col("text"))).alias("term")).join(classes.select(F.col("same").alias("term"), F.col("term").alias("class")), "term").groupBy("class").agg(F.countDistinct("id").alias("docs"))


table("g13_g14_equivalence", _expand, f"SELECT class, count(DISTINCT id) AS docs FROM (SELECT doc_id AS id, unnest({_LOWTOK}) AS term FROM documents) JOIN (VALUES ('license', 'licence'), ('license', 'licensed'), ('version', 'release')) c(class, same) ON term = same GROUP BY class")


def _vec(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_COS = "abs(round(1 - list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 6))"


def _knn(spark: SparkSession, t) -> DataFrame:
    q = _vec(t).where("id = 0").first()["vec"]
    return X.knn(_vec(t), q, 20)


table("g15_exact_knn", _knn, f"SELECT a.vec_id AS id, {_COS.format(a='a.embedding', b='b.embedding')} AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY distance, id LIMIT 20")
table("g16_knn_join", lambda spark, t: X.knn_join(_vec(t), _vec(t).where("id % 50 = 0"), 10).select("query", "id", "distance", "rank"), f"SELECT query, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM (SELECT q.vec_id AS query, a.vec_id AS id, {_COS.format(a='a.embedding', b='q.embedding')} AS distance FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE rank <= 10")


def _fusion(spark: SparkSession, t, alpha: float | None) -> DataFrame:
    o = t("orders")
    a = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), (F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1).alias("rank"))
    b = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), (F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")) - 1).alias("rank"))
    return X.rrf(a, b, alpha)


def _fusion_sql(a: str, b: str) -> str:
    return f"SELECT id, round(coalesce({a} / (60 + t + 1.0::DOUBLE), 0.0) + coalesce({b} / (60 + v + 1.0::DOUBLE), 0.0), 9) AS score FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS t FROM orders WHERE o_orderstatus = 'P') FULL JOIN (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS v FROM orders WHERE o_orderpriority = '1-URGENT') USING (id)"


table("g17_g18_rrf", lambda spark, t: _fusion(spark, t, None), _fusion_sql("1.0::DOUBLE", "1.0::DOUBLE"))
table("g19_alpha_fusion", lambda spark, t: _fusion(spark, t, 0.25), _fusion_sql("0.75::DOUBLE", "0.25::DOUBLE"))


def _rerank(spark: SparkSession, t) -> DataFrame:
    w = Window.partitionBy("query")
    c = t("orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), F.row_number().over(w.partitionBy("o_custkey").orderBy("o_orderkey")).alias("text_rank"), "o_totalprice", "o_orderdate")
    c = c.withColumn("size", X.normalised(F.col("o_totalprice"), w)).withColumn("age", S.recency(S.age_days(F.lit(dt.datetime(2002, 1, 1)), F.col("o_orderdate")) / 100.0)).withColumn("text", 1.0 / F.col("text_rank"))
    return X.rerank(c, {"size": 0.5, "age": 0.3, "text": 1.0}).select("query", "id", F.round("score", 6).alias("score"), "rank")


table("g23_g26_rerank", _rerank, "SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, text_rank, id) AS rank FROM (SELECT query, id, text_rank, round(0.5::DOUBLE * least(1.0::DOUBLE, ln(1 + p) / ln(1 + max(p) OVER (PARTITION BY query))) + 0.3::DOUBLE * exp(-ln(2.0::DOUBLE) / 30.0::DOUBLE * (floor((epoch(TIMESTAMP '2002-01-01') - epoch(d)) / 86400) / 100.0::DOUBLE)) + 1.0::DOUBLE / text_rank, 9) AS score FROM (SELECT o_custkey AS query, o_orderkey AS id, o_totalprice AS p, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS text_rank FROM orders))")
table("g27_g33_frecency", lambda spark, t: X.frecency(t("events").select(F.col("user_id").alias("id"), "ts"), dt.datetime(2024, 2, 1), 3.0), "SELECT user_id AS id, round(sum(exp(-ln(2.0::DOUBLE) / 3.0::DOUBLE * ((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400.0::DOUBLE))), 6) AS score FROM events GROUP BY 1")
table("g34_combo", lambda spark, t: X.combo(t("events").select(F.col("event_type").alias("query"), F.col("user_id").alias("id")), 5, 0.1).select("query", "id", "hits", F.round("boost", 6).alias("boost")), "SELECT event_type AS query, user_id AS id, count(*) AS hits, round(least(3.0::DOUBLE, 1 + (count(*) - 5 + 1) * 0.1::DOUBLE), 6) AS boost FROM events GROUP BY 1, 2 HAVING count(*) >= 5")


def _clones(spark: SparkSession, t) -> DataFrame:
    d = docs(t).select("id", _low(F.col("text")).alias("ts")).where(F.size("ts") >= 24)
    sig = X.minhash(d)
    from .tables import cut

    sig = cut(sig)
    groups = sig.groupBy("sig").agg(F.min("id").alias("rep"))
    pairs = J.band_pairs(sig)
    s = groups.select(F.col("rep").alias("id"), "sig")
    est = pairs.join(s.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").where(X.agreement(F.col("sa"), F.col("sb")) >= 0.82).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = G.components(s.select("id"), est)
    return sig.join(groups, "sig").join(comp.withColumnRenamed("id", "rep"), "rep").select("id", "component")


table("g36_g40_clone_clusters", _clones, None)

# H. scalar functions over whole tables
table("h1_http_paths", lambda spark, t: t("pages").select("page_id", S.http_path(F.regexp_replace("url", "/([0-9]+)", "/:id")).alias("p")), "SELECT page_id, replace(regexp_replace(regexp_replace(url, '/([0-9]+)', '/:id', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', '{param}', 'g'), '{nothing}', '') AS p FROM pages")
table("h2_sql_tables", lambda spark, t: t("part").select("p_partkey", F.array_join(S.sql_tables(F.concat(F.lit("SELECT * FROM "), F.col("p_type"), F.lit(" JOIN parts WHERE x"))), ",").alias("names")), "SELECT p_partkey, lower(p_type) || ',parts' AS names FROM part")
table("h6_package", lambda spark, t: t("pages").select("page_id", S.package_of(F.regexp_replace("url", "^[a-z]+://", ""), 2).alias("pkg")), "SELECT page_id, array_to_string((string_split(regexp_replace(url, '^[a-z]+://', ''), '/'))[1:least(2, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) - 1)], '/') AS pkg FROM pages")
table("h18_age_days", lambda spark, t: t("orders").select("o_orderkey", S.age_days(F.lit(dt.datetime(2002, 1, 1)), F.col("o_orderdate")).alias("days")), "SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days FROM orders")
table("h17_h19_days_and_clamp", lambda spark, t: t("events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum(S.clamp_percent(F.col("value") * 3)), 4).alias("v")), "SELECT ts::DATE AS day, round(sum(greatest(0.0::DOUBLE, least(100.0::DOUBLE, value * 3))), 4) AS v FROM events GROUP BY 1")
table("h20_h21_tokens_and_cost", lambda spark, t: t("documents").groupBy("source").agg(F.sum(S.token_estimate(F.col("text"))).alias("tokens"), F.round(F.sum(S.token_estimate(F.col("text"))) * 0.000003, 9).alias("cost")), "SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, round(sum(ceil(length(text) / 4.0))::BIGINT * 0.000003::DOUBLE, 9) AS cost FROM documents GROUP BY 1")
table("h24_redact", lambda spark, t: docs(t).select("id", F.length(S.redact(F.col("text"))).cast("long").alias("chars")), r"SELECT doc_id AS id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '\bAKIA[0-9A-Z]{16}\b', '<aws-key>', 'g'), '\bgh[pousr]_[A-Za-z0-9]{36,}\b', '<token>', 'g'), '(?i)\b(password|secret|api_key)\s*[=:]\s*[^\s]+', '<secret>', 'g'))::BIGINT AS chars FROM documents")
table("h29_h8_ids", lambda spark, t: t("part").select("p_partkey", S.file_of(F.concat(F.lower("p_type"), F.lit(".go::"), "p_name")).alias("file")), "SELECT p_partkey, lower(p_type) || '.go' AS file FROM part")
table("h30_gcx_rows", lambda spark, t: t("part").select(S.gcx_row(F.col("p_partkey"), F.col("p_name"), F.col("p_brand")).alias("line")), "SELECT p_partkey || chr(9) || p_name || chr(9) || p_brand AS line FROM part")
