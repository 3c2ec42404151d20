"""Registered reranking, source-code, rule and composed queries, each beside its DuckDB SQL where there is one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import code as K
from ..operators import graph as G
from ..operators import rerank as R
from ..operators import search as X
from ..operators import tools as M
from . import dsl
from .adapter import Graph
from .graphs import bfs_sql
from .relational import graph, table
from .tables import cut

# Query shapes
_SHAPES = "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN lower(p_type) || '/' || lower(p_brand) WHEN 2 THEN p_type || '(' || p_brand || ')' WHEN 3 THEN 'get' || p_type || ' of the ' || p_name WHEN 4 THEN replace(p_name, ' ', '_') WHEN 5 THEN p_name || ' OR ' || p_type || ' OR ' || p_brand ELSE 'how does ' || p_type || ' load_' || p_brand || ' work' END AS q FROM part"


def _shapes(spark: SparkSession, t) -> DataFrame:
    return spark.sql(_SHAPES.replace("FROM part", "FROM {part}"), part=t("part"))


_SYMBOL = r"({x} <> '' AND NOT regexp_matches({x}, '\s') AND ((regexp_matches({x}, '::|[./\\_]') AND regexp_matches({x}, '[\p{{L}}\p{{Nd}}]')) OR regexp_matches({x}, '\p{{Ll}}\p{{Lu}}|\p{{Lu}}\p{{Ll}}') OR (length({x}) >= 2 AND regexp_replace({x}, '[^\p{{L}}]', '', 'g') <> '' AND NOT regexp_matches(regexp_replace({x}, '[^\p{{L}}]', '', 'g'), '[^\p{{Lu}}]'))))"
_CLASS = r"CASE WHEN trim(q) = '' THEN 'concept' WHEN regexp_matches(q, '\bOR\b.*\bOR\b|,[^,]*,|\|[^|]*\|') THEN 'soup' WHEN regexp_matches(q, '[()]|->|=>') THEN 'signature' WHEN NOT regexp_matches(trim(q), '\s') AND regexp_matches(q, '[/\\]') AND regexp_matches(q, '[\p{L}\p{Nd}]') THEN 'path' WHEN " + _SYMBOL.format(x="trim(q)") + " THEN 'symbol' ELSE 'concept' END"
_STOPS = ", ".join(f"'{w}'" for w in R.STOPWORDS)
table(
    "g20_g21_query_shape", lambda spark, t: _shapes(spark, t).select("id", R.query_class(F.col("q")).alias("class"), F.round(R.alpha(F.col("q")), 6).alias("alpha")),
    f"WITH s AS ({_SHAPES}), c AS (SELECT id, q, {_CLASS} AS class, list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda x: x <> '') AS ts FROM s), n AS (SELECT id, class, len(ts) AS n, len(list_filter(ts, lambda x: {_SYMBOL.format(x='x')})) AS ids, len(list_filter(ts, lambda x: lower(x) IN ({_STOPS}))) AS stops FROM c) SELECT id, class, round(CASE class WHEN 'soup' THEN 0.3::DOUBLE WHEN 'signature' THEN 0.35::DOUBLE WHEN 'path' THEN 0.15::DOUBLE ELSE 0.5::DOUBLE - 0.2::DOUBLE * CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN n = 1 THEN ids::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ids::DOUBLE / n - stops::DOUBLE / n - 0.12::DOUBLE * (n - 2))) END END, 6) AS alpha FROM n",
)

_PATHS = "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'pkg/tests/' WHEN 1 THEN 'legacy/' WHEN 2 THEN 'examples/' WHEN 3 THEN 'include/' ELSE 'src/' END || lower(p_type) || CASE p_partkey % 5 WHEN 0 THEN '_test.go' WHEN 1 THEN '.d.ts' WHEN 2 THEN '/index.js' WHEN 3 THEN '.h' ELSE '.go' END AS path FROM part"
_PENALTY = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN {R.PATH_PENALTY[n]}::DOUBLE" for n, p in R.PATH_RULES) + " ELSE 1.0::DOUBLE END"
table("g28_path_penalty", lambda spark, t: spark.sql(_PATHS.replace("FROM part", "FROM {part}"), part=t("part")).select("id", "path", R.path_penalty(F.col("path")).alias("penalty")), f"SELECT id, path, {_PENALTY} AS penalty FROM ({_PATHS})")

_HITS = "SELECT o_custkey AS query, o_orderkey AS id, o_orderpriority AS file_path, CAST(CASE WHEN o_orderkey % 3 > 0 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 END AS BIGINT) AS text_rank, CAST(CASE WHEN o_orderkey % 4 > 0 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 END AS BIGINT) AS vector_rank FROM orders"
_RANKED = "coalesce(61.0::DOUBLE / (60 + {c} + 1), 0.0::DOUBLE)"


def _hits(spark: SparkSession, t) -> DataFrame:
    return spark.sql(_HITS.replace("FROM orders", "FROM {orders}"), orders=t("orders"))


table("g29_file_coherence", lambda spark, t: R.file_coherence(_hits(spark, t)).select("query", "id", F.round("coherence", 6).alias("coherence")), f"WITH h AS ({_HITS}), f AS (SELECT query, file_path, sum({_RANKED.format(c='text_rank')} + {_RANKED.format(c='vector_rank')}) AS s, count(*) AS n FROM h GROUP BY 1, 2), m AS (SELECT query, max(s) AS top FROM f GROUP BY 1) SELECT query, id, round(CASE WHEN n >= 2 AND top > 0 THEN s / top ELSE 0.0 END, 6) AS coherence FROM h JOIN f USING (query, file_path) JOIN m USING (query)")
_PROV = "CASE origin WHEN 'lsp_resolved' THEN 0.6::DOUBLE WHEN 'ast_resolved' THEN 1.0::DOUBLE WHEN 'ast_inferred' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END"
graph("g30_provenance", lambda g: R.provenance(g.edges, g.nodes).select("id", F.round("provenance", 6).alias("provenance")), f"SELECT to_id AS id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (sum(round({_PROV} * 1000)::BIGINT)::DOUBLE / count(*) / 1000 - 0.5::DOUBLE) / 0.5::DOUBLE)), 6) AS provenance FROM edges WHERE kind IN ('calls', 'references') GROUP BY 1")
_COSINES = "SELECT o_custkey AS list, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 997 AS DOUBLE) / 997 END AS cosine FROM orders"
table("g31_head_refine", lambda spark, t: R.head_refine(spark.sql(_COSINES.replace("FROM orders", "FROM {orders}"), orders=t("orders")), 8).select("list", "id", "refined"), f"SELECT list, id, row_number() OVER (PARTITION BY list ORDER BY CASE WHEN rank <= 8 THEN 0 ELSE 1 END, CASE WHEN rank <= 8 AND cosine IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN rank <= 8 THEN -cosine END NULLS FIRST, rank) AS refined FROM ({_COSINES})")


def _resets(spark: SparkSession, t) -> DataFrame:
    h = _hits(spark, t)
    channel = lambda c: h.where(F.col(f"{c}_rank").isNotNull()).select(F.col("query").alias("list"), F.lit(c).alias("channel"), F.col("file_path").alias("repo_prefix"), "id", F.col(f"{c}_rank").alias("rank"))
    return R.rank_reset(channel("text").unionByName(channel("vector")))


table("g32_rank_reset", _resets, f"WITH h AS ({_HITS}), c AS (SELECT query AS list, 'text' AS channel, file_path AS repo_prefix, id, text_rank AS rank FROM h WHERE text_rank IS NOT NULL UNION ALL SELECT query, 'vector', file_path, id, vector_rank FROM h WHERE vector_rank IS NOT NULL) SELECT list, channel, repo_prefix, id, row_number() OVER (PARTITION BY list, channel, repo_prefix ORDER BY rank, id) - 1 AS rank FROM c")


def _completion(g: Graph) -> DataFrame:
    seeds = g.nodes.where("kind = 'interface'").select(F.lit("q").alias("query"), "id", (F.row_number().over(Window.orderBy("id")) - 1).alias("rank"))
    return R.graph_completion(seeds, g.edges, g.nodes, ["implements", "references", "calls"], 8)


graph("e31_graph_completion", _completion, ", s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM nodes WHERE kind = 'interface'), n AS (SELECT DISTINCT s.id, s.rank, to_id AS other FROM s JOIN edges ON from_id = s.id WHERE kind IN ('implements', 'references', 'calls') AND to_id IN (SELECT id FROM nodes) AND to_id NOT IN (SELECT id FROM s)), o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY other ORDER BY rank, id) = 1) SELECT 'q' AS query, id, true AS is_seed FROM s UNION ALL SELECT 'q', other, false FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY other) <= 8)")


def candidates(g: Graph, texts: list[str], top: int = 200) -> DataFrame:
    """Text and vector channels over the nodes for a few queries: overlap of name tokens, and of name bigrams; the best ``top`` of each."""
    q = g.spark.createDataFrame([(x,) for x in texts], "query string")
    n = g.nodes.withColumn("ts", S.index_tokens(F.col("name")))
    hit = n.join(F.broadcast(q.withColumn("qs", S.index_tokens(F.col("query")))), F.arrays_overlap("ts", "qs"))  # q: the queries of one call
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.lower(c), i, 2))
    hit = hit.withColumn("t", R.overlap(F.col("qs"), F.col("ts"))).withColumn("v", R.overlap(grams(F.col("query")), grams(F.col("name"))))
    by = lambda c: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), "id")) - 1
    both = hit.withColumn("text_rank", by("t")).withColumn("vector_rank", by("v"))
    keep = lambda c: F.when(F.col(c) < top, F.col(c))
    rows = both.withColumn("text_rank", keep("text_rank")).withColumn("vector_rank", keep("vector_rank")).where("text_rank IS NOT NULL OR vector_rank IS NOT NULL")
    return rows.select(
        "query", "id", "text_rank", "vector_rank", "kind", "name", "qual_name", F.concat("name", F.lit("("), "language", F.lit(")")).alias("signature"), "file_path", "repo_prefix",
        "project_id", (F.col("end_line") - F.col("start_line")).alias("churn"), F.lit(dt.datetime(2001, 12, 1)).alias("authored_at"),
    )


def search_symbols(g: Graph, texts: list[str]) -> DataFrame:
    """Ranked symbols: channels, all signals with hub and authority scores, file communities and co-change, and proximity to each query's best rows."""
    c = cut(candidates(g, texts))
    pairs = ["calls", "references"]
    near = cut(R.central_seeds(c))
    step = g.edges.where(F.col("kind").isin(pairs)).select("from_id", "to_id")
    both = step.union(step.select("to_id", "from_id")).toDF("id", "other").distinct()
    reach = near.join(both, "id").groupBy("query", F.col("other").alias("id")).agg(F.count("*").alias("n"))
    central = reach.withColumn("score", F.col("n") / F.max("n").over(Window.partitionBy("query"))).select("query", "id", "score")
    extra = {"hits": G.hits(g.nodes, g.edges, pairs), "community": g.nodes.select("id", F.col("file_path").alias("community")), "centrality": central}
    return R.score(R.signals(c, g.edges, dt.datetime(2002, 1, 1), extra))


graph("g23_g24_rerank", lambda g: search_symbols(g, ["red widget", "NATION_3", "blue bolt small", "Supplier"]).select("query", "id", F.round("score", 6).alias("score"), "rank"), None)


def _pack(g: Graph) -> DataFrame:
    """The best rows of a query with one hop of neighbours, packed into a budget of tokens."""
    top = search_symbols(g, ["red widget"]).where("rank <= 20").select("query", "id", (F.col("rank") - 1).alias("rank"))
    grown = R.graph_completion(top, g.edges, g.nodes, ["calls", "member_of"], 3).join(top.select("id", "rank"), "id", "left")
    w = Window.partitionBy("query").orderBy(F.desc("is_seed"), F.asc_nulls_last("rank"), "id")
    rows = grown.withColumn("r", F.row_number().over(w)).join(g.nodes.select("id", "name"), "id").select(F.lit(0).alias("list"), F.col("r").alias("rank"), "id", (F.length("name") + 8).alias("tokens"))
    return X.greedy_pack(rows, 900)


graph("m141_smart_context", _pack, None)

# Source code
_CODE = K.CODE_TOKEN.replace("'", "''")
_KEYS = ", ".join(f"'{k}'" for k in K.KEYWORDS)
table("g38_clone_tokens", lambda spark, t: t("documents").select("doc_id", K.clone_tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n"), F.md5(F.array_join("ts", " ").cast("binary")).alias("form")), f"SELECT doc_id, len(ts)::BIGINT AS n, md5(array_to_string(ts, ' ')) AS form FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_CODE}'), lambda x: CASE WHEN regexp_matches(x, '^[\\p{{L}}_]') THEN CASE WHEN lower(x) IN ({_KEYS}) THEN lower(x) ELSE 'v' END WHEN regexp_matches(x, '^[0-9]') THEN '0' WHEN regexp_matches(x, '^[\"''`]') THEN 's' ELSE x END) AS ts FROM documents)")


def _maintained(spark: SparkSession, t) -> DataFrame:
    """A clone index of all bodies, with a tenth taken out and put in again, asked for the partners of every 50th body."""
    sig = cut(X.minhash(t("documents").select(F.col("doc_id").alias("id"), K.clone_tokens(F.col("text")).alias("ts")).where(F.size("ts") >= K.LEAST_TOKENS), 5))
    some = sig.where("id % 10 = 3")
    index = cut(K.index_add(K.index_remove(K.band_rows(sig), some), some))
    found = K.probe(index, sig.where("id % 50 = 0").select("id"))
    s = sig.select("id", "sig")
    j = found.join(s, "id").join(s.select(F.col("id").alias("other"), F.col("sig").alias("sb")), "other")
    return j.withColumn("similarity", X.agreement(F.col("sig"), F.col("sb"))).where("similarity >= 0.82").select("id", "other", F.col("shared").cast("long").alias("shared"), F.round("similarity", 6).alias("similarity"))


table("b13_g40_clone_probe", _maintained, None)


def _files(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("path"), F.lit("").alias("language"), "text")


_RULE_SQL = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{c}' AS category, '{s}' AS severity, '{w}' AS cwe, doc_id FROM l WHERE regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}')" for r, c, lang, s, w, p in K.RULES if not lang)
for _cat in ("sast", "hygiene", "review", "domain"):
    table(f"analyze_{_cat}", lambda spark, t, c=_cat: K.run_rules(_files(t), categories=[c]).groupBy("rule", "severity", "cwe").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files")), f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT rule, severity, cwe, count(*) AS n, count(DISTINCT doc_id) AS files FROM ({_RULE_SQL}) WHERE category = '{_cat}' GROUP BY 1, 2, 3")
_SOURCES = "SELECT p_partkey AS path, CASE p_partkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'rust' ELSE 'c' END AS language, CASE p_size % 5 WHEN 0 THEN 'x := panic(\"' || p_name || '\")' WHEN 1 THEN 'let y = ' || replace(p_name, ' ', '_') || '.unwrap();' WHEN 2 THEN 'unsafe { ' || p_type || ' }' WHEN 3 THEN 'strcpy(a, b);' ELSE p_name END || chr(10) || p_brand AS text FROM part"
_UNSAFE = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS severity, path FROM l WHERE language = '{lang}' AND regexp_matches(line, '{p}')" for r, c, lang, s, w, p in K.RULES if c == "unsafe")
table("analyze_unsafe_patterns", lambda spark, t: K.run_rules(spark.sql(_SOURCES.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part}"), part=t("part")), categories=["unsafe"]).select("path", "line_no", "rule", "severity"), f"WITH l AS (SELECT path, language, unnest(string_split(text, chr(10))) AS line FROM ({_SOURCES})) SELECT path, 1 AS line_no, rule, severity FROM ({_UNSAFE})")
_USER_RULES = """
- id: acme-widget
  severity: high
  pattern: '\\bwidget\\b'
- id: acme-ring
  pattern: 'ring$'
"""
table("k2_k3_user_rules", lambda spark, t: K.run_rules(t("part").select(F.col("p_partkey").alias("path"), F.lit("").alias("language"), F.col("p_name").alias("text")), K.load_rules(_USER_RULES)).select("path", "rule", "severity"), r"SELECT p_partkey AS path, 'acme-widget' AS rule, 'high' AS severity FROM part WHERE regexp_matches(p_name, '\bwidget\b') UNION ALL SELECT p_partkey, 'acme-ring', 'medium' FROM part WHERE regexp_matches(p_name, 'ring$')")
graph("e26_taint_pattern", lambda g: g.nodes.where(K.taint_pattern("widget kind:method path:lib/economy")).select("id"), "SELECT id FROM nodes WHERE (contains(lower(name), 'widget') OR contains(lower(id), 'widget')) AND kind = 'method' AND starts_with(file_path, 'lib/economy')")


def _signatures(g: Graph) -> DataFrame:
    p = g.tables["part"].select(F.concat(F.lit("fn::p"), "p_partkey").alias("id"), F.regexp_replace("p_name", " ", "_").alias("f"), "p_size", "p_brand")
    old = F.format_string("%s(a int, b string) %s", "f", F.lit("error"))
    new = F.when(F.col("p_size") % 6 == 0, old).when(F.col("p_size") % 6 == 1, F.format_string("%s(a int) error", "f")).when(F.col("p_size") % 6 == 2, F.format_string("%s(a int, b string, c bool) error", "f")).when(F.col("p_size") % 6 == 3, F.format_string("%s(a int, b string, c = 1) error", "f")).when(F.col("p_size") % 6 == 4, F.format_string("%s(a long, b string) int", "f"))
    return K.signature_check(p.select("id", old.alias("old"), new.alias("new")), g.edges).withColumn("reasons", F.array_join("reasons", ","))


graph("f25_m165_signature_check", _signatures, ", s AS (SELECT 'fn::p' || p_partkey AS id, CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'removed_parameter' WHEN 2 THEN 'required_parameter_added' WHEN 3 THEN '' WHEN 4 THEN 'parameter_changed,result_changed' ELSE 'removed' END AS reasons FROM part) SELECT s.id, reasons <> '' AS breaking, reasons, (SELECT count(DISTINCT from_id) FROM edges WHERE kind IN ('calls', 'references') AND to_id = s.id) AS callers, (SELECT count(DISTINCT from_id) FROM edges WHERE kind IN ('implements', 'overrides') AND to_id = s.id) AS implementors FROM s")


def _ann(spark: SparkSession, t) -> DataFrame:
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    n = v.count()
    cells = max(1, int(n**0.5))
    centres = K.fit_cells(v, cells)
    index = cut(K.in_cells(v, centres))
    return K.search_cells(index, v.where("id % 50 = 0"), centres, 10, max(1, -(-cells // 2))).select("query", "id", "distance", "rank")


table("g16_cell_search", _ann, None)
_WORD_VECTORS = "SELECT w AS token, embedding AS vec FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) JOIN embeddings ON vec_id = ascii(w) * 3 % 200 WHERE w <> 'widget'"


def _static(spark: SparkSession, t) -> DataFrame:
    p = t("part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tokens"))
    words = p.select(F.explode("tokens").alias("token")).distinct().where("token <> 'widget'").withColumn("vec_id", F.pmod(F.ascii("token") * 3, F.lit(200)))
    vectors = words.join(t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec")), "vec_id").select("token", "vec")
    return K.token_vectors(p, vectors).select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


table("g41_static_embedding", _static, f"WITH v AS MATERIALIZED ({_WORD_VECTORS}), d AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS token FROM part), m AS (SELECT id, i, avg(x) AS x FROM (SELECT id, generate_subscripts(vec, 1) - 1 AS i, unnest(vec)::DOUBLE AS x FROM d JOIN v USING (token)) GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), z AS (SELECT p_partkey AS id, unnest(range((SELECT max(len(vec)) FROM v))) AS i FROM part) SELECT z.id, z.i, round(coalesce(CASE WHEN n > 0 THEN x / n ELSE 0.0 END, 0.0), 6) AS x FROM z LEFT JOIN m ON z.id = m.id AND z.i = m.i LEFT JOIN n ON z.id = n.id")

# Analyses
_TODOS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '// TODO(clerk' || o_custkey % 7 || ') AB-' || o_orderkey % 50 || ': ' || o_orderpriority WHEN 1 THEN '# FIXME ' || o_orderstatus WHEN 2 THEN 'x = 1' ELSE '/* HACK: ' || o_orderpriority || ' */' END AS line FROM orders"
table("h22_todo_scan", lambda spark, t: spark.sql(_TODOS.replace("FROM orders", "FROM {orders}"), orders=t("orders")).where(F.col("line").rlike("TODO|FIXME|HACK|XXX")).select("id", S.todo_fields(F.col("line")).alias("f")).groupBy("f.tag", "f.assignee", "f.ticket").agg(F.count("*").alias("n")), f"SELECT regexp_extract(line, '(TODO|FIXME|HACK|XXX)', 1) AS tag, regexp_extract(line, '(?:TODO|FIXME|HACK|XXX)\\(@?([^)]*)\\)', 1) AS assignee, regexp_extract(line, '([A-Z]+-[0-9]+)', 1) AS ticket, count(*) AS n FROM ({_TODOS}) WHERE regexp_matches(line, 'TODO|FIXME|HACK|XXX') GROUP BY 1, 2, 3")
_STRINGS = "SELECT p_partkey AS id, 'SELECT a FROM ' || lower(p_type) || CASE WHEN p_size % 2 = 0 THEN ' JOIN ' || replace(lower(p_brand), '#', '_') || ' ON x' ELSE ' WHERE y' END AS s FROM part"
table("analyze_sql_rebuild", lambda spark, t: spark.sql(_STRINGS.replace("FROM part", "FROM {part}"), part=t("part")).select("id", F.explode(S.sql_tables(F.col("s"))).alias("table")).groupBy("table").agg(F.count("*").alias("references"), F.min("id").alias("first")), f"SELECT tbl AS \"table\", count(*) AS \"references\", min(id) AS first FROM (SELECT id, unnest(regexp_extract_all(s, '(?:FROM|JOIN) ([a-z0-9_]+)', 1)) AS tbl FROM ({_STRINGS})) GROUP BY 1")
graph("analyze_synthesizers", lambda g: g.typed.where("origin = 'ast_inferred'").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.countDistinct("from_id").alias("sources")), "SELECT label, count(*) AS n, count(DISTINCT kind) AS kinds, count(DISTINCT from_id) AS sources FROM typed WHERE origin = 'ast_inferred' GROUP BY 1", typed=True)
graph("analyze_dbt_models", lambda g: M.models(g.typed), "SELECT from_id AS model, CASE WHEN bool_or(flag = 'true') THEN 'table' ELSE 'view' END AS materialised, count(DISTINCT CASE WHEN kind = 'depends_on' THEN to_id END) AS upstream, count(DISTINCT CASE WHEN kind = 'exposes' THEN to_id END) AS exposed FROM typed WHERE kind IN ('depends_on', 'exposes') GROUP BY 1", typed=True)
_BUNDLE = {"interfaces": "nodes kind=interface", "implementors": "nodes kind=interface | traverse in kind=implements depth=1", "asian types": "nodes kind=type | filter path=asia"}


def _named(g: Graph) -> DataFrame:
    out = None
    for name, text in _BUNDLE.items():
        part = dsl.run(text, g.nodes, g.edges, None).groupBy().agg(F.count("*").alias("n"), F.min("id").alias("first")).select(F.lit(name).alias("name"), "n", "first")
        out = part if out is None else out.unionByName(part)
    return out


graph("analyze_named", _named, "SELECT 'interfaces' AS name, count(*) AS n, min(id) AS first FROM nodes WHERE kind = 'interface' UNION ALL SELECT 'implementors', count(*), min(id) FROM (SELECT id FROM nodes WHERE kind = 'interface' UNION SELECT from_id FROM edges WHERE kind = 'implements' AND to_id IN (SELECT id FROM nodes WHERE kind = 'interface')) UNION ALL SELECT 'asian types', count(*), min(id) FROM nodes WHERE kind = 'type' AND starts_with(file_path, 'asia')")

# Composed questions
_OPEN = "SELECT o_orderkey AS pr, l_partkey AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'"
graph("m15_conflicting_changes", lambda g: M.conflicts(g._sql(_OPEN), 2), f", o AS (SELECT DISTINCT pr, symbol FROM ({_OPEN})) SELECT a.pr AS a, b.pr AS b, count(*) AS shared FROM o a JOIN o b ON a.symbol = b.symbol AND a.pr < b.pr GROUP BY 1, 2 HAVING count(*) >= 2")
_WALK = bfs_sql("SELECT 'fn::p3' AS id UNION ALL SELECT 'fn::p4'", ["calls", "member_of"], "out", 3)
graph("m16_context_closure", lambda g: M.context_closure(g.edges, g.spark.createDataFrame([("fn::p3",), ("fn::p4",)], "id string"), g.nodes.select("id", (F.length("name") + 4).alias("tokens")), 600, ["calls", "member_of"], 3), _WALK.replace("SELECT id, depth FROM (", ", reached AS (", 1) + " SELECT id, depth, total FROM (SELECT r.id, depth, sum(length(name) + 4) OVER (ORDER BY depth, r.id)::BIGINT AS total FROM reached r JOIN nodes n ON r.id = n.id) WHERE total <= 600")
table("m22_response_stats", lambda spark, t: M.response_stats(t("documents").select(F.col("doc_id").alias("id"), "text")), "SELECT doc_id AS id, len(string_split(text, chr(10)))::BIGINT AS lines, octet_length(encode(text))::BIGINT AS bytes, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
table("m82_head", lambda spark, t: t("documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 2), "\n").alias("head")), "SELECT doc_id, array_to_string((string_split(text, chr(10)))[1:2], chr(10)) AS head FROM documents")
table("m74_symbol_source", lambda spark, t: M.source_lines(t("documents").select(F.col("doc_id").alias("path"), "text"), t("documents").select(F.col("doc_id").alias("path"), F.lit(2).alias("start"), F.lit(3).alias("end")), 1), "SELECT doc_id AS path, 2 AS start, 3 AS \"end\", array_to_string((string_split(text, chr(10)))[1:4], chr(10)) AS source FROM documents")
table("m166_verify_citation", lambda spark, t: M.citations(t("documents").select(F.col("doc_id").alias("path"), F.substring("text", 30, 12).alias("span")), t("documents").select(F.col("doc_id").alias("path"), "text")), "SELECT doc_id AS path, instr(text, substr(text, 30, 12)) > 0 AS found, len(string_split(substr(text, 1, greatest(instr(text, substr(text, 30, 12)), 1)), chr(10)))::BIGINT AS line FROM documents WHERE substr(text, 30, 12) <> ''")
table("m133_search_artifacts", lambda spark, t: t("pages").where(F.contains("url", F.lit("/en/")) & F.contains(F.lower("html"), F.lit("<article"))).select("page_id", "url"), "SELECT page_id, url FROM pages WHERE contains(url, '/en/') AND contains(lower(html), '<article')")
graph("m69_recent_changes", lambda g: g.tables["lineitem"].where(F.col("l_shipdate") >= F.lit(dt.datetime(1998, 6, 1))).groupBy("l_partkey").agg(F.count("*").alias("changes"), F.max("l_shipdate").alias("last")), " SELECT l_partkey, count(*) AS changes, max(l_shipdate) AS last FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1")
graph("m3_api_impact", lambda g: M.api_impact(g.typed), "SELECT route, handlers, consumers, CASE WHEN consumers >= 10 THEN 'CRITICAL' WHEN consumers >= 5 THEN 'HIGH' WHEN consumers >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT to_id AS route, count(DISTINCT CASE WHEN kind = 'handles_route' THEN from_id END) AS handlers, count(DISTINCT CASE WHEN kind = 'consumes' THEN from_id END) AS consumers FROM typed WHERE kind IN ('handles_route', 'consumes') GROUP BY 1) WHERE handlers > 0", typed=True)
graph("m49_architecture", lambda g: M.architecture(g.nodes, g.edges, 5), ", s AS (SELECT 'unit' AS part, file_path AS name, count(*) AS n FROM nodes GROUP BY 2), h AS (SELECT 'hub' AS part, to_id AS name, count(*) AS n FROM edges WHERE kind IN ('calls', 'references') GROUP BY 2), e AS (SELECT 'entry' AS part, from_id AS name, count(*) AS n FROM edges WHERE kind = 'calls' AND from_id NOT IN (SELECT to_id FROM edges WHERE kind = 'calls') GROUP BY 2) SELECT part, name, n FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, name) AS k FROM (SELECT * FROM s UNION ALL SELECT * FROM h UNION ALL SELECT * FROM e)) WHERE k <= 5")
