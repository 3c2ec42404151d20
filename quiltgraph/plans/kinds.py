"""Registered analyses by edge kind, each beside its DuckDB SQL.

The typed edges run from types to parts. Attributes that the driver's tables lack are read off the columns they have: a part's name
has two words, its path a type and a brand, an edge a flag, a label and a tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kinds as K
from .adapter import Graph
from .relational import graph

_PARTS = "SELECT id, name, split_part(name, ' ', 1) AS first_word, split_part(name, ' ', 2) AS last_word, split_part(file_path, '/', 2) AS kind_dir, split_part(split_part(file_path, '/', 3), '.', 1) AS brand FROM nodes WHERE kind IN ('function', 'method')"
_LEVELS = "CASE label WHEN '0' THEN 'debug' WHEN '1' THEN 'info' WHEN '2' THEN 'warn' WHEN '3' THEN 'error' WHEN '4' THEN 'fatal' END"


def _parts(g: Graph) -> DataFrame:
    return g.spark.sql(_PARTS.replace("FROM nodes", "FROM {nodes}"), nodes=g.nodes)


def _attributed(g: Graph) -> DataFrame:
    """Typed edges with the attributes that analyses read."""
    e = g.typed
    label = F.col("label")
    level = F.when(label == "0", "Trace").when(label == "1", "Infof").when(label == "2", "Warning").when(label == "3", "Error").when(label == "4", "Fatalf").otherwise("Println")
    return e.select("from_id", "to_id", "kind", "origin", label.alias("mode"), F.when(F.col("flag") == "true", "write").otherwise("read").alias("op"), level.alias("method"), F.lit(None).cast("string").alias("level"), label.alias("orm"), F.lit("").alias("table_name"), F.col("origin").alias("derivation"))


def _joined(df: DataFrame) -> DataFrame:
    """Lists of ids as text."""
    return df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def _few(col: str, cond: str = "true") -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {col}) FILTER ({cond}))[1:{K.SAMPLES}], ','), '')"


def _analysis(name: str, fn, sql: str) -> None:
    graph(f"analyze_{name}", lambda g: _joined(fn(g, _attributed(g), _parts(g))), f", parts AS ({_PARTS}) {sql}", typed=True)


def _with(parts: DataFrame, **columns) -> DataFrame:
    return parts.select("id", "name", *[c.alias(n) for n, c in columns.items()])


_CONTEXT = "CASE WHEN kind_dir < 'm' THEN 'log_message' ELSE 'error_msg' END"


def _strings(p: DataFrame) -> DataFrame:
    return p.select("id", F.expr(_CONTEXT).alias("context"), F.col("name").alias("value"))


def _source(p: DataFrame) -> DataFrame:
    return _with(p, source=F.expr(_SOURCE))


_SOURCE = "CASE WHEN last_word < 'm' THEN 'env' ELSE 'file' END"

_analysis("channel_ops", lambda g, e, p: K.channel_ops(e), f"SELECT to_id AS channel, count(*) FILTER (kind = 'sends') AS sends, count(*) FILTER (kind = 'recvs') AS recvs, {_few('from_id', 'kind = $$sends$$')} AS senders, {_few('from_id', 'kind = $$recvs$$')} AS receivers FROM typed WHERE kind IN ('sends', 'recvs') GROUP BY 1")
_analysis("goroutine_spawns", lambda g, e, p: K.goroutine_spawns(e), f"SELECT to_id AS target, label AS mode, count(*) AS spawns, {_few('from_id')} AS spawners FROM typed WHERE kind = 'spawns' GROUP BY 1, 2")
_analysis("field_writers", lambda g, e, p: K.field_writers(e, g.nodes.where("kind = 'method'")), f"SELECT to_id AS field, count(*) AS writes, {_few('from_id')} AS writers FROM typed WHERE kind = 'writes' AND to_id IN (SELECT id FROM nodes WHERE kind = 'method') GROUP BY 1")
_TIER = "CASE WHEN starts_with(origin, 'lsp_') THEN 'lsp' WHEN starts_with(origin, 'ast_') THEN 'ast' ELSE 'heuristic' END"
_analysis("ref_facts", lambda g, e, p: K.ref_facts(e, g.nodes, ["returns", "typed_as", "arg_of"], "asia/"), f"SELECT from_id, to_id, t.kind, b.name AS ref_name, origin, {_TIER} AS tier, a.file_path FROM typed t JOIN nodes a ON from_id = a.id JOIN nodes b ON to_id = b.id WHERE t.kind IN ('returns', 'typed_as', 'arg_of') AND starts_with(a.file_path, 'asia/')")
_analysis("annotation_users", lambda g, e, p: K.annotation_users(e, g.nodes), "SELECT to_id AS id, name, count(DISTINCT from_id) AS users FROM typed t JOIN nodes n ON to_id = n.id WHERE t.kind = 'annotated' GROUP BY 1, 2")
_analysis("config_readers", lambda g, e, p: K.config_readers(e, _source(p)), f"SELECT id, name, {_SOURCE} AS source, count(*) AS reads, {_few('from_id')} AS readers FROM typed JOIN parts ON to_id = id WHERE kind = 'reads_config' GROUP BY 1, 2, 3")
_analysis("env_var_users", lambda g, e, p: K.env_var_users(e, _source(p)), f"SELECT name, count(*) AS reads, {_few('from_id')} AS readers FROM typed JOIN parts ON to_id = id WHERE kind = 'reads_config' AND {_SOURCE} = 'env' GROUP BY 1")
_analysis("sql_call_sites", lambda g, e, p: K.sql_call_sites(e, g.nodes), f"SELECT from_id AS symbol, name, n.file_path, count(*) AS queries, count(*) FILTER (flag <> 'true') AS reads, count(*) FILTER (flag = 'true') AS writes, {_few('to_id')} AS tables FROM typed t JOIN nodes n ON from_id = n.id WHERE t.kind = 'queries' GROUP BY 1, 2, 3")
_analysis("event_emitters", lambda g, e, p: K.event_emitters(e, _with(p, event_kind=F.col("brand")), "warn"), f"SELECT id, name, brand AS event_kind, count(*) AS emits, {_few('from_id')} AS emitters FROM typed JOIN parts ON to_id = id WHERE kind = 'emits' AND label = '2' GROUP BY 1, 2, 3")
_analysis("pubsub", lambda g, e, p: K.pubsub(e, _with(p, transport=F.col("brand")), "subscribe"), f"SELECT id, name, brand AS transport, count(*) FILTER (kind = 'emits') AS publishes, count(*) FILTER (kind = 'listens_on') AS subscribes, {_few('from_id', 'kind = $$emits$$')} AS publishers, {_few('from_id', 'kind = $$listens_on$$')} AS subscribers FROM typed JOIN parts ON to_id = id WHERE kind IN ('emits', 'listens_on') GROUP BY 1, 2, 3 HAVING count(*) FILTER (kind = 'listens_on') > 0")
_analysis("string_emitters", lambda g, e, p: K.string_emitters(e, _strings(p)), f"SELECT id, {_CONTEXT} AS context, name AS value, count(*) AS emits, {_few('from_id')} AS emitters FROM typed JOIN parts ON to_id = id WHERE kind = 'emits' GROUP BY 1, 2, 3")
_analysis("log_events", lambda g, e, p: K.log_events(e, _strings(p)), f"SELECT name AS value, {_LEVELS} AS level, count(*) AS emits, {_few('from_id')} AS emitters FROM typed JOIN parts ON to_id = id WHERE kind = 'emits' AND {_CONTEXT} = 'log_message' GROUP BY 1, 2")
_analysis("error_surface", lambda g, e, p: K.error_surface(e, g.nodes, _strings(p)), f", m AS (SELECT from_id, {_few('name')} AS messages FROM typed JOIN parts ON to_id = id WHERE kind = 'emits' AND {_CONTEXT} = 'error_msg' GROUP BY 1) SELECT from_id AS symbol, n.file_path, count(*) AS throws, {_few('to_id')} AS errors, coalesce(any_value(messages), '') AS messages, count(DISTINCT to_id) AS kinds FROM typed t JOIN nodes n ON from_id = n.id LEFT JOIN m USING (from_id) WHERE t.kind = 'throws' GROUP BY 1, 2")
_CONTRACT = "CASE WHEN first_word < 'd' THEN 'http' WHEN first_word < 'h' THEN 'grpc' WHEN first_word < 'p' THEN 'topic' ELSE 'graphql' END"
_analysis("routes", lambda g, e, p: K.routes(e, _with(p, type=F.expr(_CONTRACT), method=F.upper("last_word"), path=F.concat(F.lit("/"), "kind_dir"), service=F.col("brand"), topic=F.col("name"), operation=F.col("first_word"), field=F.col("last_word"))), f"SELECT from_id AS handler, to_id AS route, c AS route_kind, CASE c WHEN 'graphql' THEN first_word WHEN 'topic' THEN '' ELSE upper(last_word) END AS method, CASE c WHEN 'graphql' THEN last_word WHEN 'topic' THEN name WHEN 'grpc' THEN brand ELSE '/' || kind_dir END AS path FROM typed JOIN (SELECT *, {_CONTRACT} AS c FROM parts) ON to_id = id WHERE kind = 'handles_route'")
_analysis("models", lambda g, e, p: K.models(e, p, "3"), "SELECT from_id AS model, coalesce(name, to_id) AS table_name, label AS orm, origin AS derivation FROM typed LEFT JOIN parts ON to_id = id WHERE kind = 'models_table' AND label = '3'")
_analysis("components", lambda g, e, p: K.components(e, g.nodes), "SELECT id, name, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT from_id AS id, 0 AS i, 1 AS o FROM typed WHERE kind = 'renders_child' UNION ALL SELECT to_id, 1, 0 FROM typed WHERE kind = 'renders_child') JOIN nodes USING (id) GROUP BY 1, 2")
_DEGREE = ", ".join(f"coalesce({k}, 0) AS {k}" for k in ("depends_on", "configures", "mounts", "exposes", "uses_env"))
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("depends_on", "configures", "mounts", "exposes", "uses_env"))
_analysis("k8s_resources", lambda g, e, p: K.k8s_resources(e, g.nodes.where("kind IN ('type', 'interface')").select("id", F.col("kind").alias("k8s_kind"), F.col("repo_prefix").alias("namespace"), "name")), f"SELECT id, kind AS k8s_kind, repo_prefix AS namespace, name, {_DEGREE} FROM nodes LEFT JOIN (SELECT from_id, {_COUNTS} FROM typed GROUP BY 1) ON id = from_id WHERE kind IN ('type', 'interface')")
_analysis("images", lambda g, e, p: K.images(e, p.select("id", F.col("name").alias("ref"), F.col("brand").alias("tag"), F.col("kind_dir").alias("role"))), "SELECT id, name AS ref, brand AS tag, kind_dir AS role, coalesce(consumers, 0) AS consumers FROM parts LEFT JOIN (SELECT to_id, count(*) AS consumers FROM typed WHERE kind = 'depends_on' GROUP BY 1) ON id = to_id")
_analysis("kustomize", lambda g, e, p: K.kustomize(e.withColumn("kind", F.when(F.col("kind") == "composes", "references").otherwise(F.col("kind"))), g.nodes.where("kind IN ('type', 'interface')").select("id", F.col("file_path").alias("dir"))), "SELECT id, file_path AS dir, coalesce(d, 0) AS depends_on, coalesce(r, 0) AS resources FROM nodes LEFT JOIN (SELECT from_id, count(*) FILTER (kind = 'depends_on') AS d, count(*) FILTER (kind = 'composes') AS r FROM typed GROUP BY 1) ON id = from_id WHERE kind IN ('type', 'interface')")
_analysis("tests_as_edges", lambda g, e, p: K.tests_as_edges(e, g.nodes).unionByName(K.tests_as_edges(e, g.nodes, "test")), f"SELECT to_id AS id, name, count(DISTINCT from_id) AS n, {_few('from_id')} AS others FROM typed t JOIN nodes n ON to_id = n.id WHERE t.kind = 'tests' GROUP BY 1, 2 UNION ALL SELECT from_id, name, count(DISTINCT to_id), {_few('to_id')} FROM typed t JOIN nodes n ON from_id = n.id WHERE t.kind = 'tests' GROUP BY 1, 2")
