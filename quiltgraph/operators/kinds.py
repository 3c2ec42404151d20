"""Analyses by edge kind: who sends, reads, emits, throws, routes, renders, mounts and tests what.

Every function takes edges(from_id, to_id, kind, ...) and, where names or attributes are reported, nodes(id, name, ...), whose
attribute columns each docstring names. Lists of ids hold the SAMPLES smallest; the counts beside them cover all.
Null ends make no row. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Ids listed a row, smallest first; counts are of all.
SAMPLES = 5


def _ends(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("kind").isin(list(kinds)) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())


def _gather(rows: DataFrame, keys: list[str], counts: dict[str, Column | str], lists: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """keys, counts of rows that meet a condition, and lists of the smallest ids of a column among such rows.

    Counts combine on the map side. Lists come from distinct (keys, id) pairs ranked under a window whose limit
    reaches the map side too, so no task holds the ids of a hot key.
    """
    out = rows.groupBy(*keys).agg(*[F.count_if(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in counts.items()])
    for name, (col, cond) in lists.items():
        pairs = rows.where(cond).select(*keys, F.col(col).alias("_member")).where(F.col("_member").isNotNull()).distinct()
        top = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_member"))).where(F.col("_r") <= SAMPLES)
        few = top.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sort_array(F.collect_list("_member")).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(few, same, "left").drop(*[f"_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


#: Condition that every row meets.
_ALL = "true"


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _named(edges: DataFrame, nodes: DataFrame, end: str, *attributes: str) -> DataFrame:
    """edges with the attributes of the node at one end."""
    return edges.join(nodes.select(F.col("id").alias(end), *attributes), end)


def channel_ops(edges: DataFrame) -> DataFrame:
    """(channel, sends, recvs, senders, receivers)."""
    e = _ends(edges, "sends", "recvs").select(F.col("to_id").alias("channel"), "from_id", "kind")
    return _gather(e, ["channel"], {"sends": _is("sends"), "recvs": _is("recvs")}, {"senders": ("from_id", _is("sends")), "receivers": ("from_id", _is("recvs"))})


def goroutine_spawns(edges: DataFrame) -> DataFrame:
    """(target, mode, spawns, spawners); edges.mode."""
    return _gather(_ends(edges, "spawns").select(F.col("to_id").alias("target"), "mode", "from_id"), ["target", "mode"], {"spawns": _ALL}, {"spawners": ("from_id", _ALL)})


def field_writers(edges: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, writes, writers) of writes whose target is one of fields(id)."""
    e = _ends(edges, "writes").join(fields.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return _gather(e.select(F.col("to_id").alias("field"), "from_id"), ["field"], {"writes": _ALL}, {"writers": ("from_id", _ALL)})


def ref_facts(edges: DataFrame, nodes: DataFrame, kinds: list[str], path: str | None = None) -> DataFrame:
    """(from_id, to_id, kind, ref_name, origin, tier, file_path): reference edges between known nodes, of the files under a path."""
    e = _ends(edges, *kinds).select("from_id", "to_id", "kind", "origin")
    e = _named(_named(e, nodes.withColumnRenamed("name", "ref_name"), "to_id", "ref_name"), nodes, "from_id", "file_path")
    if path is not None:
        e = e.where(F.col("file_path").startswith(path))
    return e.select("from_id", "to_id", "kind", "ref_name", "origin", S.tier_label(F.col("origin")).alias("tier"), "file_path")


def annotation_users(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, users): symbols that carry each annotation, counted once."""
    e = _ends(edges, "annotated").select(F.col("to_id").alias("id"), "from_id").distinct().groupBy("id").agg(F.count("*").alias("users"))
    return _named(e, nodes, "id", "name").select("id", "name", "users")


def config_readers(edges: DataFrame, keys: DataFrame, source: str | None = None) -> DataFrame:
    """(id, name, source, reads, readers) of keys(id, name, source), of one source where it is given."""
    keys = keys if source is None else keys.where(F.col("source") == source)
    e = _named(_ends(edges, "reads_config").select("to_id", "from_id"), keys, "to_id", "name", "source").withColumnRenamed("to_id", "id")
    return _gather(e, ["id", "name", "source"], {"reads": _ALL}, {"readers": ("from_id", _ALL)})


def env_var_users(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(name, reads, readers): configuration keys that come from the environment, by variable name."""
    e = _named(_ends(edges, "reads_config").select("to_id", "from_id"), keys.where("source = 'env'"), "to_id", "name")
    return _gather(e, ["name"], {"reads": _ALL}, {"readers": ("from_id", _ALL)})


def sql_call_sites(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, name, file_path, queries, reads, writes, tables); edges.op is write or anything else."""
    e = _named(_ends(edges, "queries").select("from_id", "to_id", F.coalesce("op", F.lit("")).alias("op")), nodes, "from_id", "name", "file_path").withColumnRenamed("from_id", "symbol")
    return _gather(e, ["symbol", "name", "file_path"], {"queries": _ALL, "reads": F.col("op") != "write", "writes": F.col("op") == "write"}, {"tables": ("to_id", _ALL)})


def level_of(level: Column) -> Column:
    """Canonical log level of a level or method name; null for none."""
    low = F.lower(level)
    return F.when(low.isin("warn", "warning", "warnf"), "warn").when(low.isin("info", "infof"), "info").when(low.isin("debug", "trace", "debugf"), "debug").when(low.isin("error", "errorf"), "error").when(low.isin("fatal", "fatalf"), "fatal")


def event_emitters(edges: DataFrame, events: DataFrame, level: str | None = None) -> DataFrame:
    """(id, name, event_kind, emits, emitters) of events(id, name, event_kind); edges.method, kept where its level is the one asked for."""
    e = _ends(edges, "emits")
    if level is not None:
        e = e.where(level_of(F.col("method")) == level)
    e = _named(e.select("from_id", "to_id"), events, "to_id", "name", "event_kind").withColumnRenamed("to_id", "id")
    return _gather(e, ["id", "name", "event_kind"], {"emits": _ALL}, {"emitters": ("from_id", _ALL)})


def pubsub(edges: DataFrame, topics: DataFrame, role: str | None = None) -> DataFrame:
    """(id, name, transport, publishes, subscribes, publishers, subscribers) of topics(id, name, transport); role publish or subscribe keeps topics that have such."""
    e = _named(_ends(edges, "emits", "listens_on").select("from_id", "to_id", "kind"), topics, "to_id", "name", "transport").withColumnRenamed("to_id", "id")
    out = _gather(e, ["id", "name", "transport"], {"publishes": _is("emits"), "subscribes": _is("listens_on")}, {"publishers": ("from_id", _is("emits")), "subscribers": ("from_id", _is("listens_on"))})
    return out if role is None else out.where(F.col(f"{role}s") > 0 if role == "subscribe" else F.col("publishes") > 0)


def string_emitters(edges: DataFrame, strings: DataFrame, context: str | None = None) -> DataFrame:
    """(id, context, value, emits, emitters) of strings(id, context, value)."""
    strings = strings if context is None else strings.where(F.col("context") == context)
    e = _named(_ends(edges, "emits").select("from_id", "to_id"), strings, "to_id", "context", "value").withColumnRenamed("to_id", "id")
    return _gather(e, ["id", "context", "value"], {"emits": _ALL}, {"emitters": ("from_id", _ALL)})


def log_events(edges: DataFrame, strings: DataFrame, level: str | None = None) -> DataFrame:
    """(value, level, emits, emitters) of log messages; the level is the edge's, or else its method's."""
    e = _named(_ends(edges, "emits").select("from_id", "to_id", F.coalesce("level", level_of(F.col("method"))).alias("level")), strings.where("context = 'log_message'"), "to_id", "value")
    out = _gather(e, ["value", "level"], {"emits": _ALL}, {"emitters": ("from_id", _ALL)})
    return out if level is None else out.where(F.col("level") == level)


def error_surface(edges: DataFrame, nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """(symbol, file_path, throws, kinds, errors, messages): what each thrower throws, and the error texts that it emits; kinds counts distinct errors."""
    t = _ends(edges, "throws").select("from_id", "to_id", "kind")
    m = _ends(edges, "emits").join(strings.where("context = 'error_msg'").select(F.col("id").alias("to_id"), "value"), "to_id").join(t.select("from_id"), "from_id", "left_semi").select("from_id", F.col("value").alias("to_id"), "kind")
    e = _named(t.unionByName(m), nodes, "from_id", "file_path").withColumnRenamed("from_id", "symbol")
    n = t.distinct().groupBy(F.col("from_id").alias("symbol")).agg(F.count("*").alias("kinds"))
    return _gather(e, ["symbol", "file_path"], {"throws": _is("throws")}, {"errors": ("to_id", _is("throws")), "messages": ("to_id", _is("emits"))}).join(n, "symbol")


def routes(edges: DataFrame, contracts: DataFrame, kind: str | None = None) -> DataFrame:
    """(handler, route, route_kind, method, path) of contracts(id, type, method, path, service, topic, operation, field).

    http and ws routes have a method and a path, grpc a service and a method, topics a name, graphql an operation and a field.
    """
    method = F.when(F.col("type") == "graphql", F.col("operation")).when(F.col("type") == "topic", "").otherwise(F.col("method"))
    path = F.when(F.col("type") == "graphql", F.col("field")).when(F.col("type") == "topic", F.col("topic")).when(F.col("type") == "grpc", F.col("service")).otherwise(F.col("path"))
    c = contracts.select(F.col("id").alias("to_id"), F.col("type").alias("route_kind"), method.alias("method"), path.alias("path"))
    c = c if kind is None else c.where(F.col("route_kind") == kind)
    return _ends(edges, "handles_route").select("from_id", "to_id").join(c, "to_id").select(F.col("from_id").alias("handler"), F.col("to_id").alias("route"), "route_kind", "method", "path")


def models(edges: DataFrame, tables: DataFrame, orm: str | None = None) -> DataFrame:
    """(model, table_name, orm, derivation): edges.orm, .table_name, .derivation; a missing table name is the target's name."""
    e = _ends(edges, "models_table")
    e = e if orm is None else e.where(F.col("orm") == orm)
    j = e.join(tables.select(F.col("id").alias("to_id"), "name"), "to_id", "left")
    return j.select(F.col("from_id").alias("model"), F.coalesce(F.nullif("table_name", F.lit("")), "name", "to_id").alias("table_name"), "orm", "derivation")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, fan_in, fan_out) of what renders or is rendered."""
    e = _ends(edges, "renders_child").select(F.inline(F.array(F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return _named(e.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")), nodes, "id", "name").select("id", "name", "fan_in", "fan_out")


def _out_degrees(edges: DataFrame, nodes: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """nodes with the number of edges of each kind that leave them, zero where none does."""
    d = _ends(edges, *kinds).groupBy(F.col("from_id").alias("id")).agg(*[F.count_if(_is(k)).alias(n) for k, n in kinds.items()])
    return nodes.join(d, "id", "left").fillna(0, list(kinds.values()))


def k8s_resources(edges: DataFrame, resources: DataFrame) -> DataFrame:
    """resources(id, k8s_kind, namespace, name) with depends_on, configures, mounts, exposes, uses_env counts."""
    return _out_degrees(edges, resources, {k: k for k in ("depends_on", "configures", "mounts", "exposes", "uses_env")})


def images(edges: DataFrame, built: DataFrame, role: str | None = None) -> DataFrame:
    """built(id, ref, tag, role) with the number of edges that depend on each."""
    n = _ends(edges, "depends_on").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("consumers"))
    return (built if role is None else built.where(F.col("role") == role)).join(n, "id", "left").fillna(0, ["consumers"])


def kustomize(edges: DataFrame, overlays: DataFrame) -> DataFrame:
    """overlays(id, dir) with the bases they depend on and the resources they name."""
    return _out_degrees(edges, overlays, {"depends_on": "depends_on", "references": "resources"})


def tests_as_edges(edges: DataFrame, nodes: DataFrame, by: str = "symbol") -> DataFrame:
    """(id, name, n, others): tests of each symbol, or with by="test" symbols of each test; n counts distinct partners."""
    here, there = ("to_id", "from_id") if by == "symbol" else ("from_id", "to_id")
    e = _named(_ends(edges, "tests").select("from_id", "to_id").distinct(), nodes, here, "name").select(F.col(here).alias("id"), "name", F.col(there).alias("other"))
    return _gather(e, ["id", "name"], {"n": _ALL}, {"others": ("other", _ALL)})
