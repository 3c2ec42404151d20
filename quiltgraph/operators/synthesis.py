"""Edges derived from other edges, and the extension registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(sources: DataFrame, targets: DataFrame, key: str, kind: str, synthesizer: str) -> DataFrame:
    """(from_id, to_id, kind, synthesizer): every source with every target of its key; channel, stub, activity, mapper and store names all work so."""
    return sources.select(F.col("id").alias("from_id"), key).join(targets.select(F.col("id").alias("to_id"), key), key).where("from_id <> to_id").select("from_id", "to_id", F.lit(kind).alias("kind"), F.lit(synthesizer).alias("synthesizer")).distinct()


def external_nodes(edges: DataFrame) -> DataFrame:
    """(id, kind, name) placeholders for external targets."""
    e = edges.where(F.col("to_id").startswith("external::")).select(F.col("to_id").alias("id")).distinct()
    return e.select("id", F.lit("module").alias("kind"), F.regexp_replace("id", "^external::", "").alias("name"))


def speculative_dispatch(calls: DataFrame, candidates: DataFrame, cap: int = 8) -> DataFrame:
    """calls(from_id, name) with candidates(id, name), flagged; names of more than cap candidates say nothing (that is the rule, and they are left out whole)."""
    few = candidates.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= cap)
    return calls.join(candidates.join(few, "name", "left_semi"), "name").select("from_id", F.col("id").alias("to_id"), F.lit("calls").alias("kind"), F.lit("speculative").alias("origin"))


def test_edges(nodes: DataFrame, edges: DataFrame, is_test: Column) -> DataFrame:
    """Calls from test code to other code, as tests edges."""
    t = nodes.select(F.col("id").alias("from_id"), is_test.alias("test"))
    to = nodes.select(F.col("id").alias("to_id"), is_test.alias("target_test"))
    return edges.where("kind = 'calls'").join(t, "from_id").join(to, "to_id").where("test AND NOT target_test").select("from_id", "to_id", F.lit("tests").alias("kind")).distinct()


def capability_edges(edges: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Edges of a capability kind for calls whose target id fits its pattern."""
    out = None
    for kind, pattern in rules.items():
        e = edges.where((F.col("kind") == "calls") & F.col("to_id").rlike(pattern)).select("from_id", "to_id", F.lit(kind).alias("kind"))
        out = e if out is None else out.unionByName(e)
    return out


def overload_rank(candidates: DataFrame) -> DataFrame:
    """Best overload a call by shared argument types; candidates(call, id, args, hint), ties by id."""
    score = F.size(F.array_intersect("args", "hint")) - F.abs(F.size("args") - F.size("hint"))
    return candidates.groupBy("call").agg(F.max_by("id", F.struct(score, F.col("id"))).alias("id"))


class Registry:
    """Named detectors, signals and extractors that users add: name -> callable."""

    def __init__(self):
        self.items: dict[str, Callable] = {}

    def add(self, name: str, fn: Callable) -> Callable:
        if name in self.items:
            raise ValueError(f"{name} is taken")
        self.items[name] = fn
        return fn

    def get(self, name: str) -> Callable:
        return self.items[name]

    def names(self) -> list[str]:
        return sorted(self.items)


#: Signals: name -> callable that gives a Column. Detectors: name -> callable over a table of texts. Extractors: name -> callable over files.
SIGNALS, DETECTORS, EXTRACTORS = Registry(), Registry(), Registry()


def pick_unique(stubs: DataFrame, candidates: DataFrame, *keys: str) -> DataFrame:
    """stubs with target: the only candidate of the caller's repository, else, where it has none, the only one of all, else null.

    stubs(repo, keys), candidates(id, repo, keys). Candidates fold to one row a key before they are joined, so a key that many
    candidates share multiplies nothing. A stub with a null key or repository can match by the other rules alone.
    """
    c = candidates.where(F.col("id").isNotNull()).select("id", F.col("repo").alias("repo"), *keys).distinct()
    here = c.groupBy(*keys, "repo").agg(F.count("*").alias("_here"), F.min("id").alias("_own"))
    everywhere = c.groupBy(*keys).agg(F.count("*").alias("_all"), F.min("id").alias("_any"))
    target = F.when(F.col("_here") == 1, F.col("_own")).when(F.col("_here").isNull() & (F.col("_all") == 1), F.col("_any"))
    return stubs.join(here, [*keys, "repo"], "left").join(everywhere, list(keys), "left").withColumn("target", target).drop("_here", "_own", "_all", "_any")


def _synthesized(picked: DataFrame, placeholder: Column, origin: Column, confidence: Column, name: str) -> DataFrame:
    """(from_id, to_id, kind, origin, confidence, synthesizer): resolved stubs, and placeholders with no origin for the others."""
    hit = F.col("target").isNotNull()
    return picked.select("from_id", F.coalesce("target", placeholder).alias("to_id"), F.lit("calls").alias("kind"), F.when(hit, origin).alias("origin"), F.when(hit, confidence).alias("confidence"), F.when(hit, F.lit(name)).alias("synthesizer"))


def grpc_calls(stubs: DataFrame, registrations: DataFrame, types: DataFrame, members: DataFrame, implements: DataFrame) -> DataFrame:
    """Client stub calls joined to server methods.

    stubs(from_id, service, method, repo); registrations(service, impl, repo, dir) name the type that serves; types(id, name, kind, repo,
    dir); members(type_id, id, name, repo) are methods; implements(from_id, to_id). A registered type counts first: the only one of its
    name, else the smallest id of the registration's folder, else the only one of its repository. After that, implementors of the
    interface <service>Server, but those named Unimplemented. Calls with an empty service or method are left out.
    """
    t = types.where("kind = 'type'").select("id", F.col("name").alias("impl"), "repo", "dir")
    r = registrations.where("service <> '' AND impl <> ''").distinct()
    near = t.where("dir <> ''").groupBy("impl", "dir").agg(F.min("id").alias("_near"))
    sole = t.groupBy("impl").agg(F.count("*").alias("_n"), F.min("id").alias("_sole"))
    own = t.groupBy("impl", "repo").agg(F.count("*").alias("_k"), F.min("id").alias("_own"))
    served = r.join(sole, "impl").join(near, ["impl", "dir"], "left").join(own, ["impl", "repo"], "left")
    served = served.select("service", F.when(F.col("_n") == 1, F.col("_sole")).when(F.col("_near").isNotNull(), F.col("_near")).when(F.col("_k") == 1, F.col("_own")).alias("type_id")).where("type_id IS NOT NULL").distinct()
    faces = types.where((F.col("kind") == "interface") & F.col("name").endswith("Server") & (F.length("name") > 6)).select(F.col("id").alias("to_id"), F.expr("left(name, length(name) - 6)").alias("service"))
    bodies = types.where(~F.col("name").startswith("Unimplemented")).select(F.col("id").alias("from_id"))
    inferred = implements.select("from_id", "to_id").join(faces, "to_id").join(bodies, "from_id", "left_semi").select("service", F.col("from_id").alias("type_id")).distinct()
    methods = members.select("type_id", "id", F.col("name").alias("method"), "repo")
    s = stubs.where("service <> '' AND method <> ''").select("from_id", "service", "method", "repo")
    first = pick_unique(s, served.join(methods, "type_id"), "service", "method").withColumnRenamed("target", "first")
    both = pick_unique(first, inferred.join(methods, "type_id"), "service", "method").withColumn("target", F.coalesce("first", "target"))
    registered = F.col("first").isNotNull()
    return _synthesized(both, F.concat(F.lit("unresolved::grpc::"), "service", F.lit("::"), "method"), F.when(registered, "ast_resolved").otherwise("ast_inferred"), F.when(registered, 0.9).otherwise(0.7), "grpc-stub")


def workflow_calls(stubs: DataFrame, registered: DataFrame) -> DataFrame:
    """Workflow and activity calls by name: stubs(from_id, role, name, repo) with registered(id, role, name, repo)."""
    s = stubs.where("role <> '' AND name <> ''").select("from_id", "role", "name", "repo")
    return _synthesized(pick_unique(s, registered, "role", "name"), F.concat(F.lit("unresolved::temporal::"), "role", F.lit("::"), "name"), F.lit("ast_resolved"), F.lit(0.9), "workflow")


def mapper_calls(statements: DataFrame, methods: DataFrame) -> DataFrame:
    """Mapper statements with the methods they back: statements(from_id, namespace, statement, repo), methods(id, receiver, name, repo).

    The last part of the namespace is the class; class and statement name the method.
    """
    s = statements.where("namespace <> '' AND statement <> ''").select("from_id", "namespace", "statement", "repo", F.substring_index("namespace", ".", -1).alias("receiver"), F.col("statement").alias("name"))
    c = methods.where("receiver <> '' AND name <> ''")
    return _synthesized(pick_unique(s, c, "receiver", "name"), F.concat(F.lit("unresolved::mybatis::"), "namespace", F.lit("::"), "statement"), F.lit("ast_inferred"), F.lit(0.7), "mapper")
