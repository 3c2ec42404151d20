"""The property graph that the registered queries run on, projected from the driver's tables.

nodes: regions are packages, nations files, customers functions, suppliers types
(interfaces where the balance is negative), parts functions and methods.
edges: files define symbols, parts are members of the suppliers that sell them, a customer
calls the first part of each order and references its suppliers, a part calls the
next part of an order, types implement interfaces that share a part, files import files.

The SQL text is plain enough for Spark and for DuckDB, so both sides of a
comparison start from the same rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import shared_folder

NODES_SQL = """
SELECT 'pkg::' || CAST(r_regionkey AS VARCHAR(20)) AS id, 'package' AS kind, r_name AS name, '' AS qual_name, lower(r_name) AS file_path, 0 AS start_line, 0 AS end_line, '' AS language, r_name AS repo_prefix, 'tpch' AS workspace_id, '' AS project_id FROM region
UNION ALL SELECT 'file::' || CAST(n_nationkey AS VARCHAR(20)), 'file', n_name, '', lower(r_name) || '/' || lower(n_name) || '.go', 1, 10000, 'go', r_name, 'tpch', '' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'fn::c' || CAST(c_custkey AS VARCHAR(20)), 'function', c_name, lower(n_name) || '.' || c_name, lower(r_name) || '/' || lower(n_name) || '.go', CAST(c_custkey * 10 + 1 AS INT), CAST(c_custkey * 10 + 9 AS INT), lower(c_mktsegment), r_name, 'tpch', '' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'type::' || CAST(s_suppkey AS VARCHAR(20)), CASE WHEN s_acctbal < 0 THEN 'interface' ELSE 'type' END, s_name, lower(n_name) || '.' || s_name, lower(r_name) || '/' || lower(n_name) || '_types.go', CAST(s_suppkey * 50 + 1 AS INT), CAST(s_suppkey * 50 + 40 AS INT), 'go', r_name, 'tpch', '' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'fn::p' || CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_size <= 25 THEN 'function' ELSE 'method' END, p_name, '', 'lib/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || CASE WHEN p_size > 45 THEN '_test.go' ELSE '.go' END, CAST(p_partkey * 5 + 1 AS INT), CAST(p_partkey * 5 + p_size AS INT), 'go', 'LIB', 'tpch', 'lib' FROM part
"""

_ORIGIN = "CASE l_returnflag WHEN 'R' THEN 'lsp_resolved' WHEN 'A' THEN CASE l_linestatus WHEN 'O' THEN 'text_matched' ELSE 'ast_inferred' END ELSE 'ast_resolved' END"
_NEXT = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_returnflag, l_linestatus, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS next_part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem"
EDGES_SQL = f"""
SELECT from_id, to_id, kind, file_path, line, max(confidence) AS confidence, max(origin) AS origin FROM (
SELECT 'fn::c' || CAST(o_custkey AS VARCHAR(20)) AS from_id, 'fn::p' || CAST(l_partkey AS VARCHAR(20)) AS to_id, 'calls' AS kind, 'orders.go' AS file_path, CAST(l_linenumber AS INT) AS line, 1 - l_discount AS confidence, {_ORIGIN} AS origin FROM ({_NEXT}) l JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1
UNION ALL SELECT 'fn::p' || CAST(l_partkey AS VARCHAR(20)), 'fn::p' || CAST(next_part AS VARCHAR(20)), 'calls', 'lib.go', CAST(l_linenumber AS INT), 1 - l_discount, {_ORIGIN} FROM ({_NEXT}) l WHERE next_part IS NOT NULL
UNION ALL SELECT 'fn::c' || CAST(o_custkey AS VARCHAR(20)), 'type::' || CAST(l_suppkey AS VARCHAR(20)), 'references', 'orders.go', 0, 1 - l_discount, {_ORIGIN} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'fn::p' || CAST(l_partkey AS VARCHAR(20)), 'type::' || CAST(l_suppkey AS VARCHAR(20)), 'member_of', 'lib.go', 0, 1 - l_tax, 'ast_resolved' FROM lineitem
UNION ALL SELECT 'type::' || CAST(a.l_suppkey AS VARCHAR(20)), 'type::' || CAST(b.l_suppkey AS VARCHAR(20)), 'implements', 'types.go', 0, CAST(1.0 AS DOUBLE), 'ast_inferred' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0) b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey
UNION ALL SELECT 'file::' || CAST(c_nationkey AS VARCHAR(20)), 'file::' || CAST(s_nationkey AS VARCHAR(20)), 'imports', '', 0, CAST(1.0 AS DOUBLE), 'ast_resolved' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey
UNION ALL SELECT 'file::' || CAST(c_nationkey AS VARCHAR(20)), 'fn::c' || CAST(c_custkey AS VARCHAR(20)), 'defines', '', 0, CAST(1.0 AS DOUBLE), 'ast_resolved' FROM customer
UNION ALL SELECT 'file::' || CAST(s_nationkey AS VARCHAR(20)), 'type::' || CAST(s_suppkey AS VARCHAR(20)), 'defines', '', 0, CAST(1.0 AS DOUBLE), 'ast_resolved' FROM supplier
) e GROUP BY from_id, to_id, kind, file_path, line
"""
#: Kinds of the edge table.
KINDS = ("calls", "references", "member_of", "implements", "imports", "defines")
#: Origins in the order of their names, so that the largest number is the largest name.
_ORIGINS = ("ast_inferred", "ast_resolved", "lsp_resolved", "text_matched")
#: Kinds of the typed edge table, one for each (line number, return flag, line status).
TYPED_KINDS = (
    "sends", "recvs", "spawns", "writes", "reads", "accesses_field",
    "annotated", "reads_config", "reads_env", "queries", "reads_col", "writes_col",
    "emits", "listens_on", "throws", "toggles_flag", "handles_route", "models_table",
    "renders_child", "configures", "mounts", "exposes", "depends_on", "uses_env",
    "tests", "covered_by", "produces_topic", "consumes_topic", "provides", "consumes",
    "value_flow", "arg_of", "returns_to", "extends", "composes", "overrides",
    "returns", "typed_as", "cross_repo_calls", "cross_repo_implements", "cross_repo_extends", "licensed_as",
)
_KINDS = ", ".join(f"'{k}'" for k in TYPED_KINDS)
_TYPED = """SELECT 'type::' || CAST(l_suppkey AS VARCHAR(20)) AS from_id, 'fn::p' || CAST(l_partkey AS VARCHAR(20)) AS to_id,
 {pick} AS kind, 'typed.go' AS file_path, CAST(l_orderkey AS INT) AS line, l_shipdate AS ts, l_quantity AS weight, 1 - l_discount AS confidence,
 CASE l_returnflag WHEN 'R' THEN 'lsp_resolved' WHEN 'A' THEN 'ast_inferred' ELSE 'text_matched' END AS origin,
 CASE WHEN l_tax > 0.06 THEN 'true' ELSE 'false' END AS flag, CAST(CAST(l_tax * 100 AS INT) AS VARCHAR(20)) AS label FROM lineitem"""
_SLOT = "CAST((l_linenumber - 1) * 6 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END + 1 AS INT)"
TYPED_SPARK = _TYPED.format(pick=f"element_at(array({_KINDS}), {_SLOT})")
TYPED_DUCK = _TYPED.format(pick=f"([{_KINDS}])[{_SLOT}]")
#: WITH clause of the DuckDB side.
WITH = f"WITH nodes AS MATERIALIZED ({NODES_SQL}), edges AS MATERIALIZED ({EDGES_SQL})"
WITH_TYPED = f"WITH nodes AS MATERIALIZED ({NODES_SQL}), typed AS MATERIALIZED ({TYPED_DUCK})"
WITH_ALL = f"{WITH}, typed AS MATERIALIZED ({TYPED_DUCK})"

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


_FROM = re.compile(r"\b(FROM|JOIN) (" + "|".join(_TABLES) + r")\b")
#: Graph tables that this session has written, by application, folder and input files.
_WRITTEN: dict = {}


class Graph:
    """nodes, edges and typed edges of one data folder.

    The graph tables are written once a session, as Parquet in the shared folder with edges partitioned by kind, so a
    query reads the kinds and columns that it needs instead of building the graph from the raw tables each time. Each
    kind of edge is made when a query first asks for it: its keys are grouped as numbers, and only what is left gets names.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}

    def _sql(self, text: str) -> DataFrame:
        """SQL over the raw tables, passed as arguments: no view of the caller's is touched."""
        used = {m.group(2) for m in _FROM.finditer(text)}
        return self.spark.sql(_FROM.sub(r"\1 {\2}", text), **{t: self.tables[t] for t in used})

    def _path(self, name: str, text: str) -> str:
        files = sorted(f for t in self.tables.values() for f in t.inputFiles())
        folder = shared_folder(self.spark)
        tag = hashlib.md5("\n".join([name, text, *files]).encode()).hexdigest()
        return f"{folder}/graph-{self.spark.sparkContext.applicationId}-{name}-{tag}"

    def _stored(self, name: str, text: str, *by: str) -> DataFrame:
        path = self._path(name, text)
        if path not in _WRITTEN:
            df = self._sql(text)
            df.write.mode("overwrite").partitionBy(*by).parquet(path)
            _WRITTEN[path] = df.schema
        schema = _WRITTEN[path]
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    @property
    def nodes(self) -> DataFrame:
        return self._stored("nodes", NODES_SQL)

    def _edges_of_kind(self, kind: str) -> DataFrame:
        """(from_id, to_id, file_path, line, confidence, origin): the rows of EDGES_SQL of one kind, parallel ones grouped before they get names."""
        t = self.tables
        named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        inferred = F.when(status == "O", _ORIGINS.index("text_matched")).otherwise(_ORIGINS.index("ast_inferred"))
        origin = F.when(flag == "R", _ORIGINS.index("lsp_resolved")).when(flag == "A", inferred).otherwise(_ORIGINS.index("ast_resolved"))

        def out(df: DataFrame, start: Column, end: Column, file: str | Column, line: Column | None = None) -> DataFrame:
            name = F.element_at(F.array(*map(F.lit, _ORIGINS)), F.col("o") + 1)
            return df.select(start.alias("from_id"), end.alias("to_id"), (F.lit(file) if isinstance(file, str) else file).alias("file_path"), (F.lit(0) if line is None else line).cast("int").alias("line"), F.col("c").alias("confidence"), name.alias("origin"))

        def grouped(df: DataFrame, *keys: str) -> DataFrame:
            return df.groupBy(*keys).agg(F.max("c").alias("c"), F.max("o").alias("o"))

        def plain(df: DataFrame, name: str) -> DataFrame:
            return df.withColumns({"c": F.lit(1.0), "o": F.lit(_ORIGINS.index(name))})

        if kind == "calls":
            w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
            step = t["lineitem"].select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("int").alias("line"), (1 - F.col("l_discount")).alias("c"), origin.alias("o"), F.lead("l_partkey").over(w).alias("next"), F.row_number().over(w).alias("rn"))
            # one pass gives both ends of a line: from the order's customer to its first part, and from each part to the next
            both = step.join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
            first = F.struct(((F.col("rn") == 1) & F.col("o_orderkey").isNotNull()).alias("is"), F.lit(True).alias("first"), F.col("o_custkey").cast("long").alias("a"), F.col("l_partkey").cast("long").alias("b"))
            on = F.struct(F.col("next").isNotNull().alias("is"), F.lit(False).alias("first"), F.col("l_partkey").cast("long").alias("a"), F.col("next").cast("long").alias("b"))
            got = grouped(both.select("line", "c", "o", F.inline(F.array(first, on))).where("is"), "first", "a", "b", "line")
            head, file = (F.when(F.col("first"), x).otherwise(y) for x, y in (("fn::c", "fn::p"), ("orders.go", "lib.go")))
            return out(got, F.concat(head, F.col("a").cast("string")), named("fn::p", "b"), file, F.col("line"))
        if kind == "references":
            lines = t["lineitem"].select("l_orderkey", "l_suppkey", (1 - F.col("l_discount")).alias("c"), origin.alias("o"))
            both = lines.join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            return out(grouped(both, "o_custkey", "l_suppkey"), named("fn::c", "o_custkey"), named("type::", "l_suppkey"), "orders.go")
        if kind == "member_of":
            lines = t["lineitem"].select("l_partkey", "l_suppkey", (1 - F.col("l_tax")).alias("c"), F.lit(_ORIGINS.index("ast_resolved")).alias("o"))
            return out(grouped(lines, "l_partkey", "l_suppkey"), named("fn::p", "l_partkey"), named("type::", "l_suppkey"), "lib.go")
        if kind == "implements":
            sold = t["lineitem"].select("l_partkey", "l_suppkey").distinct()
            owing = sold.join(t["supplier"].where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select("l_partkey", F.col("l_suppkey").alias("to"))
            pairs = sold.join(owing, "l_partkey").where("l_suppkey <> to").select("l_suppkey", "to").distinct()
            return out(plain(pairs, "ast_inferred"), named("type::", "l_suppkey"), named("type::", "to"), "types.go")
        if kind == "imports":
            home = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
            met = t["lineitem"].select("l_orderkey", "l_suppkey").join(home, F.col("l_orderkey") == F.col("o_orderkey")).select("c_nationkey", "l_suppkey").distinct()
            pairs = met.join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey < s_nationkey").select("c_nationkey", "s_nationkey").distinct()
            return out(plain(pairs, "ast_resolved"), named("file::", "c_nationkey"), named("file::", "s_nationkey"), "")
        of = lambda table, start, prefix, end: out(plain(t[table], "ast_resolved"), named("file::", start), named(prefix, end), "")
        return of("customer", "c_nationkey", "fn::c", "c_custkey").unionByName(of("supplier", "s_nationkey", "type::", "s_suppkey")).distinct()

    def edges_of(self, *kinds: str) -> DataFrame:
        """The edges of these kinds; only they are made and read."""
        path = self._path("edges", EDGES_SQL)
        for kind in kinds:
            if (path, kind) not in _WRITTEN:
                df = self._edges_of_kind(kind)
                df.write.mode("overwrite").parquet(f"{path}/kind={kind}")
                _WRITTEN[path, kind] = df.schema
        columns = {f.name: f.dataType.simpleString() for f in _WRITTEN[path, kinds[0]]} | {"kind": "string"}
        names = ["from_id", "to_id", "kind", "file_path", "line", "confidence", "origin"]
        got = self.spark.read.option("basePath", path).schema(", ".join(f"{c} {columns[c]}" for c in names))
        return got.parquet(*[f"{path}/kind={k}" for k in kinds]).select(*names)

    @property
    def edges(self) -> DataFrame:
        return self.edges_of(*KINDS)

    @property
    def typed(self) -> DataFrame:
        return self._stored("typed", TYPED_SPARK, "kind")
