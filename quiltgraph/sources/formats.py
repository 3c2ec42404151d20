"""Readers and writers of the files around a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def coverage_profile(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, start, end, statements, count) of ``file:line.col,line.col statements count`` lines."""
    m = lambda i: F.regexp_extract("value", r"^(.+):([0-9]+)\.[0-9]+,([0-9]+)\.[0-9]+ ([0-9]+) ([0-9]+)$", i)
    return spark.read.text(path).where(F.col("value").rlike(r":[0-9]+\.[0-9]+,")).select(m(1).alias("file_path"), m(2).cast("int").alias("start"), m(3).cast("int").alias("end"), m(4).cast("int").alias("statements"), m(5).cast("int").alias("count"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, author, ts, file) of records ``commit|author|unix time`` followed by file names, records apart by NUL."""
    rec = spark.read.text(path, lineSep="\u0000").where("length(trim(value)) > 0")
    parts = rec.select(F.split(F.trim("value"), "\n").alias("p"))
    head = F.split(F.element_at("p", 1), r"\|")
    return parts.select(head[0].alias("commit"), head[1].alias("author"), F.timestamp_seconds(head[2].cast("long")).alias("ts"), F.explode(F.filter(F.expr("slice(p, 2, size(p))"), lambda x: x != "")).alias("file"))


def blame_porcelain(spark: SparkSession, path: str) -> DataFrame:
    """(commit, line, author, ts) from files of line-porcelain records, one file of blame a row."""
    text = spark.read.text(path, wholetext=True)
    rec = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^([0-9a-f]{40}) [0-9]+ ([0-9]+)(?:.*\n)author (.*)\n(?:.*\n)*?author-time ([0-9]+)"), F.lit(0))).alias("r"))
    x = lambda p, i: F.regexp_extract("r", p, i)
    return rec.select(x(r"^([0-9a-f]{40})", 1).alias("commit"), x(r"^[0-9a-f]{40} [0-9]+ ([0-9]+)", 1).cast("int").alias("line"), x(r"\nauthor (.*)", 1).alias("author"), F.timestamp_seconds(x(r"author-time ([0-9]+)", 1).cast("long")).alias("ts"))


def codeowners(spark: SparkSession, path: str) -> DataFrame:
    """(rule_no, prefix, owner): rules in order, comments left out. A rule file is one small file."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("rule_no", "line"))
    t = t.where(~F.col("line").rlike(r"^\s*(#|$)"))
    return t.select("rule_no", F.regexp_replace(F.regexp_replace(F.regexp_extract("line", r"^\s*(\S+)", 1), "^/", ""), r"\*+$", "").alias("prefix"), F.regexp_extract("line", r"^\s*\S+\s+(.*\S)", 1).alias("owner"))


def diff_hunks(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, h_start, h_end) of the new side of unified diffs."""
    text = spark.read.text(path, wholetext=True)
    per_file = text.select(F.explode(F.split("value", r"(?m)^diff --git .*$")).alias("d")).select(F.regexp_extract("d", r"(?m)^\+\+\+ b/(.*)$", 1).alias("file_path"), "d").where("file_path <> ''")
    h = per_file.select("file_path", F.explode(F.regexp_extract_all("d", F.lit(r"(?m)^@@ -[0-9,]+ \+([0-9]+(?:,[0-9]+)?) @@"), F.lit(1))).alias("h"))
    start = F.split("h", ",")[0].cast("int")
    count = F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("int"), F.lit(1))
    return h.select("file_path", start.alias("h_start"), (start + F.greatest(count, F.lit(1)) - 1).alias("h_end"))


def jsonl_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def benchmark_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(_id, title, text), queries(_id, text) and relevance(query-id, corpus-id, score)."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    return corpus, queries, spark.read.option("header", True).option("sep", "\t").schema("`query-id` string, `corpus-id` string, score int").csv(f"{folder}/qrels")


def live_schema(spark: SparkSession, url: str, properties: dict[str, str]) -> DataFrame:
    """Columns of a live database through JDBC (the driver's jar must be on the class path)."""
    return spark.read.jdbc(url, "(SELECT table_schema, table_name, column_name, data_type FROM information_schema.columns) c", properties=properties)


def source_files(spark: SparkSession, folder: str, languages: dict[str, str]) -> DataFrame:
    """(file_path, language, content, sha) of files whose ending is listed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    lang = F.try_element_at(F.create_map(*[F.lit(x) for kv in languages.items() for x in kv]), ending)
    return f.select(F.col("path").alias("file_path"), lang.alias("language"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("sha")).where("language IS NOT NULL")


def merkle(files: DataFrame, depth: int) -> DataFrame:
    """(dir, level, sha): a folder's hash over its sorted entries, from the deepest level up; files(file_path, sha)."""
    up = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    out = None
    rows = files.select(F.col("file_path").alias("name"), "sha")
    for level in range(depth):
        rows = rows.where("name <> ''").groupBy(up(F.col("name")).alias("dir")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha"))), "\n"), 256).alias("sha")).select("dir", "sha")
        found = rows.select("dir", F.lit(level).alias("level"), "sha")
        out = found if out is None else out.unionByName(found)
        rows = rows.select(F.col("dir").alias("name"), "sha")
    return out


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, change) between two manifests (file_path, sha)."""
    j = before.select("file_path", F.col("sha").alias("a")).join(after.select("file_path", F.col("sha").alias("b")), "file_path", "full_outer")
    return j.select("file_path", F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified").alias("change")).where("change IS NOT NULL")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Tables partitioned by kind, so that a kind is a folder to prune to."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def _quote(c):
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of CREATE statements."""
    n = nodes.select(F.concat(F.lit("CREATE (:"), F.col("kind"), F.lit(" {id: "), _quote(F.col("id")), F.lit(", name: "), _quote(F.col("name")), F.lit("});")).alias("line"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), _quote(F.col("from_id")), F.lit("}), (b {id: "), _quote(F.col("to_id")), F.lit("}) CREATE (a)-[:"), F.upper("kind"), F.lit("]->(b);")).alias("line"))
    return n.unionByName(e)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of node and edge elements, to stand between a graphml header and footer."""
    x = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.concat(F.lit('<node id="'), x(F.col("id")), F.lit('"><data key="kind">'), x(F.col("kind")), F.lit("</data></node>")).alias("line"))
    return n.unionByName(edges.select(F.concat(F.lit('<edge source="'), x(F.col("from_id")), F.lit('" target="'), x(F.col("to_id")), F.lit('"><data key="kind">'), x(F.col("kind")), F.lit("</data></edge>")).alias("line")))


def mermaid(edges: DataFrame) -> DataFrame:
    name = lambda c: F.concat(F.lit("n"), F.substring(F.md5(c), 1, 8), F.lit('["'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"]'))
    return edges.select(F.concat(F.lit("  "), name(F.col("from_id")), F.lit(" -->|"), F.col("kind"), F.lit("| "), name(F.col("to_id"))).alias("line"))


def dot(edges: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), q(F.col("from_id")), F.lit(" -> "), q(F.col("to_id")), F.lit(' [label="'), F.col("kind"), F.lit('"];')).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
