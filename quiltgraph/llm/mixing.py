"""Mixing sources to target weights by systematic sampling.

``source_targets`` shares a budget of words by weight, with a cap a source, the
excess reshared until none is above (closed form over the sorted cap ratios).
``mix`` gives every document of a source the same expected copies, target / size
of the source, prefix-sums them in (size, id) order, adds one random offset a
source and takes a copy for each integer crossed. In size order the words taken
differ from the target by about the longest document at most.

Prefix sums are two-level so that no source is one task: counts a (source, size),
then counts a (source, size, hash bucket of the id), then a row number inside a
bucket. Only (row, source, size) shuffles, never texts.

Nulls: a null text has size 0 and is never taken; a null source is a source of its
own, last in code-point order. Repeated rows are taken independently. Empty
table: empty result. Extra columns are ignored by the query and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, table

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def size_of(text: Column) -> Column:
    """Number of words: what is left of runs of non-space when each becomes one mark."""
    t = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(F.regexp_replace(t, r"[^\x20\x09-\x0D]+", "\u0001"), SPACE, "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) a source; a source table is small, so one task orders it."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), n.cast("int") + 1)
    rows = sizes.select("source", "source_size", w.alias("weight")).withColumn("_cap", F.col("source_size") * cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("_level", level)
    # the level where the first source, in order of cap ratios, no longer reaches its cap
    water = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    return rows.withColumn("_water", water).select(
        "source", "source_size", "weight",
        F.when(F.col("_water").isNull() | (F.col("_ratio") <= F.col("_water")), F.col("_cap")).otherwise(F.col("weight") * F.col("_water")).alias("target"),
    )


def offset(source: Column, seed: str = SEED) -> Column:
    """One random number in [0, 1) a source, in steps of 2**-28."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(source, F.lit("\u0000")), F.lit("|" + seed))), 1, 7), 16, 10).cast("double") / float(1 << 28)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row."""
    source = F.col(f"`{source_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), size_of(F.col(f"`{text_col}`")).alias("size"))
    # a key that is never null; documents of one size fall into buckets by hash of the id
    rows = rows.withColumn("s", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), "source")))
    rows = rows.withColumn("bucket", F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int"))
    rows = materialize(rows, "sizes")  # texts are read once; what follows is a few bytes a document
    parts = rows.groupBy("s", "size", "bucket").agg(F.count("*").alias("n"))
    by_size = rows.groupBy("s", "size").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    targets = source_targets(by_size.groupBy("s").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap)
    targets = targets.withColumn("s", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), "source"))).drop("source", "weight")
    upto = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    # documents of size 0 take no part
    start = by_size.where("size > 0").select("s", "size", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first")).join(targets, "s")
    inner = Window.partitionBy("s", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.where("size > 0").select("s", "size", "bucket", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("second")).join(start, ["s", "size"])
    before = before.repartition("s", "size", "bucket")  # else both sides meet by (s, size), where copies of one text are one key
    ranked = rows.where("size > 0").withColumn("rank", F.row_number().over(Window.partitionBy("s", "size", "bucket").orderBy("id")))
    r = ranked.join(before, ["s", "size", "bucket"]).withColumn("k", F.col("first") + F.col("second") + F.col("rank"))
    e, u = F.col("target") / F.col("source_size"), offset(F.col("source"), seed)
    crossed = F.floor(e * F.col("k") + u) - F.floor(e * (F.col("k") - 1) + u)
    out = ["id", "source", "size", "source_size", "target"]
    taken = r.select(*out, F.least(crossed, F.ceil(e)).cast("long").alias("copies"))
    return taken.unionByName(rows.where("size = 0").join(targets, "s").select(*out, F.lit(0).cast("long").alias("copies")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', chr(1), 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
            sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), t AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE weight * water END AS target
  FROM (SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) AS water FROM l)
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.target / nullif(t.source_size, 0) AS e,
         row_number() OVER (PARTITION BY d.source ORDER BY (d.size = 0), d.size, substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 3), d.doc_id) AS k,
         ('0x' || substr(md5(coalesce(d.source, chr(0)) || '|mix-1'), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CASE WHEN size = 0 THEN 0 ELSE size * least(floor(e * k + u) - floor(e * (k - 1) + u), ceil(e)) END::BIGINT AS taken FROM k
"""
