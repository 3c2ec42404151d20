"""Corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``;
between stages the rows are written as Parquet and read again.

Every stage carries out its operator's decision on whole texts:
quality rules drop rejected documents; near-dedup links texts whose sets of five-word
shingles have Jaccard similarity 0.8 or more and keeps the smallest doc_id of each group; substring dedup removes repeated bytes (a character cut in two goes
whole, and n_chars is counted again); decontamination drops documents that hold a
benchmark window; mixing emits a row for each copy that a document contributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm import decontaminate, mixing, quality, simhash, suffixdedup
from quiltgraph.llm.common import materialize, table
from quiltgraph.llm.nearcopies import folded

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(docs.select(*COLUMNS)), "v1").where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of a group stays: the smallest doc_id (null last), then by text hash, source and language. Rows are told apart by all their columns, so null and repeated ids are ids like others."""
    text = F.col("text")
    docs = docs.select(*COLUMNS).withColumns({"_h": folded(text), "_md5": F.md5("text")})
    ident = ["doc_id", "_md5", "source", "lang", "n_chars", "_h"]
    rows = docs.groupBy(*ident).agg(F.count("*").alias("_n"))
    named = rows.join(simhash.near_copies(docs, shingle=5, similarity=0.8).withColumnRenamed("h", "_h"), "_h", "left")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), *ident, "_n")
    first = named.groupBy("component", F.when(F.col("component").isNull(), F.col("_h")).alias("_own")).agg(F.min(order).alias("w"))
    first = materialize(first.select(*[F.col(f"w.{c}").alias(f"w{c}") for c in [*ident, "_n"]]), "kept")
    on = [F.col(c).eqNullSafe(F.col(f"w{c}")) for c in ident]
    kept = docs.join(first, on)
    if first.where("w_n > 1").limit(1).count():
        # rows that repeat in every column: one of them
        kept = kept.where("w_n = 1").unionByName(kept.where("w_n > 1").dropDuplicates(["_h"]))
    return kept.select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that the operator removes; untouched texts stay as they are."""
    out = suffixdedup.dedup(docs, keep=["lang", "source"])
    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(whole_characters(F.col("kept").cast("string")))
    return out.select(F.col("id").alias("doc_id"), text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def whole_characters(text):
    """Without the pieces of characters that a cut inside them leaves: make_valid_utf8 turns these into U+FFFD, so those of the text itself are written as U+E000 U+E002 meanwhile."""
    own, mark, escape = "\ufffd", "\ue000\ue002", "\ue000"
    hidden = F.replace(F.replace(text, F.lit(escape), F.lit("\ue000\ue001")), F.lit(own), F.lit(mark))
    clean = F.translate(F.call_function("make_valid_utf8", hidden), own, "")
    return F.replace(F.replace(clean, F.lit(mark), F.lit(own)), F.lit("\ue000\ue001"), F.lit(escape))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are looked up by text hash: what holds a window goes and nothing else, whatever its id."""
    keyed = docs.select(*COLUMNS).withColumn("_md5", F.md5("text"))
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="_md5")
    hit = found.where(F.size("matches") > 0).select(F.col("id").alias("_md5")).distinct()
    return keyed.join(hit, "_md5", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy: the document's columns, copy (from 1), size, source_size and target. Rows are keyed by all their columns; those that are equal in every column each take their own copies."""
    fields = [F.coalesce(F.concat(F.lit("v"), F.md5(F.col(c).cast("string"))), F.lit("n")) for c in COLUMNS]
    keyed = docs.select(*COLUMNS).withColumn("_key", F.md5(F.concat_ws("|", *fields)))
    m = mixing.mix(keyed, id_col="_key").where("copies > 0").select(F.col("id").alias("_key"), "size", "source_size", "target", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    if keyed.groupBy("_key").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["_key"])  # m has a row for each of them
    return keyed.join(m, "_key").select(*COLUMNS, "copy", "size", "source_size", F.round("target", 6).alias("target"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
]
#: XXH64 fingerprints and suffix dedup have no SQL form here; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
