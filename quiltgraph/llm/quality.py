"""Rule bitmask ledger: measure once, store failure bits, apply versioned policies later.

``ledger`` evaluates every rule of RULES once a document and keeps the
measurements and one bigint of failure bits. ``apply_policy`` decides from the
bits alone; ``ablations`` counts, for every rule of a policy, what only that rule
rejects, through bitwise aggregation. All of it is built-in expressions: no
shuffle for the ledger, one small aggregate for ablations.

n_repeat_words hashes each 8-word window to 64 bits (XXH64) within its document
and sorts the packed hashes, so it is exact up to a 64-bit collision inside one text.

Nulls: a null text has no words and fails too_few_words. Repeated rows: one
result each. Empty table: empty result. Extra columns pass through; a clash with
a ledger column is resolved by leaving the extra one out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")

#: Bit position -> (name, failing condition over the measures). Append only: stored ledgers keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("few_distinct_words", "n_words >= 100 AND 100 * n_distinct_words < 5 * n_words"),
)
#: Version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(n for n, _ in RULES),
}
_BIT = {n: i for i, (n, _) in enumerate(RULES)}


def mask(policy: str) -> int:
    return sum(1 << _BIT[n] for n in POLICIES[policy])


def _window_hashes(ws: str) -> str:
    """Sorted (hash, place) of the word windows of an array column."""
    return f"array_sort(transform(sequence(0, size({ws}) - {WINDOW}), i -> struct(xxhash64(slice({ws}, i + 1, {WINDOW})) AS h, i AS i)))"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of MEASURES, all bigint."""
    kept = [c for c in docs.columns if c.lower() not in {*MEASURES, "fail_bits", "_t", "_w", "_l", "_s", "_p"}]
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one = docs.select(*[F.col(f"`{c}`") for c in kept], t.alias("_t"))
    space = r"[\\x20\\x09-\\x0D]+"
    two = one.withColumn("_w", F.expr(f"filter(split(_t, '{space}', -1), x -> x <> '')")).withColumn("_l", F.expr(r"filter(split(_t, '\\n', -1), x -> translate(x, ' \t\n\u000b\f\r', '') <> '')"))
    three = two.select(
        *[F.col(f"`{c}`") for c in kept], "_t", "_l", "_w",
        F.expr(f"CASE WHEN size(_w) > {WINDOW} THEN {_window_hashes('_w')} END").alias("_s"),
    )
    # places whose hash equals a neighbour's in sorted order: compare the array with itself moved by one
    four = three.withColumn(
        "_p",
        F.expr(
            "CASE WHEN _s IS NOT NULL THEN array_sort(array_distinct(flatten(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1),"
            " (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) ELSE CAST(array() AS array<int>) END)))) END"
        ),
    )
    return four.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.expr("size(_l) - size(array_distinct(_l))").cast("long").alias("n_dup_lines"),
        F.expr(
            f"CASE WHEN size(_p) > 0 THEN {WINDOW} + aggregate(zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> least({WINDOW}, b - a)), 0L, (s, x) -> s + x) ELSE 0L END"
        ).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
    )


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measures and fail_bits: bit i is set where RULES[i] fails."""
    bits: Column = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, cond) in enumerate(RULES)])
    # a filter on the bits must not be pushed below them: it would measure every text again for each use of a measure
    return measured(docs, text_col).withColumn("fail_bits", bits.bitwiseOR(F.spark_partition_id().cast("long") * 0))


def apply_policy(led: DataFrame, policy: str = "v1", out: str = "kept") -> DataFrame:
    return led.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, n_fail, n_only, n_rejected): what each rule fails, and what would come back without it."""
    m = mask(policy)
    hit = F.col("fail_bits").bitwiseAND(F.lit(m))
    aggs = [F.count_if(hit != 0).alias("n_rejected")]
    for n in POLICIES[policy]:
        b = 1 << _BIT[n]
        aggs += [F.count_if(hit.bitwiseAND(F.lit(b)) != 0).alias(f"f_{n}"), F.count_if(hit == b).alias(f"o_{n}")]
    one = led.agg(*aggs)
    return one.select(
        "n_rejected", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_fail"), F.col(f"o_{n}").alias("n_only")) for n in POLICIES[policy]]))
    ).select("rule", "n_fail", "n_only", "n_rejected")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "base", "_base"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), (F.col("_base") & F.col("kept")).alias("kept"), "fail_bits")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r
), m AS (
  SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, len(list_distinct(ws))::BIGINT AS n_distinct_words
  FROM w LEFT JOIN cov ON w.r = cov.r
), f AS (
  SELECT *, (n_words < 20) AS r0, (100 * n_repeat_words > 30 * n_words) AS r1, (10 * n_symbols > n_words) AS r2, (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) AS r3,
         (word_chars < 2 * n_words) AS r4, (word_chars > 20 * n_words) AS r5, (n_words >= 100 AND 100 * n_distinct_words < 5 * n_words) AS r6 FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r0 OR r1) AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept,
       (r0::BIGINT + 2 * r1::BIGINT + 4 * r2::BIGINT + 8 * r3::BIGINT + 16 * r4::BIGINT + 32 * r5::BIGINT + 64 * r6::BIGINT)::BIGINT AS fail_bits
FROM f
"""
