"""URL rules and listed URLs: a blocked Bloom filter before an exact hash join.

``match_rules`` compiles a bounded rule list (host, path prefix, verdict) into one
expression. ``match_listed`` tests canonical URLs against a listed set of any
size, written once. A blocked Bloom filter (256-bit blocks, as many as the list needs, and broadcast while these are at most MAX_BLOCKS)
passes possible hits, and only these go into the exact join that removes false positives: by broadcast for a list of up to
BROADCAST_URLS, else by a shuffle of the possible hits alone. A list beyond the filter's bound is joined exactly without it. Built-in expressions only.

Nulls: a null url, or one without "://", has an empty host and path, fits no rule
and is never listed. Repeated rows: one result each. Empty tables: empty result;
an empty list blocks nothing. Extra columns pass through except the result names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, table

#: Host, path, verdict; a rule fits its host and all subdomains.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Host labels whose pages make up the listed URLs of the registered query.
LISTED_LABELS = ("ads-track", "adult-x", "free-bets")
MAX_RULES = 10_000
#: Blocks of 32 bytes that are broadcast at most, and listed URLs.
MAX_BLOCKS = 1 << 19
BROADCAST_URLS = 500_000
KEYS_PER_BLOCK = 16
OUT = ("host", "path", "rule", "verdict", "canonical", "listed")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a url; all empty without "://"."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    )


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Host without www. or m., path without closing slashes, query without utm_ parts, no scheme or fragment; null without a host."""
    q = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), "^&", "")
    c = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.when(host != "", c)


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(n, h, rule, verdict) of the longest rule that fits, else null. Ties: longer host, then block."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into the plan")
    by_host: dict[str, list[Column]] = {}
    for h, p, v in rules:
        by_host.setdefault(h.lower(), []).append(F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(len(h)).alias("h"), F.lit(h.lower() + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("prefix")))
    if not by_host:
        return F.lit(None).cast("struct<n:int,h:int,rule:string,verdict:string,prefix:string>")
    lookup = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*rs))])
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(lookup, s), F.array().cast("array<struct<n:int,h:int,rule:string,verdict:string,prefix:string>>")))), lambda r: path.startswith(r["prefix"]))
    return F.array_max(hits)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long")).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the four 64-bit words of a block."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom_blocks(keys: DataFrame, key_col: str, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the non-empty blocks."""
    k = F.col(key_col)
    rows = keys.where(k.isNotNull()).select(_block(k, n_blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(k))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def match_listed(rows: DataFrame, key_col: str, listed: DataFrame, listed_col: str, max_blocks: int = MAX_BLOCKS, broadcast_urls: int = BROADCAST_URLS) -> DataFrame:
    """rows with a boolean column listed: key_col is among listed[listed_col]."""
    own = lambda name: f"urlfilter__{name}"
    keys = materialize(listed.where(F.col(listed_col).isNotNull()).select(F.col(listed_col).alias(own("key"))).distinct(), "listed")
    n = keys.count()
    n_blocks = max(64, -(-n // KEYS_PER_BLOCK))
    k, hit, maybe = F.col(key_col), F.col(own("key")), F.col(own("maybe"))
    if n_blocks <= max_blocks:
        blocks = bloom_blocks(keys, own("key"), n_blocks).select(F.col("block").alias(own("b")), *[F.col(f"w{i}").alias(own(f"w{i}")) for i in range(4)])
        tested = rows.withColumn(own("block"), _block(k, n_blocks)).join(F.broadcast(blocks), F.col(own("block")) == F.col(own("b")), "left")  # blocks: max_blocks rows at most
        passes = k.isNotNull()
        for i, m in enumerate(_masks(k)):
            passes = passes & (F.col(own(f"w{i}")).bitwiseAND(m) == m)
        tested = tested.withColumn(own("maybe"), F.coalesce(passes, F.lit(False))).drop(own("block"), own("b"), *[own(f"w{i}") for i in range(4)])
    else:
        tested = rows.withColumn(own("maybe"), k.isNotNull())
    done = lambda d: d.withColumn("listed", hit.isNotNull()).drop(own("key"), own("maybe"))
    if n <= broadcast_urls:
        return done(tested.join(F.broadcast(keys), F.when(maybe, k) == hit, "left"))  # keys: broadcast_urls rows at most
    no = tested.where(~maybe).drop(own("maybe")).withColumn("listed", F.lit(False))
    return no.unionByName(done(tested.where(maybe).join(keys, k == hit, "left")))


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict, canonical, listed. listed has a column canonical; the longest rule decides, else the list."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in OUT]
    host, path, query = split_url(F.col(f"`{url_col}`"))
    one = pages.select(*kept, host.alias("host"), path.alias("path"), query.alias("urlfilter__query"))
    two = one.withColumn("canonical", canonical(F.col("host"), F.col("path"), F.col("urlfilter__query"))).withColumn("urlfilter__rule", match_rules(F.col("host"), F.col("path"), rules)).drop("urlfilter__query")
    out = match_listed(two, "canonical", listed, "canonical")
    verdict = F.coalesce(F.col("urlfilter__rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("rule", F.col("urlfilter__rule.rule")).withColumn("verdict", verdict).drop("urlfilter__rule")


def listed_urls(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """Canonical URLs of every page on a host with one of the labels."""
    host, path, query = split_url(F.col("url"))
    return pages.select(host.alias("h"), path.alias("p"), query.alias("q")).where(F.arrays_overlap(F.split("h", r"\."), F.array(*map(F.lit, labels)))).select(canonical(F.col("h"), F.col("p"), F.col("q")).alias("canonical"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


SQL = r"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS q FROM u
), c AS (
  SELECT r, page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM h
), listed AS (
  SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'free-bets']) AND canonical IS NOT NULL
), rules(rh, rp, rv) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT r, rh || rp AS rule, rv, row_number() OVER (PARTITION BY r ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM c JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed.canonical IS NOT NULL AS listed
FROM c LEFT JOIN best ON c.r = best.r AND best.k = 1 LEFT JOIN listed ON c.canonical = listed.canonical
"""
