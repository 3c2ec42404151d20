"""Scalar functions of the graph model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of trust in an edge's origin.
ORIGIN_RANK = {"lsp_resolved": 6, "lsp_dispatch": 5, "ast_resolved": 4, "ast_inferred": 3, "text_matched": 2, "speculative": 1}
# Confidence of a path step by origin.
TIER_SCORE = {"lsp_resolved": 1.0, "lsp_dispatch": 0.95, "ast_resolved": 0.9, "ast_inferred": 0.7, "text_matched": 0.4}
# Weight of an edge in centrality by origin.
PROVENANCE_WEIGHT = {"lsp_resolved": 0.6, "lsp_dispatch": 0.6, "ast_resolved": 1.0, "ast_inferred": 0.8, "text_matched": 0.5}
# Weight of an edge kind in communities.
COMMUNITY_WEIGHT = {"calls": 3.0, "spawns": 3.0, "member_of": 2.0, "param_of": 2.0, "implements": 2.0, "extends": 2.0, "composes": 2.0, "references": 1.5, "returns": 1.5, "typed_as": 1.5, "instantiates": 1.0, "imports": 0.5}


def case_of(c: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def origin_rank(origin: Column) -> Column:
    return case_of(origin, ORIGIN_RANK, 0)


def tier_label(origin: Column) -> Column:
    return F.when(origin.startswith("lsp_"), "lsp").when(origin.startswith("ast_"), "ast").otherwise("heuristic")


def default_origin(origin: Column, kind: Column, confidence: Column) -> Column:
    """Backfill of an empty origin from what is known of the edge."""
    structural = kind.isin("defines", "contains", "member_of", "imports")
    return F.when(origin != "", origin).when(structural, "ast_resolved").when(confidence >= 0.9, "ast_resolved").when(confidence >= 0.5, "ast_inferred").when(confidence > 0, "text_matched").otherwise("")


def tier_score(origin: Column) -> Column:
    return case_of(origin, TIER_SCORE, 0.5)


#: Smallest and largest provenance weight.
PROVENANCE_RANGE = (0.5, 1.0)


def provenance_weight(origin: Column) -> Column:
    return case_of(origin, PROVENANCE_WEIGHT, 0.5)


def community_weight(kind: Column) -> Column:
    return case_of(kind, COMMUNITY_WEIGHT, 0.0)


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "EXTRACTED").when(confidence > 0, "INFERRED").otherwise("AMBIGUOUS")


def reference_context(edge_kind: Column, source_kind: Column) -> Column:
    return (
        F.when(edge_kind == "calls", "call").when(edge_kind == "annotated", "attribute").when(edge_kind == "returns", "return_type")
        .when((edge_kind == "typed_as") & (source_kind == "param"), "parameter_type").when((edge_kind == "typed_as") & (source_kind == "field"), "field")
        .when(edge_kind.isin("reads", "writes"), "value").otherwise("type")
    )


def edge_identity(*cols: Column) -> Column:
    """128 bits over the edge's key."""
    return F.md5(F.concat_ws("\u0001", *[c.cast("string") for c in cols]))


def http_path(path: Column) -> Column:
    """:id, <id>, {id}, ${x} and $x become {param}."""
    p = path
    for pattern in (r"\$\{[^}]*\}", r"<[^>]*>", r"\{[^}]*\}", r":[A-Za-z_][A-Za-z0-9_]*", r"\$[A-Za-z_][A-Za-z0-9_]*"):
        p = F.regexp_replace(p, pattern, "\u0001")
    return F.replace(p, F.lit("\u0001"), F.lit("{param}"))


def package_of(path: Column, depth: int) -> Column:
    """The first segments of a path's folder."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(_test\.[a-z]+|\.test\.[a-z]+|\.spec\.[a-z]+)$") | path.rlike("(^|/)(tests?|__tests__)/")


def enclosing_id(id_: Column) -> Column:
    """Owner of a member id: what stands before the last dot behind ::."""
    return F.when(id_.rlike(r"::[^.]+\."), F.regexp_replace(id_, r"\.[^.:]*$", "")).otherwise("")


def file_of(id_: Column) -> Column:
    return F.substring_index(id_, "::", 1)


def is_unresolved(id_: Column) -> Column:
    return F.contains(id_, F.lit("unresolved::"))


def is_stub(id_: Column) -> Column:
    return id_.rlike(r"^([^:/]+/)?(unresolved|stdlib|builtin|external|module)::")


def stub_kind(id_: Column) -> Column:
    return F.regexp_extract(id_, r"^(?:[^:/]+/)?(unresolved|stdlib|builtin|external|module)::", 1)


def sql_tables(text: Column) -> Column:
    """Names behind FROM, JOIN, INTO and UPDATE, quotes stripped, in order, each once."""
    found = F.regexp_extract_all(text, F.lit(r'(?i)\b(?:from|join|into|update)\s+["`\[]?([A-Za-z_][A-Za-z0-9_.]*)'), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def todo_fields(line: Column) -> Column:
    """struct(tag, assignee, ticket) of a comment line; empty where absent."""
    return F.struct(
        F.upper(F.regexp_extract(line, r"(?i)\b(todo|fixme|hack|xxx)\b", 1)).alias("tag"),
        F.regexp_extract(line, r"(?i)\b(?:todo|fixme|hack|xxx)\(@?([A-Za-z0-9_-]+)\)", 1).alias("assignee"),
        F.regexp_extract(line, r"\b([A-Z][A-Z0-9]+-[0-9]+|#[0-9]+)\b", 1).alias("ticket"),
    )


def spdx(line: Column) -> Column:
    return F.regexp_extract(line, r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", 1)


def redact(text: Column) -> Column:
    """Addresses and keys replaced by what they are."""
    t = text
    for pattern, name in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"), (r"\bAKIA[0-9A-Z]{16}\b", "<aws-key>"), (r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "<token>"), (r"(?i)\b(password|secret|api_key)\s*[=:]\s*[^\s]+", "<secret>")):
        t = F.regexp_replace(t, pattern, name)
    return t


def cpp_type(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(const|volatile|struct|class|typename)\b", ""), r"[&*\s]+", " "))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def age_days(now: Column, ts: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400).cast("long")


def clamp_percent(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def recency(days: Column, half_life: float = 30.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) / half_life * days)


def index_tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more; camel case and runs of capitals are cut."""
    t = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{Nd}]+"), lambda x: F.length(x) >= 2)


def query_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores; camel case stays whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))


def gcx_row(*cols: Column) -> Column:
    """A tab-separated line: backslash, tab and newline escaped, carriage returns left out."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit(""))
    return F.concat_ws("\t", *[F.coalesce(esc(c), F.lit("")) for c in cols])


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)
