"""Operators over source text and signatures: clone tokens and bands, rule runs, signature checks, taint patterns, vector cells."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that keep their spelling in clone tokens.
KEYWORDS = [
    "break", "case", "catch", "class", "const", "continue", "def", "default", "defer", "do", "elif", "else", "enum", "except", "export", "extends", "false", "finally", "fn", "for", "func", "function",
    "go", "goto", "if", "impl", "implements", "import", "in", "interface", "is", "lambda", "let", "match", "new", "nil", "none", "not", "null", "package", "private", "public", "raise", "range", "return",
    "select", "self", "static", "struct", "super", "switch", "this", "throw", "true", "try", "type", "var", "void", "while", "with", "yield",
]
CODE_TOKEN = r"""\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`[^`]*`?|[\p{L}_][\p{L}\p{Nd}_]*|[0-9][0-9A-Za-z_.]*|[-+*/%=<>!&|^~?:.@]+|[^\s]"""
LEAST_TOKENS = 24


def clone_tokens(body: Column) -> Column:
    """Tokens of a body by form: keywords lower-cased, other identifiers v, numbers 0, string literals s, runs of operators and single brackets as they are."""
    raw = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(CODE_TOKEN), F.lit(0))
    form = lambda t: (
        F.when(t.rlike(r"^[\p{L}_]"), F.when(F.lower(t).isin(KEYWORDS), F.lower(t)).otherwise("v")).when(t.rlike("^[0-9]"), "0").when(t.rlike("^[\"'`]"), "s").otherwise(t)
    )
    return F.transform(raw, form)


# Bands of MinHash signatures as a stored table


def band_rows(signatures: DataFrame, bands: int = 16, rows: int = 4) -> DataFrame:
    """(id, band, key) of signatures(id, sig): the stored form of a clone index."""
    return signatures.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))).alias("band", "key"))


def index_add(index: DataFrame, signatures: DataFrame) -> DataFrame:
    """The index with new signatures; those of known ids are replaced."""
    return index_remove(index, signatures).unionByName(band_rows(signatures))


def index_remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def probe(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, shared): who shares bands with each of ids(id), from the stored bands alone."""
    asked = index.join(ids.select("id").distinct(), "id", "left_semi")
    other = index.select(F.col("id").alias("other"), "band", "key")
    return asked.join(other, ["band", "key"]).where("id <> other").groupBy("id", "other").agg(F.count("*").alias("shared"))


# Rules over source lines

# Rules of the bundled detectors: id, category, language (empty: any), severity, CWE, pattern.
RULES = [
    ("eval-call", "sast", "", "high", "CWE-95", r"\beval\s*\("),
    ("shell-exec", "sast", "", "high", "CWE-78", r"\b(os\.system|subprocess\.[a-z_]+\(.*shell\s*=\s*True|Runtime\.getRuntime\(\)\.exec)"),
    ("sql-concat", "sast", "", "high", "CWE-89", r"(?i)\b(select|insert|update|delete)\b[^\"']*[\"']\s*(\+|%|\.format)"),
    ("weak-hash", "sast", "", "medium", "CWE-328", r"\b(md5|sha1)\s*[.(]"),
    ("hard-secret", "sast", "", "high", "CWE-798", r"(?i)\b(password|secret|api_key|token)\s*[:=]\s*[\"'][^\"']{6,}[\"']"),
    ("no-tls-check", "sast", "", "high", "CWE-295", r"(InsecureSkipVerify\s*:\s*true|verify\s*=\s*False)"),
    ("temp-predictable", "sast", "", "low", "CWE-377", r"[\"']/tmp/[^\"']+[\"']"),
    ("http-url", "sast", "", "low", "CWE-319", r"http://[a-zA-Z0-9]"),
    ("email", "sast", "", "low", "CWE-359", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+"),
    ("todo", "hygiene", "", "low", "", r"\b(TODO|FIXME|XXX|HACK)\b"),
    ("trailing-space", "hygiene", "", "low", "", r"[ \t]+$"),
    ("long-line", "hygiene", "", "low", "", r"^.{201,}$"),
    ("debug-print", "hygiene", "", "low", "", r"\b(console\.log|fmt\.Println|print)\s*\("),
    ("commented-code", "hygiene", "", "low", "", r"^\s*(//|#).*[;{}]\s*$"),
    ("license-line", "hygiene", "", "low", "", r"(?i)\blicen[sc]ed?\b"),
    ("swallowed-error", "review", "", "medium", "CWE-391", r"(except[^:]*:\s*pass|catch\s*\([^)]*\)\s*\{\s*\}|_\s*=\s*err\b)"),
    ("magic-number", "review", "", "low", "", r"[=<>]\s*[0-9]{4,}\b"),
    ("double-negation", "review", "", "low", "", r"!!|not not "),
    ("wildcard-import", "review", "python", "low", "", r"^\s*from\s+\S+\s+import\s+\*"),
    ("go-panic", "unsafe", "go", "medium", "CWE-248", r"\bpanic\("),
    ("go-unsafe", "unsafe", "go", "high", "CWE-242", r"\bunsafe\.Pointer\b"),
    ("rust-unwrap", "unsafe", "rust", "medium", "CWE-248", r"\.(unwrap|expect)\("),
    ("rust-unsafe", "unsafe", "rust", "high", "CWE-242", r"\bunsafe\s*\{"),
    ("c-gets", "unsafe", "c", "high", "CWE-242", r"\b(gets|strcpy|strcat|sprintf)\s*\("),
    ("bare-thread", "domain", "", "low", "", r"\b(go\s+func|Thread\(|threading\.Thread)\b"),
    ("version-string", "domain", "", "low", "", r"(?i)\bversion\s+[0-9]+(\.[0-9]+)*"),
    ("symbol-run", "domain", "", "low", "", r"[#*$%&|<>]{3,}"),
]
FIELDS = ("rule", "category", "language", "severity", "cwe", "pattern")


def load_rules(text: str) -> list[tuple]:
    """User rules from JSON (a list of objects) or from a YAML list of flat entries; fields as FIELDS, rule also as id. A pattern that does not compile is an error."""
    if text.lstrip().startswith("["):
        rows = json.loads(text)
    else:
        rows = []
        for line in text.splitlines():
            m = re.match(r"^(\s*)(-\s+)?([A-Za-z_]+)\s*:\s*(.*)$", line)
            if not m or line.lstrip().startswith("#"):
                continue
            if m.group(2):
                rows.append({})
            if rows:
                v = m.group(4).strip()
                rows[-1][m.group(3)] = v[1:-1].replace("''", "'") if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    out = []
    for r in rows:
        r = {"severity": "medium", "category": "user", "language": "", "cwe": "", **r}
        r["rule"] = r.get("rule") or r.get("id")
        if not r["rule"] or not r.get("pattern"):
            raise ValueError(f"a rule needs an id and a pattern: {r}")
        re.compile(r["pattern"])
        out.append(tuple(r[f] for f in FIELDS))
    return out


def run_rules(files: DataFrame, rules=RULES, categories: list[str] | None = None) -> DataFrame:
    """(path, line_no, rule, category, severity, cwe, line) of files(path, language, text): all rules in one pass over the lines."""
    chosen = [r for r in rules if categories is None or r[1] in categories]
    kind = "struct<rule:string,category:string,severity:string,cwe:string>"
    lines = files.select("path", "language", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    hit = [
        F.when(F.col("line").rlike(p) & (F.lit(lang == "") | (F.col("language") == lang)), F.struct(F.lit(r).alias("rule"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(w).alias("cwe")))
        for r, c, lang, s, w, p in chosen
    ]
    found = F.filter(F.array(*hit), lambda x: x.isNotNull()) if hit else F.array().cast(f"array<{kind}>")
    return lines.select("path", (F.col("line_no") + 1).alias("line_no"), "line", F.explode(found).alias("h")).select("path", "line_no", "h.rule", "h.category", "h.severity", "h.cwe", "line")


# Signatures


def parse_signature(sig: Column) -> dict[str, Column]:
    """name, parameters (name, type and whether it has a default, as text) and result of a signature such as ``f(a int, b = 1) error``."""
    inside = F.regexp_extract(sig, r"\(([^()]*)\)", 1)
    params = F.filter(F.transform(F.split(inside, ","), F.trim), lambda p: p != "")
    return {"name": F.regexp_extract(sig, r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1), "params": params, "result": F.trim(F.regexp_replace(F.regexp_extract(sig, r"\)([^)]*)$", 1), r"^\s*(->|:)", ""))}


def signature_check(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, breaking, reasons, callers, implementors) of changes(id, old, new): what each new signature breaks and who is concerned.

    Reasons: renamed, removed_parameter, required_parameter_added, parameter_changed, result_changed. A null new signature is removed.
    """
    a, b = parse_signature(F.coalesce("old", F.lit(""))), parse_signature(F.coalesce("new", F.lit("")))
    n, m = F.size(a["params"]), F.size(b["params"])
    optional = lambda p: p.contains("=") | p.contains("...") | p.contains("?")
    added = F.filter(F.slice(b["params"], n + 1, F.greatest(m - n, F.lit(0))), lambda p: ~optional(p))
    common = F.least(n, m)
    flat = lambda p: F.regexp_replace(p, r"\s*=.*$", "")
    changed = F.exists(F.arrays_zip(F.slice(a["params"], 1, common).alias("x"), F.slice(b["params"], 1, common).alias("y")), lambda z: flat(z["x"]) != flat(z["y"]))
    reason = lambda c, name: F.when(c, F.lit(name))
    gone = F.col("new").isNull()
    reasons = F.array_compact(F.array(
        reason(gone, "removed"), reason(~gone & (a["name"] != b["name"]), "renamed"), reason(~gone & (m < n), "removed_parameter"),
        reason(~gone & (F.size(added) > 0), "required_parameter_added"), reason(~gone & changed, "parameter_changed"), reason(~gone & (a["result"] != b["result"]), "result_changed"),
    ))
    into = lambda kinds, name: edges.where(F.col("kind").isin(kinds)).select(F.col("to_id").alias("id"), "from_id").distinct().groupBy("id").agg(F.count("*").alias(name))
    j = changes.withColumn("reasons", reasons).join(into(["calls", "references"], "callers"), "id", "left").join(into(["implements", "overrides"], "implementors"), "id", "left")
    return j.fillna(0, ["callers", "implementors"]).select("id", (F.size("reasons") > 0).alias("breaking"), "reasons", "callers", "implementors")


def taint_pattern(text: str) -> Column:
    """Predicate over nodes(id, name, file_path, kind): terms joined by AND; bare text is part of a name or id, exact: and name= the whole name, name: part of it, path: the start of a path, kind: a kind."""
    out = F.lit(True)
    for term in text.split():
        key, sep, value = term.partition(":")
        if term.startswith("name="):
            out = out & (F.col("name") == term[5:])
        elif sep and key == "exact":
            out = out & ((F.col("name") == value) | (F.col("id") == value))
        elif sep and key == "name":
            out = out & F.contains(F.lower("name"), F.lit(value.lower()))
        elif sep and key == "path":
            out = out & F.col("file_path").startswith(value)
        elif sep and key == "kind":
            out = out & (F.col("kind") == value)
        else:
            out = out & (F.contains(F.lower("name"), F.lit(term.lower())) | F.contains(F.lower("id"), F.lit(term.lower())))
    return out


# Approximate nearest neighbours: vectors in cells around centres

FIT_ROWS = 50_000


def fit_cells(vectors: DataFrame, cells: int, rounds: int = 12, seed: int = 1, sample: int = FIT_ROWS) -> np.ndarray:
    """Unit centres of ``cells`` cells by spherical k-means over at most ``sample`` vectors(id, vec), taken in the order of a hash."""
    rows = vectors.select("vec").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toPandas()["vec"]
    x = np.stack([np.asarray(v, np.float64) for v in rows]) if len(rows) else np.zeros((1, 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = np.bincount(near, minlength=len(c)) > 0
        c[full] = total[full]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def in_cells(vectors: DataFrame, centres: np.ndarray, nearest: int = 1) -> DataFrame:
    """(id, vec, cell): every row with its ``nearest`` cells. The centres are bounded by their number."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = np.stack([np.asarray(v, np.float64) for v in f["vec"]])
            top = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :nearest]
            yield pd.DataFrame({"id": np.repeat(f["id"].to_numpy(), top.shape[1]), "vec": [v for v in f["vec"] for _ in range(top.shape[1])], "cell": top.ravel()})

    return vectors.select("id", "vec").mapInPandas(run, "id bigint, vec array<double>, cell bigint")


def search_cells(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query, id, distance, rank): k nearest by exact cosine distance among the rows of the ``probes`` cells nearest to each query."""
    q = in_cells(queries, centres, probes).select(F.col("id").alias("query"), F.col("vec").alias("q"), "cell")
    j = index.join(q, "cell").select("query", "id", "vec", "q")

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            a, b = (np.stack([np.asarray(v, np.float64) for v in f[c]]) for c in ("vec", "q"))
            n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            d = 1 - (a * b).sum(1) / np.where(n > 0, n, 1)
            f = pd.DataFrame({"query": f["query"], "id": f["id"], "distance": np.abs(np.round(d, 6))})[n > 0]
            # a batch passes on k rows a query at most
            yield f.sort_values(["query", "distance", "id"]).groupby("query").head(k)

    near = j.mapInPandas(run, "query bigint, id bigint, distance double")
    w = Window.partitionBy("query").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def token_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vec): the mean of the vectors(token, vec) of a text's tokens docs(id, tokens), scaled to length 1; no known token: zeros."""
    size = F.max(F.size("vec"))
    width = vectors.agg(size.alias("w"))
    counted = docs.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    parts = counted.join(vectors, "token").select("id", "n", F.posexplode("vec").alias("i", "x"))
    mean = parts.groupBy("id", "i").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
    lists = mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    j = docs.select("id").join(lists, "id", "left").join(F.broadcast(width), F.lit(True), "left")  # width: one row
    zeros = F.array_repeat(F.lit(0.0), F.coalesce("w", F.lit(0)).cast("int"))
    return j.select("id", F.when(F.col("m").isNull() | (norm == 0), zeros).otherwise(F.transform("m", lambda x: x / norm)).alias("vec"))
