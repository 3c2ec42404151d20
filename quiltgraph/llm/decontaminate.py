"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores postings of the training tokens, sharded by document: a
row a shard holds its documents, its sorted terms and, for each term, the places
where it stands. Shards need no shuffle and a lost one is rebuilt from its input.
``search`` sends a bounded block of test windows to every shard and intersects
offset-adjusted postings from the rarest term on; larger test sets go in several
blocks over the same stored index. It returns exact phrase matches and, on
request, proximity matches: all words of a window inside a run of a few words more.

Terms are 64-bit hashes (XXH64) of words. ``terms`` may restrict the index to
words that the test set holds: others can't be asked for.

Nulls: a null text has no words, a null item is none. Null ids are kept. Rows that
repeat an id are separate documents; items that repeat an id count once. Empty
tables: no documents, or no hits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, words

WINDOW = 10
SHARD_TOKENS = 1 << 19
#: Words of the test set in one block, and most different words for an index of these alone.
BLOCK_WORDS = 1 << 20


class _Hashes(dict):
    """Word -> hash; all words, or those in ``only`` with 0 for the rest."""

    def __init__(self, only=None):
        super().__init__()
        self.all = only is None
        if only is not None:
            self.update((w, _hash(w)) for w in only)

    def __missing__(self, w):
        if not self.all:
            return 0
        if len(self) > 1 << 20:
            self.clear()
        h = self[w] = _hash(w)
        return h


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63) or 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: set[bytes] | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, docs array<id>, starts, n_words, terms, offsets, places): a row a shard, named at random; the last five are little-endian arrays."""
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    vocabulary = None if terms is None else sorted(terms)

    def run(batches):
        known = _Hashes(vocabulary)
        get = known.__getitem__ if known.all else lambda w: dict.get(known, w, 0)
        ids: list = []
        parts: list[np.ndarray] = []
        total = 0

        def shard(id_type):
            n = np.array([len(p) for p in parts], np.int32)
            # one place is left free between documents: no phrase crosses it
            starts = (np.cumsum(n + 1) - n - 1).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            place = np.arange(len(flat), dtype=np.int32) + np.repeat(np.arange(len(n), dtype=np.int32), n)
            if not known.all:
                has = flat != 0
                flat, place = flat[has], place[has]
            o = np.argsort(flat, kind="stable")
            flat, place = flat[o], place[o]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
            cells = [starts, n, flat[first], np.append(first, len(flat)).astype(np.int32), place]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(id_type)), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], ["shard", "docs", "starts", "n_words", "terms", "offsets", "places"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                ids.append(i)
                parts.append(np.fromiter(map(get, ws), np.int64, len(ws)))
                total += len(ws) + 1
                if total >= shard_tokens:
                    yield shard(b.schema.field(0).type)
                    ids, parts, total = [], [], 0
            if ids:
                last = b.schema.field(0).type
        if ids:
            yield shard(last)

    return arrow.mapInArrow(run, f"shard string, docs array<{kind}>, starts binary, n_words binary, terms binary, offsets binary, places binary")


def windows_of(ws: list[bytes], width: int = WINDOW) -> list[list[bytes]]:
    """Runs of width words; all words if there are fewer, none if there are none."""
    return [ws[i : i + width] for i in range(len(ws) - width + 1)] if len(ws) >= width else [ws] if ws else []


class Postings:
    """One shard's index."""

    def __init__(self, starts, n_words, terms, offsets, places):
        self.starts, self.n = np.frombuffer(starts, "<i4"), np.frombuffer(n_words, "<i4")
        self.terms, self.offsets, self.places = np.frombuffer(terms, "<i8"), np.frombuffer(offsets, "<i4"), np.frombuffer(places, "<i4")

    def slots(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, number of places) of terms; 0 places for those that are absent."""
        if not len(self.terms):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        return at, np.where(self.terms[at] == asked, self.offsets[at + 1] - self.offsets[at], 0)

    def at(self, slot: int) -> np.ndarray:
        return self.places[self.offsets[slot] : self.offsets[slot + 1]]

    def phrase(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places where the terms stand in a row."""
        order = np.argsort(counts, kind="stable").tolist()
        found = self.at(slots[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            list_ = self.at(slots[k])
            want = found + k
            i = np.minimum(np.searchsorted(list_, want), len(list_) - 1)
            found = found[list_[i] == want]
        return found

    def near(self, slots: np.ndarray, counts: np.ndarray, slack: int) -> np.ndarray:
        """Starts of runs of len(slots) + slack words that hold every term, one for each place of the rarest."""
        reach = len(slots) + slack - 1
        rare = self.at(slots[int(np.argmin(counts))])
        starts = np.unique((rare[:, None] - np.arange(reach + 1)[None, :]).ravel())
        starts = starts[starts >= 0]
        # a run stays inside one document
        doc = np.searchsorted(self.starts, starts, "right") - 1
        end = np.minimum(starts + reach, self.starts[doc] + self.n[doc] - 1)
        ok = end >= starts
        for k in np.unique(slots):
            list_ = self.at(k)
            i = np.searchsorted(list_, starts)
            ok &= (i < len(list_)) & (list_[np.minimum(i, len(list_) - 1)] <= end)
        good = starts[ok]
        # of overlapping runs the first
        keep, last = [], -(1 << 30)
        for x in good.tolist():
            if x > last + reach:
                keep.append(x)
                last = x
        return np.array(keep, np.int64)


def search(index: DataFrame, items: list[tuple[object, list[bytes]]], id_type: str, item_type: str, width: int = WINDOW, slack: int | None = None) -> DataFrame:
    """(shard, place, id, n_words, matches array<struct<item, kind, lo, hi>>) for every document of the index; items: one block."""
    # one block, at most about block_words words
    shared = index.sparkSession.sparkContext.broadcast([(item, [_hash(w) for w in win]) for item, ws in items for win in windows_of(ws, width)])

    def run(batches):
        wins = shared.value
        asked = np.array(sorted({h for _, win in wins for h in win}), np.int64)
        by_width: dict[int, list] = defaultdict(list)
        for item, win in wins:
            by_width[len(win)].append((item, win))
        groups = [(n, [x[0] for x in g], np.searchsorted(asked, np.array([x[1] for x in g], np.int64))) for n, g in by_width.items()]
        for b in batches:
            for r in range(b.num_rows):
                p = Postings(*[b.column(i)[r].as_py() for i in range(2, 7)])
                ids = b.column(1)[r].values
                slot, count = p.slots(asked)
                out: dict[int, list] = defaultdict(list)
                for n, names, terms in groups:
                    counts = count[terms]
                    for w in np.flatnonzero(counts.min(1) > 0).tolist():
                        s = slot[terms[w]]
                        hits = p.phrase(s, counts[w])
                        for x, d in zip(hits.tolist(), (np.searchsorted(p.starts, hits, "right") - 1).tolist()):
                            out[d].append({"item": names[w], "kind": "phrase", "lo": x - int(p.starts[d]), "hi": x - int(p.starts[d]) + n})
                        if slack is not None:
                            runs = p.near(s, counts[w], slack)
                            for x, d in zip(runs.tolist(), (np.searchsorted(p.starts, runs, "right") - 1).tolist()):
                                out[d].append({"item": names[w], "kind": "proximity", "lo": x - int(p.starts[d]), "hi": min(x - int(p.starts[d]) + n + slack, int(p.n[d]))})
                matches = [out.get(d, []) for d in range(len(p.n))]
                kinds = pa.list_(pa.struct([("item", item_arrow), ("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * len(ids)), pa.array(np.arange(len(ids), dtype=np.int32)), ids, pa.array(p.n.astype(np.int64)), pa.array(matches, kinds)], ["shard", "place", "id", "n_words", "matches"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    item_arrow = to_arrow_type(_parse_datatype_string(item_type))
    return index.mapInArrow(run, f"shard string, place int, id {id_type}, n_words bigint, matches array<struct<item:{item_type},kind:string,lo:int,hi:int>>")


def contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, slack: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, matches) for every row of docs, against all tests."""
    tests = tests.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    # a block is what one search sends to every shard: at most about block_words words (and one item)
    chars = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-chars // (2 * block_words)))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), tests.schema["item"].dataType.simpleString()

    def block(k: int) -> list:
        rows = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).toArrow() if n_blocks > 1 else tests.toArrow()
        return [(i, words(t)) for i, t in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist())]

    first = block(0)
    terms = {w for _, ws in first for w in ws} if n_blocks == 1 else None
    index = materialize(build_index(docs, id_col, text_col, terms), "postings")
    out = search(index, first, id_type, item_type, width, slack)
    if n_blocks == 1:
        return out.select("id", "n_words", "matches")
    for k in range(1, n_blocks):
        out = out.unionByName(search(index, block(k), id_type, item_type, width, slack))
    return out.groupBy("shard", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")).select("id", "n_words", "matches")


def hit_words(matches) -> int:
    """Words under any of the ranges."""
    n = end = 0
    for lo, hi in sorted((m["lo"], m["hi"]) for m in matches):
        n += max(0, hi - max(lo, end))
        end = max(end, hi)
    return n


def digests(found: DataFrame) -> DataFrame:
    """found with n_hit, n_items and items_sha256 from its phrase matches."""
    fields = found.schema

    def run(batches):
        for b in batches:
            hit, items, sha = [], [], []
            for ms in b.column(2).to_pylist():
                ms = [m for m in ms if m["kind"] == "phrase"] if ms else []
                names = sorted({str(m["item"]) for m in ms})
                hit.append(hit_words(ms))
                items.append(len(names))
                sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(sha)], ["id", "n_words", "n_hit", "n_items", "items_sha256"])

    return found.mapInArrow(run, f"id {fields['id'].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), tw AS (
  SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (SELECT item_id, ws, least(len(ws), 10) AS l, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM t WHERE len(ws) > 0)
), dw AS (
  SELECT r, l, i, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM tw) WHERE len(ws) >= l)
), hit AS (
  SELECT r, item_id, i, dw.l FROM dw JOIN tw ON dw.l = tw.l AND dw.g = tw.g
), cov AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.r = cov.r LEFT JOIN its ON d.r = its.r
"""
