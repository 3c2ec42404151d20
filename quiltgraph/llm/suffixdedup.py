"""Exact substring dedup with a logarithmic family of sampled suffix arrays.

A byte goes if a LENGTH-byte string that covers it also starts earlier (smaller
id, or same document, earlier start). Which suffixes are indexed: of the
K-byte strings inside a LENGTH-byte window, the one with the smallest hash is its
anchor, so equal windows have equal anchors at equal places and only one suffix in
about 35 need be kept. Windows in a row with one anchor are a segment.

1. Every batch of documents gets a sorted array of its segments, ordered by
   anchor hash and then by the hash of the segment's bytes. Equal segments inside
   the batch are settled there, so a passage of a third of all documents sends
   one row a batch.
2. Arrays are dealt by anchor hash. In a bucket they enter a family of levels: a
   new array is merge-scanned against all levels below twice its size, equal
   segments leave only the earliest (the others' bytes go), so levels grow geometrically
   and each segment is merged a logarithmic number of times.
3. Anchors left with several different segments may still share single windows:
   only those windows are hashed one by one, settled in the same kind of family,
   by window hash.
4. Spans meet their texts in one join by document.

A full suffix array takes 8 bytes for each byte of text, twice the disk that the
check tool allows; sampling keeps results exact, since every window has an anchor.
Arrays order suffixes by hash (64 bits for the anchor and 64 for the segment), not
by letters: long matches need equality alone. Equality is on 128 bits of hash.

Nulls: a null text is empty. Null ids come after all others. Rows that repeat an
id are separate documents, in order of their text's MD5. Empty table: empty
result. Texts of any length: long ones are cut into overlapping pieces of PIECE
bytes. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, table

LENGTH, K = 100, 32
PIECE = 1 << 20
FLUSH = 1 << 19
SEG = np.dtype([("kh", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u2")])
_RNG = np.random.default_rng(20240607)
BASES = (_RNG.integers(1 << 62, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)).tolist()
BYTE_VALUES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Hasher:
    """Hashes of substrings of a buffer from prefix sums modulo 2**64."""

    powers: dict = {}

    def __init__(self, buf: np.ndarray, which: int = 0):
        n = len(buf) + 1
        have = Hasher.powers.get(which)
        if have is None or len(have[0]) < n:
            size, base = max(n, PIECE + (1 << 18)), BASES[which]
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = Hasher.powers[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        self.down = have[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTE_VALUES[which][buf] * have[0][: n - 1], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of all substrings of one length."""
        return _mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])

    def some(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def segments(parts: list[tuple[int, int, bytes]], length: int = LENGTH, k: int = K) -> np.ndarray:
    """SEG rows of a few texts (doc, offset of this piece, bytes), each at least length bytes long."""
    sizes = np.array([len(p[2]) for p in parts])
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    h = Hasher(buf)
    grams = h.every(k)
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min((grams & ~low) | place, length - k + 1) & low).astype(np.int64)  # of the window at each start
    which = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
    new = np.empty(len(anchor), bool)
    new[0], new[1:] = True, (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])
    inside = np.arange(len(anchor)) + length <= ends[which]  # windows that cross two texts are none
    new[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    out = np.empty(len(first), SEG)
    a = anchor[first]
    # anchors are the smallest hashes of their windows: mixed again, they spread evenly over buckets
    out["kh"] = _mix(grams[a] ^ np.uint64(0x9E3779B97F4A7C15))
    n = last - first + 1
    seg = h.some(first, last + length)
    seg ^= ((a - first) * 128 + n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out["seg"], out["n"] = seg, n
    w = which[first]
    out["doc"] = np.array([p[0] for p in parts], np.int64)[w]
    out["start"] = first - (ends - sizes)[w] + np.array([p[1] for p in parts])[w]
    return out


def windows(part: tuple[int, bytes], asked: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """SEG rows of single windows; asked: (start, n) rows. kh is the window's hash, seg a second one."""
    doc, data = part
    runs = np.repeat(asked[:, 0], asked[:, 1]) + (np.arange(asked[:, 1].sum()) - np.repeat(np.cumsum(asked[:, 1]) - asked[:, 1], asked[:, 1]))
    starts = np.unique(runs)
    out = np.empty(len(starts), SEG)
    out["doc"], out["start"], out["n"] = doc, starts, 1
    for lo in range(0, len(data), PIECE):
        at = np.flatnonzero((starts >= lo) & (starts < lo + PIECE))
        if len(at):
            buf = np.frombuffer(data[lo : lo + PIECE + length], np.uint8)
            s = starts[at] - lo
            for which, name in ((0, "kh"), (1, "seg")):
                out[name][at] = Hasher(buf, which).some(s, s + length)
    return out


def settle(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, gone): rows sorted by kh, seg, of which the earliest of equal ones is kept."""
    a = a[np.argsort(a["kh"], kind="stable")]
    same = a["kh"][1:] == a["kh"][:-1]
    twin = np.zeros(len(a), bool)
    twin[1:] |= same
    twin[:-1] |= same
    at = np.flatnonzero(twin)
    if not len(at):
        return a, a[:0]
    t = a[at]
    t = t[np.lexsort((t["start"], t["doc"], t["seg"], t["kh"]))]
    a[at] = t
    later = np.zeros(len(t), bool)
    later[1:] = (t["kh"][1:] == t["kh"][:-1]) & (t["seg"][1:] == t["seg"][:-1])
    keep = np.ones(len(a), bool)
    keep[at[later]] = False
    return a[keep], t[later]


class Family:
    """Levels of sorted arrays, each at least twice the next. A new array merges, in one scan, with all levels below twice what is merged so far, so sizes grow geometrically and an entry is rewritten a logarithmic number of times."""

    def __init__(self):
        self.levels: list[np.ndarray] = []
        self.gone: list[np.ndarray] = []

    def add(self, run: np.ndarray) -> None:
        parts, size = [run], len(run)
        while self.levels and len(self.levels[-1]) < 2 * size:
            parts.append(self.levels.pop())
            size += len(parts[-1])
        if len(parts) > 1:
            run, gone = settle(np.concatenate(parts))
            self.gone.append(gone)
        self.levels.append(run)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """(kept, gone) of all levels merged."""
        run = np.concatenate([np.empty(0, SEG), *self.levels])
        if len(self.levels) > 1:
            run, gone = settle(run)
            self.gone.append(gone)
        self.levels = []
        return run, np.concatenate([np.empty(0, SEG), *self.gone])


def pack(a: np.ndarray) -> bytes:
    """Columns one after another, bytes of equal weight together, so that small numbers compress."""
    head = np.array([len(a), a["doc"].min() if len(a) else 0], "<i8").tobytes()
    doc = (a["doc"] - (a["doc"].min() if len(a) else 0)).astype("<u8")
    return head + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(a), -1).T.tobytes() for c in (a["kh"], a["seg"], doc, a["start"], a["n"]))


def unpack(b: bytes) -> np.ndarray:
    n, base = np.frombuffer(b, "<i8", 2).tolist()
    out, at = np.empty(n, SEG), 16
    for name, kind in (("kh", "<u8"), ("seg", "<u8"), ("doc", "<u8"), ("start", "<u4"), ("n", "<u2")):
        w = np.dtype(kind).itemsize
        col = np.frombuffer(b, np.uint8, n * w, at).reshape(w, n).T
        out[name] = np.ascontiguousarray(col).reshape(-1).view(kind)
        at += n * w
    out["doc"] += base
    return out


def merge_ranges(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of ranges that overlap or touch, by document."""
    if not len(doc):
        return doc, lo, hi
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    group = np.r_[True, doc[1:] != doc[:-1]]
    # running maximum of ends inside a document
    rank = np.cumsum(group) - 1
    top = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + rank * top) - rank * top
    new = group.copy()
    new[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1]


OUT = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("run", pa.binary())])
OUT_SQL = "kind tinyint, bucket int, doc bigint, lo bigint, hi bigint, run binary"
RUN, SPAN, ASK = 0, 1, 2


def _rows(kind: int, doc, lo, hi, n_buckets: int):
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), pa.array((doc % n_buckets).astype(np.int32)), pa.array(doc.astype(np.int64)), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64)), pa.nulls(n, pa.binary())], schema=OUT
    )


def _deal(kept: np.ndarray, gone: np.ndarray, n_buckets: int, length: int):
    """Sorted arrays cut by bucket, and the spans that are settled already."""
    if len(gone):
        yield _rows(SPAN, *merge_ranges(gone["doc"].copy(), gone["start"].astype(np.int64), gone["start"].astype(np.int64) + gone["n"] + (length - 1)), n_buckets)
    if len(kept):
        # kept is sorted by kh: a bucket is a range of hashes
        bucket = (kept["kh"] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        cut = np.append(first[1:], len(kept))
        for at in range(0, len(first), 256):
            f, c = first[at : at + 256], cut[at : at + 256]
            n = len(f)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(bucket[f].astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([pack(kept[x:y]) for x, y in zip(f, c)], pa.binary())], schema=OUT
            )


def _index(n_buckets: int, length: int):
    def run(batches):
        held: list[np.ndarray] = []
        parts: list[tuple[int, int, bytes]] = []
        count = size = 0

        def scan():
            nonlocal parts, size, count
            if parts:
                held.append(segments(parts, length))
                count += len(held[-1])
            parts, size = [], 0

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = text.as_buffer()
                if data is None or len(data) < length:
                    continue
                data = data.to_pybytes()
                for lo in range(0, max(1, len(data) - length + 1), PIECE):
                    piece = data[lo : lo + PIECE + length - 1]
                    parts.append((doc, lo, piece))
                    size += len(piece)
                    if size >= PIECE:
                        scan()
                        if count >= FLUSH:
                            yield from _deal(*settle(np.concatenate(held)), n_buckets, length)
                            held, count = [], 0
        scan()
        if held:
            yield from _deal(*settle(np.concatenate(held)), n_buckets, length)

    return run


def _family(length: int, ask: bool, keep: bool = False):
    """Buckets of arrays, in order: spans of later equals, and windows to look at one by one; with keep, the merged arrays too."""

    def run(batches):
        now, family = None, Family()

        def close():
            kept, gone = family.close()
            if len(gone):
                yield _rows(SPAN, *merge_ranges(gone["doc"].copy(), gone["start"].astype(np.int64), gone["start"].astype(np.int64) + gone["n"] + (length - 1)), 1)
            if keep and len(kept):
                yield pa.RecordBatch.from_arrays([pa.array([RUN], pa.int8()), pa.array([now], pa.int32()), *[pa.nulls(1, pa.int64())] * 3, pa.array([pack(kept)], pa.binary())], schema=OUT)
            if ask and len(kept):
                same = kept["kh"][1:] == kept["kh"][:-1]
                twin = np.zeros(len(kept), bool)
                twin[1:] |= same
                twin[:-1] |= same
                t = kept[twin]
                if len(t):
                    yield _rows(ASK, t["doc"], t["start"], t["n"], 1)

        for b in batches:
            kind = b.column(0).to_numpy()
            if (kind != RUN).any():
                yield b.filter(pa.array(kind != RUN))
            bucket = b.column(1).to_numpy()
            for i in np.flatnonzero(kind == RUN).tolist():
                if bucket[i] != now:
                    yield from close()
                    now, family = bucket[i], Family()
                family.add(unpack(b.column(5)[i].as_py()))
        yield from close()

    return run


def _asked(n_buckets: int, length: int):
    """Texts with their windows to look at: arrays of single windows."""

    def run(batches):
        held: list[np.ndarray] = []
        count = 0
        for b in batches:
            for doc, text, asks in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                at = asks.values
                held.append(windows((doc, text.as_buffer().to_pybytes()), np.stack([at.field(0).to_numpy(), at.field(1).to_numpy()], 1), length))
                count += len(held[-1])
                if count >= FLUSH:
                    yield from _deal(*settle(np.concatenate(held)), n_buckets, length)
                    held, count = [], 0
        if held:
            yield from _deal(*settle(np.concatenate(held)), n_buckets, length)

    return run


def numbered(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = []) -> DataFrame:
    """(ord, id, text, kept columns): ord is the id where ids are whole numbers without nulls and repeats, else the place in order of id and text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    if rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        odd = rows.groupBy("id").agg(F.count("*").alias("n")).where("id IS NULL OR n > 1").limit(1).count()
        if not odd:
            return rows.withColumn("ord", F.col("id").cast("long"))
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), F.md5("text"))
    return materialize(ordered.withColumn("ord", F.monotonically_increasing_id()), "numbered")


def repeated_spans(rows: DataFrame, length: int = LENGTH, n_buckets: int | None = None) -> DataFrame:
    """(doc, lo, hi): byte ranges to remove from rows (ord, text); they may overlap."""
    n_buckets = n_buckets or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = rows.select("ord", "text")
    return _settled(text.mapInArrow(_index(n_buckets, length), OUT_SQL), text, length, n_buckets)


def _settled(runs: DataFrame, text: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Spans from arrays of segments, and from single windows of text(ord, text) where segments differ."""
    spark = text.sparkSession
    dealt = runs.repartition("bucket").sortWithinPartitions("kind", "bucket")
    one = materialize(dealt.mapInArrow(_family(length, True), OUT_SQL).select("kind", "doc", "lo", "hi"), "spans")
    del dealt, runs  # their shuffle files go once nothing refers to them
    free_shuffles(spark)
    asks = one.where(F.col("kind") == ASK).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("asks"))
    looked = text.join(asks, text.ord == asks.doc).select("ord", "text", "asks")
    dealt = looked.mapInArrow(_asked(n_buckets, length), OUT_SQL).repartition("bucket").sortWithinPartitions("kind", "bucket")
    two = materialize(dealt.mapInArrow(_family(length, False), OUT_SQL).select("doc", "lo", "hi"), "spans")
    del dealt, looked, asks
    free_shuffles(spark)
    return one.where(F.col("kind") == SPAN).select("doc", "lo", "hi").unionByName(two)


class IndexFamily:
    """A stored family of levels for batches that come one after another.

    ``add`` gives the spans to remove from a new batch, against everything added
    before; ids of a batch are unique whole numbers above all earlier ones. The
    batch's sorted arrays become a level, which merges with all levels below twice what is merged
    so far: levels differ geometrically in size, about log2(n) are left to scan after n batches, and each
    segment has been rewritten as often. Texts are stored beside the arrays for single windows.
    """

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 64, length: int = LENGTH):
        self.spark, self.root, self.n_buckets, self.length = spark, root, n_buckets, length
        self.levels: list[tuple[int, DataFrame]] = []  # (bytes, arrays by bucket), largest first
        self.texts: list[DataFrame] = []
        self.written = 0

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{self.written:06d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, lo, hi) of the new batch."""
        text = self._store(docs.select(F.col(f"`{id_col}`").cast("long").alias("ord"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), "texts")
        new = self._store(text.mapInArrow(_index(self.n_buckets, self.length), OUT_SQL), "batch")
        runs, every = new, text
        for _, level in self.levels:
            runs = runs.unionByName(level)
        for t in self.texts:
            every = every.unionByName(t)
        spans = _settled(runs, every, self.length, self.n_buckets)
        # equal arrays of earlier batches were settled when they came
        mine = spans.join(text.select(F.col("ord").alias("doc")), "doc", "left_semi")
        self.texts.append(text)
        level = new.where(F.col("kind") == RUN)
        size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("run")), F.lit(0))).first()[0]
        total, parts = size(level), [level]
        while self.levels and self.levels[-1][0] < 2 * total:
            n, other = self.levels.pop()
            total += n
            parts.append(other)
        if len(parts) > 1:
            both = parts[0]
            for other in parts[1:]:
                both = both.unionByName(other)
            dealt = both.repartition("bucket").sortWithinPartitions("kind", "bucket")
            level = self._store(dealt.mapInArrow(_family(self.length, False, True), OUT_SQL).where(F.col("kind") == RUN), "level")
            total = size(level)
        self.levels.append((total, level))
        return mine


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: list[str] = []) -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, spans array<struct<lo,hi>>, the columns to keep) for every row."""
    rows = numbered(docs, id_col, text_col, keep)
    spans = repeated_spans(rows, length).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = rows.join(spans, rows.ord == spans.doc, "left").select("id", "text", "ranges", *[f"keep_{c}" for c in keep])
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            kept, total, gone, all_spans = [], [], [], []
            for text, ranges in zip(b.column(1), b.column(2)):
                data = text.as_buffer().to_pybytes()
                lo = hi = np.empty(0, np.int64)
                if ranges.is_valid:
                    v = ranges.values
                    lo, hi = v.field(0).to_numpy(), v.field(1).to_numpy()
                    _, lo, hi = merge_ranges(np.zeros(len(lo), np.int64), lo, hi)
                ends = np.r_[lo, len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(np.r_[0, hi].tolist(), ends.tolist())))
                total.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                all_spans.append([{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist())])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), *b.columns[3:]],
                ["id", "kept", "n_bytes", "n_removed", "spans", *keep],
            )

    return joined.mapInArrow(run, f"id {kind}, kept binary, n_bytes bigint, n_removed bigint, spans array<struct<lo:bigint,hi:bigint>>" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
