"""Groups of near copies by SimHash fingerprints and stored pivot distances, decided by exact Jaccard similarity of
word shingles: the similarity form of the near-dedup operator.

1. Texts that are equal but for ASCII case fold into one node, so exact copies are no pairs.
2. ``fingerprints``: a SimHash over a node's different shingles, a bit 1 if set in over half of their hashes. Two sets of
   similarity s differ in a bit with chance arccos(2s / (1 + s)) / pi, ``DIFFERS`` at 0.8, whatever the bit; 64 bits cannot decide that,
   so fingerprints are as wide as the tables below need. Beside each, its distances to N_PIVOTS
   reference fingerprints over the first MARK words, computed once and stored.
3. ``bucket_sets``: nodes meet in tables keyed by bits of their own each (``shape``): narrow keys for few nodes,
   wider ones for many, and as many tables that a pair of 0.8 meets in none with chance MISS. Inside a bucket the pivot distances choose
   pairs: those of two nodes differ by a sum of as many signs as there are differing bits, so squares summed over
   all pivots exceed PIVOT_FAR in none of 1,000,000 simulated pairs of 0.8 (6500 in one), and in 3 of 4 others. Hamming distance over the
   MARK words verifies what they leave; what is connected in a bucket is a candidate set. Buckets of over a tile are
   first held against hubs of their own, and only rows of different hubs are dealt into tiles, so a large family is no square.
   Nodes of equal fingerprints are one row here and a candidate set of their own. Tables are gone through PASS at a time, which bounds the shuffle.
4. ``hub_links``: every node of a candidate set is held against the set's hub, the member that meets
   most others, by exact Jaccard similarity. Members of a family mostly link here, a row each.
5. What is left are sets of nodes that are not yet connected. ``dealt`` cuts them into tiles, so that every pair of
   unconnected nodes is in one: the largest connected part of a set is only held against the rest, so a
   family of a third of all nodes is dealt out once, not squared. Pairs of a tile whose whole
   fingerprints are alike (``far``: 9 deviations beyond 0.8) connect into larger sets.
6. The same dealing brings the texts of such a set together; exact Jaccard similarity decides.
7. ``simhash.components`` over all links.

``pair_counts`` says how many pairs of the buckets the pivots and the Hamming distance leave. Fingerprints of very short texts are coarser: 4 of 5 equal
shingles, the smallest pair of 0.8, differ in a bit with chance 0.19, and up to 0.3 % of such pairs meet in no table.

Words are those of op4. A text of fewer words than a shingle has one shingle, its words; texts
without words (null ones too) are one group. Ids play no part. Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, lower_ascii, materialize, remove
from .simhash import components

SEED, SHINGLE, LEAST = 42, 5, 0.8
#: Chance that a bit differs at LEAST, and that a pair of LEAST meets in no table.
DIFFERS, MISS = math.acos(2 * LEAST / (1 + LEAST)) / math.pi, 1e-6
#: Nodes that a bucket holds at most on average, and tables of one pass.
PER_BUCKET, PASS = 64, 24
#: Words of a fingerprint that travel with bucket rows, and the bits in which two of them differ at most (6 deviations beyond 0.8).
MARK, RADIUS = 4, 76
N_PIVOTS, PIVOT_FAR = 64, 7000
#: Nodes that a bucket of over a tile is held against first.
HUBS = 8
TILE = 1024
_SIGNS = [f"f{i}" for i in range(MARK)]


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    joined = b" ".join(ws)
    if len(ws) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    view, dig = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((dig(view[a:b], SEED) for a, b in zip(starts[: len(ws) - n + 1].tolist(), ends[n - 1 :].tolist())), np.uint64, len(ws) - n + 1))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shape(n_nodes: int, differs: float = DIFFERS) -> tuple[int, int, int]:
    """(bits of a key, tables, words of a fingerprint) for so many nodes."""
    bits = 8
    while bits < 32 and n_nodes > PER_BUCKET << bits:
        bits += 1
    tables = math.ceil(math.log(MISS) / math.log1p(-((1 - differs) ** bits)))
    return bits, tables, max(MARK, -(-tables // (64 // bits)))


def far(n_words: int) -> int:
    """The bits in which whole fingerprints of a pair of LEAST differ at most: 9 deviations more than the mean."""
    n = 64 * n_words
    return int(n * DIFFERS + 9 * math.sqrt(n * DIFFERS * (1 - DIFFERS)))


def set_bits(x: np.ndarray) -> np.ndarray:
    """How many rows of x (n, words) have each bit set: adders over whole words, three rows into two."""
    planes = []
    while True:
        carries = []
        while len(x) > 2:
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            x = np.concatenate([odd ^ c, x[3 * m :]])
        if len(x) == 2:
            carries.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        planes.append(x[0])
        if not carries:
            break
        x = np.concatenate(carries)
    bits = np.unpackbits(np.array(planes).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (1 << np.arange(len(planes))) @ bits.astype(np.int64)


def factors(n_words: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, n_words, dtype=np.uint64) | np.uint64(1)


def fingerprint(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes, a word of 64 bits for each factor."""
    total = 0
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] * by
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        total = total + set_bits(x)
    return np.packbits(total * 2 > len(h), bitorder="little").view("<u8")


def pivot_distances(fp: np.ndarray) -> np.ndarray:
    """(n, N_PIVOTS) bytes: distances of the first MARK words of fp to fixed pseudo-random fingerprints."""
    pivots = np.random.default_rng(SEED + 1).integers(0, 2**64, (N_PIVOTS, MARK), dtype=np.uint64)
    return np.stack([np.minimum(np.bitwise_count(fp[:, :MARK] ^ p).sum(1, dtype=np.int64), 255).astype(np.uint8) for p in pivots], 1)


def folded(text: Column) -> Column:
    """The node of a text."""
    return F.md5(F.coalesce(lower_ascii(text), F.lit("")))


def fingerprints(docs: DataFrame, n_docs: int, text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(node, h, sig array<bigint>, dist binary) for every different text, as wide as n_docs asks for; written, so node is fixed."""
    n_words = shape(n_docs)[2]

    def run(batches):
        by = factors(n_words)
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.array([fingerprint(shingles(t, n), by) for t in b.column(1).to_pylist()], np.uint64)
            at = pa.array(np.arange(len(fp) + 1) * n_words, pa.int32())
            dist = pa.array([d.tobytes() for d in pivot_distances(fp)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(fp.view(np.int64).ravel())), dist], ["h", "sig", "dist"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(folded(text).alias("h"), text.alias("text")).mapInArrow(run, "h string, sig array<bigint>, dist binary")
    one = rows.groupBy("h").agg(F.first("sig").alias("sig"), F.first("dist").alias("dist"))
    return materialize(one.withColumn("node", F.monotonically_increasing_id()), "fingerprints")


def bit_keys(n_nodes: int) -> list[Column]:
    """The key of each table, from the words in sig."""
    bits, tables, _ = shape(n_nodes)
    each = 64 // bits
    key = lambda t: F.shiftrightunsigned(F.col("sig")[t // each], t % each * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return [key(t).bitwiseOR(F.lit(t << 32).cast("long")) for t in range(tables)]


def _sets(fp: np.ndarray, dist: np.ndarray, comp: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The set of each row of a bucket: comps that pairs within PIVOT_FAR by pivots and RADIUS in truth connect. counts adds up pairs of unconnected rows, those that the pivots leave, and those within the radius."""
    label = np.unique(comp, return_inverse=True)[1]
    n = len(label)
    if n > 8 and label.max() == n - 1:
        # the row nearest to the middle of all
        hub = ((dist - dist.mean(0)) ** 2).sum(1).argmin()
        near = np.bitwise_count(fp ^ fp[hub]).sum(1) <= RADIUS
        label[near] = label[near].min()
    rest = np.flatnonzero(label != np.bincount(label).argmax())
    if not len(rest):
        return label
    inner = np.ones(n, bool)
    inner[rest] = False
    square = (dist * dist).sum(1)
    pairs = []
    for at in range(0, len(rest), 256):
        r = rest[at : at + 256]
        apart = square[r][:, None] + square[None, :] - 2 * (dist[r] @ dist.T)
        i, j = np.nonzero(apart <= PIVOT_FAR)
        i = r[i]
        once = (label[i] != label[j]) & ((i < j) | inner[j])
        i, j = i[once], j[once]
        left = len(i)
        ok = np.bitwise_count(fp[i] ^ fp[j]).sum(1) <= RADIUS
        pairs.append((i[ok], j[ok]))
        if counts is not None:
            counts += (int(((label[r][:, None] != label[None, :]) & ((r[:, None] < np.arange(n)) | inner)).sum()), left, int(ok.sum()))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    while len(i):
        new = np.arange(n)
        a, b = label[i], label[j]
        np.minimum.at(new, a, np.minimum(a, b))
        np.minimum.at(new, b, np.minimum(a, b))
        label = new[new][label]
        if (label[i] == label[j]).all():
            break
    return label


def whole_buckets(batches, rows: int):
    """Tables of whole buckets (key, part) from sorted rows, and the start of each bucket."""
    held: list[pa.RecordBatch] = []

    def out(t: pa.Table, k: np.ndarray, p: np.ndarray):
        return t, np.append(np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])]), len(k)).tolist()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k, p = t.column("key").to_numpy(), t.column("part").to_numpy()
        # the last bucket may go on in the next batch
        other = np.flatnonzero((k != k[-1]) | (p != p[-1]))
        if len(other):
            last = int(other[-1]) + 1
            yield out(t.slice(0, last), k[:last], p[:last])
            t = t.slice(last)
        held = t.to_batches()
    if sum(x.num_rows for x in held):
        t = pa.Table.from_batches(held).combine_chunks()
        yield out(t, t.column("key").to_numpy(), t.column("part").to_numpy())


def _buckets(batches):
    """(key, part, node, fp, dist, comp) of each bucket of two rows or more."""
    for t, starts in whole_buckets(batches, 1 << 14):
        key, part, node, comp = (t.column(c).to_numpy() for c in ("key", "part", "node", "comp"))
        fp = np.stack([t.column(c).to_numpy().view(np.uint64) for c in _SIGNS], 1)
        dist = np.frombuffer(b"".join(t.column("dist").to_pylist()), np.uint8).reshape(-1, N_PIVOTS).astype(np.float32) - 32 * MARK
        for x, y in zip(starts, starts[1:]):
            if y - x > 1:
                yield key[x], part[x], node[x:y], fp[x:y], dist[x:y], comp[x:y]


def _mixed(key: int, part: int, node: np.ndarray) -> np.ndarray:
    """Names of sets."""
    seed = np.array([key, part], np.int64).view(np.uint64) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    x = (node.astype(np.uint64) + (seed[0] ^ seed[1])) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def set_rows(rows: DataFrame) -> DataFrame:
    """(key, node): the candidate sets, each with a key, of bucket rows in order."""

    def run(batches):
        keys, nodes = [], []
        for key, part, node, fp, dist, comp in _buckets(batches):
            label = _sets(fp, dist, comp)
            size = np.bincount(label, minlength=len(label))
            low = np.full(len(label), np.iinfo(np.int64).max)
            np.minimum.at(low, label, node)
            more = size[label] > 1
            if more.any():
                keys.append(_mixed(key, part, low[label[more]]))
                nodes.append(node[more])
            if len(keys) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])
                keys, nodes = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return rows.select("key", "part", "node", "comp", *_SIGNS, "dist").mapInArrow(run, "key bigint, node bigint")


def bucket_rows(nodes: DataFrame, keys: list[Column], tile: int = TILE) -> tuple[DataFrame, DataFrame | None]:
    """(key, part, node, comp, words, dist) in order, and the rows of buckets of over a tile, where comp is below zero for those that a hub holds."""
    each = F.explode(F.array(*keys)).alias("key")
    rows = nodes.select("node", *[F.col("sig")[i].alias(c) for i, c in enumerate(_SIGNS)], "dist", each)
    big = materialize(nodes.select(each).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("key"), "big")
    whole = rows if not big.limit(1).count() else rows.join(big, "key", "left_anti")
    order = lambda x: x.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    small = order(whole.withColumns({"part": F.lit(0).cast("long"), "comp": F.col("node")}))
    if whole is rows:
        return small, None
    large = rows.join(big, "key")
    hubs = large.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("node", "key", F.lit(i)), *_SIGNS)).alias(f"hub{i}") for i in range(HUBS)])
    differ = lambda i: sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub{i}.{c}"))) for c in _SIGNS), F.lit(0))
    near = F.coalesce(*[F.when(differ(i) <= RADIUS, F.lit(-1 - i).cast("long")) for i in range(HUBS)], F.col("node"))
    held = materialize(large.join(hubs, "key").select("key", near.alias("comp"), "node", *_SIGNS, "dist"), "large")
    parts = dealt(held, tile).select("key", "part", "node", "comp", *_SIGNS, "dist")
    return small.select(*parts.columns).union(parts), held


def candidate_sets(sigs: DataFrame, n_docs: int, tile: int = TILE) -> DataFrame:
    """(key, node, n): the rows of every candidate set; of sets with the same nodes one. sigs are as wide as n_docs asks for."""
    same = sigs.groupBy(F.xxhash64("sig").alias("s"), "sig").agg(F.min("node").alias("node"), F.first("dist").alias("dist"), F.count("*").alias("n"))
    # nodes of one fingerprint are one row of the tables
    nodes = materialize(same, "nodes")
    found, written = [], []
    if nodes.where("n > 1").limit(1).count():
        found.append(sigs.join(nodes.where("n > 1").select("sig"), "sig").select(F.xxhash64("sig", F.lit("same")).alias("key"), "node"))
    keys = bit_keys(n_docs)
    for at in range(0, len(keys), PASS):
        rows, large = bucket_rows(nodes, keys[at : at + PASS], tile)
        found.append(materialize(set_rows(rows), "sets"))
        written.append(found[-1])
        if large is not None:
            found.append(materialize(large.where("comp < 0").select(F.xxhash64("key", "comp").alias("key"), "node"), "hubs"))
            written.append(found[-1])
            remove(large)
        free_shuffles(sigs.sparkSession)
    rows = found[0]
    for x in found[1:]:
        rows = rows.union(x)
    one, two = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    sets = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y")).where("n > 1")
    chosen = sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    out = materialize(rows.join(chosen, "key"), "sets")
    for x in (nodes, *written):
        remove(x)
    return out


def pair_counts(docs: DataFrame, text_col: str = "text", n: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row: pairs of unconnected rows in buckets, those that the pivots leave, and those within the radius."""
    n_docs = docs.count()
    nodes = fingerprints(docs, n_docs, text_col, n)

    def run(batches):
        counts = np.zeros(3, np.int64)
        for _, _, _, fp, dist, comp in _buckets(batches):
            _sets(fp, dist, comp, counts)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in counts], ["met", "pivots", "verified"])

    rows = bucket_rows(nodes, bit_keys(n_docs), tile)[0].mapInArrow(run, "met bigint, pivots bigint, verified bigint")
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def hub_pairs(met: DataFrame) -> DataFrame:
    """(a, b): every node with the hub of each of its buckets, once."""
    weight = met.groupBy("node").agg(F.sum("n").alias("w"))
    hub = met.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node")).alias("hub")).select("key", F.col("hub.node").alias("b"))
    return met.join(hub, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def words_of(c: pa.ListArray) -> np.ndarray:
    """Fingerprints of a column, a row each."""
    return c.flatten().to_numpy().view(np.uint64).reshape(len(c), -1)


def hub_links(pairs: DataFrame, nodes: DataFrame, least: float, n: int) -> DataFrame:
    """The pairs (a, b) of similarity ``least`` or more; nodes are (node, sig, text)."""

    def run(batches):
        for b in batches:
            ok = [jaccard(shingles(x, n), shingles(y, n)) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def alike(batches):
        for b in batches:
            if b.num_rows:
                x, y = (words_of(c) for c in b.columns[2:])
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(1) <= far(x.shape[1])))

    side = lambda k, c: nodes.select(F.col("node").alias(k), F.col(c).alias(f"{c}_{k}"))
    close = pairs.join(side("a", "sig"), "a").join(side("b", "sig"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(alike, "a bigint, b bigint")
    both = close.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def dealt(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """rows (key, comp, node, more columns) of the keys with several comps, with a tile number: every two nodes of a key and different comps are in one tile. Keys of half a tile at most are one tile as they are; only larger ones are multiplied."""
    half = max(1, tile // 2)
    size = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.max(F.struct("c", "comp")).alias("top")).where("k > 1")
    cut = size.select("key", F.col("top.comp").alias("top"), F.ceil(F.col("n") / half).alias("wide"), F.ceil((F.col("n") - F.col("top.c")) / half).alias("high"))
    whole = rows.join(cut.where("wide = 1").select("key"), "key").select(*rows.columns, F.lit(0).cast("long").alias("part"))
    x = rows.join(cut.where("wide > 1"), "key")
    spread = lambda seed, m: F.pmod(F.xxhash64("node", "key", F.lit(seed)), F.col(m))
    column = F.transform(F.sequence(F.lit(0).cast("long"), F.col("high") - 1), lambda r: r * F.col("wide") + spread(1, "wide"))
    row = F.when(F.col("comp") == F.col("top"), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda c: spread(2, "high") * F.col("wide") + c))
    out = whole.union(x.select(*rows.columns, F.explode(F.array_distinct(F.concat(column, row))).alias("part")))
    return out.repartition("key", "part").sortWithinPartitions("key", "part", "node")


def connected(node: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray] | None, least: float = LEAST) -> tuple[list[int], list[int]]:
    """Edges (a, b) that join the comps of a tile: over pairs whose fingerprints are alike, or if sets are given, of similarity ``least`` or more."""
    root = np.unique(comp, return_inverse=True)[1]
    size = np.array([len(s) for s in sets]) if sets is not None else None
    a, b = [], []
    for i in range(len(node) - 1):
        j = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if size is not None:
            j = j[np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]) - 1e-6]
        if len(j):
            j = j[np.bitwise_count(sig[j] ^ sig[i]).sum(1) <= far(sig.shape[1])]
        for k in j.tolist():
            if root[k] != root[i] and (sets is None or jaccard(sets[i], sets[k]) >= least):
                a.append(int(node[i]))
                b.append(int(node[k]))
                root[root == root[k]] = root[i]
    return a, b


def tile_links(tiles: DataFrame, least: float, n: int, exact: bool) -> DataFrame:
    """(a, b) from tiles (key, part, node, comp, sig and, if exact, text)."""

    def run(batches):
        now, node, comp, sig, sets = None, [], [], [], []

        def out():
            a, b = connected(np.array(node, np.int64), np.array(comp, np.int64), np.array(sig), sets if exact else None, least)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [words_of(x) if k == 4 else x.to_pylist() for k, x in enumerate(batch.columns)]
            for key, part, i, c, s, *t in zip(*columns):
                if (key, part) != now:
                    if len(node) > 1:
                        yield out()
                    now, node, comp, sig, sets = (key, part), [], [], [], []
                node.append(i)
                comp.append(c)
                sig.append(s)
                if exact:
                    sets.append(shingles(t[0], n))
        if len(node) > 1:
            yield out()

    return tiles.select("key", "part", "node", "comp", "sig", *(["text"] if exact else [])).mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(h, component) for the texts (by :func:`folded`) that are linked to another one."""
    text = F.col(f"`{text_col}`")
    n_docs = docs.count()
    sigs = fingerprints(docs, n_docs, text_col, shingle)
    met = candidate_sets(sigs, n_docs, tile)
    asked = met.select("node").distinct().join(sigs.select("node", "h", "sig"), "node")
    rows = docs.select(folded(text).alias("h"), text.alias("text")).join(asked, "h").groupBy("node").agg(F.first("sig").alias("sig"), F.first("text").alias("text"))
    nodes = materialize(rows, "nodes")
    first = materialize(hub_links(hub_pairs(met), nodes, least, shingle), "links")
    # candidate sets of several connected parts: which of their nodes may be alike
    known = components(first)
    comp = lambda x: x.join(known, "node", "left").select(*x.columns, F.coalesce("label", "node").alias("comp"))
    with_sig = comp(met.select("key", "node")).join(nodes.select("node", "sig"), "node")
    maybe = materialize(tile_links(dealt(with_sig, tile), least, shingle, False), "maybe")
    chains = components(maybe.union(known.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    full = comp(chains.select(F.col("label").alias("key"), "node")).join(nodes, "node")
    second = materialize(tile_links(dealt(full, tile), least, shingle, True), "links")
    label = components(first.union(second))
    out = materialize(label.join(sigs.select("node", "h"), "node").select("h", F.col("label").alias("component")), "near")
    for x in (met, nodes, first, maybe, second, sigs, known, chains, label):
        remove(x)
    return out
