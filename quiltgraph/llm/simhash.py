"""SimHash near-duplicate groups with pivot distance tables.

1. ``fingerprints``: one 64-bit fingerprint a document, over hashed word shingles.
2. Equal fingerprints fold into one node, so a group of exact
   copies, however large, is one node and no pair.
3. ``pivot_table``: the Hamming distances of every node to N_PIVOTS reference fingerprints, computed
   once and stored beside it.
4. ``links``: nodes meet in tables keyed by equal bit blocks (see ``block_tables``; with e more blocks
   than the radius, e of them are equal in every linked pair, so no link is missed). Inside a bucket rows are
   sorted by their first pivot distance, and a row meets the following ones only while that distance
   is within the radius; of these pairs the largest difference of any other pivot distance discards
   most (triangle inequality), and exact Hamming distance verifies the survivors.
   A bucket emits a star for each of its connected sets, at most one row a node, never all pairs.
   Buckets of over TILE rows are cut into tiles of chunk pairs, so that a task
   never holds more than two chunks; every pair of the bucket is still in a tile.
   ``pair_counts`` says how many pairs each step discards.
5. ``components``: min-label propagation with pointer jumping, one checkpoint a round.

Pivot distances of random fingerprints crowd around 32, so 57 % of all pairs are within the radius on any one
of them: a sort by one coordinate over all nodes would leave half of all pairs. Therefore blocks first
choose who meets; pivots do the rest.

``near_copies`` links by Jaccard similarity of shingle sets instead of a radius (see ``nearcopies``):
64 bits cannot decide 0.8, where two fingerprints differ in some 10 bits.

Nulls: a null text has no words, fingerprint zero. Null ids are their own rows;
a group of null ids only has a null component. Repeated rows: same fingerprint,
same component. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, materialize, remove

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Nodes that a bucket holds at most on average before keys widen.
PER_BUCKET = 8
N_PIVOTS = 16
TILE = 4096
#: Keys of large buckets that are broadcast at most.
BROADCAST_KEYS = 100_000


def pivots(n: int = N_PIVOTS, seed: int = SEED) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit values."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text; a bit is 1 if set in over half of the shingle hashes, repeats included."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= n:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.empty_like(ends)
        starts[0], starts[1:] = 0, ends[:-1] + 1
        view, dig = memoryview(joined), xxhash.xxh64_intdigest
        h = np.fromiter((dig(view[a:b], seed) for a, b in zip(starts[: len(ws) - n + 1].tolist(), ends[n - 1 :].tolist())), np.uint64, len(ws) - n + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp bigint) for every row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def block_tables(radius: int, n_nodes: int) -> list[list[tuple[int, int]]]:
    """The bit blocks (start, length) of each table's key.

    With radius + e blocks, ``e`` of them are equal in every pair within the radius, so a table for each choice
    of e blocks misses no pair. ``e`` is the smallest number whose keys spread n_nodes over buckets of PER_BUCKET.
    """
    e = 2
    while e < 4 and n_nodes > PER_BUCKET << (64 * e // (radius + e)):
        e += 1
    cuts = [64 * i // (radius + e) for i in range(radius + e + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in c] for c in combinations(range(radius + e), e)]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp) with dist: a byte for the distance to each pivot."""

    def run(batches):
        for b in batches:
            d = np.bitwise_count(b.column(1).to_numpy().view(np.uint64)[:, None] ^ pivots()[None, :])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in d], pa.binary())], ["node", "fp", "dist"])

    return nodes.select("node", "fp").mapInArrow(run, "node bigint, fp bigint, dist binary")


def _bucket_stars(key: np.ndarray, fp: np.ndarray, dist: np.ndarray, node: np.ndarray, radius: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows grouped by key: star edges (node, smallest node) of the sets that verified pairs connect within a key. counts adds up pairs within the radius on the first pivot, on all, and in truth."""
    order = np.lexsort((dist[:, 0], key))
    key, fp, dist, node = key[order], fp[order], dist[order], node[order]
    n = len(key)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    left = np.arange(n - 1)
    shift = 1
    while len(left):
        left = left[left + shift < n]
        # sorted by the first distance: beyond the radius there is nothing further on
        left = left[(key[left] == key[left + shift]) & (dist[left + shift, 0] - dist[left, 0] <= radius)]
        if not len(left):
            break
        # rows already in one set need no further look
        open_ = left[parent[left] != parent[left + shift]]
        near = open_
        for p in range(1, dist.shape[1], 4):
            if not len(near):
                break
            near = near[(np.abs(dist[near, p : p + 4] - dist[near + shift, p : p + 4]) <= radius).all(1)]
        passed = len(near)
        near = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= radius]
        if counts is not None:
            counts += (len(open_), passed, len(near))
        for i in near.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(near):
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        shift += 1
    low = node.copy()
    np.minimum.at(low, parent, node)
    root = low[parent]
    keep = root != node
    return node[keep], root[keep]


def bucket_rows(nodes: DataFrame, radius: int, tile: int) -> DataFrame:
    """(key, part, node, fp, dist) in order: the tiles of all buckets."""
    tables = block_tables(radius, nodes.count())
    keys = []
    for t, blocks in enumerate(tables):
        key = F.lit(t).cast("long")
        for start, length in blocks:
            key = F.shiftleft(key, length).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << length) - 1)))
        keys.append(key)
    rows = nodes.select("node", "fp", "dist", F.explode(F.array(*keys)).alias("key"))
    big = nodes.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    big = materialize(big.select("key", F.ceil(F.col("n") / (tile // 2)).cast("int").alias("m")), "big")
    n_big = big.count()
    if n_big == 0:
        cut = rows.withColumn("m", F.lit(None).cast("int"))
    else:
        cut = rows.join(F.broadcast(big) if n_big <= BROADCAST_KEYS else big, "key", "left")
    mine = F.pmod(F.xxhash64("node", "key"), F.col("m").cast("long")).cast("int")
    part = F.when(F.col("m").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: (F.least(o, mine).cast("long") * F.col("m") + F.greatest(o, mine)))
    )
    return cut.select("key", F.explode(part).alias("part"), "node", "fp", "dist").repartition("key", "part").sortWithinPartitions("key", "part", "node")


def _bucket_batches(batches, tile: int):
    """(bucket number, fp, dist, node) arrays of whole buckets from sorted rows."""
    held: list[pa.RecordBatch] = []

    def out(tbl: pa.Table):
        k, p = tbl.column("key").to_numpy(), tbl.column("part").to_numpy()
        new = np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])] if len(k) else np.zeros(0, bool)
        dist = np.frombuffer(b"".join(tbl.column("dist").to_pylist()), np.int8).reshape(len(k), N_PIVOTS)
        return np.cumsum(new), tbl.column("fp").to_numpy().view(np.uint64), dist, tbl.column("node").to_numpy().copy()

    for b in batches:
        held.append(b)
        tbl = pa.Table.from_batches(held).combine_chunks()
        k, p = tbl.column("key").to_numpy(), tbl.column("part").to_numpy()
        if not len(k):
            continue
        # the last bucket may go on in the next batch
        other = (k != k[-1]) | (p != p[-1])
        last = len(k) - int(np.argmax(other[::-1])) if other.any() else 0
        if last and tbl.num_rows >= 2 * tile:
            yield out(tbl.slice(0, last))
            tbl = tbl.slice(last)
        held = tbl.to_batches()
    if held:
        yield out(pa.Table.from_batches(held).combine_chunks())


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) star edges between nodes (node bigint, fp bigint, dist binary, fp distinct) that chains of verified links connect."""

    def run(batches):
        for key, fp, dist, node in _bucket_batches(batches, tile):
            a, b = _bucket_stars(key, fp, dist, node, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return bucket_rows(nodes, radius, tile).mapInArrow(run, "a bigint, b bigint")


def pair_counts(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row: pairs of a bucket within the radius on the first pivot, those within it on all pivots, and those within it in truth (pairs that are connected already are not looked at)."""

    def run(batches):
        counts = np.zeros(3, np.int64)
        for key, fp, dist, node in _bucket_batches(batches, tile):
            _bucket_stars(key, fp, dist, node, radius, counts)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in counts], ["first_pivot", "all_pivots", "verified"])

    rows = bucket_rows(nodes, radius, tile).mapInArrow(run, "first_pivot bigint, all_pivots bigint, verified bigint")
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = label.join(seen, label.node == seen.a, "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("label").alias("hop"))
        new = materialize(lower.join(jump, "low", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("hop", "low")).alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        remove(label)
        label = new.select("node", "label")
        if not changed:
            remove(both)
            return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp bigint, component_id): every row with its fingerprint and the smallest id that links reach."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # nodes are fingerprints, so those of null ids only link others too
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    table = materialize(pivot_table(nodes.select(F.col("fp").alias("node"), "fp")), "pivots")
    comp = components(links(table, radius))
    named = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    # written, so that the join deals out both sides anew and a fingerprint of very many rows can be split
    named = materialize(named.join(least, "label").select("fp", "component_id"), "named")
    remove(table)
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def near_copies(docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(h, component) by Jaccard similarity of shingle sets instead of a radius; h is ``nearcopies.folded`` of the text, and only linked texts have a row."""
    from . import nearcopies

    return nearcopies.groups(docs, text_col, shingle, similarity)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
