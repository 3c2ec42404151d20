"""Graphs in numbers, for rounds over more pairs than one task may hold.

Nodes are numbered in the order of their ids; pairs are written once, as blocks of packed arrays that keep all pairs
of a target together. A round sends the nodes' values (8 bytes a node) to tasks that hold a block each and takes one
value a target back: no join, no strings, no table between rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, drop

#: Pairs after which a block is closed at the next target, and pairs a partition.
BLOCK, PARTITION = 1_000_000, 4_000_000


class Numbered:
    def __init__(self, nodes: DataFrame, pairs: DataFrame):
        """pairs(src, dst[, w]); pairs with an end outside nodes drop out."""
        rows = cut(nodes.select("id").distinct().orderBy("id").withColumn("m", F.monotonically_increasing_id()))
        part = F.shiftright("m", 33)
        sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
        before, self.n = {}, 0
        for p in sorted(sizes):
            before[p], self.n = self.n, self.n + sizes[p]
        at = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(max(sizes, default=0) + 1)]), part.cast("int"))
        self.ids = cut(rows.select("id", (F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + at).cast("int").alias("n")))
        drop(rows)
        w = F.col("w").cast("double") if "w" in pairs.columns else F.lit(1.0)
        ends = lambda c, o: self.ids.select(F.col("id").alias(c), F.col("n").alias(o))
        self.pairs = cut(pairs.select("src", "dst", w.alias("w")).join(ends("src", "s"), "src").join(ends("dst", "d"), "dst").select("s", "d", "w"))
        self.size = self.pairs.count()
        self._packed: dict = {}

    def blocks(self, way: str) -> DataFrame:
        """Packed pairs, parallel ones added up: in (towards dst), out (towards src) or both (loops dropped)."""
        if way not in self._packed:
            p = self.pairs
            if way != "in":
                p = p.select(F.col("d").alias("s"), F.col("s").alias("d"), "w")
            if way == "both":
                p = p.unionByName(self.pairs).where("s <> d")
            parts = max(1, -(-self.size * (2 if way == "both" else 1) // PARTITION))
            kind = "src binary, start binary, dst binary, w binary"

            def pack(batches):
                held = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches]
                if not held:
                    return
                s, d, w = (np.concatenate(c) for c in zip(*held))
                held.clear()
                key = d.astype(np.int64) << 32 | s
                o = np.argsort(key)
                key, w = key[o], w[o]
                one = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # parallel pairs are one, of their summed weight
                w, key = np.add.reduceat(w, one), key[one]
                s, d = (key & 0xFFFFFFFF).astype(np.int32), (key >> 32).astype(np.int32)
                new = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                at = 0
                while at < len(new):
                    to = max(at + 1, int(np.searchsorted(new, new[at] + BLOCK)))
                    end = new[to] if to < len(new) else len(d)
                    cells = (s[new[at] : end], (new[at:to] - new[at]).astype(np.int32), d[new[at:to]], w[new[at] : end])
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["src", "start", "dst", "w"])
                    at = to

            self._packed[way] = cut(p.select("s", "d", "w").repartition(parts, "d").mapInArrow(pack, kind))
        return self._packed[way]

    def each(self, way: str, kernel, *vectors: np.ndarray, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
        """(targets, values): kernel(src, start, dst, w, *vectors) gives one value for each target of a block."""
        sc = self.ids.sparkSession.sparkContext
        sent = sc.broadcast(vectors)

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    src, start, dst = (np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in range(3))
                    got = kernel(src, start, dst, np.frombuffer(b.column(3)[i].as_buffer(), np.float64), *sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (dst, np.asarray(got, dtype))], ["dst", "x"])

        t = self.blocks(way).mapInArrow(run, "dst binary, x binary").toArrow()
        sent.destroy()
        of = lambda c, kind: np.concatenate([np.empty(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]])
        return of("dst", np.int32), of("x", dtype)

    def total(self, way: str, x: np.ndarray) -> np.ndarray:
        """Weighted sum of x over each node's sources."""
        out = np.zeros(self.n)
        at, got = self.each(way, lambda src, start, dst, w, x: np.add.reduceat(x[src] * w, start), x)
        out[at] = got
        return out

    def total_of_pairs(self, way: str) -> np.ndarray:
        """How many sources each node has."""
        out = np.zeros(self.n, np.int64)
        at, got = self.each(way, lambda src, start, dst, w: np.diff(np.r_[start, len(src)]), dtype=np.int64)
        out[at] = got
        return out

    def best(self, way: str, x: np.ndarray, op=np.minimum, none: int = -1) -> np.ndarray:
        """Smallest (or largest) of whole numbers x over each node's sources."""
        out = np.full(self.n, none, np.int64)
        at, got = self.each(way, lambda src, start, dst, w, x: op.reduceat(x[src], start), x, dtype=np.int64)
        out[at] = got
        return out

    def named(self, names: bool = False, **columns: np.ndarray) -> DataFrame:
        """(id, columns); with names the columns are numbers of nodes and come back as ids."""
        spark = self.ids.sparkSession
        kinds = {c: "bigint" if x.dtype.kind in "iu" else "double" for c, x in columns.items()}
        sent = spark.sparkContext.broadcast(tuple(columns.values()))

        def run(batches):
            for b in batches:
                at = b.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[at]) for x in sent.value]], ["id", *columns])

        out = self.ids.mapInArrow(run, "id string, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))
        if names:
            for c in columns:
                out = out.join(self.ids.select(F.col("id").alias("_name"), F.col("n").cast("bigint").alias(c)), c).drop(c).withColumnRenamed("_name", c)
            out = out.select("id", *columns)
        return out

    def numbers(self, table: DataFrame) -> np.ndarray:
        """Numbers of the nodes of table(id)."""
        return self.ids.join(table.select("id").distinct(), "id", "left_semi").select("n").toArrow().column("n").to_numpy().astype(np.int64)


def h_index(src, start, dst, w, x):
    """The largest h for each target such that h sources have x of h or more."""
    size = np.diff(np.r_[start, len(src)])
    row = np.repeat(np.arange(len(start)), size)
    v = x[src][np.lexsort((-x[src], row))]
    place = np.arange(len(src)) - np.repeat(start, size) + 1
    return np.maximum.reduceat(np.minimum(place, v), start)


def heaviest(src, start, dst, w, label):
    """The label of most weight around each target, the smallest of those that tie to nine digits."""
    row = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(src)]))
    o = np.lexsort((label[src], row))
    r, c = row[o], label[src][o]
    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
    votes = np.round(np.add.reduceat(w[o], new), 9)
    r, c = r[new], c[new]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    top = np.repeat(np.maximum.reduceat(votes, first), np.diff(np.r_[first, len(r)]))
    return np.minimum.reduceat(np.where(votes == top, c, np.iinfo(np.int64).max), first)
