"""Leiden and Louvain communities: moves, refinement and aggregation.

Nodes only ever join neighbours, so weak components are independent but for the total weight: each is one task's
work, with the whole graph's total, and the result does not depend on how many there are or how large they are.
A caller may ask for a contraction by label moves first (``limit``).
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from . import graph as G


class Weighted:
    """A symmetric graph in rows: neighbours and weights of each node, self weights apart."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, total: float | None = None):
        self.n = n
        own = src == dst
        self.loop = np.bincount(src[own], weights=w[own], minlength=n)
        a, b, c = np.r_[src[~own], dst[~own]], np.r_[dst[~own], src[~own]], np.r_[w[~own], w[~own]]
        key = a.astype(np.int64) * n + b
        u, inv = np.unique(key, return_inverse=True)
        self.w = np.bincount(inv, weights=c, minlength=len(u))
        self.to = u % n
        self.first = np.searchsorted(u // n, np.arange(n + 1))
        self.degree = np.add.reduceat(np.r_[self.w, 0.0], self.first[:-1]) * (np.diff(self.first) > 0) + 2 * self.loop if n else np.zeros(0)
        self.total = total or float(self.degree.sum()) or 1.0

    def around(self, i: int):
        return self.to[self.first[i] : self.first[i + 1]], self.w[self.first[i] : self.first[i + 1]]

    def contract(self, label: np.ndarray, k: int) -> Weighted:
        at = np.repeat(np.arange(self.n), np.diff(self.first))
        once = at < self.to
        src, dst = label[at[once]], label[self.to[once]]
        return Weighted(k, np.r_[src, label], np.r_[dst, label], np.r_[self.w[once], self.loop], self.total)

    def modularity(self, label: np.ndarray, gamma: float = 1.0) -> float:
        at = np.repeat(np.arange(self.n), np.diff(self.first))
        inside = self.w[label[at] == label[self.to]].sum() + 2 * self.loop.sum()
        return float(inside / self.total - gamma * (np.bincount(label, weights=self.degree) ** 2).sum() / self.total**2)


def numbered(label: np.ndarray) -> tuple[np.ndarray, int]:
    u, inv = np.unique(label, return_inverse=True)
    return inv, len(u)


def move(g: Weighted, label: np.ndarray, todo=None, gamma: float = 1.0) -> np.ndarray:
    """Local moves until no node of the queue gains; a node that moves puts its neighbours outside the new community back in the queue."""
    label = label.copy()
    mass = np.bincount(label, weights=g.degree, minlength=g.n).tolist()
    degree = g.degree.tolist()
    queue = deque(range(g.n) if todo is None else todo)
    waiting = np.zeros(g.n, bool)
    waiting[list(queue)] = True
    free = [c for c in range(g.n) if mass[c] == 0][::-1]
    lab = label.tolist()
    while queue:
        i = queue.popleft()
        waiting[i] = False
        to, w = g.around(i)
        near: dict[int, float] = {}
        for j, x in zip(to.tolist(), w.tolist()):
            near[lab[j]] = near.get(lab[j], 0.0) + x
        mine, k = lab[i], degree[i]
        mass[mine] -= k
        best, gain = mine, near.get(mine, 0.0) - gamma * k * mass[mine] / g.total
        for c, x in near.items():
            v = x - gamma * k * mass[c] / g.total
            if v > gain + 1e-12 or (abs(v - gain) <= 1e-12 and c < best and c != mine and best != mine):
                best, gain = c, v
        if gain < -1e-12 and free:  # alone is better than anywhere
            best = free.pop()
        mass[best] += k
        if best != mine:
            lab[i] = best
            for j in to.tolist():
                if lab[j] != best and not waiting[j]:
                    waiting[j] = True
                    queue.append(j)
    return np.array(lab, np.int64)


def refine(g: Weighted, label: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Inside each community: nodes join a well connected part of it, from singletons on, so every part is connected."""
    part = list(range(g.n))
    mass, size = g.degree.tolist(), [1] * g.n
    whole = np.bincount(label, weights=g.degree, minlength=g.n)
    out = [0.0] * g.n  # weight from a part to the rest of its community
    for i in range(g.n):
        to, w = g.around(i)
        out[i] = float(w[label[to] == label[i]].sum())
    for i in np.argsort(g.degree, kind="stable").tolist():
        if size[part[i]] != 1:
            continue
        k, c = g.degree[i], label[i]
        if out[i] < gamma * k * (whole[c] - k) / g.total - 1e-12:
            continue  # not well connected itself
        near: dict[int, float] = {}
        to, w = g.around(i)
        for j, x in zip(to.tolist(), w.tolist()):
            if label[j] == c:
                near[part[j]] = near.get(part[j], 0.0) + x
        best, gain = part[i], 0.0
        for p, x in near.items():
            if out[p] >= gamma * mass[p] * (whole[c] - mass[p]) / g.total - 1e-12:
                v = x - gamma * k * mass[p] / g.total
                if v > gain + 1e-12:
                    best, gain = p, v
        if best != part[i]:
            out[best] += out[i] - 2 * near[best]
            mass[best] += k
            size[best] += 1
            size[part[i]] = 0
            part[i] = best
    return np.array(part, np.int64)


def optimise(g: Weighted, start: np.ndarray | None = None, todo=None, refined: bool = True, levels: int = 12, gamma: float = 1.0) -> np.ndarray:
    """Labels from 0: Leiden, or Louvain without refinement. start and todo: an earlier partition and the nodes to look at again."""
    label, _ = numbered(start if start is not None else np.arange(g.n))
    of = np.arange(g.n)  # node of the contracted graph for each node
    level = g
    for step in range(levels):
        moved = move(level, label, todo if step == 0 else None, gamma)
        moved, k = numbered(moved)
        parts = refine(level, moved, gamma) if refined else moved
        parts, n = numbered(parts)
        if n == level.n:
            label = moved
            break
        upper = np.zeros(n, np.int64)
        upper[parts] = moved
        of, level, label = parts[of], level.contract(parts, n), upper
    return numbered(label[of])[0]


def communities(nodes: DataFrame, pairs: DataFrame, refined: bool = True, gamma: float = 1.0, limit: int | None = None, before: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """(id, community): Leiden (or Louvain) over pairs(src, dst, w), named by the smallest id inside.

    Incremental form: before(id, community) is kept but for the nodes of changed(id), new nodes, and whom their moves reach.
    """
    w = cut(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("w").cast("double").alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    ids = nodes.select("id").distinct()
    top = cut(ids.withColumn("top", F.col("id")))
    while limit is not None and w.count() > limit:
        label = G.communities(w.select(F.col("src").alias("id")).union(w.select("dst")).distinct(), w, 4)
        n = w.count()
        a, b = (label.select(F.col("id").alias(c), F.col("community").alias(f"{c}_top")) for c in ("src", "dst"))
        w = cut(w.join(a, "src").join(b, "dst").groupBy(F.least("src_top", "dst_top").alias("src"), F.greatest("src_top", "dst_top").alias("dst")).agg(F.sum("w").alias("w")))
        top = cut(top.join(label.select(F.col("id").alias("top"), "community"), "top", "left").select("id", F.coalesce("community", "top").alias("top")))
        if w.count() == n:
            break  # nothing merges any more
    whole = 2 * (w.agg(F.sum("w")).first()[0] or 0.0)
    group = cut(G.components(w.select(F.inline(F.array(F.struct(F.col("src").alias("id")), F.struct(F.col("dst").alias("id"))))), w)).select(F.col("id").alias("src"), "component")
    rows = w.select("src", "dst", "w", F.lit(0).cast("byte").alias("row"))
    if before is not None:
        joined = top.join(before.select("id", "community"), "id", "left")
        redo = changed.select("id").distinct().withColumn("redo", F.lit(True)) if changed is not None else ids.limit(0).withColumn("redo", F.lit(True))
        state = joined.join(redo, "id", "left").groupBy("top").agg(F.min("community").alias("community"), F.bool_or(F.coalesce("redo", F.col("community").isNull())).alias("redo"))
        rows = rows.unionByName(state.select(F.col("top").alias("src"), F.when(~F.col("redo"), F.col("community")).alias("dst"), F.lit(0.0).alias("w"), F.lit(1).cast("byte").alias("row")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        e, s = f[f["row"] == 0], f[f["row"] == 1]
        names = np.unique(np.r_[e["src"].to_numpy(str), e["dst"].to_numpy(str), s["src"].to_numpy(str)])
        at = lambda c: np.searchsorted(names, c.to_numpy(str))
        g = Weighted(len(names), at(e["src"]), at(e["dst"]), e["w"].to_numpy(), whole)
        start = todo = None
        if len(s):
            start = np.arange(len(names))
            kept = s[s["dst"].notna()]
            ends = np.unique(kept["dst"].to_numpy(str), return_inverse=True)[1] if len(kept) else np.empty(0, int)
            lead = {}
            for i, c in zip(at(kept["src"]).tolist(), ends.tolist()):
                start[i] = lead.setdefault(c, i)
            todo = np.unique(at(s[s["dst"].isna()]["src"])).tolist()
        label = optimise(g, start, todo, refined, gamma=gamma)
        return pd.DataFrame({"top": names, "label": [f"{names[0]}:{x}" for x in label.tolist()]})

    got = rows.join(group, "src").groupBy("component").applyInPandas(run, "top string, label string")
    joined = top.join(got, "top", "left").select("id", F.coalesce("label", F.concat(F.lit("alone:"), F.col("id"))).alias("label"))
    joined = cut(joined)
    name = joined.groupBy("label").agg(F.min("id").alias("community"))
    return joined.join(name, "label").select("id", "community")
