"""The corpus pipeline against its stages worked out in plain Python."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from quiltgraph.llm import decontaminate, nearcopies, simhash
from quiltgraph.llm.common import words

from .test_corpus import DOCS, plain_removal


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    clean = [text(rng.randrange(40, 120)) for _ in range(30)]
    passage = text(60)
    bench = text(15)
    rows = list(enumerate(clean))
    rows += [(100 + i, t) for i, t in enumerate(clean[:5])]  # exact copies
    rows += [(200, "too short"), (201, "a b c d e f g h " * 20), (202, None)]
    rows += [(300, text(50) + "\n" + passage), (301, passage + "\n" + text(50))]
    rows += [(400, text(30) + " " + bench + " " + text(30))]
    d = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], DOCS)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # by hand: rules drop 200 to 202, copies go, shared passages stay once, 400 is contaminated
    kept = {i: t for i, t in rows if not 100 <= i < 203}
    fps = {i: simhash.fingerprint(t) for i, t in kept.items()}
    assert all((a ^ b).bit_count() > 4 for x, a in fps.items() for y, b in fps.items() if x < y)
    after = {i: k.decode() for i, _, _, _, k in plain_removal(sorted(kept.items()), 100)}
    assert passage not in after[301]
    after.pop(400)
    # every kept document takes part: one source, or shares that leave none without a copy
    got = {r.doc_id: r.text for r in out}
    assert got.items() <= after.items()
    stages = d
    for _, f in corpus_pipeline.STAGES[:-1]:
        stages = f(spark, stages, str(tmp_path))
    assert {r.doc_id: r.text for r in stages.collect()} == after
    sizes = {}
    for i, t in after.items():
        sizes[f"s{i % 3}"] = sizes.get(f"s{i % 3}", 0) + len(t.split())
    for s, n in sizes.items():
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.size for r in mine) - mine[0].target) <= 2 * max(len(t.split()) for t in after.values()) and mine[0].source_size == n
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)
    for (name, f), cols in zip(corpus_pipeline.STAGES[:-1], [corpus_pipeline.COLUMNS] * 4):
        assert f(spark, d, str(tmp_path)).columns == cols, name


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], DOCS)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0
    assert decontaminate.windows_of(words("a b")) == [[b"a", b"b"]]


def test_near_copies_by_jaccard(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(5000)}"
    rows, n = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.choice((60, 150, 400)))]
        rows.append((n, " ".join(base)))
        near = list(base)
        # each changed word changes up to five shingles on both sides
        for at in rng.sample(range(5, len(base) - 5), rng.randrange(1, max(3, len(base) // 25))):
            near[at] = word()
        rows.append((n + 1, " ".join(near)))
        n += 2
    one = [word() for _ in range(150)]
    for _ in range(40):  # a large group, in tiles
        near = list(one)
        near[rng.randrange(150)] = word()
        rows.append((n, " ".join(near)))
        n += 1
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    comp = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum((simhash.fingerprint(rows[a][1]) ^ simhash.fingerprint(rows[b][1])).bit_count() > 4 for a, b in pairs) > 20
    for _ in range(50):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect()} == set(comp.values())
    for tile in (16, 1024):
        named = {r.h: r.component for r in nearcopies.groups(d, tile=tile).collect()}
        mine = {i: named.get(hashlib.md5(t.encode()).hexdigest(), -1 - i) for i, t in rows}
        assert all((mine[a] == mine[b]) == (comp[a] == comp[b]) for a in comp for b in comp)


def test_cut_characters_go_and_own_marks_stay(spark, tmp_path):
    both = "\u00e9" * 120
    text = "keep \ufffd and \ue000\ufffd " + both[:60] + "\u00eb" + both[:61]
    d = spark.createDataFrame([(1, "x" + both, "en", "s", 121), (2, text, "en", "s", len(text)), (3, "\ufffd \ue000\ue001", "en", "s", 3)], DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, d, str(tmp_path)).collect()}
    removed = {i: k for i, _, _, _, k in plain_removal([(r[0], r[1]) for r in d.select("doc_id", "text").collect()], 100)}
    assert got[3] == "\ufffd \ue000\ue001" and got[2].startswith("keep \ufffd and \ue000\ufffd ")
    assert got == {i: k.decode("utf-8", "ignore") for i, k in removed.items()}


def test_near_copies_come_by_fingerprints_and_pivots(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"q{rng.randrange(9000)}"
    texts = []
    for _ in range(150):
        base = [word() for _ in range(rng.choice((30, 90, 300)))]
        near = list(base)
        for at in rng.sample(range(5, len(base) - 5), max(1, len(base) // 50)):
            near[at] = word()
        texts += [" ".join(base), " ".join(near)]
    sets = [nearcopies.shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if nearcopies.jaccard(sets[a], sets[b]) >= 0.8]
    assert len(pairs) > 80
    x = np.random.default_rng(1).integers(0, 2**64, (301, 3), dtype=np.uint64)
    for n in (1, 2, 3, 4, 7, 300, 301):
        plain = np.unpackbits(x[:n].view(np.uint8), axis=1, bitorder="little").sum(0)
        assert (nearcopies.set_bits(x[:n]) == plain).all()
    by = nearcopies.factors(19)
    fps = np.array([nearcopies.fingerprint(h, by) for h in sets])
    differ = lambda a, b: int(np.bitwise_count(fps[a] ^ fps[b]).sum())
    assert all(differ(a, b) <= nearcopies.far(19) for a, b in pairs)
    assert all(differ(a, a - 2) > nearcopies.far(19) for a in range(2, len(sets)))
    dist = nearcopies.pivot_distances(fps).astype(int)
    assert all(((dist[a] - dist[b]) ** 2).sum() <= nearcopies.PIVOT_FAR for a, b in pairs)
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    c = nearcopies.pair_counts(d).first()
    assert c.met > 2 * c.pivots > 2 * c.verified > 0
    stored = nearcopies.fingerprints(d, len(texts))
    node = {r.h: r.node for r in stored.collect()}
    node = [node[hashlib.md5(t.encode()).hexdigest()] for t in texts]
    for tile in (4, 1024):
        held = {}
        for r in nearcopies.candidate_sets(stored, len(texts), tile).collect():
            held.setdefault(r.node, set()).add(r.key)
        assert all(held[node[a]] & held[node[b]] for a, b in pairs)
    # the stage takes its rows from them
    asked, made = [], nearcopies.fingerprints
    monkeypatch.setattr(nearcopies, "fingerprints", lambda *a: asked.append(1) or made(*a))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect()}
    assert asked and kept == set(range(len(texts))) - {a for a, _ in pairs}


def test_family_without_a_hub(spark):
    """A chain: each text is near the next one only, so no member is near all others."""
    rng = random.Random(8)
    now = [f"c{rng.randrange(9000)}" for _ in range(200)]
    texts = [" ".join(now)]
    for step in range(30):
        now = list(now)
        now[(step * 37) % 190 + 3] = f"n{step}"
        now[(step * 53) % 190 + 3] = f"m{step}"
        texts.append(" ".join(now))
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    sets = [nearcopies.shingles(t) for t in texts]
    assert nearcopies.jaccard(sets[0], sets[-1]) < 0.5 and all(nearcopies.jaccard(a, b) >= 0.8 for a, b in zip(sets, sets[1:]))
    for tile in (4, 1024):
        got = nearcopies.groups(d, tile=tile).collect()
        assert len(got) == len(texts) and len({r.component for r in got}) == 1


def test_only_large_sets_are_multiplied(spark):
    """Rows that Spark's explode makes, as its own counts say: none for keys of half a tile or less."""
    small = [(key, comp, 100 * key + node) for key in range(50) for node in range(8) for comp in [100 * key + (node > 4)]]
    large = [(99, 9900 + (node > 30), 9900 + node) for node in range(40)]

    def multiplied(rows, out):
        got = nearcopies.dealt(spark.createDataFrame(rows, "key long, comp long, node long"), 16).collect()
        out.extend((r.key, r.part, r.node, r.comp) for r in got)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store = spark._jsparkSession.sharedState().statusStore()
        ran = store.executionsList()
        last = ran.apply(ran.size() - 1).executionId()
        values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
        found = [(n.name(), n.metrics()) for n in (nodes.apply(i) for i in range(nodes.size()))]
        made = [values.get(m.apply(0).accumulatorId()) for name, m in found if name == "Generate"]
        return sum(int(v.get().replace(",", "")) for v in made if v.isDefined())

    one, both = [], []
    assert multiplied(small, one) == 0 and sorted(one) == sorted((k, 0, n, c) for k, c, n in small)
    assert multiplied(small + large, both) == len(both) - len(small) > len(large)
    tiles = {}
    for k, p, n, c in both:
        tiles.setdefault((k, p), set()).add(n)
    assert all(any({a, b} <= t for t in tiles.values()) for k, x, a in large for _, y, b in large if x != y)
    # a key of one comp has nothing to pair
    assert multiplied([(1, 7, 7), (1, 7, 8)], []) == 0


def test_null_and_repeated_ids_keep_their_rows(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"u{rng.randrange(4000)}" for _ in range(n))
    bench = text(15)
    t = [text(80) for _ in range(8)]
    bad = text(30) + " " + bench + " " + text(30)
    rows = [(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (None, t[4]), (9, t[4]), (8, t[5]), (8, t[5]), (None, bad), (7, bad + " " + t[6]), (None, t[7]), (None, t[7])]
    d = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], DOCS)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = lambda rs: sorted(((r.doc_id, r.text) for r in rs), key=str)
    near = corpus_pipeline.near_dedup(spark, d, str(tmp_path)).collect()
    once = [(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (9, t[4]), (8, t[5]), (None, bad), (7, bad + " " + t[6]), (None, t[7])]
    assert at(near) == sorted(once, key=str)
    clean = corpus_pipeline.decontamination(spark, d, str(tmp_path)).collect()
    assert at(clean) == sorted([r for r in rows if bench not in r[1]], key=str)
    mixed = corpus_pipeline.mixture(spark, d, str(tmp_path)).collect()
    # one source: target 1.5 times its size, so a row is there once or twice, each of two equal rows too
    per = lambda x: sum(r.text == x for r in mixed)
    assert all(1 <= per(x) <= 2 for x in (t[0], t[1], t[2], t[3], bad)) and all(2 <= per(x) <= 4 for x in (t[4], t[5], t[7]))


def test_chains_through_null_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(5, "a"), (None, "b"), (6, "c")], "doc_id long, text string")
    fps = {"a": 0, "b": 0b1111, "c": 0b11111111}
    made, simhash.fingerprints = simhash.fingerprints, lambda d, *_: d.select(F.col("doc_id").alias("id"), F.create_map(*[F.lit(x) for kv in fps.items() for x in kv])[F.col("text")].cast("long").alias("fp"))
    try:
        got = simhash.near_duplicates(docs).collect()
    finally:
        simhash.fingerprints = made
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (None, 5), (6, 5)}
