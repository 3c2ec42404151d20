"""Document operators against brute force on small and awkward inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quiltgraph.llm import decontaminate, licenses, lm, mixing, quality, simhash, suffixdedup
from quiltgraph.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).withColumn("size", F.lit("clash")).withColumn("fp", F.lit(0))


def sentences(n, seed, vocab=400):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(5, 60))) for _ in range(n)]


# SimHash


def plain_fingerprint(text):
    ws = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    sh = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) > 4 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_groups(spark):
    base = sentences(40, 1)
    texts = base + base[:10] + [t + " tail" for t in base] + [None, "", "  \n", "One", "É a B c", "x " * 20_000]
    rows = [(i * 3, t, "s") for i, t in enumerate(texts)] + [(6, base[2], "s")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {i: plain_fingerprint(t) for i, t, _ in rows}
    assert all(r.fp % 2**64 == fp[r.doc_id] for r in got)
    comp = {i: i for i in fp}
    for _ in range(50):
        for a in fp:
            comp[a] = min(comp[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 4)
    assert {r.doc_id: r.component_id for r in got} == comp
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_a_large_bucket_in_tiles(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 2**63, 50)})
    n = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "node long, fp long")
    want = list(range(len(fps)))
    for _ in range(20):
        want = [min(want[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
    table = simhash.pivot_table(n)
    assert all(list(r.dist) == [(r.fp % 2**64 ^ int(p)).bit_count() for p in simhash.pivots()] for r in table.collect())
    for tile in (4096, 16):
        edges = simhash.links(table, tile=tile)
        got = {r.node: r.label for r in simhash.components(edges).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want
    c = simhash.pair_counts(table).first()
    assert c.first_pivot > c.all_pivots >= c.verified > 0


def test_block_tables_miss_no_pair():
    rng = np.random.default_rng(3)
    for n_nodes, tables, bits in ((1000, 15, 20), (10**8, 35, 26), (10**10, 70, 30)):
        got = simhash.block_tables(4, n_nodes)
        assert len(got) == tables and min(sum(n for _, n in t) for t in got) >= bits
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(all(diff >> s & ((1 << n) - 1) == 0 for s, n in t) for t in got)


# Mixing


def test_targets_by_water_filling(spark):
    s = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), ("d", 50), (None, 5), ("z", 0)], "source string, source_size long")
    got = {r.source: r for r in mixing.source_targets(s).collect()}
    weights = dict(zip(["a", "b", "c", "d", "z", None], [5, 2, 1, 5, 2, 1]))
    sizes = {r.source: r.source_size for r in s.collect()}
    left, capped, t = 1.5 * sum(sizes.values()), set(), {}
    while True:
        w = sum(weights[k] for k in sizes if k not in capped)
        t = {k: 2 * sizes[k] if k in capped else (left - 2 * sum(sizes[c] for c in capped)) * weights[k] / w for k in sizes}
        more = {k for k in sizes if k not in capped and t[k] > 2 * sizes[k] + 1e-9}
        if not more:
            break
        capped |= more
    for k in sizes:
        assert got[k].weight == weights[k] and abs(got[k].target - t[k]) < 1e-6


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 80)), "abc"[min(2, i % 5)] if i % 7 else None) for i in range(400)] + [(1, "dup dup", "a"), (1, "dup dup", "a"), (500, None, "q")]
    d = docs(spark, rows)
    a, b = [sorted(mixing.mix(d.repartition(n)).collect(), key=str) for n in (1, 7)]
    assert a == b and len(a) == len(rows)
    f = pd.DataFrame([r.asDict() for r in a])
    assert (f.copies <= 2).all() and (f.copies >= 0).all()
    f["taken"] = f["copies"] * f["size"]
    for _, g in f.groupby(f.source.fillna("-")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * g["size"].max() + 1
    assert mixing.mix(docs(spark, [])).count() == 0


# Decontamination


def plain_hits(text, items):
    ws = words(text)
    hit, names = set(), set()
    for i, t in items:
        for w in decontaminate.windows_of(words(t)):
            for x in range(len(ws) - len(w) + 1):
                if ws[x : x + len(w)] == w:
                    hit |= set(range(x, x + len(w)))
                    names.add(str(i))
    return len(ws), len(hit), sorted(names)


@pytest.mark.parametrize("block_words,shard", [(1 << 20, 1 << 19), (20, 50)])
def test_contamination(spark, block_words, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_TOKENS", shard)
    texts = sentences(40, 3, vocab=30)
    items = [(10, " ".join(texts[0].split()[:12])), (9, texts[1].upper()), (9, "w1, w2!"), (8, None), (7, "..."), (6, "w3"), (None, texts[2][:80])]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100, None, "s"), (0, texts[5] + "\n" + texts[0], "s"), (101, "é " + texts[1], "s")]
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.digests(decontaminate.contamination(docs(spark, rows), tests, block_words=block_words)).collect()
    want = sorted((i, *(lambda r: (r[0], r[1], len(r[2]), hashlib.sha256(",".join(r[2]).encode()).hexdigest()))(plain_hits(t, items))) for i, t, _ in rows)
    assert sorted((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    assert decontaminate.contamination(docs(spark, rows), tests.where("false")).where(F.size("matches") > 0).count() == 0
    assert decontaminate.contamination(docs(spark, []), tests).count() == 0


def test_proximity(spark):
    d = docs(spark, [(1, "a x b y c", "s"), (2, "c b a", "s"), (3, "a b", "s"), (4, "a . . p q r s b c", "s")])
    t = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    r = {x.id: [m.kind for m in x.matches] for x in decontaminate.contamination(d, t, slack=2).collect()}
    assert r[1] == ["proximity"] and r[2] == ["proximity"] and r[3] == [] and r[4] == []


# Licenses


def test_licenses_against_all_pairs(spark):
    m = licenses.Matcher(licenses.TEMPLATES, licenses.PHRASES, {b"license": 5, b"the": 50, b"under": 9}, 0.8)
    rng = random.Random(4)
    pool = [w.decode() for w in licenses.vocabulary()] + ["foo", "bar"]
    for _ in range(300):
        line = " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
        if rng.random() < 0.5:
            t = words(rng.choice(licenses.TEMPLATES)[1])
            line += " " + " ".join(w.decode() for w in t if rng.random() < 0.9)
        ws = words(line)
        want = {(k, len(s & set(ws)) / len(s)) for k, (_, t) in enumerate(licenses.TEMPLATES) for s in [set(words(t))] if len(s & set(ws)) >= 0.8 * len(s) - 1e-9}
        n, _, found = licenses.scan_text(line, m)
        if len(ws) <= licenses.RUN:
            assert n == len(ws) and {(k, c) for k, _, _, c in found} == want


def test_license_blocks_across_lines_against_all_pairs():
    """Texts of many lines: every line and every run, against every template."""
    m = licenses.Matcher(licenses.TEMPLATES, licenses.PHRASES, {b"software": 9}, 0.8)
    rng = random.Random(14)
    for trial in range(60):
        ws = []
        for _ in range(rng.randrange(1, 5)):
            ws += [f"x{rng.randrange(50)}" for _ in range(rng.randrange(0, 60))]
            t = [w.decode() for w in words(rng.choice(licenses.TEMPLATES)[1])]
            ws += [w for w in t if rng.random() < rng.choice((1, 0.95, 0.8))]
        lines, at = [], 0
        while at < len(ws):
            k = rng.choice((3, 8, 30, 200))
            lines.append(ws[at : at + k])
            at += k
        blocks = [(x[a : a + 64], None) for x in lines for a in range(0, max(1, len(x) - 32), 32)]
        for run in {max(16, 1 << (2 * len(words(t)) - 1).bit_length()) for _, t in licenses.TEMPLATES}:
            blocks += [(ws[a : a + run], run) for a in range(0, max(1, len(ws) - run // 2), run // 2)]
        best = {}
        for x, run in blocks:
            have = {w.encode() for w in x}
            for k, (_, t) in enumerate(licenses.TEMPLATES):
                s = set(words(t))
                if run in (None, max(16, 1 << (2 * len(words(t)) - 1).bit_length())) and len(s & have) >= 0.8 * len(s) - 1e-9:
                    best[k] = max(best.get(k, 0), len(s & have) / len(s))
        got = {}
        for k, _, _, c in licenses.scan_text("\n".join(" ".join(x) for x in lines), m)[2]:
            got[k] = max(got.get(k, 0), c)
        assert got == best


def test_license_digests(spark, tmp_path):
    rows = [(1, "x\nReleased under the MIT License.\ny", "s"), (2, "CC BY-NC all rights reserved cc by", "s"), (3, None, "s"), (4, "General\nPublic license", "s"), (5, "plain words " * 9000 + "Licensed under the Apache License, Version 2.0.", "s")]
    path = str(tmp_path / "t")
    docs(spark, rows).write.parquet(path + "/documents.parquet")
    r = {x.doc_id: x for x in licenses.op8_license_scans(spark, path).collect()}
    assert r[1].labels == "mit" and r[1].score == 1.0 and r[1].n_base == 0 and r[1].first_word is None
    assert (r[2].n_base, r[2].first_word, r[2].last_word, r[2].base_labels) == (3, 0, 6, "cc-by,reserved")
    assert r[3].n_words == 0 and r[3].labels == "" and r[3].score == 0.0
    assert (r[4].base_labels, r[4].n_base) == ("gpl", 1)
    assert r[5].labels == "apache-2.0"


# Quality


def test_quality_against_python(spark):
    texts = [*sentences(20, 6), None, "", "a b c d e f g h " * 5, "x\ny\nx\n \nx", "#a *b | <c>", "a b c d e f g h q a b c d e f g h", "é\tÉ\x0bz \x0c", "w " * 20_000, "one two three four five six seven eight"]
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])), "v1").collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        ws = b.split()
        g = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        rep = {p for k in range(len(ws) - 7) if g[tuple(ws[k : k + 8])] > 1 for p in range(k, k + 8)}
        ls = [x for x in b.split(b"\n") if x.split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(ws), sum(len(w.decode()) for w in ws), len(rep), len(ls) - len(set(ls))), t
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert bool(r.fail_bits & 1) == (len(ws) < 20) and r.kept == (r.fail_bits == 0)
    assert quality.ledger(docs(spark, [])).count() == 0


def test_ablations(spark):
    led = spark.createDataFrame([(0,), (1,), (3,), (2,), (2,)], "fail_bits long")
    r = {x.rule: (x.n_fail, x.n_only, x.n_rejected) for x in quality.ablations(led, "base").collect()}
    assert r == {"too_few_words": (2, 1, 4), "repeated_windows": (3, 2, 4)}


# Suffix arrays


def plain_removal(rows, length):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    chunk = lambda n: "".join(rng.choice("abc é\n") for _ in range(n))
    shared = [chunk(rng.randrange(80, 400)) for _ in range(6)]
    return [(i, "".join(rng.choice(shared) if rng.random() < 0.4 else chunk(rng.randrange(1, 200)) for _ in range(rng.randrange(0, 8)))) for i in range(40)]


@pytest.mark.parametrize("seed,piece", [(1, 1 << 20), (2, 1 << 20), (3, 700)])
def test_suffix_dedup(spark, seed, piece, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE", piece)
    rows = corpus(seed) + [(50, "z" * 1000), (51, None), (52, "z" * 99), (53, "z" * 100), (54, "ab" * 400)]
    got = suffixdedup.dedup(docs(spark, [(i, t, "s") for i, t in rows]), keep=["lang"]).collect()
    assert sorted((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == plain_removal(sorted(rows), 100)
    assert {r.lang for r in got} == {"en"}


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    got = suffixdedup.dedup(docs(spark, [(1, t, "s"), (1, t, "s"), (None, t, "s"), (2, "x", "s")])).collect()
    assert sorted((str(r.id), r.n_removed) for r in got) == [("1", 0), ("1", 300), ("2", 0), ("None", 300)]
    assert suffixdedup.dedup(docs(spark, [])).count() == 0


def test_stored_family_equals_one_batch(spark, tmp_path):
    rows = corpus(7)
    f = suffixdedup.IndexFamily(spark, str(tmp_path / "family"), n_buckets=5)
    got = set()
    for k in range(5):
        part = docs(spark, [(i, t, "s") for i, t in rows[k * 8 : k * 8 + 8]])
        for r in f.add(part).collect():
            got |= {(r.doc, x) for x in range(r.lo, r.hi)}
        assert all(a >= 2 * b for (a, _), (b, _) in zip(f.levels, f.levels[1:]))  # sizes are geometric
    want = set()
    for r in suffixdedup.dedup(docs(spark, [(i, t, "s") for i, t in rows])).collect():
        want |= {(r.id, x) for s in r.spans for x in range(s.lo, s.hi)}
    assert got == want


def test_family_of_levels():
    rng = np.random.default_rng(2)
    runs = []
    for _ in range(11):
        r = np.zeros(rng.integers(1, 50), suffixdedup.SEG)
        r["kh"], r["seg"], r["doc"], r["start"], r["n"] = rng.integers(0, 40, len(r)), rng.integers(0, 3, len(r)), rng.integers(0, 99, len(r)), rng.integers(0, 999, len(r)), 1
        runs.append(suffixdedup.settle(r)[0])
        assert (suffixdedup.unpack(suffixdedup.pack(runs[-1])) == runs[-1]).all()
    f = suffixdedup.Family()
    for r in runs:
        f.add(r)
        assert len(f.levels) <= 4
    kept, gone = f.close()
    want, _ = suffixdedup.settle(np.concatenate(runs))
    assert (kept == want).all() and len(kept) + len(gone) == sum(map(len, runs))


# Language model


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in lm.initial(rng.normal(size=lm.CLASSES).astype(np.float32)).items()}
    w = rng.integers(0, lm.CLASSES, (3, lm.CONTEXT + 1))
    on = rng.random((3, lm.CONTEXT)) < 0.8
    loss, g = lm.gradients(p, w[:, :-1], w[:, 1:], on)
    for k in lm.SHAPES:
        at = (int(w[0, 1]), 2) if k == "E" else tuple(1 for _ in lm.SHAPES[k])
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-5
        assert abs((lm.gradients(q, w[:, :-1], w[:, 1:], on)[0] - loss) / 1e-5 - g[k][at]) < 1e-5


def test_shifts_only_where_exponents_need_them(monkeypatch):
    """Same loss and gradients with and without the shift; wide parameters still get it."""
    rng = np.random.default_rng(4)
    w = rng.integers(0, lm.CLASSES, (5, lm.CONTEXT + 1))
    on = rng.random((5, lm.CONTEXT)) < 0.8
    made = []
    widest = lm.widest
    monkeypatch.setattr(lm, "widest", lambda m: made.append(widest(m)) or made[-1])
    for wide in (1, 40):
        p = {k: v.astype(np.float64) * wide for k, v in lm.initial(rng.normal(size=lm.CLASSES).astype(np.float32)).items()}
        made.clear()
        loss, g = lm.gradients(p, w[:, :-1], w[:, 1:], on)
        assert (max(made) >= lm.SHIFT) == (wide > 1)
        with monkeypatch.context() as m:
            m.setattr(lm, "SHIFT", 0)
            loss0, g0 = lm.gradients(p, w[:, :-1], w[:, 1:], on)
        assert np.isclose(loss, loss0, rtol=1e-12) and all(np.allclose(g[k], g0[k], rtol=1e-9, atol=1e-12) for k in lm.SHAPES)
        low = lm.gradients({k: v.astype(np.float32) for k, v in p.items()}, w[:, :-1], w[:, 1:], on)
        assert np.isfinite(low[0]) and all(np.isfinite(x).all() for x in low[1].values())


def test_each_id_is_scored_once_and_nothing_looks_ahead():
    rng = np.random.default_rng(2)
    p = lm.initial(rng.normal(size=lm.CLASSES).astype(np.float32))
    s = lm.Scorer(p)
    seqs = [rng.integers(0, lm.CLASSES, n).astype(np.uint8) for n in (2, 9, 32, 33, 34, 57, 58, 200)]
    stride = lm.CONTEXT - lm.OVERLAP
    want = []
    for x in seqs:
        total = 0.0
        for i in range(1, len(x)):  # x[i] from the ids in its window
            k = 0 if i <= lm.CONTEXT else -(-(i - lm.CONTEXT) // stride)
            before = x[k * stride : i]
            pad = np.zeros(lm.CONTEXT, np.uint8)
            pad[: len(before)] = before
            z = (lm.attend(p, pad[None])[-1][0, len(before) - 1] @ p["U"] + p["b"]).astype(np.float64)
            total += z[x[i]] - np.log(np.exp(z).sum())
        want.append(total)
    assert np.allclose(s.texts(np.concatenate(seqs), np.array([len(x) for x in seqs])), want, atol=1e-3)


def test_words_are_encoded_alike_in_bulk_and_one_by_one():
    enc = lm.load_encoder(lm.TOKENIZER)
    counts = np.arange(lm.END_ID + 1)
    spaced = np.array([int(i < lm.END_ID and enc.decode_single_token_bytes(i)[:1] == b" ") for i in range(lm.END_ID + 1)])
    v = lm.Vocabulary(counts, spaced)
    for ws in ([b"the", b"x1.5,", b"'s", "é".encode(), b"a#b"], [b"a", "b\u00a0".encode(), "\u00a0c\u3000".encode(), b"d"]):
        w = lm.Words(v.cls, v.inside, v.spaced, lm.TOKENIZER, {b"a": -1.0})
        n = w.lookup(ws + ws)
        want = [v.cls[lm.encode_word(enc, x)] for x in ws + ws]
        assert w.sequences(n).tolist() == np.concatenate(want).tolist()
        assert np.allclose(w.inside[n], [v.inside[lm.encode_word(enc, x)].sum() for x in ws + ws])


def test_probabilities_sum_to_one():
    counts = np.random.default_rng(3).integers(0, 50, lm.END_ID + 1)
    v = lm.Vocabulary(counts, np.arange(lm.END_ID + 1) % 2)
    mass = np.bincount(v.cls, weights=10**v.inside, minlength=lm.CLASSES)
    assert np.allclose(mass[np.bincount(v.cls, minlength=lm.CLASSES) > 0], 1)


def test_lm_scores(spark):
    texts = sentences(60, 8, vocab=50)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100, None, "s"), (101, "zzz unseen zzz", "s"), (None, "w1 w2", "s"), (5, texts[5], "s")]
    got = lm.score(docs(spark, rows), frequent=10).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    tok = lambda t: (t or "").encode().lower().split()
    c, n = Counter(), 0
    for i, t, _ in rows:
        if not held(i):
            c.update(tok(t))
            n += 1
    total, v = sum(c.values()) + n, len(c) + 1
    for r in got:
        t = next(t for i, t, _ in rows if i == r.id)
        ws = tok(t)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.id), len(ws) + 1, total)
        assert r.n_known == sum(c[w] > 0 for w in ws) + 1
        assert abs(r.base_score - sum(np.log10((k + 1) / (total + v + 1)) for k in [*(c[w] for w in ws), n])) < 1e-9
        assert r.score < 0
    trained = sum(r.score for r in got)
    untrained = sum(r.score for r in lm.score(docs(spark, rows), frequent=10, rounds=0).collect())
    assert trained > untrained  # likelier text, held-out documents included
    ho = lambda rs: sum(r.score for r in rs if r.held_out)
    assert ho(got) < 0
    assert lm.score(docs(spark, [])).count() == 0


def test_training_covers_every_position(spark):
    rng = np.random.default_rng(2)
    seqs = [rng.integers(1, 99, n).astype(np.uint8).tobytes() for n in (2, 3, 32, 33, 34, 65, 66, 500)]
    wins, lengths = lm.consecutive(seqs)
    assert b"".join(w[1:n].tobytes() for w, n in zip(wins, lengths)) == b"".join(s[1:] for s in seqs)
    # texts without ASCII spaces and long ones too: all ids, between two ends
    enc = lm.load_encoder(lm.TOKENIZER)
    v = lm.Vocabulary(np.arange(lm.END_ID + 1), np.array([int(i < lm.END_ID and enc.decode_single_token_bytes(i)[:1] == b" ") for i in range(lm.END_ID + 1)]))
    texts = ["\u6f22\u5b57" * 3000, "word " * 9000, "", None]
    got = {}
    for r in lm.encoded(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), v, lm.TOKENIZER).collect():
        assert 2 <= len(r.seq) <= lm.CHUNK + 1
        got.setdefault(r.no, set()).add(bytes(r.seq))
    end = v.cls[lm.END_ID : lm.END_ID + 1].tobytes()
    for t in texts:
        full = end + b"".join(v.cls[lm.encode_word(enc, w)].tobytes() for w in lm.tokens(t)) + end
        for no, at in enumerate(range(0, len(full) - 1, lm.CHUNK)):
            assert full[at : at + lm.CHUNK + 1] in got[no]


def test_partitions_do_not_change_scores(spark):
    rows = [(i, t, "s") for i, t in enumerate(sentences(80, 21, vocab=60))] + [(i, "same text again", "s") for i in range(200, 240)]
    d = docs(spark, rows)
    one, two = ({r.id: r.score for r in lm.score(x, shard=500).collect()} for x in (d.repartition(1), d.repartition(7)))
    # but for the order of float sums inside a batch of windows
    assert one.keys() == two.keys() and len(one) == len(rows) and np.allclose([one[i] for i in one], [two[i] for i in one], rtol=1e-5, atol=1e-5)


def test_most_counted(spark):
    n = [1] * 50 + [2] * 20 + [5, 9, 100, 1000]
    c = spark.createDataFrame([(f"w{i}".encode(), k) for i, k in enumerate(n)], "word binary, n long")
    for most in (0, 3, 4, 24, 30, 74, 1000):
        got = sorted(r.n for r in lm.most_counted(c, most).collect())
        assert len(got) <= most and got == sorted(n)[len(n) - len(got) :]
        assert len(got) == {0: 0, 3: 3, 4: 4, 24: 24, 30: 24, 74: 74, 1000: 74}[most]


def test_wrapped_and_long_licenses():
    long = " ".join(f"clause{i}" for i in range(90))
    templates = [*licenses.TEMPLATES, ("long", long)]
    m = licenses.Matcher(templates, licenses.PHRASES, {}, 0.8)
    labels = lambda t: {templates[k][0] for k, *_ in licenses.scan_text(t, m)[2]}
    pad = " ".join(f"x{i}" for i in range(150))
    for label, t in templates:
        ws = t.split()
        for before in (0, 1, 17, 40, 80, 131):
            head = " ".join(pad.split()[:before])
            for width in (1, 2, 4, 7, len(ws)):
                wrapped = "\n".join(" ".join(ws[i : i + width]) for i in range(0, len(ws), width))
                assert label in labels(f"{head}\n{wrapped}\n{pad}"), (label, before, width)
            assert label in labels(f"{head} {t} {pad}"), (label, before)
    assert labels(pad + "\n" + pad) == set()
