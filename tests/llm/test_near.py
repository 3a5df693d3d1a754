"""Near-duplicate texts and vectors, and vector search, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import ann, common, embed_dedup, near_dup


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for size, copies_ in [(1, 2), (2, 3), (3, 2), (5, 30), (6, 30), (12, 20), (40, 20), (150, 9), (120, 60)]:
        base = [rng.choice(words) for _ in range(size)]
        for c in range(copies_):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 15))):
                text[rng.randrange(size)] = rng.choice(words)
            rows.append((len(rows), " ".join(text) if c % 3 else "  ".join(text).upper()))
    return rows + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "É é"), (5004, "é É"), (None, rows[0][1]), rows[5]]


@pytest.mark.parametrize("k, paired", [(2, 16), (2, 3), (5, 16)])
def test_near_texts_equal_brute_force(table, monkeypatch, k, paired):
    monkeypatch.setattr(near_dup, "PAIRED", paired)
    rows = copies()
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components(sets, links)
    out = near_dup.near_duplicates(table(rows, "doc_id long, text string"), k, 80).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for n, shared in ((400, 360), (30, 27), (2000, 1000)):
        x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        rows = near_dup.registers([np.sort(x[:n]), np.sort(x[n - shared:])])
        got = near_dup.estimate(rows[:1], rows[1:], np.array([n]), np.array([n]))[0]
        assert abs(got - shared / (2 * n - shared)) < 0.15


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200)]
    out = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(30):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (base + rng.standard_normal(16) * rng.choice([0.02, 0.15])).tolist(), group % 3))
    base = rng.standard_normal(16)
    rows += [(1000 + i, (base + rng.standard_normal(16) * 0.01).tolist(), 1) for i in range(80)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, rows[0][1], None), (2005, [], 0), (2006, [1e300] * 16, 0), (None, rows[0][1], 0), rows[3]]
    return rows, odd


def test_near_vectors_equal_brute_force(table, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    rows, odd = vectors()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    root = components(unit, links)
    degree = {i: sum(i in pair for pair in links) for i in unit}
    out = embed_dedup.near_duplicates(table(rows + odd, "vec_id long, embedding array<double>, label int"), 0.93).collect()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        if r.vec_id in unit:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept


def test_vectors_at_the_limit_share_a_table():
    from terrace.llm import embed_dedup

    # sign bits of two vectors at cosine c differ with probability acos(c) / pi
    assert (1 - (1 - np.arccos(0.93) / np.pi) ** embed_dedup.BITS) ** embed_dedup.TABLES <= 2e-4
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 30_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    missed = int((embed_dedup.table_codes(a) != embed_dedup.table_codes(b)).all(axis=1).sum())
    assert missed <= 15  # 2e-4 of 30,000 are 6


def test_radius_search_finds_every_code():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (400, ann.CODE_BITS // 8), dtype=np.uint8)
    codes[200:] = codes[:200] ^ (rng.random((200, ann.CODE_BITS // 8)) < 0.3)
    index = ann.MultiIndex(codes)
    for radius in (0, 7, 31, 32, 60, 111, 128, 200, 256):
        apart = np.unpackbits(codes ^ codes[7], axis=1).sum(axis=1)
        assert index.within(codes[7], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_search_recall_and_order(table):
    rows, odd = vectors(4)
    rows = [(i, (np.array(v) * (1 + i % 5)).tolist(), k) for i, v, k in rows]
    ids = np.array([i for i, _, _ in rows])
    x = np.array([v for _, v, _ in rows])
    odd = [r for r in odd if r[0] != 2004 and r[0] != 2006 and r[0] is not None and r[0] >= 2000]
    out = ann.search(table(rows + odd + rows[:1], "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0, 20, 0.3).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [i for i in sorted(ids) if i % 20 == 0]
    shares = []
    for q, found in got.items():
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        shares.append(len(set(best) & {i for i, _ in found}) / 20)
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20
    assert np.mean(shares) >= 0.9


def test_more_wanted_texts_than_the_list_holds_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k l"), (3, "x y z")], "doc_id LONG, text STRING")
    monkeypatch.setattr(near_dup, "LISTED_IDS", 0)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 2, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
