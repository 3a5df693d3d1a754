"""Vector codes against integer k-means by hand."""

import hashlib
import math
import random

import numpy as np
import pytest

from terrace.llm import part_codes

SCHEMA = "vec_id long, label long, embedding array<float>"


def brute(rows, positions, entries, rounds):
    kept = [(v, label, [math.floor(4096 * float(np.float32(x))) for x in e]) for v, label, e in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    axes = len(order[0][2]) // positions
    kept = [r for r in kept if len(r[2]) == len(order[0][2])]

    def cut(v, p):
        return v[p * axes:(p + 1) * axes]

    def closest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    books = [[cut(r[2], p) for r in order if len(r[2]) == len(order[0][2])][:entries] for p in range(positions)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for r in kept:
                groups.setdefault(closest(cut(r[2], p), book)[1], []).append(cut(r[2], p))
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for v, label, x in kept:
        best = [closest(cut(x, p), books[p]) for p in range(positions)]
        out.append((v, label, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    fit = lambda n: n if n < 1 << 63 else None
    sums = {label: [e for _, x, _, e in out if x == label] for label in {r[1] for r in out}}
    totals = {x: fit(sum(e)) if all(n < 1 << 63 for n in e) else None for x, e in sums.items()}
    return sorted(((v, c, fit(e), totals[x], digest) for v, x, c, e in out), key=repr)


def vectors(n, dim, scale=0.2, seed=5):
    rng = random.Random(seed)
    rows = [(i * 7 % n, rng.choice([None, 1, 2, 2, 2]), [rng.choice([rng.gauss(0, scale), 0.25, -0.0, -0.1]) for _ in range(dim)]) for i in range(n)]
    odd = [None, [], [0.1] * (dim - 1) + [None], [0.1] * (dim - 1) + [float("nan")], [float("-inf")] + [0.1] * (dim - 1), [0.0] * dim, [0.5] * (dim + 1)]
    return rows + [rows[3], rows[3], (rows[4][0], 1, [0.125] * dim), (None, None, [0.3] * dim)] + [(1000 + i, 1, e) for i, e in enumerate(odd)]


@pytest.mark.parametrize("positions, entries, rounds, n, dim, scale", [(8, 16, 6, 90, 16, 0.2), (2, 4, 3, 60, 6, 1e30), (4, 16, 2, 9, 4, 0.2), (1, 3, 4, 50, 3, 2e5)])
def test_codes_equal_brute_force(table, positions, entries, rounds, n, dim, scale):
    rows = vectors(n, dim, scale)
    out = part_codes.compress(table(rows, SCHEMA), positions, entries, rounds).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute(rows, positions, entries, rounds)


@pytest.mark.parametrize("subtree", [1, 3, 1000])
def test_trie_gives_all_distances(monkeypatch, subtree):
    monkeypatch.setattr(part_codes, "SUBTREE", subtree)
    rng = np.random.default_rng(2)
    points = np.unique(rng.integers(-2, 2, (300, 5)), axis=0)
    book = rng.integers(-2, 2, (6, 5))
    exact = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    runs = list(part_codes.leaves(points, book))
    assert [r[:2] for r in runs] == [(a, b) for a, b in zip([0, *[r[1] for r in runs]], [r[1] for r in runs])]
    assert (np.concatenate([r[2] for r in runs]) == exact).all()
    index, distance = part_codes.nearest(points, book)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_ordered_bytes_keep_order_and_value():
    values = np.array([-1e40, -4096.0, -1.0, -0.0, 0.0, 3.0, 2.0 ** 60, 1e40])
    cells = [row.tobytes() for row in part_codes.ordered_bytes(values.reshape(-1, 1))]
    assert cells == sorted(cells) and cells[3] == cells[4]
    assert (part_codes.from_ordered(cells, 1).ravel() == values).all()


def test_nothing_takes_part(table):
    assert part_codes.compress(table([(1, 1, None), (2, 1, [])], SCHEMA)).collect() == []
    assert part_codes.compress(table([], SCHEMA)).collect() == []


def test_odd_dimension_is_refused(table):
    with pytest.raises(ValueError, match="equal parts"):
        part_codes.compress(table([(1, 1, [0.5] * 9)], SCHEMA))
