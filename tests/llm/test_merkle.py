"""The Merkle manifest against a plain recursive tree."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from terrace.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*digests):
    return sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, arity):
    """Root, and the runs (place in the run, run) above every leaf."""
    ways = [[] for _ in leaves]
    under = [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        runs = [range(a, min(a + arity, len(leaves))) for a in range(0, len(leaves), arity)]
        for run in runs:
            for i in run:
                for w in under[i]:
                    ways[w].append((i - run[0], [leaves[j] for j in run]))
        under = [[w for i in run for w in under[i]] for run in runs]
        leaves = [h(*[leaves[j] for j in run]) for run in runs]
    return leaves[0], ways


def expected(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subroots, below = [], [], {}
    for lang in langs:
        ordered = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, ways = tree([leaf(r) for r in ordered], arity)
        below[lang] = list(zip(ordered, ways))
        subroots.append(root)
    root, upper = tree(subroots, arity)
    for lang, subroot, way in zip(langs, subroots, upper):
        for row, own in below[lang]:
            shown = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                shown = (*row[:3], row[3] + 1, row[4])
            digest, proof = leaf(shown), []
            for at, run in own + way:
                proof += run[:at] + run[at + 1:]
                digest = h(*run[:at], digest, *run[at + 1:])
            out.append((row[0], leaf(row), subroot, root, h(*proof), digest, digest == root))
    return sorted(out, key=repr)


def documents(n, seed=1):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", None, "fr"]
    rows = [(i * 3 % 97 + i, rng.choice(["a", None, ""]), rng.choice(langs), rng.choice([None, 5, 2**31 - 1]), rng.choice([None, "", "tä" * i])) for i in range(n)]
    return rows + [rows[0], rows[0], (None, None, None, None, None), (7, "b", "solo", 3, "x" * 200_000)]


@pytest.mark.parametrize("arity, band, n", [(2, 10, 60), (2, 2, 60), (3, 1, 45), (2, 1, 17)])
def test_manifest_equals_plain_tree(table, arity, band, n):
    rows = documents(n)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    frame = table(rows, SCHEMA).withColumn("tree", F.lit("t")).withColumn("block", F.lit(1)).withColumn("shown", F.lit(1))
    out = merkle.manifest(frame, arity, tampered, band).collect()
    assert sorted((tuple(r)[:7] for r in out), key=repr) == expected(rows, arity)
    assert any(not r.verified for r in out)


def test_untampered_rows_all_verify(table):
    assert all(r.verified for r in merkle.manifest(table(documents(30), SCHEMA)).collect())


def test_one_row_and_no_rows(table):
    (only,) = merkle.manifest(table([(4, "s", "en", 1, "x")], SCHEMA)).collect()
    assert only.root == only.subroot == only.leaf and only.verified and only.proof_sha256 == h()
    assert merkle.manifest(table([], SCHEMA)).collect() == []
