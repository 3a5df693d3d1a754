"""Removal of repeated word windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from terrace.llm import substring_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, words in texts:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            least[key] = min(least.get(key, (True, 1 << 62)), (d is not None, d or 0))
    out = []
    for d, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < (d is not None, d or 0):
                gone |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        spans = sum(i in gone and i - 1 not in gone for i in range(len(words)))
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), spans, " ".join(kept)))
    return sorted(out, key=repr)


def documents(seed, n=60, vocabulary=40):
    rng = random.Random(seed)
    words = [f"wört{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(size)] for size in (5, 13, 14, 40, 200)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, n), rng.choice([" ", "  ", "\n", "\t \x0b"]).join(text)))
    whole = " ".join(passages[4])
    hot = [(200 + i, whole) for i in range(40)]  # a passage that most rows hold
    odd = [(None, whole), (None, None), (300, None), (301, ""), (302, " \n\t\x0c"), (303, "a b\x1cc " * 20), (304, "A b\x1cc " * 20), (305, "x"), (306, "w " * 5000), (307, "w " * 20)]
    return rows + hot + odd + [rows[0], rows[1], hot[0]]


@pytest.mark.parametrize("window, first, group_hashes", [(13, 4, 2_000_000), (13, 4, 50), (5, 4, 100), (3, 4, 100), (1, 1, 100), (40, 3, 1000)])
def test_dedup_equals_brute_force(table, window, first, group_hashes):
    rows = documents(window)
    out = substring_dedup.dedup(table(rows, SCHEMA), window, True, first, group_hashes).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute(rows, window)


def test_stops_where_no_candidate_survives(table):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(50))) for i in range(5)]
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.dedup(table(rows, SCHEMA), 32).collect()} == {(i, 0) for i in range(5)}
    assert substring_dedup.dedup(table([], SCHEMA)).collect() == []
    assert substring_dedup.dedup(table([(1, None)], SCHEMA)).collect()[0].n_words == 0


def test_words_and_windows_of_a_block():
    texts = [b"", b"a b c", b"", b"", b"a b", b"dd e f g", b""]
    payload = substring_dedup.zstandard.ZstdCompressor().compress(b"\n".join(texts))
    block = substring_dedup.Block([1, 2, 3, 4, 5, 6, None], payload)
    assert [block.text[a:b] for a, b in zip(block.start, block.end)] == [b"a", b"b", b"c", b"a", b"b", b"dd", b"e", b"f", b"g"]
    assert block.inside(2).tolist() == [True, True, False, True, False, True, True, True, False]
    two = block.windows(2)
    assert two[0] == two[3] and len(set(two.tolist())) == len(two) - 1
    assert block.candidates([2, 4], 1, np.ones(9, bool)).tolist() == [5]
    assert substring_dedup.lengths(13) == [4, 8, 13] and substring_dedup.lengths(4) == [4] and substring_dedup.lengths(3) == [3]


def test_text_is_not_shuffled_again(spark, table):
    texts = substring_dedup.blocks(table(documents(3), SCHEMA))
    answers = substring_dedup.stored(spark.createDataFrame([(0, 0, b"\x00")], substring_dedup.ANSWERS_DDL), "answers")
    plan = substring_dedup.with_answers(texts, [answers])._jdf.queryExecution().sparkPlan().toString()
    side = plan[plan.index("terrace_blocks"):] if "terrace_blocks" in plan else plan
    assert "Bucketed: true" in side or "SelectedBucketsCount" in side
