"""Text, number and lexicon columns."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.functions import lexicon, numbers, text
from terrace.operators.textmodel import stratified_folds


def one(spark, data, expr, ddl="x STRING"):
    return [r[0] for r in spark.createDataFrame([(d,) for d in data], ddl).select(expr).collect()]


def test_normalised_collapses_links_mentions_runs_and_blanks(spark):
    got = one(spark, ["GOOOOAL  @José_x see https://t.co/x #Tag\tnow", "aabb", "a\n\n\nb", None], text.normalised(F.col("x")))
    assert got == ["gooal see now", "aabb", "a b", None]


def test_letter_runs_count_words_of_any_script(spark):
    got = one(spark, ["⚽⚽⚽", "https://t.co/x", "one two x three", "año über ça_va 12"], text.letter_runs(F.col("x")))
    assert got == [0, 0, 3, 4]


def test_parse_utc_variants(spark):
    data = ["2026-06-11T19:00Z", "2026-06-11T19:05:43.630Z", "2026-06-11T19:30:37.467994Z", "2026-06-11T21:00:00+02:00", "junk", ""]
    got = one(spark, data, F.date_format(text.parse_utc(F.col("x")), "HH:mm:ss.SSSSSS"))
    assert got == ["19:00:00.000000", "19:05:43.630000", "19:30:37.467994", "19:00:00.000000", None, None]


def test_message_key_is_trimmed_sha(spark):
    import hashlib

    got = one(spark, ["  we are done \n"], text.message_key(F.col("x")))
    assert got == [hashlib.sha256(b"we are done").hexdigest()[:24]]


def test_grams(spark):
    assert one(spark, ["The goal, the END"], text.word_grams(F.col("x"))) == [
        ["the", "goal", "the", "end", "the goal", "goal the", "the end"]
    ]
    assert one(spark, ["a😀b", "x"], text.char_grams(F.col("x"), 2, 3)) == [["a😀", "😀b", "a😀b"], []]


@pytest.mark.parametrize("score,expected", [
    ("2-1", (2, 1)), ("0–0", (0, 0)), ("3—2", (3, 2)), ("junk", None), ("", None), (None, None), ("1-2-3", None),
])
def test_score_goals(spark, score, expected):
    got = one(spark, [score], numbers.score_goals(F.col("x")))[0]
    assert (tuple(got) if got else None) == expected


def test_exact_round_equals_scalar_rounding(spark):
    rng = random.Random(7)
    values = [rng.random() for _ in range(500)] + [round(rng.random(), 5) for _ in range(2000)] + [i / 32 for i in range(64)]
    got = one(spark, values, numbers.exact_round(F.col("x"), 4), "x DOUBLE")
    assert got == [round(v, 4) for v in values]


SAMPLES = [
    "total panic, we're done, can't watch this",
    "the ref is corrupt, var robbery, disgrace",
    "what a goal!! golazo, let's go",
    "we look comfortable and in control, cruising",
    "it's over, hopeless, absolutely gutted",
    "no way, can't believe what just happened",
]


def test_each_emotion_fires(spark):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(SAMPLES)], "i INT, message STRING")
    got = lexicon.emotion_intensities(df).orderBy("i").collect()
    for row, name in zip(got, lexicon.EMOTION_TERMS):
        assert row[f"emo_{name}"] > 0


def test_nested_terms_count_twice_and_other_languages_fire(spark):
    df = spark.createDataFrame([("Que GOLAZO increible",), ("se acabó, estamos eliminados 😭",), ("😡🤬 robo",), (None,)], "message STRING")
    got = lexicon.emotion_intensities(df).collect()
    assert got[0]["emo_joy"] == pytest.approx(2.0)
    assert got[1]["emo_despair"] == pytest.approx(0.9 + 1.0 + 0.9)
    assert got[2]["emo_anger"] == pytest.approx(0.9 + 1.0 + 0.9)
    assert all(v == 0 for v in got[3].asDict().values() if v is not None)


def test_scoring_forms_agree_also_on_self_overlapping_terms(spark):
    terms = {"panic": {"haha": 1.0, "aa": 0.5, "ha": 0.25}, "joy": {"haha": 2.0}}
    data = ["hahaha", "aaaaa", "HAHAhaha", "", None, "none"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(data)], "i INT, message STRING")
    fast = lexicon.emotion_intensities(df, "message", terms).orderBy("i").collect()
    slow = lexicon.builtin_intensities(df, "message", terms).orderBy("i").collect()
    brute = [
        (sum(w * (m or "").lower().count(t) for t, w in terms["panic"].items()), 2.0 * (m or "").lower().count("haha"))
        for m in data
    ]
    assert [(r.emo_panic, r.emo_joy) for r in fast] == brute
    assert [(r.emo_panic, r.emo_joy) for r in slow] == brute


def test_counter_without_the_automaton_library(monkeypatch):
    import builtins

    real = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name == "ahocorasick":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    texts = pd.Series([*SAMPLES, "hahaha 😭😭", None])
    fast = lexicon.text_scorer(lexicon.EMOTION_TERMS)(texts)
    monkeypatch.setattr(builtins, "__import__", blocked)
    assert (lexicon.text_scorer(lexicon.EMOTION_TERMS)(texts) == fast).all()


def test_panic_score_signs_and_bounds(spark):
    data = ["this is a disaster we are choking", "we look comfortable and in control", "panic " * 50, None, ""]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(data)], "i INT, message STRING")
    got = [r.panic for r in lexicon.panic_score(df).orderBy("i").collect()]
    assert got[0] > 0.5 and got[1] < -0.5 and got[2] <= 1.0 and got[3:] == [0.0, 0.0]


def test_folds_of_every_class_differ_by_one_row_at_the_most(spark):
    rows = [(i, y, "x") for i, y in enumerate(["a"] * 1003 + ["b"] * 58 + ["c"] * 3 + [None] * 11)]
    got = stratified_folds(spark.createDataFrame(rows, "id LONG, y STRING, _n STRING"), "y", "id").toPandas()
    assert len(got) == len(rows) and got["id"].is_unique and set(got["fold"]) == set(range(5))
    for _, part in got.groupby("y", dropna=False):
        sizes = part["fold"].value_counts().reindex(range(5), fill_value=0)
        assert sizes.max() - sizes.min() <= 1


def test_normalised_against_the_plain_patterns(spark):
    """Guards and the blank pattern change nothing: links, mentions, runs, every kind of blank."""
    import regex

    data = ["a  b\t\tc\u00a0d \u2003 e", " one two ", "see https://x.y/z?q=1 and HTTP://Q now", "hi @ola #Tag_1 @ #", "goooool!!!! aa bbb", "http s://x https:// y", "@a\u2028@b", "", None]
    df = spark.createDataFrame(list(enumerate(data)), "i INT, t STRING")
    got = df.select("i", text.normalised(F.col("t")).alias("n"), text.letter_runs(F.col("t")).alias("k")).orderBy("i").collect()
    blank = r"[\s\x1c-\x1f\x85\p{Z}]"
    for row, t in zip(got, data):
        if t is None:
            assert row.n is None and row.k is None
            continue
        plain = regex.sub(r"[@#][\p{L}\p{N}_]+", " ", regex.sub(rf"https?://(?:(?!{blank}).)+", " ", t.lower(), flags=regex.S))
        plain = regex.sub(rf"{blank}+", " ", regex.sub(r"(.)\1{2,}", r"\1\1", plain)).strip()
        bare = regex.sub(r"[@#][\p{L}\p{N}_]+", " ", regex.sub(rf"https?://(?:(?!{blank}).)+", " ", t, flags=regex.S))
        assert (row.n, row.k) == (plain, len(regex.findall(r"[\p{L}\p{Nl}\p{No}]{2,}", bare))), t
