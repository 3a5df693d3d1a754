"""Substring containment as an equi-join.

A term occurs in a text only if each of its short character runs does. Each term
is filed under the rarest of its runs; a text's runs are held against a one-bit
filter of those anchors as they are cut, so only the few that can name a term are
shuffled, with neither a cross join nor a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import char_runs, literal_count

ANCHOR = 4
# One bit per hash value: 64 KB, whatever the number of terms. More terms let more runs through.
FILTER_BITS = 1 << 19
# One text in so many is counted to rank the runs; the ranking changes the cost, never the answer.
RANKED = 50


def anchor(term: Column) -> Column:
    return F.substring(term, 1, ANCHOR)


def grams(text: Column, lengths: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """Distinct runs of the given lengths; the lengths must cover every anchor."""
    return F.array_distinct(F.concat(*[char_runs(text, n) for n in lengths]))


def term_runs(term: Column) -> Column:
    """Distinct anchors a term can be filed under: its runs of four, or a shorter term itself."""
    return F.when(F.char_length(term) <= ANCHOR, F.array(term)).otherwise(F.array_distinct(char_runs(term, ANCHOR)))


def _place(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(FILTER_BITS))


def filter_words(runs: DataFrame, run: str) -> Column:
    """The bits of all runs as one array of 64-bit words (a scalar subquery of fixed size)."""
    places = runs.select(_place(F.col(run)).alias("_place"))
    held = places.groupBy(F.floor(F.col("_place") / 64).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_place % 64 AS INT))")).alias("_set")
    )
    words = runs.sparkSession.range(FILTER_BITS // 64).join(held, "id", "left")
    dense = F.sort_array(F.collect_list(F.struct("id", F.coalesce("_set", F.lit(0).cast("bigint")).alias("_set"))))
    return words.agg(F.transform(dense, lambda w: w["_set"])).scalar()


def held_runs(texts: DataFrame, text: str, words: Column, *keep: str) -> DataFrame:
    """(keep, _anchor): a text's distinct runs whose bit is set.

    The test follows the cut in the same generated code, so other runs are never
    written, sorted or shuffled.
    """
    place = _place(F.col("_anchor"))
    held = F.getbit(F.get(words, F.floor(place / 64).cast("int")), (place % 64).cast("int"))
    return texts.select(*keep, F.explode(grams(F.col(text))).alias("_anchor")).filter(held == 1)


def anchored_terms(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Terms with ``_anchor``, the run the fewest texts hold (ties: the smaller run)."""
    runs = terms.filter(F.col(term) != "").select(term).distinct().withColumn("_anchor", F.explode(term_runs(F.col(term))))
    ranked = texts.filter(F.pmod(F.xxhash64(text), F.lit(RANKED)) == 0)
    counted = held_runs(ranked, text, filter_words(runs, "_anchor")).groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.struct(F.coalesce("_n", F.lit(0)), "_anchor")
    rarest = runs.join(counted, "_anchor", "left").groupBy(term).agg(F.min_by("_anchor", rank).alias("_anchor"))
    return terms.join(rarest, term)


def anchor_hits(texts: DataFrame, key: str, text: str, anchored: DataFrame) -> DataFrame:
    """(key, _anchor) of the runs that are kept."""
    return held_runs(texts, text, filter_words(anchored, "_anchor"), key)


def containment_join(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Every (text row, term row) where the term occurs in the text, once each.

    Only keys and anchors go through the first join; the text itself meets the
    candidates by key, to check them. Texts that are null or empty and empty terms
    have no pair; a repeated term row has its own. ``key`` must be unique.
    """
    anchored = anchored_terms(texts, text, terms, term)
    candidates = anchor_hits(texts, key, text, anchored).join(anchored, "_anchor").drop("_anchor")
    return texts.join(candidates, key).filter(F.contains(F.col(text), F.col(term)))


def lexicon_table_scores(texts: DataFrame, key: str, text: str, lexicon: DataFrame, categories: list[str]) -> DataFrame:
    """Weighted term hits per message and category for a lexicon held as a table.

    For lexicons too large to sit in the plan. ``lexicon`` is (category, term,
    weight). Messages without a hit keep a row of zeros.
    """
    low = texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    hits = containment_join(low, key, "_low", lexicon, "term").select(
        key, "category", (F.col("weight") * literal_count(F.col("_low"), F.col("term"))).alias("_v")
    )
    sums = hits.groupBy(key).agg(
        *[F.sum(F.when(F.col("category") == c, F.col("_v")).otherwise(0.0)).alias(f"emo_{c}") for c in categories]
    )
    return texts.select(key).join(sums, key, "left").select(
        key, *[F.coalesce(f"emo_{c}", F.lit(0.0)).alias(f"emo_{c}") for c in categories]
    )


def semi_contains(texts: DataFrame, text: str, terms: DataFrame, term: str, key: str) -> DataFrame:
    """Rows of ``texts`` that contain any term of a term table."""
    hits = containment_join(texts.select(key, text), key, text, terms, term).select(key).distinct()
    return texts.join(hits, key, "left_semi")
