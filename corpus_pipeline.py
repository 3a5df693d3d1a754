"""The corpus pipeline: documents to packed sequences, each stage over all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Between stages the rows are written and read again, so a lost
executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import language, near_dup, packing, quality, suffix_dedup
from terrace.llm.common import stored
from terrace.llm.queries import table, tokenizer_file
from terrace.session import configure


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the co-trained classifier rejects go."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents in no learned language go."""
    return language.accepted(docs, language.fit(docs))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, five-word shingles: of each group the document with the smallest doc_id stays."""
    judged = near_dup.near_duplicates(docs, 5, 80)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: later copies of 100-byte strings are cut from the texts."""
    cut = suffix_dedup.dedup(docs, 100, text_out=True, carry=docs.columns)
    text = F.when(F.col("carried.text").isNotNull(), F.col("kept_text"))
    own = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("carried.n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[(own[c] if c in own else F.col(f"carried.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: all ids in windows of 2048."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 2048, 1).drop("ids")


STAGES = [
    ("quality", good_quality), ("language", known_language), ("near_copies", no_near_copies),
    ("repeats", no_repeats), ("packing", packed),
]
# Models, hashing and tokenizers: not SQL. The tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
