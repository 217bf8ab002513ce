"""A corpus from raw documents to token ids: filter, deduplicate, mix and encode.

Every stage reads what the one before it wrote. All but the last return the columns of
``documents``, whatever else these are called. A null text counts as empty, keys may repeat, and an
empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.llm.common import table, written
from curbflow.llm.jaccard_join import keep_first
from curbflow.llm.piece_codec import encode_pieces
from curbflow.llm.quality_mil import score_quality, train_quality
from curbflow.llm.source_mix import mixed_rows
from curbflow.llm.substring_dedup import remove_repeats


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with the columns of these names renamed, for operators that add their own."""
    return docs.withColumnsRenamed({n: f"_own_{n}" for n in names if n in docs.columns})


def _back(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, those that were put aside under their own names."""
    return docs.select(*[F.col(f"_own_{c}").alias(c) if f"_own_{c}" in docs.columns else F.col(c) for c in like.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject. Empty
    texts have a score too; a text's score does not depend on its row."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return _back(score_quality(_aside(docs, "score"), model).filter("score >= 0.5"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the smallest key; texts without words
    are in no group and stay."""
    return keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents hold; ``n_chars`` follows the text. Rows
    with a null key neither lose nor remove any."""
    kept = remove_repeats(_aside(docs, "n_words", "n_removed"))
    return _back(kept.withColumn("n_chars", F.length("text").cast("long")), docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are never taken."""
    return mixed_rows(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    coded = encode_pieces(docs.select("doc_id", "source", "text"), decoded="decoded")
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("substring_dedup", without_repeats),
    ("source_mix", to_weights),
    ("piece_encoding", to_pieces),
]

# Training, shingle hashing and tokenizing cannot be said in SQL; tests hold the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
