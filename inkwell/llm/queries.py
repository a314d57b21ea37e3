"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import contamination, language, lines, lm, near, pieces, pii, quality, substrings, toxicity
from ._store import narrow_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log-perplexity and whether its language's bands keep it."""
    return quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), keep=["doc_id", "lang"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without its later repeated runs of lines."""
    return lines.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids and whether decoding them gives its text again."""
    return pieces.tokenised(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return contamination.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity score and verdict."""
    return toxicity.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")).drop("text")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, as given and as found."""
    return language.identified(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that the documents have more than once."""
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal datum of every document."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's mean log-score under the bigrams of all other documents."""
    return lm.scored(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_substrings": op5_substrings,
    "op8_personal_data": op8_personal_data,
    "op10_lm_score": op10_lm_score,
    "pipeline": pipeline,
    "op7_line_dedup": op7_line_dedup,
    "op9_pieces": op9_pieces,
    "op6_quality_rules": op6_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": contamination.SQL,
    "op10_lm_score": lm.SQL,
}
