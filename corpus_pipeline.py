"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Language identification, near duplicates, benchmark decontamination, secrets, packing. All but the last return the
columns of the documents they are given. Nulls, repeated rows, empty tables and further columns are handled as the
operators say; no stage drops a document for any reason but its own decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm import chosen_path, decontamination, harmonic_packing, language_mixture, secret_ownership
from vitrine.llm.common import stored, table

#: Share of the leading language below which a text counts as of no one language.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and mixtures in which no language has half of the text."""
    model = language_mixture.fit(docs.select("text", "lang"))
    told = language_mixture.identify(docs, model, F.struct(*docs.columns).alias("_row"))
    good = (F.col("lang_pred") != language_mixture.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)
    return told.where(good).select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id."""
    return chosen_path.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific, live-looking credentials are masked; n_chars follows the text."""
    masked = secret_ownership.redact(docs, secret_ownership.scan(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return harmonic_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("secrets", secrets),
    ("packing", packing),
]

#: No SQL can train a language model or tokenise; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
