"""The corpus pipeline: language ID, near-duplicate removal, passage removal, benchmark decontamination, mixing.

Every stage takes the rows that its predecessor kept; all but the last return the columns of ``documents``. Other columns that
the input has are dropped. An empty input goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import decontamination, language, mixing, near_dedup, suffix_dedup
from specloom.llm.common import remainder, settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that ``lang`` names, with the predicted one as ``lang``. Texts without letters go, and texts that hold
    nothing in a script of a learned language (score 0). The model learns from three quarters of the rows (by the remainder that ``op7_language``
    holds out), so a row's own label is no more than one among many."""
    docs = docs.select(COLUMNS)
    model = language.learn(docs.where(remainder("doc_id", 4) != 2))
    return language.identify(docs, model, with_spans=False).where("lang_pred <> 'und' AND score > 0").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; of rows with the same id the one with the smallest (text, lang, source,
    n_chars) stays, nulls first. Rows without an id stay."""
    docs = docs.select(COLUMNS)
    keep = settle(near_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct(), "kept")
    least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("d")
    return docs.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "d.*").select(COLUMNS).union(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that an earlier document has; characters that are cut in two go as well. Documents
    with nothing left go."""
    cut = suffix_dedup.repeated(docs, outputs=("kept_text",), carry=("lang", "source"))
    return cut.where("length(kept_text) > 0").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    return decontamination.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs.select(COLUMNS))


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing_to_weights),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
