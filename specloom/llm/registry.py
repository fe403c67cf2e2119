"""Queries of this subpackage, one per operator, and the SQL of those that SQL can express. Two more queries show the parts of operators 5 and 6
that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, class_lm, decontamination, filter_audit, html_text, language, mixing, near_dedup, oracles, prefix_trie, quality, suffix_dedup, token_counts, warc
from .common import remainder, table


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def class_lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 1)
    return class_lm.base_scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_warc": warc.op2_warc,
    "op3_quality": quality.op3_quality,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_class_lm": class_lm.op6_class_lm,
    "op7_language": language.op7_language,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_ann": ann.op9_ann,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_html_text": html_text.op13_html_text,
    "mixing_targets": mixing_targets,
    "class_lm_base": class_lm_base,
}
ORACLES = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_warc": warc.ORACLE,
    "op4_near_dedup": oracles.NEAR_DEDUP,
    "op8_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "mixing_targets": oracles.MIXING_TARGETS,
    "class_lm_base": oracles.CLASS_LM_BASE,
}
