"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import canonical, fold_key, lookalike_spans
from .shared import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that differ from their span only in characters that look the same."""
    return lookalike_spans(table(spark, sf_dir, "answers"), table(spark, sf_dir, "cuadv1"))


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields in their consistent form, with a hash of the case-folded form to compare by."""
    docs = table(spark, sf_dir, "cuadv1").select(F.lit("cuadv1.doc_text").alias("field"), F.col("title").alias("key"), F.col("doc_text").alias("t"))
    answers = table(spark, sf_dir, "answers").select(F.lit("answers.text").alias("field"), F.col("answer_id").cast("string").alias("key"), F.col("text").alias("t"))
    both = docs.unionByName(answers)
    return both.select("field", "key", canonical(F.col("t")).alias("form"), F.md5(fold_key(F.col("t"))).alias("fold_md5"))


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical}
