"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .language import SEGMENTS, Centroids, classified, fitted, full
from .shared import kept, table


def _sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    model: Centroids | None = fitted(documents)
    return documents, classified(documents, model) if model else spark.createDataFrame([], SEGMENTS)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong, or which mix languages."""
    _, sentence = _sentences(spark, sf_dir)
    per = full(sentence).groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))  # six at most
    wrong = (F.size("langs") > 1) | (F.col("langs")[0] != F.col("label"))
    return per.filter(wrong).select("doc_id", F.explode("langs").alias("lang"))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its main language, the confidence, and the number of languages in it."""
    documents, sentence = _sentences(spark, sf_dir)
    length = F.col("end_pos") - F.col("start_pos")
    per = sentence.filter("lang is not null").groupBy("doc_id", "lang").agg(F.sum(length).alias("chars"), (F.sum(F.col("confidence") * length) / F.sum(length)).alias("confidence"))
    best = per.groupBy("doc_id").agg(F.max(F.struct("chars", "confidence", "lang")).alias("m"), F.count("*").alias("languages"))
    out = documents.select(F.col("doc_id").cast("long")).join(best, "doc_id", "left")
    return out.select("doc_id", F.col("m.lang").alias("lang"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.lit(0)).alias("languages"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of stretches of one language, full sentences or not, in documents that mix languages, with place and confidence."""
    _, sentence = _sentences(spark, sf_dir)
    known = kept(sentence.filter("lang is not null"))
    mixed = known.groupBy("doc_id").agg(F.countDistinct("lang").alias("k")).filter("k > 1").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy("start_pos")
    new = F.coalesce((F.lag("lang").over(order) != F.col("lang")).cast("int"), F.lit(1))
    marked = known.join(mixed, "doc_id", "left_semi").withColumn("new", new)
    numbered = marked.withColumn("segment", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "segment", "lang").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.avg("confidence").alias("confidence"))


QUERIES = {"p9_found": p9_found, "p9_documents": p9_documents, "p9_segments": p9_segments}
