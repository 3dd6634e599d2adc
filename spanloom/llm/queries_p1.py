"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .overlap import coded_records, cross_split_classes, expanded, overlap_counts, split_paragraphs
from .shared import kept, table


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    paras = split_paragraphs(*(table(spark, sf_dir, t) for t in ("paras", "train_meta", "test_meta_id")))
    coded = kept(coded_records(paras, "text", "para_id", "part", "source"))
    return coded, kept(cross_split_classes(coded))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paragraphs, one of a training and one of a test contract, that differ in a fifth of the words at most."""
    coded, classes = _classes(spark, sf_dir)
    pairs = expanded(classes, coded).filter(F.col("query_id") != F.col("corpus_id"))
    return pairs.select(F.least("query_id", "corpus_id").alias("para_id_a"), F.greatest("query_id", "corpus_id").alias("para_id_b")).distinct()


def p1_overlap_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split and source: paragraphs, those with an equal and with a near partner in the other split, and pairs."""
    coded, classes = _classes(spark, sf_dir)
    return overlap_counts(coded, classes).withColumnRenamed("records", "paragraphs")


QUERIES = {"p1_found": p1_found, "p1_overlap_by_source": p1_overlap_by_source}
