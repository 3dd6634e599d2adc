"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, table
from .together import balance, grouped_split, title_components


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test titles tied to some training title by a filer, directly or through further titles."""
    train, test = (table(spark, sf_dir, t).select("title").distinct() for t in ("train_meta", "test_meta_id"))
    of = kept(title_components(train.unionByName(test)))
    leaking = of.join(train, "title", "left_semi").select("component").distinct()
    return of.join(test, "title", "left_semi").join(leaking, "component", "left_semi").select("title")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "train_meta").select("title", "q_id").unionByName(table(spark, sf_dir, "test_meta_id").select("title", "q_id"))


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validation or test for every title, whole groups of tied titles together."""
    return grouped_split(_samples(spark, sf_dir), F.col("q_id"))


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the rows of each question fall on the three splits."""
    both = _samples(spark, sf_dir)
    return balance(both, F.col("q_id"), kept(grouped_split(both, F.col("q_id"))))


QUERIES = {"p3_found": p3_found, "p3_split": p3_split, "p3_balance": p3_balance}
