"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .leaks import DROP, held_items, item_blocks, without_leaks
from .shared import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each evaluation item of which they hold at least half in runs of ten words."""
    held = held_items(table(spark, sf_dir, "documents"), item_blocks(table(spark, sf_dir, "eval_items")))
    return held.select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each item; items that none holds included."""
    items = table(spark, sf_dir, "eval_items")
    held = held_items(table(spark, sf_dir, "documents"), item_blocks(items))
    per = held.groupBy("item_id").agg(F.count("*").alias("docs"), F.sum((F.col("covered") == F.col("item_words")).cast("long")).alias("docs_whole"))
    return items.select("item_id", "benchmark", "split").join(per, "item_id", "left").fillna(0, ["docs", "docs_whole"])


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold runs of items, without those runs; no text where more than half of its words are in them."""
    return without_leaks(table(spark, sf_dir, "documents"), item_blocks(table(spark, sf_dir, "eval_items")), drop=DROP)


QUERIES = {"p8_found": p8_found, "p8_leaked_items": p8_leaked_items, "p8_clean": p8_clean}
