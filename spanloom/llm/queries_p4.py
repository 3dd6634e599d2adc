"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .packing import packed_all
from .shared import table


def p4_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for every non-empty paragraph, for each capacity; only longer paragraphs are in pieces."""
    settings = table(spark, sf_dir, "size_limits").filter("problem = 4").orderBy("setting").collect()  # a table of settings
    paras = table(spark, sf_dir, "paras").select("para_id", "text")
    return packed_all(paras, "para_id", "text", {s.setting: s.capacity for s in settings}).withColumnRenamed("item_id", "para_id")


QUERIES = {"p4_containers": p4_containers}
