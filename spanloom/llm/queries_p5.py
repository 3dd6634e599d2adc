"""Queries of problem 5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cutting import pieces
from .shared import table

FIELDS = {"paras": ("para_id", "text"), "cuadv1": ("title", "doc_text")}


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every non-empty paragraph and contract, each within the capacity set for its table."""
    settings = table(spark, sf_dir, "size_limits").filter("problem = 5").orderBy("setting").collect()  # a table of settings
    parts = []
    for s in settings:
        key, text = FIELDS[s.table_name]
        own = pieces(table(spark, sf_dir, s.table_name), key, text, s.capacity, s.overlap)
        parts.append(own.select(F.lit(s.setting).alias("setting"), F.lit(s.table_name).alias("table_name"), "key", "piece", "start_pos", "end_pos"))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p5_pieces": p5_pieces}
