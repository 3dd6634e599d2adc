"""Text similarity: edit distance where it serves, the matching-blocks ratio in Arrow batches where that is asked for."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType


@arrow_udf(DoubleType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the signs in matching blocks by all signs; null if one is null."""
    return _ratio(a, b)


def nearest(rows: DataFrame, text: str, catalogue: DataFrame, name: str, most: int = 10_000) -> DataFrame:
    """Each distinct text with the catalogue's nearest name by edit distance, the least name at a tie.

    The catalogue goes to every task, so its size is checked; a larger one must be blocked first.
    """
    if catalogue.limit(most + 1).count() > most:
        raise ValueError(f"a catalogue of more than {most} names must be blocked before it is matched")
    texts = rows.filter(F.col(text).isNotNull()).select(text).distinct()
    pairs = texts.crossJoin(F.broadcast(catalogue.select(name).distinct())).withColumn("distance", F.levenshtein(F.col(text), F.col(name)))
    return pairs.groupBy(text).agg(F.min(F.struct("distance", name)).alias("m")).select(text, f"m.{name}", "m.distance")
