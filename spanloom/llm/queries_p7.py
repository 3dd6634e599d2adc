"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .encode import encoded
from .shared import table


def p7_ids(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Ids of every document by the public byte-level vocabulary, without special tokens."""
    import public_tokenizers

    path, pattern = path or str(public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN
    return encoded(table(spark, sf_dir, "documents"), path, pattern)


QUERIES = {"p7_ids": p7_ids}
