"""Subword tokens of words, by a public tokenizer's vocabulary file; its path is a parameter and nothing of it is kept here.

Functions run over Arrow batches; a worker reads the vocabulary once.  Null texts give null, empty ones no tokens.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .text import blank_words

MAPS = StructType([StructField("token_word", ArrayType(IntegerType())), StructField("word_token", ArrayType(IntegerType()))])


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def word_maps(text: Column, path: str, pattern: str) -> Column:
    """(token_word, word_token): the word of each token, and the first token of each blank-separated word, words being tokenised one by one."""

    @arrow_udf(MAPS)
    def maps_of_words(words: pa.Array) -> pa.Array:
        encoding, rows = _encoding(path, pattern), []
        for ws in words.to_pylist():
            if ws is None:
                rows.append(None)
                continue
            sizes = [len(encoding.encode_ordinary(w)) for w in ws]
            first = [0, *sizes]
            for i in range(1, len(first)):
                first[i] += first[i - 1]
            rows.append({"token_word": [i for i, n in enumerate(sizes) for _ in range(n)], "word_token": first[:-1]})
        return pa.array(rows, pa.struct([("token_word", pa.list_(pa.int32())), ("word_token", pa.list_(pa.int32()))]))

    return maps_of_words(F.when(text.isNotNull(), blank_words(text)))


def round_trips(text: Column, path: str, pattern: str) -> Column:
    """Whether decoding a text's ids gives the text."""

    @arrow_udf(BooleanType())
    def same_again(texts: pa.Array) -> pa.Array:
        encoding = _encoding(path, pattern)
        return pa.array([None if t is None else encoding.decode(encoding.encode_ordinary(t)) == t for t in texts.to_pylist()], pa.bool_())

    return same_again(text)
