"""Problem 2: one consistent form for text that looks the same.

``canonical`` is a compatibility normalisation in composed form with mapped blanks, look-alike
letters folded to Latin and characters without picture removed; ``fold_key`` adds full case
folding.  Both run once per distinct value of a batch.  Null stays null, empty stays empty;
raised and circled digits stay apart from plain ones, as they look different.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .asread import as_read, match_key, span_key


def _per_distinct(f: Callable[[str | None], object], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    def run(values: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(values)
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        forms = pa.array([f(v) for v in coded.dictionary.to_pylist()], kind)
        return forms.take(coded.indices)

    return run


def canonical(text: Column) -> Column:
    """The consistent form, case kept."""
    run = _per_distinct(as_read, pa.string())

    @arrow_udf("string")
    def canonical_form(v: pa.Array) -> pa.Array:
        return run(v)

    return canonical_form(text)


def fold_key(text: Column) -> Column:
    """The consistent form with case folded and blanks collapsed, for joins that ignore case."""
    run = _per_distinct(match_key, pa.string())

    @arrow_udf("string")
    def folded_key(v: pa.Array) -> pa.Array:
        return run(v)

    return folded_key(text)


def span_form(text: Column) -> Column:
    """The consistent form by which spans are compared: blanks collapsed, case kept; worked out once for each distinct text of a batch."""
    run = _per_distinct(span_key, pa.string())

    @arrow_udf("string")
    def form_of_span(v: pa.Array) -> pa.Array:
        return run(v)

    return form_of_span(text)


def reads_equal(a: Column, b: Column) -> Column:
    """Whether two texts look the same; null if one is null."""
    return span_form(a) == span_form(b)


def lookalike_spans(answers: DataFrame, contracts: DataFrame) -> DataFrame:
    """(answer_id) of answers that differ from the span they point at but look the same.

    An answer whose text is null, whose title has no text, or whose positions are null or outside the text is no case.
    """
    docs = contracts.select("title", "doc_text").filter(F.col("doc_text").isNotNull())
    wanted = answers.select("answer_id", "title", "text", "start_pos", "end_pos").filter("text is not null and start_pos >= 0 and end_pos >= start_pos")
    span = F.col("doc_text").substr(F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos") + 1)
    pairs = wanted.join(docs, "title").select("answer_id", "text", span.alias("span")).filter("text <> span")
    return pairs.filter(reads_equal(F.col("text"), F.col("span"))).select("answer_id")
