"""Ordered state within a document: what was said of earlier parts feeds the later ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def sequential(parts: DataFrame, key: str, order: list[str], predict: Callable[[dict, list[str]], str], most: int) -> DataFrame:
    """Parts with ``said``: the result of ``predict(row, the last most results of the document)``.

    Documents are spread and sorted by Spark, and streamed: a task holds the memory of one document at a
    time, whatever its number of parts.  Rows without a key are one document.
    """
    fields = parts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: deque[str] = deque(maxlen=most)
        now = object()
        for b in batches:
            said = []
            for row in b.to_pylist():
                if row[key] != now:
                    memory.clear()
                    now = row[key]
                out = predict(row, list(memory))
                memory.append(out)
                said.append(out)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, "said"])

    placed = parts.repartition(key).sortWithinPartitions(key, *order)
    return placed.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", said string")
