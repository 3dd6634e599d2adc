"""Problem 7: a corpus as ids of a byte-level tokenizer.

Two tiers.  A whole pre-token that is in the vocabulary is resolved by a minimal perfect hash
(hash and displace: no empty slot, one comparison of bytes).  The others are merged by a heap over
linked bytes, so that a run of any length takes ``n log n`` steps.  Results are remembered per
distinct pre-token in each worker.

Null and empty texts have the defined result of no ids (an empty list).  The tables of the hash are
as large as the vocabulary, whatever the corpus, and go to the workers with the task.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small

_TURN = 0x9E3779B1
MEMO = 1_000_000  # distinct pre-tokens remembered by a worker before it starts anew


def vocabulary(path: str) -> list[bytes]:
    """Tokens in the order of their ids, from lines of base64 and rank."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without a gap")
    return [token for _, token in ranked]


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings; ``get`` gives a member's index and None for others."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.keys, self.n, self.m = keys, n, max(1, n // 4)
        h = [xxhash.xxh3_128_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for i, x in enumerate(h):
            buckets[x % self.m].append(i)
        lows = np.array([(x >> 32) & 0xFFFFFFFF for x in h], np.uint64)[:, None]
        steps = np.array([(x >> 64) & 0xFFFFFFFF | 1 for x in h], np.uint64)[:, None]
        taken = np.zeros(n, bool)
        self.turn, self.slot = np.zeros(self.m, np.int64), np.zeros(n, np.int64)
        free_at = 0
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # a lone key takes any free slot, told by a negative turn
                while taken[free_at]:
                    free_at += 1
                at, d = np.array([free_at]), -1 - free_at
            else:
                first, size = 0, 16
                while True:
                    d = np.arange(first, first + size).astype(np.uint64)
                    at = (((lows[own] + d * np.uint64(_TURN)) * steps[own] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                    ok = ~taken[at].any(0)
                    for i in range(1, len(own)):
                        ok &= (at[:i] != at[i]).all(0)
                    if ok.any():
                        at, d = at[:, ok.argmax()], first + int(ok.argmax())
                        break
                    first, size = first + size, min(4 * size, 4096)
            taken[at] = True
            self.slot[at] = own
            self.turn[b] = d
        self.turn_list, self.slot_list = self.turn.tolist(), self.slot.tolist()

    def get(self, key: bytes) -> int | None:
        x = xxhash.xxh3_128_intdigest(key)
        d = self.turn_list[x % self.m]
        at = -1 - d if d < 0 else ((((x >> 32) & 0xFFFFFFFF) + d * _TURN) * ((x >> 64) & 0xFFFFFFFF | 1) >> 32 & 0xFFFFFFFF) % self.n
        i = self.slot_list[at]
        return i if self.keys[i] == key else None


def merge(piece: bytes, find) -> list[int]:
    """Ids of a byte string by merging the neighbours of least rank first, the left ones at a tie."""
    n = len(piece)
    ids = [find(piece[i : i + 1]) for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    start_of = list(range(n))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := find(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or not alive[i]:
            continue  # one of the two was merged since
        ids[i], end[i], alive[j] = rank, stop, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            if (r := find(piece[start_of[i] : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (k := before[i]) >= 0 and (r := find(piece[start_of[k] : stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class Encoder(dict):
    """Ids of each pre-token; a dict, so that known ones take one lookup."""

    def __init__(self, table: PerfectHash, pattern: str):
        super().__init__()
        self.find, self.split = table.get, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace")
        whole = self.find(raw)
        ids = [whole] if whole is not None else merge(raw, self.find)
        if len(self) >= MEMO:
            self.clear()
        if len(raw) <= 256:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> array:
        return array("i", chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else array("i")


def encoded(documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts have no ids, other columns are left out."""
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(PerfectHash(vocabulary(path)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value, pattern)
        for b in small(batches):
            values, offsets = array("i"), [0]
            for t in b.column(1).to_pylist():
                values.extend(encoder.encode(t))
                offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
