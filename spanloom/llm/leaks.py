"""Problem 8: evaluation passages inside training text.

The items' words (as read, lower case) form one generalised suffix automaton; every document's
words are streamed through it once, which gives at each word the longest run that some item also
holds.  Each state of the automaton is marked with the longest run that reached it, and marks go up the suffix
links once; the states of an item's own prefixes then give, place by place, the longest run that ends there, so covering
an item takes time in proportion to its words however repetitive it is.  A document holds an item
when at least half of the item's words lie in runs of ``MIN_RUN`` words and more.

Items are written to the shared folder in blocks of bounded size, each its own automaton, and each block is a scan
of its own over the documents, so a task builds one automaton at most, and a worker keeps it for the next
task of the same block.  Null and empty texts hold nothing; an item under ``MIN_RUN`` words is never held.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asread import _WORD, as_read, words
from .shared import kept, small

MIN_RUN = 10
SHARE = 0.5
DROP = 0.5  # share of a document's words in runs of items above which nothing of it is kept
BLOCK_CHARS = 4_000_000  # characters of items in one automaton: 160 MB of a worker, as measured
_PART = 1 << 30  # codes of the signs that part items, which no text has


class Automaton:
    """Suffix automaton of several word sequences.

    A state's only transition is kept in two arrays; states with more, some in ten, have a dictionary.
    """

    def __init__(self, items: list[tuple[int, list[str]]], min_run: int = MIN_RUN):
        self.items = [(i, len(w)) for i, w in items]
        self.min_run = min_run
        self.vocab: dict[str, int] = {}
        self.code, self.to = array("i", [-1]), array("i", [0])
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {0: {}}
        self.prefixes: list[array] = []
        last = 0
        for k, (_, ws) in enumerate(items):
            own = array("i")
            for code in (*(self.vocab.setdefault(w, len(self.vocab)) for w in ws), _PART + k):
                last = self._add(last, code)
                own.append(last)
            own.pop()
            self.prefixes.append(own)
        self.top = array("i", bytes(4 * len(self.link)))  # the shortest of a state's suffixes that is long enough
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[s] >= min_run:
                up = self.link[s]
                self.top[s] = self.top[up] if self.length[up] >= min_run else s
        self.holders: dict[int, list[int]] = {}  # items with that suffix
        for k, own in enumerate(self.prefixes):
            for t in {self.top[s] for s in own} - {0}:
                self.holders.setdefault(t, []).append(k)

    def _add(self, last: int, code: int) -> int:
        cur, q = self._state(self.length[last] + 1), last
        while q >= 0 and (to := self._next(q, code)) is None:
            self._put(q, code, cur)
            q = self.link[q]
        if q < 0:
            self.link[cur] = 0
        elif self.length[to] == self.length[q] + 1:
            self.link[cur] = to
        else:
            copy = self._state(self.length[q] + 1)
            self.code[copy], self.to[copy] = self.code[to], self.to[to]
            if to in self.more:
                self.more[copy] = dict(self.more[to])
            self.link[copy] = self.link[to]
            while q >= 0 and self._next(q, code) == to:
                self._put(q, code, copy)
                q = self.link[q]
            self.link[to] = self.link[cur] = copy
        return cur

    def _state(self, length: int) -> int:
        self.code.append(-1)
        self.to.append(0)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _next(self, state: int, code: int) -> int | None:
        return self.to[state] if self.code[state] == code else self.more[state].get(code) if state in self.more else None

    def _put(self, state: int, code: int, to: int) -> None:
        if state in self.more:
            self.more[state][code] = to
        elif self.code[state] in (-1, code):
            self.code[state], self.to[state] = code, to
        else:
            self.more[state] = {self.code[state]: self.to[state], code: to}
            self.code[state] = -1

    def runs(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) wherever the longest run that ends there has ``min_run`` words or more."""
        codes, tos, link, length, more, least, root = self.code, self.to, self.link, self.length, self.more, self.min_run, self.more[0]
        state = run = 0
        for i, code in enumerate(map(self.vocab.get, ws)):
            if code is None:
                state = run = 0
                continue
            while state:
                if codes[state] == code:
                    state = tos[state]
                    break
                if state in more and (to := more[state].get(code)) is not None:
                    state = to
                    break
                state = link[state]
                run = length[state]
            else:
                state, run = root[code], 0
            run += 1
            if run >= least:
                yield i, state, run

    def covered(self, ws: list[str]) -> dict[int, int]:
        """For each item met, the words covered, as bits."""
        longest: dict[int, int] = {}
        for _, state, run in self.runs(ws):
            if run > longest.get(state, 0):
                longest[state] = run
        if not longest:
            return {}
        met = {k for s in longest for k in self.holders[self.top[s]]}
        for s in list(longest):  # a run's suffixes are runs too
            while (s := self.link[s]) > 0 and self.length[s] >= self.min_run and longest.get(s) != self.length[s]:
                longest[s] = self.length[s]
        out = {}
        for k in met:
            bits, start, end = 0, 0, 0
            for p, s in enumerate(self.prefixes[k], 1):
                way = []
                while s not in longest and self.length[s] >= self.min_run:
                    way.append(s)
                    s = self.link[s]
                n = longest.get(s, 0)
                for w in way:
                    longest[w] = n
                if n:
                    if p - n > end:
                        bits |= ((1 << (end - start)) - 1) << start
                        start = p - n
                    start, end = min(start, p - n), p
            out[k] = bits | ((1 << (end - start)) - 1) << start
        return out


_LAST: dict[str, Automaton] = {}


def _load(path: str) -> Automaton:
    if path not in _LAST:
        from pyarrow import fs, parquet

        where, inner = fs.FileSystem.from_uri(path)
        t = parquet.read_table(inner, filesystem=where, columns=["item_id", "item_text"], partitioning=None)
        _LAST.clear()
        _LAST[path] = Automaton([(i, words(x)) for i, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)])
    return _LAST[path]


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "item_text", most: int = BLOCK_CHARS) -> list[str]:
    """Folders of the shared folder with the items in blocks of bounded size."""
    slim = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("item_text")).filter("item_text is not null and item_id is not null")
    chars = slim.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if not chars:
        return []
    blocks = -(-chars // most)
    at = kept(slim.repartition(1 if blocks == 1 else int(blocks), "item_id").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")), "block")
    return [f"{at.kept_at}/block={r.block}" for r in at.select("block").distinct().toLocalIterator()]


def _united(parts: list[DataFrame], documents: DataFrame, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], schema)


def held_items(documents: DataFrame, paths: list[str], share: float = SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, item_words) of every item that a document holds; ``paths`` from ``item_blocks``."""
    schema = "doc_id long, item_id long, covered int, item_words int"
    slim = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text <> ''")

    def through(path: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                machine, rows = _load(path), []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k, bits in machine.covered(words(t)).items():
                        item, n = machine.items[k]
                        if bits.bit_count() >= share * n:
                            rows.append((d, item, bits.bit_count(), n))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "covered", "item_words"])

        return run

    return _united([slim.mapInArrow(through(p), schema) for p in paths], documents, schema)


def _shown_words(text: str) -> tuple[str, list[tuple[int, int]]]:
    shown = as_read(text)
    return shown, [m.span() for m in _WORD.finditer(shown)]


def without_leaks(documents: DataFrame, paths: list[str], min_run: int = MIN_RUN, doc_id: str = "doc_id", text: str = "text", drop: float = 1.0) -> DataFrame:
    """(doc_id, removed, clean_text) of every document with runs of items; ``removed`` counts words, the text is as read.

    Runs of ``min_run`` words and more go (``MIN_RUN`` at least); where they are more than ``drop`` of a document's
    words, all of it does (``clean_text`` is null).  Rows with the same id are told apart by their text.
    """
    slim = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text <> ''").withColumn("h", F.md5("text"))
    schema = "doc_id long, h string, runs array<int>"

    def through(path: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                machine, rows = _load(path), []
                for d, t, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    shown, places = _shown_words(t)
                    ends = {i - n + 1: i + 1 for i, _, n in machine.runs([shown[i:j].lower() for i, j in places]) if n >= min_run}  # the last of equal starts is the longest
                    if ends:
                        rows.append((d, h, [x for pair in ends.items() for x in pair]))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "h", "runs"])

        return run

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for d, t, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shown, places = _shown_words(t)
                keep, at, done, removed = [], 0, 0, 0
                for i, j in sorted((x[k], x[k + 1]) for x in runs for k in range(0, len(x), 2)):
                    if j > done:
                        if i > done or not keep:
                            keep.append(shown[at : places[i][0]])
                        removed += j - max(i, done)
                        at, done = places[j - 1][1], j
                rows.append((d, removed, None if removed > drop * len(places) else "".join([*keep, shown[at:]])))
            kinds = (pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "removed", "clean_text"])

    found = _united([slim.mapInArrow(through(p), schema) for p in paths], documents, schema)
    per = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("runs").alias("runs"))  # one list a block at most
    hit = slim.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    return hit.select("doc_id", "text", "runs").filter(F.size("runs") > 0).mapInArrow(clean, "doc_id long, removed int, clean_text string")
