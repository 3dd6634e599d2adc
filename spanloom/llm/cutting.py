"""Problem 5: cutting long items at natural boundaries, with an overlap.

A piece ends at the last paragraph end in the upper half of its room, else sentence end, else (in the
lower half) paragraph or sentence end, else at a blank, else between a word and a sign, else at the
capacity.  The next piece starts exactly ``overlap`` characters before that end.  Null and empty
texts have no piece, texts within the capacity one.

Every text above the capacity is worked on in ranges of ``SPAN`` capacities, every file in byte ranges, with a
halo that reaches one capacity and ``HALO`` characters further.  Where a piece starts in a range depends on the
ranges before it, so a range is cut for every place at which a piece could first start in it: these chains meet
after a few pieces, and its boundary table is short, with one row per run of starts that share their end (where
that end is, where the chain leaves the range, and with how many pieces).  The tables of a text are stitched in order:
prefix sums of lengths and of pieces, and one look-up a range, say where the text enters each.  Ranges then
emit their own pieces as offsets, each for itself.  No step holds a whole file, nor all boundaries of one text: what is
stitched in one task are the runs of a text's ranges, of 16 bytes, at most one for each boundary within a capacity.

Boundaries have a bounded context (a sentence's closing sign followed by ``CONTEXT`` blanks ends it whatever
comes after them), so ranges of any size give the same pieces as the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, small

SPAN = 4  # capacities in one range of a text in a table
CONTEXT = 64  # blanks that are looked over after a closing sign
HALO = CONTEXT + 8

# A boundary is the place where the first character of the rest stands.
_SENTENCE = re.compile(
    rf"[.!?][\"'”’»)\]]{{0,3}}(?=\s{{1,{CONTEXT}}}[^\sa-zà-öø-ÿ]|\s{{{CONTEXT}}}|\s{{0,{CONTEXT}}}\Z)|[。！？][」』）]{{0,2}}"
)


class _Kinds:
    """Whether a code point is a blank (1), a letter or digit (2) or neither (0); filled by pages of 4,096 as they are met."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint8)
        self.known: set[int] = set()

    def of(self, codes: np.ndarray) -> np.ndarray:
        for page in np.unique(codes >> 12).tolist():
            if page not in self.known:
                signs = map(chr, range(page << 12, (page + 1) << 12))
                self.table[page << 12 : (page + 1) << 12] = [1 if c.isspace() else 2 * c.isalnum() for c in signs]
                self.known.add(page)
        return self.table[codes]


_KINDS = _Kinds()


def boundaries(text: str, start: int = 0, stop: int | None = None, shift: int = 0) -> list[np.ndarray]:
    """Places of paragraph, sentence, blank and sign boundaries after ``start`` and up to ``stop`` of ``text``, plus ``shift``."""
    stop = len(text) if stop is None else stop
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, feed = _KINDS.of(codes), codes == 10
    ends = np.r_[feed[:-1] & ~feed[1:], feed[-1:]]
    blank, word = kind == 1, kind == 2
    found = [
        np.flatnonzero(ends) + 1,
        np.fromiter((m.end() for m in _SENTENCE.finditer(text)), np.int64),
        np.flatnonzero(~blank[:-1] & blank[1:]) + 1,
        np.flatnonzero(word[:-1] & ~word[1:]) + 1,
    ]
    return [f[(f > start) & (f <= stop)] + shift for f in found]


class Cutter:
    """Where pieces end, over the boundaries of a stretch of text; ``total`` is where the text itself ends, if that is in the stretch."""

    def __init__(self, marks: list[np.ndarray], length: int, total: int | None, capacity: int, overlap: int):
        if not 0 <= overlap < capacity:
            raise ValueError("the overlap must be smaller than the capacity")
        self.capacity, self.overlap = capacity, overlap
        self.total = total if total is not None else 1 << 62
        self.last = []
        for m in marks:  # the last boundary up to each place
            at = np.zeros(length + 1, np.int64)
            at[m] = m
            self.last.append(np.maximum.accumulate(at))

    def ends(self, start: np.ndarray) -> np.ndarray:
        """The end of the piece that begins at each start; negative where it is the text's last."""
        out = np.full(len(start), -self.total)
        open_ = np.flatnonzero(start + self.capacity < self.total)
        s = start[open_]
        room, least = s + self.capacity, s + self.overlap
        half = np.maximum(least, s + self.capacity // 2)
        end = room.copy()
        for kind, above in ((3, least), (2, least), (1, least), (0, least), (1, half), (0, half)):  # the first choice comes last
            m = self.last[kind][room]
            end = np.where(m > above, m, end)
        out[open_] = end
        return out


def cut(length: int, marks: list[np.ndarray], capacity: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text of that length, in one go: what the ranges must give."""
    cutter, out, start = Cutter(marks, length, length, capacity, overlap), [], 0
    while (end := int(cutter.ends(np.array([start]))[0])) > 0:
        out.append((start, end))
        start = end - overlap
    out.append((start, length))
    return out


def range_table(cutter: Cutter, own: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The boundary table of a range of ``own`` characters, places relative to its start.

    Runs (4 rows): start of the run, its piece's end, the first start behind the range (-1: the text ends), pieces until then.
    Nodes (2 rows): starts of further pieces in the range, and their ends.  Ends are negative where the text ends.
    """
    overlap = cutter.overlap
    start = np.arange(1 if first else min(own, cutter.capacity - overlap))
    end = cutter.ends(start)
    new = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
    off, end = start[new], end[new]
    nodes: dict[int, int] = {}
    todo = np.unique(end[end > 0] - overlap)
    while len(todo := todo[todo < own]):
        ends = cutter.ends(todo)
        nodes |= zip(todo.tolist(), ends.tolist(), strict=True)
        todo = np.unique(ends[ends > 0] - overlap)
        todo = todo[[x not in nodes for x in todo.tolist()]] if len(todo) else todo
    leaves: dict[int, tuple[int, int]] = {}

    def leave(e: int) -> tuple[int, int]:
        return (-1, 1) if e < 0 else (e - overlap, 1) if e - overlap >= own else (leaves[e - overlap][0], leaves[e - overlap][1] + 1)

    places = sorted(nodes)
    for p in reversed(places):
        leaves[p] = leave(nodes[p])
    out = [leave(e) for e in end.tolist()]
    return np.array([off, end, [x for x, _ in out], [n for _, n in out]], np.int32), np.array([places, [nodes[p] for p in places]], np.int32).reshape(2, -1)


def walk(runs: np.ndarray, nodes: np.ndarray, entry: int, own: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a range's pieces when the text enters it at ``entry``."""
    further = dict(zip(nodes[0].tolist(), nodes[1].tolist(), strict=True))
    start, end = entry, int(runs[1][np.searchsorted(runs[0], entry, "right") - 1])
    while True:
        yield start, abs(end)
        if end < 0 or end - overlap >= own:
            return
        start, end = end - overlap, further[end - overlap]


_TABLES = "own long, key string, i int, n int, runs binary, nodes binary"
_ENTRIES = "own long, i int, at long, entry int, piece int"
_PIECES = "key string, piece int, start_pos long, end_pos long"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _stitched(tables: DataFrame, capacity: int, overlap: int) -> DataFrame:
    """Pieces from the written boundary tables of ranges."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for own, ranges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = place = piece = 0
                for r in sorted(ranges, key=lambda r: r["i"]):
                    if place is not None and place < at + r["n"]:
                        runs = np.frombuffer(r["runs"], np.int32).reshape(4, -1)
                        k = np.searchsorted(runs[0], place - at, "right") - 1
                        rows.append((own, r["i"], at, place - at, piece))
                        place = at + int(runs[2, k]) if runs[2, k] >= 0 else None
                        piece += int(runs[3, k])
                    at += r["n"]
            if rows:
                yield _batch(rows, _ENTRIES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for key, n, runs, nodes, at, entry, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = walk(np.frombuffer(runs, np.int32).reshape(4, -1), np.frombuffer(nodes, np.int32).reshape(2, -1), entry, n, overlap)
                rows += [(key, piece + k, at + s, at + e) for k, (s, e) in enumerate(own)]
            if rows:
                yield _batch(rows, _PIECES)

    per_text = tables.groupBy("own").agg(F.collect_list(F.struct("i", "n", "runs")).alias("ranges"))  # one short table a range
    entries = per_text.mapInArrow(enter, _ENTRIES)
    return tables.join(entries, ["own", "i"]).select("key", "n", "runs", "nodes", "at", "entry", "piece").mapInArrow(emit, _PIECES)


def pieces(texts: DataFrame, key: str, text: str, capacity: int, overlap: int, size: int | None = None) -> DataFrame:
    """(key, piece, start_pos, end_pos) of every non-empty text; ends are exclusive, keys as strings, other columns left out.

    Equal keys are texts of their own.  ``size`` is the number of characters in a range, ``SPAN`` capacities if not given.
    """
    size = size or SPAN * capacity
    slim = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.length(text).alias("n")).filter("n > 0")
    zero = F.lit(0)
    short = slim.filter(F.col("n") <= capacity).select("key", zero.alias("piece"), zero.cast("long").alias("start_pos"), F.col("n").cast("long").alias("end_pos"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for own, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, a in enumerate(range(0, len(t), size)):
                    n, reach, low = min(size, len(t) - a), min(size + capacity, len(t) - a), max(0, a - HALO)
                    marks = boundaries(t[low : a + reach + HALO], a - low, a - low + reach, low - a)
                    cutter = Cutter(marks, reach, len(t) - a if a + reach == len(t) else None, capacity, overlap)
                    rows.append((own, k, i, n, *(x.tobytes() for x in range_table(cutter, n, i == 0))))
            if rows:
                yield _batch(rows, _TABLES)

    long = slim.filter(F.col("n") > capacity).select(F.monotonically_increasing_id().alias("own"), "key", "text")
    return short.unionByName(_stitched(kept(long.mapInArrow(mark, _TABLES)), capacity, overlap))


def file_pieces(spark: SparkSession, paths: list[str], capacity: int, overlap: int, size: int = 1 << 24) -> DataFrame:
    """(key, piece, start_pos, end_pos) of UTF-8 files, in characters; no task reads more than ``size`` bytes and two halos of a file.

    A range owns the characters whose first byte is in it.  Their number in each range, summed up, places its pieces in
    the whole file.  A file that can't be read fails the query; bytes that are no UTF-8 count as one character each.
    """
    from pyarrow import fs

    ranges = []
    for own, path in enumerate(paths):
        where, inner = fs.FileSystem.from_uri(path)
        n = where.get_file_info(inner).size
        if n is None:
            raise FileNotFoundError(path)
        ranges += [(own, path, i, a, min(n, a + size)) for i, a in enumerate(range(0, n, size))]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in small(batches):
            rows = []
            for own, path, i, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where, inner = fs.FileSystem.from_uri(path)
                with where.open_input_file(inner) as f:
                    low, high = max(0, start - 4 * HALO), min(stop + 4 * (capacity + HALO + 1), f.size())
                    raw, whole = f.read_at(high - low, low), high == f.size()
                a, z = (next((k for k in range(p - low, min(p - low + 4, len(raw))) if raw[k] & 0xC0 != 0x80), p - low) for p in (start, stop))
                before, text, after = (x.decode("utf-8", "surrogateescape") for x in (raw[:a], raw[a:z], raw[z:]))
                if not text:
                    continue
                reach = min(len(text) + len(after), len(text) + capacity)
                marks = boundaries(before + text + after[: capacity + HALO], len(before), len(before) + reach, -len(before))
                cutter = Cutter(marks, reach, len(text) + len(after) if whole and reach == len(text) + len(after) else None, capacity, overlap)
                rows.append((own, path, i, len(text), *(x.tobytes() for x in range_table(cutter, len(text), i == 0))))
            if rows:
                yield _batch(rows, _TABLES)

    spread = spark.createDataFrame(ranges, "own long, path string, i int, a long, z long").repartition(max(1, len(ranges)), "own", "i")
    return _stitched(kept(spread.mapInArrow(mark, _TABLES)), capacity, overlap)
