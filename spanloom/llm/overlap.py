"""Problem 1: the same or nearly the same records in evaluation and training splits.

Records become sequences of word codes of 64 bits (words as read, in lower case).  Equal records are one class, joined by the
hash of the whole canonical sequence.  Records that differ in up to a fifth of
the words are found exactly, without sampling: with ``d`` edits allowed, any ``d + e``
disjoint word pairs of the evaluation record leave at least ``e`` of them whole in its
partner, at nearly the same place.  The rarest disjoint pairs of each evaluation class
("pivots") form an index, written to the shared folder in blocks of bounded size, each of one range of lengths;
training records of lengths that can match a block are streamed against it, and what shares enough pivots is verified
by the edit distance itself.  A text met before in the same task isn't matched again.

The result of the search is pairs of classes.  Counts come from classes and their sizes; only where pairs of records are
asked for are classes expanded, and then in salted cells of at most ``CELL`` by ``CELL`` records.

Null and empty texts, and texts under ``MIN_WORDS`` words, take part in nothing.  A title found in both splits counts
for both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asread import words
from .shared import kept, small

MIN_WORDS = 10
EXTRA = 3  # pivots beyond the edits allowed; a pair must share at least so many
SLOTS = 1 << 15  # counters of word pairs; their noise only makes the choice of pivots less good
BLOCK_WORDS = 4_000_000  # words of evaluation records in one block of the index: some 100 MB of a worker
BAND = 1.1  # lengths within this factor stay together when blocks are cut
CELL = 2000  # members of a class that meet members of another in one cell
SEEN = 100_000  # texts that a task remembers having matched
HITS = 2_000_000  # pivots met by training records that are worked on at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


_CODES = _Codes()

CODED = pa.schema(
    [("rec_id", pa.int64()), ("part", pa.string()), ("source", pa.string()), ("n", pa.int32()), ("h", pa.binary()), ("seq", pa.binary())]
)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = []
        for rec, part, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            w = words(text)
            if len(w) >= MIN_WORDS:
                seq = np.fromiter(map(_CODES.__getitem__, w), np.uint64, len(w)).tobytes()
                rows.append((rec, part, source, len(w), xxhash.xxh3_128_digest(seq), seq))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CODED, strict=True)], schema=CODED)


def coded_records(records: DataFrame, text: str, rec_id: str, part: str, source: str) -> DataFrame:
    """(rec_id, part, source, n, h, seq) of every record with enough words; any other columns are left out."""
    slim = records.select(F.col(rec_id).cast("long"), F.col(part).cast("string"), F.col(source).cast("string"), F.col(text).cast("string"))
    return slim.mapInArrow(_code, "rec_id long, part string, source string, n int, h binary, seq binary")


def _grams(codes: np.ndarray) -> np.ndarray:
    """A hash for each pair of neighbouring words, in 44 bits."""
    x = (codes[:-1] * _MIX) ^ codes[1:]
    x ^= x >> np.uint64(29)
    return (x * _MIX) >> np.uint64(20)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for b in small(batches):
        grams = [_grams(np.frombuffer(seq, np.uint64)) for seq in b.column(0).to_pylist()]
        total += np.bincount((np.concatenate(grams) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "seen"])


def pivots(codes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of the rarest disjoint word pairs, ``n // 4 + EXTRA`` of them (or all that fit)."""
    n = len(codes)
    k = min(n // 4 + EXTRA, n // 2)
    rarity = seen[(_grams(codes) % np.uint64(SLOTS)).astype(np.int64)]
    taken, out = bytearray(n), []
    for i in np.argsort(rarity, kind="stable").tolist():
        if not (taken[i] or taken[i + 1]):
            taken[i] = taken[i + 1] = 1
            out.append(i)
            if len(out) == k:
                break
    if len(out) < k:  # too scattered a choice: every second place instead
        grid = np.arange(0, n - 1, 2)
        out = grid[np.argsort(rarity[grid], kind="stable")[:k]].tolist()
    return np.array(out, np.int64)


def _pivoted(seen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            h, seq, block = (b.column(i) for i in range(3))
            at = [pivots(np.frombuffer(s, np.uint64), seen).astype(np.int32).tobytes() for s in seq.to_pylist()]
            yield pa.RecordBatch.from_arrays([h, seq, pa.array(at, pa.binary()), block], names=["h", "seq", "at", "block"])

    return run


_BITS = 23
_LOW = (1 << _BITS) - 1


class _Block:
    """Pivots of one block, sorted by word pair and length."""

    def __init__(self, path: str):
        from pyarrow import fs, parquet

        where, inner = fs.FileSystem.from_uri(path)
        t = parquet.read_table(inner, filesystem=where, columns=["h", "seq", "at"], partitioning=None)
        self.h = t.column("h").to_pylist()
        by_length = pc.sort_indices(pc.binary_length(t.column("seq")))  # a record's partners are neighbours
        t, self.row = t.take(by_length), by_length.to_pylist()
        self.seq = [np.frombuffer(s, np.uint64) for s in t.column("seq").to_pylist()]
        self.n = np.array([len(s) for s in self.seq], np.int64)
        at = [np.frombuffer(a, np.int32) for a in t.column("at").to_pylist()]
        self.k = np.array([len(a) for a in at], np.int64)
        own = np.repeat(np.arange(len(at)), self.k)
        pos = np.concatenate(at) if at else np.zeros(0, np.int32)
        key = np.concatenate([_grams(s)[a] for s, a in zip(self.seq, at, strict=True)]) if at else np.zeros(0, np.uint64)
        key = key << np.uint64(20) | np.minimum(self.n[own], (1 << 20) - 1).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.own, self.pos = key[order], own[order].astype(np.int32), pos[order].astype(np.int32)
        self.present = np.zeros(1 << _BITS, bool)  # whether any pivot has these bits: most pairs of a record are in none
        self.present[(key >> np.uint64(20)).astype(np.int64) & _LOW] = True
        self.sketch: dict[int, int] = {}
        self.bags: dict[int, np.ndarray] = {}


_LAST: dict[str, _Block] = {}


def _block(path: str) -> _Block:
    if path not in _LAST:
        _LAST.clear()
        _LAST[path] = _Block(path)
    return _LAST[path]


def _sketch(codes: np.ndarray) -> int:
    out = np.zeros(512, np.uint8)
    out[codes % 512] = 1
    return int.from_bytes(np.packbits(out).tobytes(), "little")


def _bag(codes: np.ndarray) -> np.ndarray:
    """The words as a sorted set in which the second, third and further uses of a word are words of their own."""
    x = np.sort(codes)
    at = np.arange(len(x))
    first = np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]][: len(x)], at, 0))
    return np.sort(x + (at - first).astype(np.uint64) * _MIX)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common of two bags, each as often as both have it."""
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Words to insert, delete or replace, by Myers' bit vectors; ``limit + 1`` stands for anything above."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if len(b) - m > limit:
        return limit + 1
    if not m:
        return len(b)
    peq: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left = full, 0, m, len(b)
    for w in b.tolist():
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        left -= 1
        if score - left > limit:
            return limit + 1
    return score


def _match(codes: list[np.ndarray], block: _Block, size: int = HITS) -> Iterator[tuple[int, int, int, int]]:
    """(which of codes, which of the block, edits, edits allowed) of every near pair, once."""
    m = np.array([len(c) for c in codes], np.int64)
    gram = np.concatenate([_grams(c) for c in codes])
    who = np.repeat(np.arange(len(codes)), m - 1)
    where = np.concatenate([np.arange(x - 1) for x in m])
    some = np.flatnonzero(block.present[gram.astype(np.int64) & _LOW])
    gram, who, where = gram[some] << np.uint64(20), who[some], where[some]
    low, high = np.minimum(-(-4 * m // 5), (1 << 20) - 1), np.minimum(5 * m // 4 + 1, (1 << 20) - 1)
    lo = np.searchsorted(block.key, gram | low[who].astype(np.uint64), "left")
    hi = np.searchsorted(block.key, gram | high[who].astype(np.uint64), "right")
    hit = np.flatnonzero(hi > lo)
    lo, hi, who, where = lo[hit], hi[hit], who[hit], where[hit]
    ends = np.cumsum(hi - lo)

    shift = (lo - (ends - (hi - lo))).astype(np.int64)
    first, last = np.searchsorted(block.n, [-(-4 * m.min() // 5), 5 * m.max() // 4 + 2])  # the partners that these lengths may have
    span = max(1, int(last - first))
    place, far = where.astype(np.int32), (m[who] // 4 + 1).astype(np.int32)  # no pair allows more edits than that

    def hits(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, begin = (hi - lo)[a:b], ends[a - 1] if a else 0
        row = np.repeat(np.arange(a, b, dtype=np.int32), n)
        flat = np.arange(begin, ends[b - 1]) + shift[row]
        ok = np.flatnonzero(np.abs(place[row] - block.pos[flat]) <= far[row])
        row, flat = row[ok], flat[ok]
        t, j, e = who[row], block.pos[flat].astype(np.int64), block.own[flat]
        d = np.maximum(m[t], block.n[e]) // 5
        ok = np.flatnonzero((np.abs(place[row] - j) <= d) & (np.abs(m[t] - block.n[e]) <= d))
        t, e = t[ok], e[ok]
        return t * span + (e - first), j[ok], block.k[e] - d[ok]

    for a, b in _slices(ends, who, size):
        # each pivot of a record counts once for a partner, however often its words recur there
        if ends[b - 1] - (ends[a - 1] if a else 0) <= size:
            pair, pivot, spare = hits(a, b)
            ok = np.flatnonzero(np.bincount(pair, minlength=1)[pair] >= spare)
            once = _distinct(pair[ok] << 32 | pivot[ok])
        else:  # one record: what is kept of all its slices is at most the block's pivots, and is counted only when complete
            once = np.zeros(0, np.int64)
            for x, y in _slices(ends[a:b] - (ends[a - 1] if a else 0), np.arange(b - a), size):
                pair, pivot, _ = hits(a + x, a + y)
                once = _distinct(np.r_[once, pair << 32 | pivot])
        once >>= 32
        begin = np.flatnonzero(np.r_[True, once[1:] != once[:-1]][: len(once)])
        pair, shared = once[begin], np.diff(np.r_[begin, len(once)])
        t, e = pair // span, pair % span + first
        d = np.maximum(m[t], block.n[e]) // 5
        sketches: dict[int, int] = {}
        bags: dict[int, np.ndarray] = {}
        for x, y, limit in zip(*(v[shared >= block.k[e] - d].tolist() for v in (t, e, d)), strict=True):
            if x not in sketches:
                sketches[x] = _sketch(codes[x])
            if y not in block.sketch:
                block.sketch[y] = _sketch(block.seq[y])
            p, q = sketches[x], block.sketch[y]
            if (p & ~q).bit_count() <= limit and (q & ~p).bit_count() <= limit:
                if x not in bags:
                    bags[x] = _bag(codes[x])
                if y not in block.bags:
                    block.bags[y] = _bag(block.seq[y])
                if max(len(codes[x]), len(block.seq[y])) - _common(bags[x], block.bags[y]) <= limit:
                    edits = edit_distance(codes[x], block.seq[y], limit)
                    if edits <= limit:
                        yield x, block.row[y], edits, limit


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]


def _slices(ends: np.ndarray, who: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, cut only where ``who`` changes, of ``size`` matches at most, or of a single one of ``who``."""
    last = np.flatnonzero(np.r_[who[1:] != who[:-1], True][: len(who)]) + 1  # where each one's rows end
    a, k = 0, 0
    while k < len(last):
        k = max(k + 1, int(np.searchsorted(ends[last - 1], (ends[a - 1] if a else 0) + size, "right")))
        yield a, int(last[k - 1])
        a = int(last[k - 1])


NEAR = pa.schema([("corpus_h", pa.binary()), ("query_h", pa.binary()), ("edits", pa.int32())])
CLASSES = "corpus_h binary, query_h binary, edits int"


def _near(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        block = None
        for b in small(batches, 2048):
            block = block or _block(path)
            if len(seen) > SEEN:
                seen.clear()
            own, some = [], []
            for h, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    own.append(h)
                    some.append(np.frombuffer(seq, np.uint64))
            order = np.argsort([len(c) for c in some], kind="stable").tolist() if len(block.key) else []
            found = []
            for at in range(0, len(order), 64):  # of nearly one length, so their partners are few of the block
                now = order[at : at + 64]
                found += [(own[now[x]], block.h[y], d) for x, y, d, _ in _match([some[i] for i in now], block) if d]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), NEAR, strict=True)], schema=NEAR)

    return run


def _ranges(words: dict[int, int]) -> list[tuple[int, int, int]]:
    """(first band, last band, blocks) so that no block has many more than ``BLOCK_WORDS`` of the bands' words; only a single band is cut further."""
    out: list[tuple[int, int, int]] = []
    total = 0
    for band in sorted(words):
        if out and total + words[band] <= BLOCK_WORDS:
            out[-1] = (out[-1][0], band, 1)
            total += words[band]
        else:
            out.append((band, band, -(-words[band] // BLOCK_WORDS)))
            total = words[band]
    return out


def cross_split_classes(coded: DataFrame, query: str = "test", corpus: str = "train") -> DataFrame:
    """(corpus_h, query_h, edits) of every pair of texts, one of each part, within a fifth of the longer one's words; equal ones have 0 edits.

    ``coded`` comes from ``coded_records`` and should be a written table, as it is read several times.
    """
    ours, theirs = coded.filter(F.col("part") == query), coded.filter(F.col("part") == corpus)
    both = ours.select("h").intersect(theirs.select("h"))
    exact = both.select(F.col("h").alias("corpus_h"), F.col("h").alias("query_h"), F.lit(0).alias("edits"))
    band = F.floor(F.log("n") / np.log(BAND)).cast("int")
    sizes = {r.band: r.words for r in ours.groupBy(band.alias("band")).agg(F.sum("n").alias("words")).collect()}  # one row a band of lengths
    if not sizes:
        return exact
    seen = np.zeros(SLOTS, np.int64)
    for r in theirs.select("seq").mapInArrow(_count, "slot long, seen long").groupBy("slot").agg(F.sum("seen").alias("seen")).toLocalIterator():
        seen[r.slot] = r.seen  # one row for each of the SLOTS counters at most
    ranges = _ranges(sizes)
    block = reduce(lambda c, r: c.when(band.between(r[1][0], r[1][1]), F.concat(F.lit(f"{r[0]}-"), F.pmod(F.xxhash64("h"), F.lit(r[1][2])).cast("string"))), enumerate(ranges), F)
    blocks = sum(r[2] for r in ranges)
    distinct = ours.select("h", "n", "seq").dropDuplicates(["h"]).select("h", "seq", block.alias("block"))
    pivoted = distinct.repartition(max(6, blocks), "block", F.pmod(F.xxhash64("h"), F.lit(6))).mapInArrow(_pivoted(seen), "h binary, seq binary, at binary, block string")
    index = kept(pivoted, "block")
    have = {r.block for r in index.select("block").distinct().collect()}
    near = []
    for i, (first, last, k) in enumerate(ranges):
        fits = theirs.filter((F.col("n") >= int(0.8 * BAND**first) - 1) & (F.col("n") <= int(1.25 * BAND ** (last + 1)) + 2)).select("h", "seq")
        near += [fits.mapInArrow(_near(f"{index.kept_at}/block={i}-{j}"), CLASSES) for j in range(k) if f"{i}-{j}" in have]
    return reduce(DataFrame.unionByName, near, exact).distinct()


def class_members(coded: DataFrame) -> DataFrame:
    """(part, h, members): how many records of each part have each text."""
    return coded.groupBy("part", "h").agg(F.count("*").alias("members"))


def expanded(classes: DataFrame, coded: DataFrame, query: str = "test", corpus: str = "train") -> DataFrame:
    """(query_id, corpus_id, edits) of every pair of records of each pair of classes, made in cells of at most some ``CELL`` by ``CELL``."""
    sizes = class_members(coded).withColumn("cells", F.ceil(F.col("members") / CELL).cast("int"))
    out = classes
    for side, part in (("query", query), ("corpus", corpus)):
        own = sizes.filter(F.col("part") == part).select(F.col("h").alias(f"{side}_h"), F.col("cells").alias(f"{side}_cells"))
        out = out.join(own, f"{side}_h")
    cell = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_cells") - 1)).alias(f"{side}_cell")
    cells = kept(out.select("*", cell("query")).select("*", cell("corpus")))
    key = ["corpus_h", "query_h", "edits", "query_cell", "corpus_cell"]
    sides = []
    for side, part in (("query", query), ("corpus", corpus)):
        members = coded.filter(F.col("part") == part).select(F.col("h").alias(f"{side}_h"), F.col("rec_id").alias(f"{side}_id"))
        placed = members.join(cells.select(f"{side}_h", f"{side}_cells").distinct(), f"{side}_h")
        placed = placed.select(f"{side}_h", f"{side}_id", F.pmod(F.xxhash64(f"{side}_id"), F.col(f"{side}_cells")).cast("int").alias(f"{side}_cell"))
        sides.append(placed.join(cells.select(*key), [f"{side}_h", f"{side}_cell"]))
    return sides[0].join(sides[1], key).select("query_id", "corpus_id", "edits")


def cross_split_pairs(coded: DataFrame, query: str = "test", corpus: str = "train") -> DataFrame:
    """(query_id, corpus_id, edits) of every pair of records of the two parts within a fifth of the longer one's words."""
    return expanded(kept(cross_split_classes(coded, query, corpus)), coded, query, corpus)


def overlap_counts(coded: DataFrame, classes: DataFrame, query: str = "test", corpus: str = "train") -> DataFrame:
    """(split, source, records, with_equal, with_near, pairs): from classes and their sizes, never from pairs of records.

    A record that is in both parts is no partner of its own.
    """
    parts = coded.groupBy("rec_id").agg(F.countDistinct("part").alias("parts")).filter("parts > 1").select("rec_id", F.lit(1).alias("self"))
    grouped = coded.join(parts, "rec_id", "left").groupBy("part", "h", "source", F.coalesce("self", F.lit(0)).alias("self")).agg(F.count("*").alias("records"))
    sizes, each = class_members(coded), None
    for part, own, other, theirs in ((query, "query_h", "corpus_h", corpus), (corpus, "corpus_h", "query_h", query)):
        partners = classes.join(sizes.filter(F.col("part") == theirs).select(F.col("h").alias(other), "members"), other)
        per = partners.groupBy(F.col(own).alias("h")).agg(
            F.sum(F.when(F.col("edits") == 0, F.col("members")).otherwise(0)).alias("equal"), F.sum(F.when(F.col("edits") > 0, F.col("members")).otherwise(0)).alias("near")
        )
        rows = grouped.filter(F.col("part") == part).join(per, "h", "left").fillna(0, ["equal", "near"]).withColumn("equal", F.col("equal") - F.least("equal", "self"))
        each = rows if each is None else each.unionByName(rows)
    some = lambda c: F.sum(F.when(F.col(c) > 0, F.col("records")).otherwise(0))
    return each.groupBy(F.col("part").alias("split"), "source").agg(
        F.sum("records").alias("records"), some("equal").alias("with_equal"), some("near").alias("with_near"), F.sum(F.col("records") * (F.col("equal") + F.col("near"))).alias("pairs")
    )


def split_paragraphs(paras: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Paragraphs with the part their contract's title is in; those of neither are left out."""
    sides = train.select("title", F.lit("train").alias("part")).unionByName(test.select("title", F.lit("test").alias("part")))
    sides = sides.filter(F.col("title").isNotNull()).distinct()
    return paras.select("para_id", "title", "source", "text").join(sides, "title")
