"""Problem 4: filling containers of fixed capacity with items that aren't divided.

Only the histogram of lengths matters, which has at most ``capacity`` entries whatever the number of items.  The
configuration linear program over it (how many containers of which pattern of exact lengths) is solved by
multiplicative weights: a length's weight is its size, times a factor that falls as its items get placed; a
knapsack dynamic program over a block of the lengths placed least so far prices patterns, led by each of them, the
longest first; each that comes within ``NEAR`` of the dearest is used for the largest whole number of containers by which
no length in it moves on by more than ``STEP`` of its items (one container at least).  So the solution is rounded as it is built: a step is a
fraction of the program's solution rounded down to whole containers, nothing is left over to another method, and
every item is placed by a priced pattern.

Each setting's program is one task of a Spark job, on a group of at most ``capacity`` rows.  Its result is a table of
intervals (items of a length, by rank, to container numbers), joined back to the items.  Items get their
rank by a window per length and salt, so that a length held by a third of all items has no task of its own.

Null and empty items are in no container.  An item above the capacity is divided into whole
containers and a rest, which is packed like any other item.  Equal items are told apart by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import kept

STEP = 0.25  # share of a length's items that one pricing may place
LEAN = 0.2  # how much less a length weighs once its items are placed
NEAR = 0.1  # how far from the dearest pattern a pattern may stay
GAP = 0.0005  # how much of a container a block of lengths may leave unused before a larger one is priced
TABLE = 400_000  # entries of a knapsack's table: lengths in a block times capacity
LEAST_BLOCK = 16
SALT_ROWS = 200_000


class Knapsack:
    """The dearest patterns for every room up to the capacity; a length is in one at most ``most`` times."""

    def __init__(self, size: np.ndarray, value: np.ndarray, most: np.ndarray, room: int):
        self.steps: list[tuple[int, int, int]] = []
        for i, (w, n) in enumerate(zip(size.tolist(), np.minimum(most, room // size).tolist(), strict=True)):
            part = 1
            while n > 0:  # n as a sum of powers of two and a rest
                part = min(part, n)
                self.steps.append((i, part, w * part))
                n, part = n - part, part * 2
        self.best = np.zeros(room + 1, np.float32)
        self.better = np.zeros((len(self.steps), room + 1), bool)
        for k, (i, part, w) in enumerate(self.steps):
            new, old = self.best[: room + 1 - w] + np.float32(value[i] * part), self.best[w:]
            np.greater(new, old + np.float32(1e-3), out=self.better[k, w:])
            np.maximum(old, new, out=old)

    def pattern(self, room: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, how many of each) of the dearest pattern for that room, with one of ``first`` added."""
        out, k = {} if first is None else {first: 1}, len(self.steps)
        while k and room:
            back = self.better[:k, room][::-1].argmax()
            if not self.better[k - 1 - back, room]:
                break
            k -= 1 + back
            i, part, w = self.steps[k]
            out[i] = out.get(i, 0) + part
            room -= w
        return np.fromiter(out, np.int64, len(out)), np.fromiter(out.values(), np.int64, len(out))


def program(length: np.ndarray, count: np.ndarray, capacity: int, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(containers, lengths by their place in ``length``, how many of each in one container) until every item is placed."""
    rng, left = np.random.default_rng(seed), count.astype(np.int64)
    step = np.maximum(1, (STEP * count).astype(np.int64))
    block = usual = max(LEAST_BLOCK, TABLE // capacity)
    while left.any():
        some = np.flatnonzero(left)
        placed = 1 - left[some] / count[some]
        whole = len(some) <= block
        if not whole:  # those placed least, in steps
            some = np.sort(some[np.lexsort((rng.random(len(some)), np.floor(placed / STEP)))[:block]])
            placed = 1 - left[some] / count[some]
        size = length[some]
        weight = size * np.exp(-LEAN * (placed - placed.min()))
        sack = Knapsack(size, weight, np.minimum(left[some], step[some]), capacity)
        own, per = sack.pattern(capacity)
        if not whole and (size[own] * per).sum() < (1 - GAP) * capacity:
            block *= 2  # these lengths can't fill a container: price more of them
            continue
        block, dearest, moved, used = usual, (weight[own] * per).sum(), np.zeros(len(some), np.int64), False
        for lead in [*np.argsort(-size, kind="stable").tolist(), None]:  # the longest first, as they are the hardest to place
            if lead is not None:
                if moved[lead] or not left[some[lead]]:
                    continue
                own, per = sack.pattern(capacity - int(size[lead]), lead)
                if moved[own].any() or (weight[own] * per).sum() < (1 - NEAR) * dearest:
                    continue
            elif used:
                break
            else:
                own, per = sack.pattern(capacity)
            n = int((np.minimum(left[some[own]], np.maximum(step[some[own]], per)) // per).min())
            if n > 0:
                left[some[own]] -= n * per
                moved[own] += n * per
                used = True
                yield n, some[own], per


def configurations(length: np.ndarray, count: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, shift, per container, first container).

    An item of that length and rank goes to container ``first + (rank + shift) // per``.
    """
    length, taken = np.asarray(length, np.int64), np.zeros(len(length), np.int64)
    rows, base = [], 0
    for n, own, per in program(length, np.asarray(count), capacity):
        before = taken[own]
        taken[own] += n * per
        rows += zip(length[own].tolist(), before.tolist(), taken[own].tolist(), (-before).tolist(), per.tolist(), [base] * len(own), strict=True)
        base += n
    return rows


_INTERVALS = "setting string, n int, lo long, hi long, shift long, per long, base long"


def _solved(group: pd.DataFrame) -> pd.DataFrame:
    setting, capacity = group["setting"].iloc[0], int(group["capacity"].iloc[0])
    group = group.sort_values("n")
    rows = configurations(group["n"].to_numpy(), group["times"].to_numpy(), capacity)
    return pd.DataFrame([(setting, *r) for r in rows], columns=[x.split()[0] for x in _INTERVALS.split(", ")])


def packed_all(items: DataFrame, item_id: str, text: str, capacities: dict[str, int]) -> DataFrame:
    """(setting, item_id, piece, start_pos, end_pos, container): where each item, or each part of one above the capacity, goes in each setting."""
    sizes = kept(items.select(F.col(item_id).alias("item_id"), F.length(text).alias("n")).filter("n > 0"))
    settings = F.array(*(F.struct(F.lit(s).alias("setting"), F.lit(c).alias("capacity")) for s, c in capacities.items()))
    each = sizes.select("item_id", "n", F.explode(settings).alias("s")).select("item_id", "n", "s.*")
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("capacity")).cast("int"))))
    start, end = F.col("piece") * F.col("capacity"), F.least("n", (F.col("piece") + 1) * F.col("capacity"))
    each = each.select("setting", "capacity", "item_id", "piece", start.alias("start_pos"), end.alias("end_pos"), (end - start).alias("n"))
    histogram = kept(each.groupBy("setting", "capacity", "n").agg(F.count("*").alias("times")))  # at most one row for each length up to the capacity
    apart = histogram.repartitionByRange(len(capacities), "setting")  # else the settings, being small, share a task
    intervals = kept(apart.groupBy("setting").applyInPandas(_solved, _INTERVALS))
    salts = max(1, (histogram.agg(F.max("times")).first()[0] or 0) // SALT_ROWS)
    salted = each.withColumn("salt", F.pmod(F.xxhash64("item_id", "piece"), F.lit(salts)))
    before = salted.groupBy("setting", "n", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("setting", "n").orderBy("salt")) - F.col("count"))
    own = Window.partitionBy("setting", "n", "salt").orderBy("item_id", "piece")
    ranked = salted.withColumn("r", F.row_number().over(own) - 1).join(before.select("setting", "n", "salt", "before"), ["setting", "n", "salt"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("before"))
    # a pattern uses up a step of one of its lengths, so there are some 6 patterns a length, whatever the number of items
    placed = ranked.join(F.broadcast(intervals), ["setting", "n"]).filter((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    container = F.col("base") + F.expr("(r + shift) div per")
    return placed.select("setting", "item_id", "piece", "start_pos", "end_pos", container.alias("container"))


def packed(items: DataFrame, item_id: str, text: str, capacity: int) -> DataFrame:
    """(item_id, piece, start_pos, end_pos, container) for one capacity."""
    return packed_all(items, item_id, text, {"": capacity}).drop("setting")
