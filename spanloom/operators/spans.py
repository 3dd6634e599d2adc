"""Span algebra on DataFrames.  Ends are inclusive unless a name says otherwise.

All sweeps are windows over a key (a document), so a plan has one shuffle by that key and reuses it.
Rows with a null position are left out; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    """The part two inclusive spans share; nulls when they share nothing."""
    lo, hi = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(lo <= hi, lo), F.when(lo <= hi, hi)


def within(inner_start: Column, inner_end: Column, start: Column, end: Column) -> Column:
    return (inner_start >= start) & (inner_end <= end)


def union(spans: DataFrame, key: str | list[str], start: str, end: str) -> DataFrame:
    """Spans with exclusive ends united where they overlap or touch: (key, start, end)."""
    keys = [key] if isinstance(key, str) else key
    rows = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    grouped = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def complement(spans: DataFrame, lengths: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """Non-empty parts of each document outside its spans (exclusive ends); a document without spans is one part."""
    united = union(spans, key, start, end)
    order = Window.partitionBy(key).orderBy(start)
    gaps = united.select(key, F.coalesce(F.lag(end).over(order), F.lit(0)).alias("_a"), F.col(start).alias("_b"))
    rest = lengths.select(key, length).join(united.groupBy(key).agg(F.max(end).alias("_last")), key, "left").select(key, F.coalesce("_last", F.lit(0)).alias("_a"), F.col(length).alias("_b"))
    return gaps.unionByName(rest).filter("_b > _a").select(key, F.col("_a").alias(start), F.col("_b").alias(end))


def atoms(spans: DataFrame, lengths: DataFrame, key: str, start: str, end: str, label: str, length: str) -> DataFrame:
    """Each document cut into the longest runs under the same labels: (key, start, end, labels), exclusive ends.

    The places where a span begins or ends are numbered in each document; a span covers the pieces between the numbers of its
    ends, so it meets only pieces that it covers.  Equal neighbours become one; empty spans cover nothing.
    """
    rows = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("e"), F.col(label).cast("string").alias("l"))
    ends = rows.select(key, F.explode(F.array("s", "e")).alias("p")).unionByName(lengths.select(key, F.explode(F.array(F.lit(0), F.col(length).cast("int"))).alias("p"))).distinct()
    order = Window.partitionBy(key).orderBy("p")
    numbered = ends.select(key, F.col("p").alias("a"), F.lead("p").over(order).alias("b"), F.row_number().over(order).alias("r"))
    number = lambda p, r: numbered.select(key, F.col("a").alias(p), F.col("r").alias(r))
    placed = rows.filter("s < e").distinct().join(number("s", "r0"), [key, "s"]).join(number("e", "r1"), [key, "e"])
    covered = placed.select(key, "l", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1)).alias("r"))
    sets = numbered.filter("b is not null").join(covered, [key, "r"], "left").groupBy(key, "a", "b").agg(F.array_sort(F.collect_set("l")).alias("labels"))  # labels, few by nature
    order = Window.partitionBy(key).orderBy("a")
    marked = sets.withColumn("_new", F.coalesce((F.lag("labels").over(order) != F.col("labels")).cast("int"), F.lit(1)))
    runs = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_g", "labels").agg(F.min("a").alias(start), F.max("b").alias(end)).select(key, start, end, "labels")


def invert_token_map(tokens: DataFrame, key: str) -> DataFrame:
    """From (key, tok_i, c_start, c_end) with exclusive ends: the first token and the one after the last that cover each sign."""
    chars = tokens.filter("c_end > c_start").select(key, "tok_i", F.explode(F.sequence(F.col("c_start"), F.col("c_end") - 1)).alias("char_i"))
    return chars.groupBy(key, "char_i").agg(F.min("tok_i").alias("tok_first"), (F.max("tok_i") + 1).alias("tok_end"))


def removed_ranges(maps: DataFrame, key: str, new_to_old: str) -> DataFrame:
    """(key, old_start, removed, new_pos): signs of the old text without a place in the new one, and the last kept place before them."""
    flat = maps.select(key, F.posexplode(new_to_old).alias("n", "o"))
    order = Window.partitionBy(key).orderBy("n")
    gap = F.lead("o").over(order) - F.col("o") - 1
    return flat.select(key, (F.col("o") + 1).alias("old_start"), gap.alias("removed"), F.col("n").alias("new_pos")).filter("removed > 0")
