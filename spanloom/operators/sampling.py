"""Deterministic sampling by hashes: the same rows whatever the partitioning, and the same in SQL.

A sample is the rows with the least ``md5(seed|keys)`` of their group; asking for more rows than there
are gives all.  Weighted samples use keys of exponential variates.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lot(seed: int, *keys: str) -> Column:
    """A row's lot, as text that sorts at random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def variate(seed: int, *keys: str) -> Column:
    """The lot as a number between 0 and 1."""
    return (F.conv(F.substring(lot(seed, *keys), 1, 13), 16, 10).cast("double") + 1) / float(2**52 + 1)


def take(rows: DataFrame, by: list[str], keys: list[str], count: Column, seed: int, order: Column | None = None, spread: bool = True) -> DataFrame:
    """At most ``count`` (a number, or a column) rows of each group: those with the least lots, or of least ``order`` (a number of 0 and more).

    With ``spread``, for groups that may hold a third of all rows: rows are counted by bucket of their lot first, so only rows of buckets
    that are needed are moved, and each bucket of a group is ranked by itself.  Without, each group is ranked in one task.
    """
    lots = [lot(seed, *keys) if order is None else order, *keys]
    if not spread:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*lots))).filter(F.col("_n") <= count).drop("_n")
    bucket = F.conv(F.substring(lots[0], 1, 2), 16, 10).cast("int") if order is None else F.floor(F.log2(order + 1e-9) * 8).cast("int")
    marked = rows.withColumn("_k", bucket)
    sizes = marked.groupBy(*by, "_k").agg(F.count("*").alias("_c"), F.max(count).alias("_want"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = sizes.withColumn("_before", before).filter(F.col("_before") < F.col("_want"))
    needed = needed.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_k").alias("_kk"), "_before")
    same = F.col("_k") == F.col("_kk")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    ranked = marked.join(needed, same).withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_k").orderBy(*lots)) + F.col("_before"))
    return ranked.filter(F.col("_n") <= count).select(*rows.columns)


def label_split(n: int, n_train: int, seed: int) -> list[tuple[int, str]]:
    """A seeded split of label numbers; the first ``n_train`` of a shuffle are for training."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    train = set(order[:n_train])
    return [(i, "train" if i in train else "held_out") for i in range(n)]


def negatives_per_label(positives: DataFrame, parts: DataFrame, ratio: float, seed: int) -> DataFrame:
    """For each label, parts (doc, part) that don't have it, ``ratio`` times as many as have it.

    A document is as likely as any other and so is each part of it: parts weigh one by the number of parts of their document.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = parts.join(parts.groupBy("doc").agg(F.count("*").alias("w")), "doc")
    sized = sized.repartition(n, "doc", "part")  # as the join below needs it; by number, as a part is small but becomes a row a label
    wanted = positives.groupBy("label").agg(F.floor(F.count("*") * ratio).alias("want"))
    every = F.broadcast(wanted.agg(F.collect_list(F.struct("label", "want")).alias("every")))  # one row, of labels, of which there are few
    has = positives.groupBy("doc", "part").agg(F.collect_set("label").alias("has"))
    # a part meets the labels it lacks within its row, so the grid of parts and labels is never moved
    lacking = F.filter("every", lambda x: ~F.coalesce(F.array_contains("has", x["label"]), F.lit(False)))
    free = sized.join(has, ["doc", "part"], "left").crossJoin(every).select("doc", "part", "w", F.explode(lacking).alias("x")).select("doc", "part", "w", "x.label", "x.want")
    cost = F.round(-F.log(variate(seed, "doc", "part", "label")) * F.col("w"), 9)
    return take(free.withColumn("cost", cost), ["label"], ["doc", "part"], F.col("want"), seed, F.col("cost")).select("doc", "part", "label")


def negatives_within(positives: DataFrame, parts: DataFrame, seed: int) -> DataFrame:
    """For each document and label, as many parts of the document without the label as have it, or all there are."""
    wanted = positives.groupBy("doc", "label").agg(F.count("*").alias("want"))
    free = parts.join(wanted, "doc").join(positives.select("doc", "part", "label").distinct(), ["doc", "part", "label"], "left_anti")
    return take(free, ["doc", "label"], ["doc", "part", "label"], F.col("want"), seed, spread=False).select("doc", "part", "label")


def negatives_per_part(positives: DataFrame, labels: DataFrame, count: int, seed: int) -> DataFrame:
    """For each part with a label, ``count`` labels that it doesn't have."""
    parts = positives.select("doc", "part").distinct()
    free = parts.crossJoin(F.broadcast(labels.select("label"))).join(positives.select("doc", "part", "label").distinct(), ["doc", "part", "label"], "left_anti")
    return take(free, ["doc", "part"], ["doc", "part", "label"], F.lit(count), seed, spread=False)


def balance(rows: DataFrame, by: list[str], keys: list[str], positive: Column, seed: int, when_none: int | Column = 1, spread: bool = True) -> DataFrame:
    """All positive rows of each group and as many others; ``when_none`` (a number, or an aggregate of the group) others of a group without a positive."""
    none = when_none if isinstance(when_none, Column) else F.lit(when_none)
    per = rows.groupBy(*by).agg(F.sum(positive.cast("int")).alias("_k"), none.alias("_none")).withColumn("_most", F.when(F.col("_k") > 0, F.col("_k")).otherwise(F.col("_none"))).drop("_none")
    others = take(rows.filter(~positive).join(per, by), by, keys, F.col("_most"), seed, spread=spread)
    return rows.filter(positive).unionByName(others.select(*rows.columns))
