"""Registries and logs of runs: best checkpoints, restarts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best(rows: DataFrame, by: list[str], metric: str, order: str) -> DataFrame:
    """The row of the largest metric of each group, the first by ``order`` at a tie; rows without a metric don't count."""
    window = Window.partitionBy(*by).orderBy(F.desc(metric), order)
    return rows.filter(F.col(metric).isNotNull()).withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r")


def last_restart(rows: DataFrame, by: list[str], order: str, step: str) -> DataFrame:
    """Log lines since the last time the step didn't increase."""
    window = Window.partitionBy(*by).orderBy(order)
    fell = F.when(F.col(step) <= F.lag(step).over(window), F.col(order))
    marked = rows.withColumn("_fell", fell)
    return marked.withColumn("_from", F.max("_fell").over(Window.partitionBy(*by))).filter((F.col("_from").isNull()) | (F.col(order) >= F.col("_from"))).drop("_fell", "_from")


def marked_last(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """``rows`` with ``kept``: whether a row is among the newest ``n`` of its group."""
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) <= n)


def keep_last(rows: DataFrame, by: list[str], order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The newest ``n`` rows of each group, and those to delete."""
    marked = marked_last(rows, by, order, n)
    return marked.filter("kept").drop("kept"), marked.filter("not kept").drop("kept")


def relative_to_first(rows: DataFrame, by: list[str], order: str, value: str) -> Column:
    """The value divided by the first one of its group."""
    return F.col(value) / F.nullif(F.first(value).over(Window.partitionBy(*by).orderBy(order)), F.lit(0))


def recently_used(rows: DataFrame, by: list[str], item: str, time: str) -> DataFrame:
    """Each item once, with the time of its last use and its place in the history, newest first."""
    last = rows.groupBy(*by, item).agg(F.max(time).alias(time))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(time), item)))


def clamped(index: Column, n: Column, last: Column) -> Column:
    """An index brought into range; -1 stands for the last one viewed."""
    return F.greatest(F.lit(0), F.least(F.when(index == -1, last).otherwise(index), n - 1))


def ordered_buckets(rows: DataFrame, order: str, n: int = 64) -> Column:
    """A number that rises with ``order`` (its bounds are a sample of at most 1,000 values), by which rows in one order can be worked on side by side."""
    sample = sorted(r[0] for r in rows.select(order).filter(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order)).limit(1000).collect())
    bounds = sample[:: max(1, len(sample) // n)]
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)


def running_sums(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with sum_<column>, summed up in the order of a unique column: windows within ordered buckets, plus the sums of the buckets before."""
    placed = rows.withColumn("_b", ordered_buckets(rows, order))
    sums = placed.groupBy("_b").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])  # a row a bucket
    own = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ran = placed.join(F.broadcast(sums), "_b").withColumns({f"sum_{c}": F.sum(c).over(own) + F.col(f"_{c}") for c in columns})
    return ran.drop("_b", *[f"_{c}" for c in columns])
