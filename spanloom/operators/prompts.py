"""Memory of earlier parts for a prompt: frames over the parts before, within a budget of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def preceding(parts: DataFrame, key: str, order: list[str], value: str, most: int) -> DataFrame:
    """Each part with ``memory``: the values of the ``most`` parts before it, oldest first."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(-most, -1)
    return parts.withColumn("memory", F.collect_list(value).over(frame))


def within_budget(memory: str, size, budget: int):
    """The newest values whose sizes add up to the budget; the one that crosses it is still taken."""
    newest = F.reverse(F.col(memory))
    kept = F.aggregate(
        newest,
        F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.when(acc["used"] <= budget, F.struct((acc["used"] + size(x)).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc),
    )
    return F.reverse(kept["kept"])
