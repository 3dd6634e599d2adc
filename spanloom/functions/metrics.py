"""Token overlap as Column expressions.  Three conventions for empty sides are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens


def joint(gold: Column, predicted: Column) -> Column:
    """Tokens in common, each as often as both lists have it."""
    times = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.aggregate(F.array_intersect(gold, predicted), F.lit(0), lambda n, w: n + F.least(times(gold, w), times(predicted, w)))


def counts(gold: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """Tokens of the gold text, of the predicted one, and in common; null texts have none."""
    g, p = tokens(gold), tokens(predicted)
    return F.size(g), F.size(p), joint(g, p)


def with_counts(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """``rows`` with n_gold, n_pred and n_joint.  Tokens get a projection of their own, or they would be worked out again for every word compared."""
    words = rows.withColumns({"_g": tokens(gold), "_p": tokens(predicted)})
    return words.withColumns({"n_gold": F.size("_g"), "n_pred": F.size("_p"), "n_joint": joint(F.col("_g"), F.col("_p"))}).drop("_g", "_p")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def lenient(n_gold: Column, n_pred: Column, n_joint: Column) -> dict[str, Column]:
    """p, r, f1, iou; an empty side counts as fully right, both empty as 1."""
    return {
        "p": F.coalesce(_ratio(n_joint, n_pred), F.lit(1.0)),
        "r": F.coalesce(_ratio(n_joint, n_gold), F.lit(1.0)),
        "f1": F.coalesce(_ratio(2 * n_joint, n_gold + n_pred), F.lit(1.0)),
        "iou": F.coalesce(_ratio(n_joint, n_gold + n_pred - n_joint), F.lit(1.0)),
    }


def strict(n_gold: Column, n_pred: Column, n_joint: Column) -> dict[str, Column]:
    """p, r, f1, iou; nothing divided by nothing is 0."""
    zero = F.lit(0.0)
    return {k: F.coalesce(v, zero) for k, v in {
        "p": _ratio(n_joint, n_pred), "r": _ratio(n_joint, n_gold), "f1": _ratio(2 * n_joint, n_gold + n_pred), "iou": _ratio(n_joint, n_gold + n_pred - n_joint),
    }.items()}


def agreeing(n_gold: Column, n_pred: Column, n_joint: Column) -> dict[str, Column]:
    """p, r, f1; when a side is empty all are 1 if both are, else 0."""
    empty, same = (n_gold == 0) | (n_pred == 0), (n_gold == n_pred).cast("double")
    own = strict(n_gold, n_pred, n_joint)
    return {k: F.when(empty, same).otherwise(own[k]) for k in ("p", "r", "f1")}


def rounded(columns: dict[str, Column], prefix: str = "") -> list[Column]:
    return [F.round(v, 6).alias(prefix + k) for k, v in columns.items()]
