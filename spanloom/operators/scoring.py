"""Scores of predictions against annotations, rolled up from one table of counts.

``facts`` joins once and counts once; micro, macro and per-document scores are sums over it, so
no roll-up reads texts again.  A prediction without annotation counts against an empty text, and
a sample delivered twice counts once (the first delivery).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M

KEYS = ("title", "para_idx", "q_id")
COUNTS = ("n_gold", "n_pred", "n_joint")


def first_delivery(samples: DataFrame, keys: tuple[str, ...] = KEYS, by: str = "loaded_at") -> DataFrame:
    """One row per key, that with the least ``by``."""
    rest = [c for c in samples.columns if c not in keys]
    return samples.groupBy(*keys).agg(F.min(F.struct(by, *[c for c in rest if c != by])).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def with_kind(samples: DataFrame) -> DataFrame:
    """Samples with ``kind``: the column type where there is one, else the older small."""
    have = [c for c in ("type", "small") if c in samples.columns]
    return samples.withColumn("kind", F.coalesce(*have) if have else F.lit(None).cast("int"))


def facts(predictions: DataFrame, gold: DataFrame, parse: Callable[[Column], Column], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Predictions with their token counts; ``gold`` has a text in column ``gold``, ``parse`` reads the prediction."""
    both = predictions.join(gold.select(*keys, "gold"), list(keys), "left")
    return M.with_counts(both, F.col("gold"), parse(F.col("prediction"))).select(*keys, "type", *COUNTS)


def total(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])


def scored(rows: DataFrame, rule=M.lenient) -> DataFrame:
    """Scores as columns, from the counts of each row."""
    return rows.select("*", *[v.alias(k) for k, v in rule(*(F.col(c) for c in COUNTS)).items()])


def mean(rows: DataFrame, *by: str, names: tuple[str, ...] = ("p", "r", "f1", "iou")) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])


def micro(rows: DataFrame) -> DataFrame:
    return scored(total(rows))


def macro(rows: DataFrame) -> DataFrame:
    """Mean over questions."""
    return mean(scored(total(rows, "q_id")))


def document_macro(rows: DataFrame) -> DataFrame:
    """Mean over questions of the mean over documents."""
    return mean(mean(scored(total(rows, "q_id", "title")), "q_id"))


def answer_scores(rows: DataFrame) -> DataFrame:
    """``rows`` (answers, prediction) with exact, p, r and f1: exact against any one of the answers, the others against all of them in a row.

    Answers without a word don't count; without any, only a prediction without words is right.
    """
    from ..functions.text import tokens

    golds = F.filter(F.transform(F.coalesce("answers", F.array().cast("array<string>")), tokens), lambda w: F.size(w) > 0)
    both = rows.withColumn("_g", golds).withColumn("_p", tokens(F.col("prediction")))
    gold = F.flatten("_g")
    scores = M.agreeing(F.size(gold), F.size("_p"), M.joint(gold, F.col("_p")))
    exact = F.when(F.size("_g") == 0, F.size("_p") == 0).otherwise(F.array_contains("_g", F.col("_p"))).cast("double")
    return both.select(*rows.columns, exact.alias("exact"), *[v.alias(k) for k, v in scores.items()])


def squad_report(rows: DataFrame, threshold: float) -> DataFrame:
    """One row of percentages over ``answer_scores`` (with has_answer and na_prob): of all, as predicted; and of those with and those without
    an answer, where a question whose probability of no answer is above the threshold counts as left unanswered."""
    held = F.col("na_prob") > threshold
    after = {k: F.when(held, (~F.col("has_answer")).cast("double")).otherwise(F.col(k)) for k in ("exact", "f1")}
    pct = lambda c, name: F.round(100 * F.avg(c), 6).alias(name)
    parts = [pct(k, k) for k in ("exact", "f1", "p", "r")]
    for name, own in (("has_answer", F.col("has_answer")), ("no_answer", ~F.col("has_answer"))):
        parts += [pct(F.when(own, v), f"{name}_{k}") for k, v in after.items()] + [F.count(F.when(own, 1)).alias(f"{name}_total")]
    return rows.agg(F.count("*").alias("total"), F.count(F.when(held, 1)).alias("withheld"), *parts)


def missing(gold: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Annotated samples without a prediction."""
    return gold.join(predictions, list(keys), "left_anti")


def predicted(samples: DataFrame, predict: Callable[[list[dict]], list[str | None]], batch: int = 64) -> DataFrame:
    """Samples with ``prediction``: a model as a function over batches of rows, run where the rows are; keys stay with their results."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            said = [p for i in range(0, len(rows), batch) for p in predict(rows[i : i + batch])]
            if len(said) != len(rows):
                raise ValueError("a model must give one prediction a row")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, "prediction"])

    return samples.mapInArrow(run, ddl + ", prediction string")
