"""Interval joins of annotations with parts of their document.

The join is on the document's key with the interval as residual condition, so Spark hashes or
merges on the key instead of comparing everything with everything.  Answers of one document may be many:
places are bucketed, so that one hot document is spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import overlap, within


def contained(answers: DataFrame, parts: DataFrame, key: str, bucket: int = 1 << 16) -> DataFrame:
    """Answers (start_pos, end_pos) that lie wholly in a part (offset, length), in its own coordinates; joined by key and by the bucket in which an answer starts."""
    lo, hi = F.col("offset"), F.col("offset") + F.col("length") - 1
    p = parts.filter("length > 0").withColumnRenamed(key, "_key").withColumn("_b", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))))
    inside = answers.join(p, (answers[key] == p["_key"]) & (F.floor(answers["start_pos"] / bucket) == p["_b"]) & within(answers["start_pos"], answers["end_pos"], lo, hi)).drop("_key", "_b")
    return inside.withColumn("start_pos", F.col("start_pos") - F.col("offset")).withColumn("end_pos", F.col("end_pos") - F.col("offset"))


def clip(answers: DataFrame, parts: DataFrame, key: str, bucket: int = 1 << 16) -> DataFrame:
    """Each answer cut to every part it overlaps, in the part's coordinates, with the text of the overlap when there is one.

    Places are bucketed, so a document with a third of all answers is many join keys; a pair is kept in the bucket of its first common place only.
    """
    a = answers.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_pos") / bucket), F.floor(F.col("end_pos") / bucket))))
    p = parts.withColumn("_p_end", F.col("offset") + F.col("length") - 1).filter("length > 0").withColumnRenamed(key, "_key")
    p = p.withColumn("_pb", F.explode(F.sequence(F.floor(F.col("offset") / bucket), F.floor(F.col("_p_end") / bucket))))
    lo, hi = overlap(a["start_pos"], a["end_pos"], p["offset"], p["_p_end"])
    both = a.join(p, (a[key] == p["_key"]) & (a["_b"] == p["_pb"]) & lo.isNotNull() & (F.floor(lo / bucket) == a["_b"]))
    out = both.withColumn("_lo", lo).withColumn("_hi", hi)
    cut = F.substr("answer_text", F.col("_lo") - F.col("start_pos") + 1, F.col("_hi") - F.col("_lo") + 1)
    return out.select(*[c for c in answers.columns if c not in ("start_pos", "end_pos", "answer_text")], *[c for c in parts.columns if c not in (key, "length")], (F.col("_lo") - F.col("offset")).alias("start_pos"), (F.col("_hi") - F.col("offset")).alias("end_pos"), cut.alias("answer_text"))
