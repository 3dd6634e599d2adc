"""Texts with runs removed, and annotations moved with them.

Where a text loses characters, a table of runs says which of it stayed: (key, run, old_start, new_start, length).  It has a row
for each stretch kept, so its size follows what was removed, not the text; the map of every character, where one is wanted, is
``character_map``.  A removed character has the new place of the last one kept before it (0 if there is none).

Null texts have no runs; an empty text has one run of no length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Blanks after a blank, and line ends after a line end.
REPEATED = "(?<= ) +|(?<=\n)\n+"


def kept_runs(docs: DataFrame, key: str, text: str, pattern: str = REPEATED) -> DataFrame:
    """The stretches of each text that stay when all matches of ``pattern`` go."""
    kept = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    gone = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.length(x))
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.arrays_zip(kept.alias("kept"), gone.alias("gone"))).alias("run", "x"))
    before = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    rows = rows.select(key, "run", F.col("x.kept").alias("length"), F.coalesce("x.gone", F.lit(0)).alias("gone"))
    return rows.select(key, "run", total(F.col("length") + F.col("gone")).alias("old_start"), total("length").alias("new_start"), "length")


def character_map(runs: DataFrame, key: str) -> DataFrame:
    """(key, new_pos, old_pos) of every character that stayed."""
    rows = runs.filter("length > 0").select(key, "old_start", "new_start", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("i"))
    return rows.select(key, (F.col("new_start") + F.col("i")).alias("new_pos"), (F.col("old_start") + F.col("i")).alias("old_pos"))


def moved(places: DataFrame, runs: DataFrame, key: str, place: str) -> DataFrame:
    """``places`` with ``new_<place>``: one pass in the order of the text carries the last run along."""
    name = f"new_{place}"
    keep = F.struct(*[c for c in places.columns if c != key])
    ours = places.filter(F.col(place).isNotNull()).select(key, F.col(place).cast("int").alias("_p"), F.lit(1).alias("_kind"), keep.alias("_row"), F.lit(None).cast("struct<o:int,n:int,k:int>").alias("_run"))
    own = F.struct(F.col("old_start").alias("o"), F.col("new_start").alias("n"), F.col("length").alias("k"))
    theirs = runs.filter("length > 0").select(key, F.col("old_start").alias("_p"), F.lit(0).alias("_kind"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), own.alias("_run"))
    order = Window.partitionBy(key).orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.unionByName(theirs).withColumn("_last", F.last("_run", ignorenulls=True).over(order)).filter("_kind = 1")
    at = F.col("_last.n") + F.least(F.col("_p") - F.col("_last.o"), F.col("_last.k") - 1)
    return both.select(key, "_row.*", F.coalesce(at, F.lit(0)).alias(name))


def cleaned(docs: DataFrame, answers: DataFrame, key: str, text: str, by: list[str], pattern: str = REPEATED) -> DataFrame:
    """(key, by, start_pos, end_pos, answer_text): answers of ``docs`` (inclusive ends) in the cleaned text, united where they overlap or touch."""
    from .spans import union

    runs = kept_runs(docs, key, text, pattern)
    spans = answers.select(key, *by, F.col("start_pos").alias("a"), F.col("end_pos").alias("z")).filter("a <= z")
    spans = moved(moved(spans, runs, key, "a"), runs, key, "z")
    united = union(spans.select(key, *by, F.col("new_a").alias("s"), (F.col("new_z") + 1).alias("e")), [key, *by], "s", "e")
    clean = docs.filter(F.col(text).isNotNull()).select(key, F.regexp_replace(text, pattern, "").alias("_t"))
    return united.join(clean, key).select(key, *by, F.col("s").alias("start_pos"), (F.col("e") - 1).alias("end_pos"), F.substr("_t", F.col("s") + 1, F.col("e") - F.col("s")).alias("answer_text"))
