"""Cutting documents into paragraphs, merged sections, token blocks and windows.

Folds that depend on what came before run over lengths only, inside one row, and the text is
regrouped by the group numbers they give; nothing copies text again and again.  Null and
empty texts have no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, para_idx, offset, length, text) of the non-empty lines of each document."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "text")).withColumn("length", F.length("text"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("offset", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)).cast("int"))
    return placed.filter("length > 0").select(key, (F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1).alias("para_idx"), "offset", "length", "text")


def _fold(lengths: Column, new, grown, finish=None) -> Column:
    """Group numbers: an item opens a group where ``new`` (size of the open group, item) says so, else the group grows to ``grown`` of the two.

    Only the places where groups open are gathered on the way.
    """
    begin = F.struct(F.lit(None).cast("bigint").alias("size"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(acc, n):
        opens = acc["size"].isNull() | new(acc["size"], n)
        return F.struct(
            F.when(opens, n.cast("bigint")).otherwise(grown(acc["size"], n).cast("bigint")).alias("size"), (acc["i"] + 1).alias("i"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    # within the finish, the places are at hand and aren't worked out again for each group
    repeat = lambda acc: lambda s, g: F.array_repeat(g, F.coalesce(F.get(acc["starts"], g + 1), acc["i"]) - s)
    return F.aggregate(lengths, begin, step, finish or (lambda acc: F.flatten(F.transform(acc["starts"], repeat(acc)))))


def merged_count(lengths: Column, least: int = 300) -> Column:
    """How many groups ``merge_short`` makes of a row's items."""
    return _fold(lengths, lambda size, n: size >= least, lambda size, n: size + n + 1, lambda acc: F.size(acc["starts"]))


def merged_groups(lengths: Column, least: int = 300) -> Column:
    """The group of each of a row's items, as ``merge_short`` would number them."""
    return _fold(lengths, lambda size, n: size >= least, lambda size, n: size + n + 1)


def _grouped(items: DataFrame, key: str, order: str, size: str, fold: Column) -> DataFrame:
    """(key, order, group) from a fold over the sizes of each document's items, which alone are gathered."""
    per = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).alias("n")))).alias("x"))
    per = per.select(key, F.transform("x", lambda v: v["o"]).alias("os"), F.transform("x", lambda v: v["n"]).alias("ns"))
    zipped = per.select(key, F.explode(F.arrays_zip(F.col("os").alias("o"), fold.alias("g"))).alias("z"))
    return zipped.select(key, F.col("z.o").alias(order), F.col("z.g").alias("group"))


def merge_short(items: DataFrame, key: str, order: str, size: str, least: int = 300) -> DataFrame:
    """Greedy merge: neighbours join until their group has ``least`` signs, counting one sign between two; the last may stay short."""
    return _grouped(items, key, order, size, merged_groups(F.col("ns"), least))


def pack_greedy(items: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Greedy packing: neighbours join while their group stays within ``most``."""
    return _grouped(items, key, order, size, _fold(F.col("ns"), lambda size, n: size + n > most, lambda size, n: size + n))


def words_with_places(texts: DataFrame, key: str, text: str, blank: str = " ") -> DataFrame:
    """(key, tok_i, c_start, c_end) of the words between blanks (a pattern for one of them), ends exclusive."""
    parts = texts.select(key, F.posexplode(F.split(text, blank)).alias("i", "w")).select(key, "i", F.length("w").alias("n"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("c_start", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("int")).filter("n > 0")
    number = F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1
    return placed.select(key, number.alias("tok_i"), "c_start", (F.col("c_start") + F.col("n")).alias("c_end"))


def word_count(text: Column, blank: str = " ") -> Column:
    """How many words ``words_with_places`` makes of a text, counted in its row."""
    return F.array_size(F.array_remove(F.split(text, blank), ""))


def token_blocks(tokens: DataFrame, key: str, most: int) -> DataFrame:
    """(key, block, c_start, c_end, n_tokens): blocks of ``most`` tokens as spans of signs; blanks between blocks are dropped."""
    return tokens.groupBy(key, F.floor(F.col("tok_i") / most).cast("int").alias("block")).agg(F.min("c_start").alias("c_start"), F.max("c_end").alias("c_end"), F.count("*").cast("int").alias("n_tokens"))


def without_gaps(blocks: DataFrame, lengths: DataFrame, key: str, length: str) -> DataFrame:
    """Blocks with chunk_start and chunk_end (inclusive): what lies between two belongs to the one before, the text's edges to the first and last."""
    order = Window.partitionBy(key).orderBy("block")
    rows = blocks.join(lengths.select(key, F.col(length).alias("_n")), key)
    start = F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("c_start"))
    return rows.select(*blocks.columns, start.alias("chunk_start"), (F.coalesce(F.lead("c_start").over(order), F.col("_n")) - 1).alias("chunk_end"))


def word_at(places: DataFrame, words: DataFrame, key: str, place: str, name: str, bucket: int = 1 << 10) -> DataFrame:
    """``places`` with the number of the word that each place is in, null for none; joined by key and bucket of the text."""
    at = lambda c: F.floor(F.col(c) / bucket)
    spread = words.select(F.col(key).alias("_key"), F.col("tok_i").alias(name), "c_start", "c_end", F.explode(F.sequence(at("c_start"), F.floor((F.col("c_end") - 1) / bucket))).alias("_b"))
    inside = (places[key] == spread["_key"]) & (at(place) == spread["_b"]) & (places[place] >= spread["c_start"]) & (places[place] < spread["c_end"])
    return places.join(spread, inside, "left").drop("_key", "_b", "c_start", "c_end")


def labelled_windows(questions: DataFrame, words: DataFrame, counts: DataFrame, key: str, length: int, stride: int, offset: int) -> DataFrame:
    """Windows of each question's document with the place of its answer in them.

    questions: key, none (no answer), p and z (first and last sign of the answer).  Where the answer isn't wholly in a window, and where a place is in no
    word, start_position and end_position are 0 and the window is impossible; else they are words of the window, ``offset`` further.
    """
    found = word_at(word_at(questions, words, key, "p", "_a"), words, key, "z", "_z")
    rows = counts.select(key, "n", F.explode(windows(F.col("n"), length, stride)).alias("start")).withColumn("length", F.least(F.lit(length), F.col("n") - F.col("start")))
    inside = F.coalesce(~F.col("none") & (F.col("_a") >= F.col("start")) & (F.col("_z") <= F.col("start") + F.col("length") - 1), F.lit(False))
    label = lambda c: F.when(inside, F.col(c) - F.col("start") + offset).otherwise(0)
    both = found.join(rows, key).withColumns({"start_position": label("_a"), "end_position": label("_z"), "is_impossible": ~inside})
    return both.drop("_a", "_z", "n")


def windows(n: Column, length: int, stride: int) -> Column:
    """Starts of windows of ``length`` over ``n`` tokens; a window starts as long as the one before didn't reach the end."""
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    return F.when(n > 0, F.filter(starts, lambda s: (s == 0) | (s - stride + length < n)))


def padded(ids: Column, width: Column, pad: int, left: bool = False) -> Column:
    """Ids filled up to ``width``."""
    fill = F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)
