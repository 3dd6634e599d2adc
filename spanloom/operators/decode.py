"""Answers out of start and end scores.

Every step is a window over the question, so questions spread over tasks; ties are broken by place
(score first, then start, end, and feature; no answer last), which makes the result the same in every run.

Features are windows over a document: (qa, feature, start_scores, end_scores, context_offset, context_length) and, if places
are to be those of the document, context_shift (document token less place in the window).  Place 0 stands for no answer.
Instead of the scores they may have what ``proposals`` makes of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spans(features: DataFrame, n: int, longest: int) -> DataFrame:
    """Every pair of best start and end that is a span of the context: (qa, feature, start, end, score), in places of the window."""
    return _spans(features, n, longest).drop("shift")


def proposals(scores: DataFrame, n: int, longest: int) -> DataFrame:
    """``scores`` with ``pairs`` (start, end, score) of the ``n`` best starts and ends, and ``none``, the score of no answer, in place of the scores.

    Features that share vectors of scores are joined with these, so that pairs are worked out once a vector; they hold for the same ``n`` and ``longest``.
    """

    def best(c: str):
        places = F.transform(F.col(c), lambda x, i: F.struct((-x.cast("double")).alias("s"), i.alias("i")))
        return F.slice(F.array_sort(places), 1, n)

    def pair(a):
        return lambda b: F.struct(a["i"].alias("start"), b["i"].alias("end"), F.round(-a["s"] - b["s"], 6).alias("score"))

    fits = lambda a: lambda b: (b["i"] >= a["i"]) & (b["i"] - a["i"] + 1 <= longest)
    # a row of one item, so that the best ends aren't sorted again for each start
    both = F.array(F.struct(best("start_scores").alias("a"), best("end_scores").alias("b")))
    pairs = F.flatten(F.flatten(F.transform(both, lambda x: F.transform(x["a"], lambda a: F.transform(F.filter(x["b"], fits(a)), pair(a))))))
    none = F.round(F.get("start_scores", F.lit(0)).cast("double") + F.get("end_scores", F.lit(0)).cast("double"), 6)
    return scores.select(*[c for c in scores.columns if c not in ("start_scores", "end_scores")], pairs.alias("pairs"), none.alias("none"))


def _spans(features: DataFrame, n: int, longest: int, pairs: Column | str = "pairs") -> DataFrame:
    found = features if "pairs" in features.columns else proposals(features, n, longest)
    shift = F.col("context_shift").cast("int") if "context_shift" in features.columns else F.lit(0)
    low, high = F.col("context_offset"), F.col("context_offset") + F.col("context_length") - 1
    found = found.select("qa", "feature", shift.alias("shift"), low.alias("low"), high.alias("high"), F.explode(pairs).alias("p"))
    inside = (F.col("p.start") >= F.col("low")) & (F.col("p.start") <= F.col("high")) & (F.col("p.end") <= F.col("high"))
    return found.filter(inside | (F.col("p.start") < 0)).select("qa", "feature", "p.start", "p.end", "p.score", "shift")


def null_scores(features: DataFrame) -> DataFrame:
    """(qa, feature, score) of the feature whose place 0 has the least score: the score of no answer."""
    none = features if "none" in features.columns else proposals(features, 1, 1)
    return none.groupBy("qa").agg(F.min(F.struct(F.col("none").alias("score"), "feature")).alias("m")).select("qa", "m.feature", "m.score")


def n_best(features: DataFrame, n: int, longest: int, tokens: DataFrame | None = None, small: bool = False) -> DataFrame:
    """(qa, rank, feature, start, end, score, prob): the ``n`` best distinct answers of each question, no answer (start and end -1) among them.

    Where no answer isn't among the best ``n`` it follows as one more.  The same place met in several windows counts once, with its
    best score.  start and end are tokens of the document; with ``tokens`` (qa, tok_i, c_start, c_end; ends exclusive) places
    are compared, and given as char_start and char_end (inclusive), in signs.  Probabilities are over the rows returned.
    ``small``: questions are many and of few features, so features move by question before they are spans; else spans move by place, and the distinct ones by question.
    """
    start, end = F.col("start") + F.col("shift"), F.col("end") + F.col("shift")
    nothing = F.col("start") <= 0
    if small:
        features = (features if "pairs" in features.columns else proposals(features, n, longest)).repartition("qa")
        features = features.withColumn("_r", F.row_number().over(Window.partitionBy("qa").orderBy("none", "feature")))
        none = F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.col("none").alias("score")))
        pairs = F.when(F.col("_r") == 1, F.concat(F.coalesce("pairs", F.array()), none)).otherwise(F.col("pairs"))
        found = _spans(features, n, longest, pairs)
    else:
        found = _spans(features, n, longest)
    found = found.select("qa", "feature", F.when(nothing, -1).otherwise(start).alias("start"), F.when(nothing, -1).otherwise(end).alias("end"), "score")
    if not small:
        found = found.unionByName(null_scores(features).select("qa", "feature", F.lit(-1).alias("start"), F.lit(-1).alias("end"), "score"))
    place = ["start", "end"]
    if tokens is not None:
        place = ["char_start", "char_end"]
        first = tokens.select("qa", F.col("tok_i").alias("start"), F.col("c_start").alias("char_start"))
        last = tokens.select("qa", F.col("tok_i").alias("end"), (F.col("c_end") - 1).alias("char_end"))
        # never broadcast: the size of tokens is estimated by compressed files of text, far too low
        found = found.join(first.hint("merge"), ["qa", "start"], "left").join(last.hint("merge"), ["qa", "end"], "left")
        found = found.withColumns({c: F.when(F.col("start") < 0, -1).otherwise(F.col(c)) for c in place})
    rows = Window.partitionBy("qa")
    order = rows.orderBy(F.desc("score"), F.col("start") < 0, "start", "end", "feature")
    one = Window.partitionBy("qa", *place).orderBy(F.desc("score"), "start", "end", "feature")
    distinct = found.withColumn("_f", F.row_number().over(one)).filter("_f = 1")
    kept = distinct.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= n) | (F.col("start") < 0))
    kept = kept.withColumn("rank", F.least("rank", F.lit(n + 1))).withColumn("_e", F.exp(F.col("score") - F.max("score").over(rows)))
    out = ["qa", "rank", "feature", "start", "end"] + (place if tokens is not None else [])
    return kept.select(*out, "score", F.round(F.col("_e") / F.sum("_e").over(rows), 6).alias("prob"))


def with_text(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """``ranked`` with the text of each answer, '' for no answer; documents: (qa, text)."""
    cut = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start") + 1)
    return ranked.join(documents.select("qa", "text").hint("merge"), "qa", "left").withColumn("text", F.when(F.col("start") < 0, F.lit("")).otherwise(cut))


def with_words(ranked: DataFrame, documents: DataFrame, blank: str = " ") -> DataFrame:
    """``ranked`` with char_start, char_end (inclusive) and text of each answer, -1 and '' for no answer, where tokens are the words between blanks.

    documents: (qa, text).  Words have signs of their own, so answers distinct in words are distinct in signs: places in signs are worked out only
    for the answers that are left, each in its row.  Documents are never broadcast: their size in files, compressed, says little of their size in memory.
    """
    parts = F.split("text", blank)
    numbers = F.filter(F.transform(parts, lambda w, i: F.when(w != "", i)), lambda i: i.isNotNull())
    docs = documents.select("qa", F.col("text").alias("_t"), F.when(F.array_contains(parts, ""), numbers).alias("_at"))  # null: word numbers are part numbers
    part = lambda c: F.coalesce(F.get("_at", F.col(c)), F.col(c))
    before = lambda k: F.length(F.call_function("substring_index", F.col("_t"), F.lit(blank), k))
    none = F.col("start") < 0
    first = F.when(none, -1).otherwise(before(part("start")) + F.when(part("start") > 0, len(blank)).otherwise(0))
    rows = ranked.join(docs.hint("merge"), "qa", "left").withColumns({"char_start": first, "char_end": F.when(none, -1).otherwise(before(part("end") + 1) - 1)})
    cut = F.substring("_t", F.col("char_start") + 1, F.col("char_end") - F.col("char_start") + 1)
    return rows.select(*ranked.columns, "char_start", "char_end", F.when(none, F.lit("")).otherwise(cut).alias("text"))


def answers(ranked: DataFrame, *keep: str) -> DataFrame:
    """(qa, start, end, score_best, score_null): the best of all where it beats no answer, else -1; and the columns of ``keep`` ('' likewise)."""
    best = F.min(F.when(F.col("start") >= 0, F.struct("rank", "start", "end", "score", *keep)))
    per = ranked.groupBy("qa").agg(best.alias("m"), F.max(F.when(F.col("start") < 0, F.col("score"))).alias("score_null"))
    wins = F.coalesce(F.col("score_null") - F.col("m.score") < 0, F.lit(False))
    return per.select(
        "qa", F.when(wins, F.col("m.start")).otherwise(-1).alias("start"), F.when(wins, F.col("m.end")).otherwise(-1).alias("end"), F.col("m.score").alias("score_best"), "score_null",
        *(F.when(wins, F.col(f"m.{c}")).otherwise("").alias(c) for c in keep),
    )
