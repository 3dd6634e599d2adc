"""Queries over start and end scores (the vectors stand in for a model's)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, segment
from .common import Catalogue

C = Catalogue()

_F = """f as (select label qa, vec_id feature, embedding[1:32] st, embedding[33:64] en from embeddings),
 a as (select qa, feature, i - 1 "start", v::double a from (select *, row_number() over (partition by qa, feature order by v desc, i) k from (select qa, feature, unnest(st) v, generate_subscripts(st, 1) i from f)) where k <= 5),
 b as (select qa, feature, i - 1 "end", v::double b from (select *, row_number() over (partition by qa, feature order by v desc, i) k from (select qa, feature, unnest(en) v, generate_subscripts(en, 1) i from f)) where k <= 5),
 s as (select qa, feature, "start", "end", round(a + b, 6) score from a join b using (qa, feature) where "start" >= 4 and "end" <= 27 and "end" >= "start" and "end" - "start" + 1 <= 12)"""
# the rows of one question: spans (proposed or no answer) with score, cut to the best distinct 5, no answer among or after them
_RANK = """d as (select * from (select *, row_number() over (partition by qa, {place} order by score desc, "start", "end", feature) k from pool) where k = 1),
 r as (select *, row_number() over (partition by qa order by score desc, "start" < 0, "start", "end", feature) r from d), k5 as (select *, least(r, 6) "rank" from r where r <= 5 or "start" < 0),
 e as (select *, exp(score - max(score) over (partition by qa)) e from k5)"""
_NULL = """z as (select qa, feature, round(st[1]::double + en[1]::double, 6) score from f), n as (select * from (select *, row_number() over (partition by qa order by score, feature) r from z) where r = 1)"""
_NB = f"""{_F}, {_NULL}, pool as (select qa, feature, "start", "end", score from s union all select qa, feature, -1, -1, score from n), {_RANK.format(place='"start", "end"')},
 nb as (select qa, "rank"::int "rank", feature, "start"::int "start", "end"::int "end", score, round(e / sum(e) over (partition by qa), 6) prob from e)"""


def _features(t):
    e = t("embeddings")
    return e.select(F.col("label").alias("qa"), F.col("vec_id").alias("feature"), F.slice("embedding", 1, 32).alias("start_scores"), F.slice("embedding", 33, 32).alias("end_scores"), F.lit(4).alias("context_offset"), F.lit(24).alias("context_length"))


@C.add(f'with {_F} select qa, feature, "start"::int "start", "end"::int "end", score from s')
def preliminary_spans(t):
    """Spans proposed by each feature."""
    return decode.spans(_features(t), 5, 12)


@C.add(f"with {_NB} select * from nb")
def nbest_spans(t):
    """The best distinct spans of each question, and no answer, with probabilities."""
    return decode.n_best(_features(t), 5, 12)


@C.add(f"""with {_NB}, p as (select qa, min("rank") filter ("start" >= 0) r, max(score) filter ("start" < 0) score_null from nb group by qa)
 select p.qa, case when score_null - nb.score < 0 then "start" else -1 end "start", case when score_null - nb.score < 0 then "end" else -1 end "end", nb.score score_best, score_null from p left join nb on p.qa = nb.qa and p.r = nb."rank\"""")
def nbest_answer(t):
    """The answer of each question, where it beats no answer."""
    return decode.answers(decode.n_best(_features(t), 5, 12))


@C.add("""with x as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from embeddings), e as (select *, exp(v - max(v) over (partition by vec_id)) e from x), p as (select *, e / sum(e) over (partition by vec_id) p, row_number() over (partition by vec_id order by v desc, i) k from e)
 select vec_id, i::int place, round(p, 6) prob from p where k <= 3""")
def top_probabilities(t):
    """Softmax over all places of a vector, and the three most probable."""
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("m", F.array_max("v")).withColumn("z", F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))))
    pairs = F.slice(F.array_sort(F.transform("v", lambda x, i: F.struct((-x).alias("s"), i.alias("i")))), 1, 3)
    return e.select("vec_id", "m", "z", F.explode(pairs).alias("b")).select("vec_id", F.col("b.i").alias("place"), F.round(F.exp(-F.col("b.s") - F.col("m")) / F.col("z"), 6).alias("prob"))


@C.add(f"""with {_NB} select qa, feature, "start", "end" + 1 span_end from nb where "rank" = 1 and "start" >= 0""")
def span_export(t):
    """The best span of each question that has one, with exclusive end."""
    best = decode.n_best(_features(t), 5, 12).filter("rank = 1 and start >= 0")
    return best.select("qa", "feature", "start", (F.col("end") + 1).alias("span_end"))


# windows of 24 words, 12 apart, over paragraphs; the scores of a window are those of a vector chosen by paragraph and window
_WIN = """w0 as (select para_id qa, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) i from paras), w1 as (select qa, i, w, sum(length(w) + 1) over (partition by qa order by i) - length(w) - 1 c_start from w0),
 tok as (select qa, row_number() over (partition by qa order by i) - 1 tok_i, c_start, c_start + length(w) c_end from w1 where w <> ''), nw as (select qa, count(*) n from tok group by qa),
 win as (select qa, n, s from (select qa, n, unnest(range(0, n, 12)) s from nw) where s = 0 or s + 12 < n),
 f as (select qa, s // 12 feature, s, least(24, n - s) m, embedding[1:32] st, embedding[33:64] en from win join embeddings on vec_id = (qa * 13 + s // 12) % (select count(*) from embeddings)),
 a as (select qa, feature, s, m, i - 1 p, v::double a from (select *, row_number() over (partition by qa, feature order by v desc, i) k from (select qa, feature, s, m, unnest(st) v, generate_subscripts(st, 1) i from f)) where k <= 5),
 b as (select qa, feature, i - 1 q, v::double b from (select *, row_number() over (partition by qa, feature order by v desc, i) k from (select qa, feature, unnest(en) v, generate_subscripts(en, 1) i from f)) where k <= 5),
 s as (select qa, feature, p + s - 4 "start", q + s - 4 "end", round(a + b, 6) score from a join b using (qa, feature) where p >= 4 and p <= m + 3 and q <= m + 3 and q >= p and q - p + 1 <= 12)"""
_TEXT = f"""{_WIN}, {_NULL}, pool as (select s.*, x.c_start char_start, y.c_end - 1 char_end from s join tok x on x.qa = s.qa and x.tok_i = s."start" join tok y on y.qa = s.qa and y.tok_i = s."end"
 union all select qa, feature, -1, -1, score, -1, -1 from n), {_RANK.format(place="char_start, char_end")},
 nb as (select e.qa, "rank"::int "rank", feature, "start"::int "start", "end"::int "end", char_start::int char_start, char_end::int char_end, score, round(e / sum(e) over (partition by e.qa), 6) prob,
 case when "start" < 0 then '' else substr(p.text, (char_start + 1)::bigint, (char_end - char_start + 1)::bigint) end "text" from e join paras p on p.para_id = e.qa)"""


def _window_answers(t):
    docs = t("paras").select(F.col("para_id").alias("qa"), "text")
    n = docs.select("qa", segment.word_count(F.col("text")).alias("n"))
    # outer: else a filter on the windows is pushed below the count, which is then made again for each window
    win = n.select("qa", "n", F.explode_outer(segment.windows(F.col("n"), 24, 12)).alias("s")).filter("s is not null")
    e = t("embeddings")
    vectors = decode.proposals(e.select("vec_id", F.slice("embedding", 1, 32).alias("start_scores"), F.slice("embedding", 33, 32).alias("end_scores")), 5, 12)
    win = win.crossJoin(F.broadcast(e.agg(F.count("*").alias("k"))))  # one row
    win = win.withColumn("feature", F.floor(F.col("s") / 12)).withColumn("vec_id", F.pmod(F.col("qa") * 13 + F.col("feature"), F.col("k")))
    features = win.hint("merge").join(vectors, "vec_id").select(  # windows are estimated by compressed files, far too low for a broadcast
        "qa", "feature", "pairs", "none", F.lit(4).alias("context_offset"), F.least(F.lit(24), F.col("n") - F.col("s")).alias("context_length"), (F.col("s") - 4).alias("context_shift"),
    )
    ranked = decode.with_words(decode.n_best(features, 5, 12, small=True), docs)
    return ranked.select("qa", "rank", "feature", "start", "end", "char_start", "char_end", "score", "prob", "text")


@C.add(f"with {_TEXT} select * from nb")
def nbest_text(t):
    """The best distinct answers over overlapping windows of each paragraph, in tokens, signs and text, with probabilities."""
    return _window_answers(t)


@C.add(f"""with {_TEXT}, best as (select qa, min("rank") filter ("start" >= 0) r, max(score) filter ("start" < 0) score_null from nb group by qa)
 select best.qa, case when score_null - nb.score < 0 then "start" else -1 end "start", case when score_null - nb.score < 0 then "end" else -1 end "end", nb.score score_best, score_null,
 case when score_null - nb.score < 0 then "text" else '' end "text" from best left join nb on nb.qa = best.qa and nb."rank" = best.r""")
def answer_text(t):
    """The answer text of each paragraph, '' where none beats no answer."""
    return decode.answers(_window_answers(t), "text")
