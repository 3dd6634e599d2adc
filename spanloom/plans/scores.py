"""Queries over scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import scoring as S
from .common import Catalogue
from .texts import TOKENS

C = Catalogue()

_GOLD = """g0 as (select *, row_number() over (partition by title, para_idx, q_id order by loaded_at, written_at nulls first) rn from test_meta_id),
 g as (select title, para_idx, q_id, type gtype, array_to_string(coalesce(answers, []), chr(10)) gold from g0 where rn = 1)"""
_PLAIN = "case when coalesce(prediction, '') in ('No', 'No.') then '' else regexp_replace(coalesce(prediction, ''), '^Yes\\.', '') end"
_FACTS = f"""{_GOLD}, b as (select p.title, p.para_idx, p.q_id, p.type, {TOKENS.format(x="g.gold")} gw, {TOKENS.format(x=_PLAIN)} pw
 from predictions p left join g using (title, para_idx, q_id)), f as (select title, para_idx, q_id, type, len(gw) n_gold, len(pw) n_pred,
 coalesce(list_sum(list_transform(list_distinct(gw), lambda x: least(len(list_filter(gw, lambda y: y = x)), len(list_filter(pw, lambda y: y = x))))), 0)::bigint n_joint from b)"""
_SAFE = "coalesce({j} / nullif({p}, 0), 1.0)::double p, coalesce({j} / nullif({g}, 0), 1.0)::double r, coalesce(2 * {j} / nullif({g} + {p}, 0), 1.0)::double f1, coalesce({j} / nullif({g} + {p} - {j}, 0), 1.0)::double iou"
_ROW = _SAFE.format(j="n_joint", p="n_pred", g="n_gold")
_SUM = _SAFE.format(j="sum(n_joint)", p="sum(n_pred)", g="sum(n_gold)")
_ROUND = "round(p, 6) p, round(r, 6) r, round(f1, 6) f1, round(iou, 6) iou"


def _gold(t):
    gold = S.first_delivery(t("test_meta_id").select("title", "para_idx", "q_id", "type", "answers", "written_at", "loaded_at"))
    return gold.withColumn("gold", F.array_join(F.coalesce("answers", F.array().cast("array<string>")), "\n"))


def _facts(t):
    return S.facts(t("predictions"), _gold(t), T.predicted_text)


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(n, 6).alias(n) for n in ("p", "r", "f1", "iou")])


@C.add(f"with {_FACTS} select title, para_idx, q_id, type, n_gold::int n_gold, n_pred::int n_pred, n_joint::int n_joint from f")
def pair_token_counts(t):
    """Tokens of annotation and prediction of each sample, and those in common."""
    return _facts(t)


@C.add(f"with {_FACTS}, s as (select title, para_idx, q_id, {_ROW} from f) select title, para_idx, q_id, {_ROUND} from s")
def pair_prf_safe(t):
    """Scores of each sample; an empty side is fully right."""
    return _rounded(S.scored(_facts(t)), "title", "para_idx", "q_id")


@C.add(f"""with {_FACTS} select title, para_idx, q_id, round(coalesce(n_joint / nullif(n_pred, 0), 0), 6)::double p, round(coalesce(n_joint / nullif(n_gold, 0), 0), 6)::double r,
 round(coalesce(2 * n_joint / nullif(n_gold + n_pred, 0), 0), 6)::double f1, round(coalesce(n_joint / nullif(n_gold + n_pred - n_joint, 0), 0), 6)::double iou from f""")
def pair_prf_zero(t):
    """Scores of each sample; nothing by nothing is 0."""
    return _rounded(S.scored(_facts(t), M.strict), "title", "para_idx", "q_id")


@C.add(f"""with {_FACTS} select title, para_idx, q_id, round(case when n_gold = 0 or n_pred = 0 then (n_gold = n_pred)::int else coalesce(n_joint / nullif(n_pred, 0), 0) end, 6)::double p,
 round(case when n_gold = 0 or n_pred = 0 then (n_gold = n_pred)::int else coalesce(n_joint / nullif(n_gold, 0), 0) end, 6)::double r,
 round(case when n_gold = 0 or n_pred = 0 then (n_gold = n_pred)::int else coalesce(2 * n_joint / nullif(n_gold + n_pred, 0), 0) end, 6)::double f1 from f""")
def pair_prf_squad(t):
    """Scores of each sample; with an empty side, whether both are."""
    return S.scored(_facts(t), M.agreeing).select("title", "para_idx", "q_id", *[F.round(n, 6).alias(n) for n in ("p", "r", "f1")])


@C.add(f"with {_FACTS}, s as (select {_SUM} from f) select {_ROUND} from s")
def metrics_micro(t):
    """Scores of the sums over all samples."""
    return _rounded(S.micro(_facts(t)))


@C.add(f"with {_FACTS}, q as (select q_id, {_SUM} from f group by q_id) select round(avg(p), 6) p, round(avg(r), 6) r, round(avg(f1), 6) f1, round(avg(iou), 6) iou from q")
def metrics_macro(t):
    """Mean over questions of their scores."""
    return _rounded(S.macro(_facts(t)))


@C.add(f"""with {_FACTS}, d as (select q_id, title, {_SUM} from f group by all), q as (select q_id, avg(p) p, avg(r) r, avg(f1) f1, avg(iou) iou from d group by q_id)
 select round(avg(p), 6) p, round(avg(r), 6) r, round(avg(f1), 6) f1, round(avg(iou), 6) iou from q""")
def metrics_doc_macro(t):
    """Mean over questions of the mean over contracts."""
    return _rounded(S.document_macro(_facts(t)))


@C.add(f"""with {_FACTS}, q as (select q_id, {_SUM} from f group by q_id), d as (select q_id, title, {_SUM} from f group by all), dq as (select q_id, avg(f1) doc_f1, avg(iou) doc_iou from d group by q_id)
 select q_id, {_ROUND}, round(doc_f1, 6) doc_f1, round(doc_iou, 6) doc_iou from q full join dq using (q_id)""")
def metrics_by_question(t):
    """Scores of each question, over its sums and over contracts, in one table."""
    per_doc = S.scored(S.total(_facts(t), "q_id", "title")).withColumnsRenamed({"f1": "own_f1", "iou": "own_iou"}).drop("p", "r")
    per = per_doc.groupBy("q_id").agg(*[F.sum(c).alias(c) for c in S.COUNTS], F.round(F.avg("own_f1"), 6).alias("doc_f1"), F.round(F.avg("own_iou"), 6).alias("doc_iou"))
    return _rounded(S.scored(per), "q_id", "doc_f1", "doc_iou")


@C.add(f"""with {_FACTS}, d as (select title, {_SUM} from f group by title), a as (select {_SUM} from f) select 'docave' kind, round(avg(p), 6) p, round(avg(r), 6) r, round(avg(f1), 6) f1, round(avg(iou), 6) iou from d
 union all select 'docsum', {_ROUND} from a""")
def metrics_docave_docsum(t):
    """Mean over contracts, and the score of all sums."""
    names = ("p", "r", "f1", "iou")
    per_doc = S.scored(S.total(_facts(t), "title")).withColumnsRenamed({n: f"own_{n}" for n in names})
    one = S.scored(per_doc.agg(*[F.sum(c).alias(c) for c in S.COUNTS], *[F.avg(f"own_{n}").alias(f"mean_{n}") for n in names]))  # one row
    both = F.array(*(F.struct(F.lit(kind).alias("kind"), *[F.round(c.format(n), 6).alias(n) for n in names]) for kind, c in (("docave", "mean_{}"), ("docsum", "{}"))))
    return one.select(F.inline(both))


@C.add(f"""with {_FACTS}, s as (select q_id, title, grouping(q_id, title)::int level, {_SUM} from f group by grouping sets ((q_id, title), (q_id), (title), ())) select q_id, title, level, {_ROUND} from s""")
def metrics_grouping_sets(t):
    """All roll-ups of one scan: by question and contract, by either, and over all."""
    facts = _facts(t).select("q_id", "title", *S.COUNTS)
    sums = facts.groupingSets([["q_id", "title"], ["q_id"], ["title"], []], "q_id", "title").agg(F.grouping_id().cast("int").alias("level"), *[F.sum(c).alias(c) for c in S.COUNTS])
    return _rounded(S.scored(sums), "q_id", "title", "level")


@C.add(f"with {_GOLD} select g.title, g.para_idx, g.q_id from g anti join predictions p using (title, para_idx, q_id)")
def completeness_anti(t):
    """Annotated samples that no prediction answers."""
    return S.missing(_gold(t), t("predictions")).select("title", "para_idx", "q_id")


@C.add(f"""with {_GOLD}, gg as (select title, q_id, string_agg(gold, ' ' order by para_idx) gold from g where gold <> '' group by all), pp as (select title, q_id, string_agg({_PLAIN}, ' ' order by para_idx) pred from predictions where {_PLAIN} <> '' group by all),
 b as (select coalesce(gg.title, pp.title) title, coalesce(gg.q_id, pp.q_id) q_id, {TOKENS.format(x="gold")} gw, {TOKENS.format(x="pred")} pw from gg full join pp on gg.title = pp.title and gg.q_id = pp.q_id)
 select title, q_id, len(gw)::int n_gold, len(pw)::int n_pred, coalesce(list_sum(list_transform(list_distinct(gw), lambda x: least(len(list_filter(gw, lambda y: y = x)), len(list_filter(pw, lambda y: y = x))))), 0)::int n_joint from b""")
def gold_pred_full_outer(t):
    """Annotations and predictions of a contract and question joined as one text each, whichever side is there."""
    glue = lambda df, c: df.filter(F.col(c) != "").groupBy("title", "q_id").agg(  # noqa: E731  (paragraphs of one contract)
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", c))), lambda x: x[c]), " ").alias(c)
    )
    both = glue(_gold(t), "gold").join(glue(t("predictions").withColumn("pred", T.predicted_text(F.col("prediction"))), "pred"), ["title", "q_id"], "full_outer")
    return M.with_counts(both, F.col("gold"), F.col("pred")).select("title", "q_id", *S.COUNTS)


_NA = "((('0x' || substr(md5('7|' || p.title || '|' || p.para_idx || '|' || p.q_id), 1, 13))::bigint + 1)::double / 4503599627370497::double)"


@C.add(f"""with {_GOLD}, b as (select p.title, p.q_id, {_NA} na, {TOKENS.format(x="prediction")} pw, list_filter(list_transform(coalesce(g0.answers, []), lambda a: {TOKENS.format(x="a")}), lambda w: len(w) > 0) gs
 from predictions p join g0 on g0.title = p.title and g0.para_idx = p.para_idx and g0.q_id = p.q_id and g0.rn = 1), c as (select *, flatten(gs) gw, len(gs) > 0 has from b),
 d as (select *, len(gw) g, len(pw) n, coalesce(list_sum(list_transform(list_distinct(gw), lambda x: least(len(list_filter(gw, lambda y: y = x)), len(list_filter(pw, lambda y: y = x))))), 0) j,
 (case when len(gs) = 0 then len(pw) = 0 else list_contains(gs, pw) end)::int exact from c),
 s as (select *, case when g = 0 or n = 0 then (g = n)::int else j / n end p, case when g = 0 or n = 0 then (g = n)::int else j / g end r, case when g = 0 or n = 0 then (g = n)::int else 2 * j / (g + n) end f1 from d),
 z as (select *, na > 0.9 held, case when na > 0.9 then (not has)::int else exact end exact_z, case when na > 0.9 then (not has)::int else f1 end f1_z from s)
 select count(*)::bigint total, count(*) filter (held)::bigint withheld, round(100 * avg(exact), 6) exact, round(100 * avg(f1), 6) f1, round(100 * avg(p), 6) p, round(100 * avg(r), 6) r,
 round(100 * avg(exact_z) filter (has), 6) has_answer_exact, round(100 * avg(f1_z) filter (has), 6) has_answer_f1, count(*) filter (has)::bigint has_answer_total,
 round(100 * avg(exact_z) filter (not has), 6) no_answer_exact, round(100 * avg(f1_z) filter (not has), 6) no_answer_f1, count(*) filter (not has)::bigint no_answer_total from z""")
def squad_scores_threshold(t):
    """Exact and token scores in percent, of all and by whether there is an answer, with answers withheld above a probability of none (seeded numbers stand in for a model's)."""
    from ..operators.sampling import variate

    both = t("predictions").join(_gold(t).select("title", "para_idx", "q_id", "answers"), ["title", "para_idx", "q_id"])
    rows = S.answer_scores(both.select("answers", "prediction", variate(7, "title", "para_idx", "q_id").alias("na_prob")))
    has = F.exists(F.coalesce("answers", F.array().cast("array<string>")), lambda a: F.size(T.tokens(a)) > 0)
    return S.squad_report(rows.withColumn("has_answer", has), 0.9)


@C.add(f"with {_FACTS} select n_gold > 0 has_answer, n_pred > 0 has_prediction, count(*)::bigint n from f group by all")
def confusion_2x2(t):
    """Samples by whether there is an answer, and a prediction."""
    return _facts(t).groupBy((F.col("n_gold") > 0).alias("has_answer"), (F.col("n_pred") > 0).alias("has_prediction")).agg(F.count("*").alias("n"))


@C.add(f"""with {_FACTS}, s as (select type, n_gold, n_pred, {_ROW} from f) select round(avg(case when type = 1 then iou end), 6) true_iou, round(avg(case when type = 2 then iou end), 6) confusing_iou, round(avg(case when type = 3 then iou end), 6) random_iou,
 count(*) filter (type <= 2 and iou < 0.99)::bigint to_look_at, count(*) filter (n_pred > 0 and n_gold = 0)::bigint spurious from s""")
def conditional_means(t):
    """Mean overlap of each kind of sample, and how many are worth a look."""
    s, iou = S.scored(_facts(t)), F.col("iou")
    of = lambda k: F.round(F.avg(F.when(F.col("type") == k, iou)), 6)
    return s.agg(
        of(1).alias("true_iou"), of(2).alias("confusing_iou"), of(3).alias("random_iou"), F.count(F.when((F.col("type") <= 2) & (iou < 0.99), 1)).alias("to_look_at"), F.count(F.when((F.col("n_pred") > 0) & (F.col("n_gold") == 0), 1)).alias("spurious")
    )


@C.add(f"""with {_FACTS}, s as (select q_id, {_ROW} from f) select c.clause_type, coalesce(c.readme_group, '') grp, count(*)::bigint n, round(avg(p), 6) p, round(avg(r), 6) r, round(avg(f1), 6) f1, round(avg(iou), 6) iou, (rank() over (order by round(avg(f1), 6) desc))::int place
 from s join clauses c using (q_id) group by c.clause_type, c.readme_group""")
def mean_by_clause(t):
    """Mean scores by clause, ranked."""
    from pyspark.sql.window import Window

    rows = S.scored(_facts(t)).groupBy("q_id").agg(F.count("*").alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in ("p", "r", "f1", "iou")])
    named = rows.join(F.broadcast(t("clauses").select("q_id", "clause_type", F.coalesce("readme_group", F.lit("")).alias("grp"))), "q_id")  # 41 clauses
    return named.select("clause_type", "grp", "n", "p", "r", "f1", "iou", F.rank().over(Window.orderBy(F.desc("f1"))).alias("place"))  # 41 rows at most


@C.add(f"""with {_FACTS}, q as (select q_id, avg(n_gold) a, avg(n_joint) b, {_SUM} from f group by q_id) select count(*)::bigint n, round(corr(a, f1), 6) corr_len_f1, round(corr(a, b), 6) corr_len_joint from q""")
def corr_pair(t):
    """Whether longer answers of a clause go with better scores."""
    q = _facts(t).groupBy("q_id").agg(F.avg("n_gold").alias("a"), F.avg("n_joint").alias("b"), *[F.sum(c).alias(c) for c in S.COUNTS])
    return S.scored(q).agg(F.count("*").alias("n"), F.round(F.corr("a", "f1"), 6).alias("corr_len_f1"), F.round(F.corr("a", "b"), 6).alias("corr_len_joint"))


@C.add(f"""with {_GOLD}, gg as (select title, q_id, string_agg(gold, ' ' order by para_idx) gold from g where gold <> '' group by all), pp as (select title, q_id, string_agg({_PLAIN}, ' ' order by para_idx) pred from predictions where {_PLAIN} <> '' group by all),
 b as (select coalesce(gg.q_id, pp.q_id) q_id, {TOKENS.format(x="gold")} gw, {TOKENS.format(x="pred")} pw from gg full join pp on gg.title = pp.title and gg.q_id = pp.q_id),
 c as (select q_id, len(gw) g, len(pw) p, coalesce(list_sum(list_transform(list_distinct(gw), lambda x: least(len(list_filter(gw, lambda y: y = x)), len(list_filter(pw, lambda y: y = x))))), 0) j from b),
 q as (select q_id, avg(coalesce(j / nullif(p, 0), 0)) p, avg(coalesce(j / nullif(g, 0), 0)) r, avg(coalesce(2 * j / nullif(g + p, 0), 0)) f1, avg(coalesce(j / nullif(g + p - j, 0), 0)) iou, count(*) n from c group by q_id)
 select count(*)::bigint questions, sum(n)::bigint pairs, round(avg(p), 6) p, round(avg(r), 6) r, round(avg(f1), 6) f1, round(avg(iou), 6) iou from q""")
def metrics_merged_docs(t):
    """Scores of whole contracts: the mean over questions (those that occur) of the mean over contracts."""
    pairs = gold_pred_full_outer(t)
    per = S.scored(pairs, M.strict).groupBy("q_id").agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in ("p", "r", "f1", "iou")])
    return per.agg(F.count("*").alias("questions"), F.sum("n").alias("pairs"), *[F.round(F.avg(n), 6).alias(n) for n in ("p", "r", "f1", "iou")])


@C.add(f"""with {_GOLD}, b as (select p.title, p.para_idx, p.q_id, {TOKENS.format(x="prediction")} pw, list_transform(coalesce(g0.answers, []), lambda a: {TOKENS.format(x="a")}) gw
 from predictions p join g0 on g0.title = p.title and g0.para_idx = p.para_idx and g0.q_id = p.q_id and g0.rn = 1)
 select title, para_idx, q_id, case when len(gw) = 0 then len(pw) = 0 else len(list_filter(gw, lambda x: x = pw)) > 0 end exact from b""")
def exact_any_gold(t):
    """Whether a prediction equals any of its sample's answers; samples without a prediction are left out."""
    both = t("predictions").join(_gold(t).select("title", "para_idx", "q_id", "answers"), ["title", "para_idx", "q_id"])
    said, gold = T.tokens(F.col("prediction")), F.coalesce("answers", F.array().cast("array<string>"))
    return both.select("title", "para_idx", "q_id", F.when(F.size(gold) == 0, F.size(said) == 0).otherwise(F.exists(gold, lambda a: T.tokens(a) == said)).alias("exact"))


@C.add(f"""with {_FACTS}, s as (select title, para_idx, q_id, type, {_ROW} from f) select s.title, s.para_idx, s.q_id, c.clause_type, s.type, round(iou, 6) iou from s join clauses c using (q_id) where type <= 2 and iou < 0.99""")
def paragraph_questions(t):
    """Samples that went wrong, with the clause's name."""
    s = S.scored(_facts(t)).filter((F.col("type") <= 2) & (F.col("iou") < 0.99))
    return s.join(F.broadcast(t("clauses").select("q_id", "clause_type")), "q_id").select("title", "para_idx", "q_id", "clause_type", "type", F.round("iou", 6).alias("iou"))  # 41 clauses
