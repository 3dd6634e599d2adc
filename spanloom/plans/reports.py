"""Queries over statistics, run logs and the browsing service."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import matching_ratio, nearest
from ..operators import runs
from .common import Catalogue

C = Catalogue()


@C.add("""with q as (select title, para_id, unnest(qas) q from paras), c as (select q.q_id q_id, count(*)::bigint n, count(distinct title)::bigint titles, min(para_id) first_para from q group by 1)
 select q_id, n, titles, (row_number() over (order by n desc, q_id))::int by_count, (row_number() over (order by first_para, q_id))::int by_first from c qualify by_count <= 10 or by_first <= 5""")
def label_explode_topk(t):
    """The ten most frequent clauses and the five first met."""
    q = t("paras").select("title", "para_id", F.explode("qas").alias("q")).groupBy("q.q_id").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"), F.min("para_id").alias("first_para"))
    ranked = q.select("q_id", "n", "titles", F.row_number().over(Window.orderBy(F.desc("n"), "q_id")).alias("by_count"), F.row_number().over(Window.orderBy("first_para", "q_id")).alias("by_first"))  # 41 rows
    return ranked.filter("by_count <= 10 or by_first <= 5")


@C.add("""select source, count(*)::bigint n, round(avg(length(text)), 6) mean_length, max(length(text))::int longest, round(quantile_cont(length(text), 0.95), 4) p95, round(quantile_cont(length(text), 0.5), 4) median from paras group by source""")
def length_stats(t):
    """Paragraph lengths by source."""
    n = F.length("text")
    return t("paras").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.max(n).alias("longest"), F.round(F.percentile(n, F.lit(0.95)), 4).alias("p95"), F.round(F.percentile(n, F.lit(0.5)), 4).alias("median"))


@C.add("""with p as (select title, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) w, len(qas) > 0 has from paras), d as (select title, count(*) n, sum(w) w, sum(has::int) h from p group by title), k as (select title, count(distinct q_id) k from answers group by title)
 select count(*)::bigint docs, round(sum(n) / count(*), 6)::double paras_per_doc, round(sum(w) / sum(n), 6)::double words_per_para, round(100.0 * sum(h) / sum(n), 6)::double percent_with_clause, round(avg(coalesce(k, 0)), 6) clauses_per_doc from d left join k using (title)""")
def sparsity_stats(t):
    """Paragraphs per contract, words per paragraph, and how many carry a clause."""
    w = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    d = t("paras").select("title", w.alias("w"), (F.size("qas") > 0).cast("int").alias("h")).groupBy("title").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum("h").alias("h"))
    k = t("answers").groupBy("title").agg(F.countDistinct("q_id").alias("k"))
    return d.join(k, "title", "left").agg(
        F.count("*").alias("docs"), F.round(F.sum("n") / F.count("*"), 6).alias("paras_per_doc"), F.round(F.sum("w") / F.sum("n"), 6).alias("words_per_para"), F.round(100.0 * F.sum("h") / F.sum("n"), 6).alias("percent_with_clause"), F.round(F.avg(F.coalesce("k", F.lit(0))), 6).alias("clauses_per_doc")
    )


@C.add("""with q as (select title, para_id, unnest(qas) q from paras) select c.q_id, c.clause_type, count(distinct para_id)::bigint paras, count(distinct title)::bigint docs from clauses c left join q on q.q.q_id = c.q_id group by all""")
def clause_counts(t):
    """Paragraphs and contracts with each clause, clauses without any included."""
    q = t("paras").select("title", "para_id", F.explode("qas").alias("q")).groupBy("q.q_id").agg(F.countDistinct("para_id").alias("paras"), F.countDistinct("title").alias("docs"))
    return t("clauses").select("q_id", "clause_type").join(q, "q_id", "left").fillna(0, ["paras", "docs"])


@C.add("""select type, count(*)::bigint n, count(*) filter (prediction like 'None%')::bigint none, count(*) filter (prediction is null)::bigint nothing, count(*) filter (prediction = '')::bigint empty,
 count(*) filter (type > 0)::bigint kept, count(*) filter (coalesce(prediction, '') <> '' and prediction not like 'None%')::bigint said from predictions group by type""")
def prediction_predicates(t):
    """Predictions by what they begin with, or lack."""
    p, count = F.col("prediction"), lambda c: F.count(F.when(c, 1))
    return t("predictions").groupBy("type").agg(
        F.count("*").alias("n"), count(p.startswith("None")).alias("none"), count(p.isNull()).alias("nothing"), count(p == "").alias("empty"), count(F.col("type") > 0).alias("kept"), count((F.coalesce(p, F.lit("")) != "") & ~p.startswith("None")).alias("said")
    )


@C.add("""select para_id, list_contains(list_transform(qas, lambda q: q.q_id), 3) has_3, len(list_filter(list_transform(qas, lambda q: q.q_id), lambda x: x = 3)) > 1 has_3_twice, len(list_filter(qas, lambda q: len(list_filter(q.answers, lambda a: contains(a.text, ' of '))) > 0)) > 0 any_of from paras""")
def array_predicates(t):
    """Whether a paragraph's annotations hold a clause, hold it twice, or hold some text."""
    ids = F.transform("qas", lambda q: q["q_id"])
    some = F.exists("qas", lambda q: F.coalesce(F.exists(q["answers"], lambda a: F.coalesce(a["text"].contains(" of "), F.lit(False))), F.lit(False)))
    return t("paras").select("para_id", F.array_contains(ids, 3).alias("has_3"), (F.size(F.filter(ids, lambda x: x == 3)) > 1).alias("has_3_twice"), some.alias("any_of"))


_LOG = "l as (select event_id, user_id, event_type, ts, value, (props::json->>'k')::int step from events)"


def _log(t):
    return t("events").select("event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("step"))


@C.add(f"""with {_LOG} select user_id, max((event_type = 'purchase')::int) has_purchase, max((event_type = 'error')::int) has_error, (case when bool_or(event_type = 'purchase') then 2 when bool_or(event_type = 'click') then 1 else 0 end)::int level,
 count(*)::bigint lines, max(step) last_step from l group by user_id""")
def run_registry(t):
    """What each run has, as a level from 0 to 2."""
    is_ = lambda k: (F.col("event_type") == k)
    level = F.when(F.bool_or(is_("purchase")), 2).when(F.bool_or(is_("click")), 1).otherwise(0)
    return _log(t).groupBy("user_id").agg(F.max(is_("purchase").cast("int")).alias("has_purchase"), F.max(is_("error").cast("int")).alias("has_error"), level.alias("level"), F.count("*").alias("lines"), F.max("step").alias("last_step"))


@C.add(f"with {_LOG}, b as (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) r from l where value is not null) select user_id, event_type, event_id, step, value from b where r = 1")
def best_checkpoint(t):
    """The best line of each run and kind, the first at a tie."""
    return runs.best(_log(t), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id", "step", "value")


@C.add(f"""with {_LOG}, s as (select user_id, event_type, max(value) best from l group by all) select event_type, count(*)::bigint n, round(avg(best), 6) mean_best, concat_ws(' & ', event_type, count(*), round(avg(best), 2)::decimal(18, 2)) latex from s group by event_type""")
def split_average(t):
    """Best values averaged over runs, and a line of a table."""
    s = _log(t).groupBy("user_id", "event_type").agg(F.max("value").alias("best"))
    return s.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean_best"), F.concat_ws(" & ", "event_type", F.count("*").cast("string"), F.round(F.avg("best"), 2).cast("decimal(18,2)").cast("string")).alias("latex"))


@C.add(f"""with {_LOG}, s as (select user_id, avg(value) filter (event_type = 'click') a, avg(value) filter (event_type = 'view') b from l group by user_id) select count(*)::bigint n, round(avg(coalesce(a, 0) - coalesce(b, 0)), 6) gap, count(*) filter (a is null or b is null)::bigint one_sided from s""")
def generalization_gap(t):
    """The mean gap between two kinds of results of the same run; a missing side counts as 0."""
    side = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    both = _log(t).groupBy("user_id").agg(side("click").alias("a"), side("view").alias("b"))
    return both.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))), 6).alias("gap"), F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("one_sided"))


@C.add(f"with {_LOG}, r as (select *, row_number() over (partition by user_id order by event_id desc) k from l) select user_id, event_id, step, k > 3 deleted from r")
def retention_lastn(t):
    """Lines of each run that are kept, the newest three, and that go."""
    return runs.marked_last(_log(t), ["user_id"], "event_id", 3).select("user_id", "event_id", "step", (~F.col("kept")).alias("deleted"))


@C.add(f"""with {_LOG}, g as (select *, case when step <= lag(step) over (partition by user_id order by event_id) then event_id end fell from l), m as (select *, max(fell) over (partition by user_id) since from g),
 k as (select * from m where since is null or event_id >= since) select user_id, event_id, step, round(step / nullif(first(step) over (partition by user_id order by event_id), 0), 6) relative from k""")
def loss_last_restart(t):
    """Log lines since the last restart, with steps relative to the first."""
    rows = runs.last_restart(_log(t), ["user_id"], "event_id", "step")
    return rows.select("user_id", "event_id", "step", F.round(runs.relative_to_first(rows, ["user_id"], "event_id", "step"), 6).alias("relative"))


@C.add(f"with {_LOG} select (event_id // 100)::bigint block, count(*)::bigint n, round(avg(value), 6) mean_value, round(avg(case when event_id % 100 > 0 then value end), 6) mean_after_first from l group by 1")
def loss_log_mean(t):
    """Means of every hundred log lines, with and without the first."""
    return _log(t).groupBy(F.floor(F.col("event_id") / 100).alias("block")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg(F.when(F.col("event_id") % 100 > 0, F.col("value"))), 6).alias("mean_after_first"))


@C.add(f"""with {_LOG}, d as (select user_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by event_id)) d, row_number() over (partition by user_id order by event_id) i from l)
 select user_id, count(*)::bigint steps, round(avg(case when i > 2 then d end) / 1e6, 3) mean_step, round(1e6 / nullif(avg(case when i > 2 then d end), 0), 6) per_second from d group by user_id""")
def throughput(t):
    """Mean time of a step after the first, and steps a second."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = _log(t).select("user_id", (us - F.lag(us).over(w)).alias("d"), F.row_number().over(w).alias("i"))
    mean = F.avg(F.when(F.col("i") > 2, F.col("d")))
    return d.groupBy("user_id").agg(F.count("*").alias("steps"), F.round(mean / 1e6, 3).alias("mean_step"), F.round(1e6 / F.nullif(mean, F.lit(0.0)), 6).alias("per_second"))


@C.add(f"with {_LOG}, m as (select user_id, step item, max(event_id) seen from l group by all) select user_id, item, seen, (row_number() over (partition by user_id order by seen desc, item))::int place from m")
def mru_history(t):
    """What each user looked at, newest first, each once."""
    return runs.recently_used(_log(t).select("user_id", F.col("step").alias("item"), F.col("event_id").alias("seen")), ["user_id"], "item", "seen")


@C.add("""select source, count(*)::bigint files, sum(octet_length(encode(text)))::bigint bytes, round(avg(octet_length(encode(text))), 3) mean_bytes, round(sum(octet_length(encode(text))) / 10240.0, 3)::double samples from documents where text is not null group by source""")
def corpus_cost(t):
    """Sizes by source, and how many samples of 1,024 tokens of ten bytes they make."""
    b = F.octet_length("text")
    return t("documents").filter("text is not null").groupBy("source").agg(F.count("*").alias("files"), F.sum(b).cast("bigint").alias("bytes"), F.round(F.avg(b), 3).alias("mean_bytes"), F.round(F.sum(b) / 10240.0, 3).alias("samples"))


@C.add("""select event_type, least(greatest(floor(value / 10)::int + 1, 0), 21)::bigint bucket, count(*)::bigint n from events where value is not null group by all""")
def value_histogram(t):
    """Values in buckets of ten."""
    return t("events").filter("value is not null").groupBy("event_type", F.width_bucket("value", F.lit(0.0), F.lit(200.0), F.lit(20)).alias("bucket")).agg(F.count("*").alias("n"))


@C.add("""select user_id, round(max(value) filter (event_type = 'click'), 6) click, round(max(value) filter (event_type = 'error'), 6) error, round(max(value) filter (event_type = 'purchase'), 6) purchase, round(max(value) filter (event_type = 'view'), 6) "view" from events group by user_id""")
def field_pivot(t):
    """Kinds of values as columns, one row per key."""
    return t("events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "view"]).agg(F.round(F.max("value"), 6))


@C.add("""select c.q_id, c.clause_type, c.readme_clause_type from clauses c where c.clause_type is distinct from c.readme_clause_type union all
 select q_id, null, null from (select distinct q_id from answers) where q_id not in (select q_id from clauses)""")
def catalogue_compare(t):
    """Clauses whose two names differ, and numbers without a clause."""
    c = t("clauses").select("q_id", "clause_type", "readme_clause_type", F.lit(1).alias("here"))
    both = c.join(t("answers").select("q_id").distinct(), "q_id", "full_outer")
    return both.filter(F.col("here").isNull() | ~F.col("clause_type").eqNullSafe(F.col("readme_clause_type"))).select("q_id", "clause_type", "readme_clause_type")


@C.add("""with n as (select distinct lower(split_part(qa_id, '__', 2)) name from answers), p as (select name, clause_type, levenshtein(name, clause_type) d from n, (select distinct clause_type from clauses)),
 r as (select *, row_number() over (partition by name order by d, clause_type) k from p) select name, clause_type, d::int distance from r where k = 1""")
def fuzzy_name_match(t):
    """Each clause name as written with the nearest of the catalogue."""
    names = t("answers").select(F.lower(F.split_part("qa_id", F.lit("__"), F.lit(2))).alias("name"))
    return nearest(names, "name", t("clauses"), "clause_type")


@C.add()
def fuzzy_ratio_match(t):
    """The same by the ratio of matching blocks, which SQL doesn't have."""
    names = t("answers").select(F.lower(F.split_part("qa_id", F.lit("__"), F.lit(2))).alias("name")).distinct()
    pairs = names.crossJoin(F.broadcast(t("clauses").select("clause_type"))).withColumn("ratio", F.round(matching_ratio(F.col("name"), F.lower("clause_type")), 6))  # 41 clauses
    return pairs.groupBy("name").agg(F.max(F.struct("ratio", "clause_type")).alias("m")).select("name", "m.clause_type", "m.ratio")


@C.add("""with n as (select title, (row_number() over (order by title) - 1)::int idx, count(*) over () n, doc_text, list_transform(qas, lambda q: q.is_impossible) impossible from cuadv1), a as (select event_id, case when step = 0 then -1 else step * 7 end asked, lag(step * 7, 1, 0) over (partition by user_id order by event_id) last_seen
 from (select event_id, user_id, (props::json->>'k')::int step from events)), c as (select event_id, asked, greatest(0, least(case when asked = -1 then last_seen else asked end, (select max(n) from n) - 1)) idx from a)
 select event_id, asked, n.idx, title, coalesce(length(doc_text), -1)::int n_chars, len(list_filter(impossible, lambda x: not x))::int answerable, impossible from c join n using (idx)""")
def contract_view(t):
    """Contracts looked up by number, brought into range, with the answerable questions of each."""
    docs = t("cuadv1").select("title", F.length("doc_text").alias("k"), F.transform("qas", lambda q: q["is_impossible"]).alias("impossible"))
    n = F.broadcast(docs.agg(F.count("*").cast("int").alias("n")))  # one row
    numbered = runs.running_sums(docs.withColumn("one", F.lit(1)), "title", ["one"]).select("title", "k", "impossible", (F.col("sum_one") - 1).cast("int").alias("idx"))
    log = _log(t)
    asked = F.when(F.col("step") == 0, -1).otherwise(F.col("step") * 7)
    log = log.select("event_id", asked.alias("asked"), F.lag(F.col("step") * 7, 1, 0).over(Window.partitionBy("user_id").orderBy("event_id")).alias("last_seen")).join(n)
    at = log.select("event_id", "asked", runs.clamped(F.col("asked"), F.col("n"), F.col("last_seen")).alias("idx"))
    return at.join(numbered, "idx").select("event_id", "asked", "idx", "title", F.coalesce("k", F.lit(-1)).alias("n_chars"), F.size(F.filter("impossible", lambda x: ~x)).alias("answerable"), "impossible")


@C.add("""with q as (select title, unnest(qas) q, generate_subscripts(qas, 1) i from cuadv1), v as (select title, i, q.qa_id qa_id, list_transform(q.answers, lambda a: a.text) a from q where len(q.answers) > 0)
 select title, list(split_part(qa_id, '__', 2) order by i) clauses, list(array_to_string(a, ' | ') order by i) texts from v group by title""")
def clause_values(t):
    """Clauses of each contract in order, with their texts."""
    found = F.filter(F.coalesce("qas", F.array()), lambda q: F.size(q["answers"]) > 0)
    rows = t("cuadv1").select("title", found.alias("f")).filter(F.size("f") > 0)
    return rows.select("title", F.transform("f", lambda q: F.split_part(q["qa_id"], F.lit("__"), F.lit(2))).alias("clauses"), F.transform("f", lambda q: F.array_join(F.transform(q["answers"], lambda a: a["text"]), " | ")).alias("texts"))


@C.add("""with g as (select title, min(para_id) first_para, count(*)::bigint n, count(*) filter (coalesce(text, '') = '')::bigint blank from paras group by title) select title, first_para, n, blank, (row_number() over (order by first_para, title))::int place from g""")
def first_appearance_groups(t):
    """Contracts as groups of paragraphs, in the order in which they first appear."""
    g = t("paras").groupBy("title").agg(F.min("para_id").alias("first_para"), F.count("*").alias("n"), F.count(F.when(F.coalesce("text", F.lit("")) == "", 1)).alias("blank"))
    g = g.withColumns({"one": F.lit(1), "key": F.concat(F.lpad(F.col("first_para").cast("string"), 20, "0"), F.coalesce("title", F.lit("")))})
    return runs.running_sums(g, "key", ["one"]).select("title", "first_para", "n", "blank", F.col("sum_one").cast("int").alias("place"))


@C.add("""with u as (select 'train' part, title, para_idx, q_id, type, loaded_at, written_at from train_meta union all select 'test', title, para_idx, q_id, type, loaded_at, written_at from test_meta_id),
 d as (select part, title, para_idx, q_id, count(*) k, max(epoch_us(loaded_at) - epoch_us(written_at)) late from u group by all)
 select part, count(*)::bigint keys, sum(k)::bigint rows_all, sum(k - 1)::bigint repeated, count(*) filter (late > 86400000000)::bigint late_day, count(*) filter (title is null)::bigint no_title from d group by part""")
def delivery_report(t):
    """Samples delivered twice, late, or without a title."""
    cols = ("title", "para_idx", "q_id", "loaded_at", "written_at")
    u = t("train_meta").select(F.lit("train").alias("part"), *cols).unionByName(t("test_meta_id").select(F.lit("test").alias("part"), *cols))
    d = u.groupBy("part", "title", "para_idx", "q_id").agg(F.count("*").alias("k"), F.max(F.unix_micros("loaded_at") - F.unix_micros("written_at")).alias("late"))
    return d.groupBy("part").agg(
        F.count("*").alias("keys"), F.sum("k").alias("rows_all"), F.sum(F.col("k") - 1).alias("repeated"), F.count(F.when(F.col("late") > 86_400_000_000, 1)).alias("late_day"), F.count(F.when(F.col("title").isNull(), 1)).alias("no_title")
    )


@C.add()
def doc_state_sequence(t):
    """A predictor that sees what it said of the ten paragraphs before, contract by contract."""
    from ..streaming.state import sequential

    def predict(row: dict, memory: list[str]) -> str:
        long = [w for w in (row["text"] or "").split() if len(w) > 8]
        return next((w for w in long if w not in memory), "None")

    paras = t("paras").select("title", "para_idx", "para_id", "text")
    return sequential(paras, "title", ["para_idx", "para_id"], predict, 10).select("para_id", "said")


@C.add()
def stream_file_resume(t):
    """Paragraphs read as a stream of files, in two runs of one checkpoint: each row once."""
    from ..streaming.files import read_twice

    return read_twice(t("paras").select("para_id", "title", "text"), "para_id long, title string, text string").select("para_id", "title", F.md5("text").alias("text_md5"))
