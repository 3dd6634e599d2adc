"""Queries over samples' kinds, aligned series, averages and agreement of two forms of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annotate, rebase, runs, spans
from ..operators import scoring as S
from ..operators import segment as G
from ..sources import files
from ..streaming.files import scratch, seeded_order
from .common import Catalogue
from .corpus import _RAW, _raw
from .reports import _LOG, _log
from .samples import _ONLY, _POS, _TRAIN, _parts, _positives
from .scores import _FACTS, _ROW, _gold, _facts
from .stored import _RUNS, _tree

C = Catalogue()


@C.add("""select title, para_idx, q_id, case when q_id % 2 = 0 then not coalesce(prediction, 'None') like '%None' else not coalesce(prediction, 'None') like 'None%' end positive from predictions""")
def positive_samples(t):
    """Samples with an answer, told by their prompt or, without one, by their target."""
    said = F.coalesce("prediction", F.lit("None"))
    prompt = F.when(F.col("q_id") % 2 == 0, F.concat(F.lit("Answer:\n"), said))
    return t("predictions").select("title", "para_idx", "q_id", T.is_positive(prompt, said).alias("positive"))


@C.add("""with p as (select q_id, 'runs/' || (case q_id % 5 when 0 then 'flan-t5-xl' when 1 then 'llama3_chat' when 2 then 'mistral' when 3 then 't5-large' else 'other' end) || '/s' || q_id path from clauses)
 select path, case when contains(path, 't5') then 'flan-t5' when contains(path, 'llama3') then 'llama3' when contains(path, 'mistral') then 'mistral' end tokenizer from p""")
def tokenizer_by_path(t):
    """The tokenizer of a run, by its path."""
    names = F.array(*map(F.lit, ("flan-t5-xl", "llama3_chat", "mistral", "t5-large", "other")))
    path = F.concat(F.lit("runs/"), F.get(names, F.col("q_id") % 5), F.lit("/s"), F.col("q_id"))
    return t("clauses").select(path.alias("path")).withColumn("tokenizer", T.tokenizer_of(F.col("path")))


@C.add("""select kind, q_id, count(*)::bigint n from (select type kind, q_id from train_meta union all select type, q_id from test_meta_id) group by all""")
def kind_of_samples(t):
    """Samples by kind, where one table calls the column small and the other type."""
    old = t("train_meta").select("q_id", F.col("type").alias("small"))
    both = S.with_kind(old).select("q_id", "kind").unionByName(S.with_kind(t("test_meta_id").select("q_id", "type")).select("q_id", "kind"))
    return both.groupBy("kind", "q_id").agg(F.count("*").alias("n"))


@C.add("""select answer_id, split_part(qa_id, '__', 1) title, c.q_id found_q_id, case when text = '' then 'None' else text end prediction from answers a left join clauses c on c.clause_type = split_part(a.qa_id, '__', 2)""")
def qa_predictions(t):
    """Answers under a question's id as predictions by contract and number of the clause, 'None' for empty ones."""
    p = t("answers").select("answer_id", T.qa_parts(F.col("qa_id"))["title"].alias("title"), F.split_part("qa_id", F.lit("__"), F.lit(2)).alias("clause_type"), T.answer_or_none(F.col("text")).alias("prediction"))
    return p.join(F.broadcast(t("clauses").select("clause_type", F.col("q_id").alias("found_q_id"))), "clause_type", "left").drop("clause_type")  # 41 clauses


@C.add("""with l as (select event_type, (event_id // 50) step, avg(value) v from events group by all), w as (select step, max(v) filter (event_type = 'click') click, max(v) filter (event_type = 'view') "view", max(v) filter (event_type = 'purchase') purchase from l group by step)
 select step::bigint step, round(click, 6) click, round("view", 6) "view", round(purchase, 6) purchase from w""")
def aligned_series(t):
    """Curves of several runs side by side, step by step; null where one has no value."""
    step = F.floor(F.col("event_id") / 50).alias("step")
    of = lambda k: F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 6).alias(k)
    return t("events").groupBy(step).agg(of("click"), of("view"), of("purchase"))


@C.add(f"""with {_RUNS}, m as (select 'm' || (q_id % 3) model, 's' || (q_id % 2) s, avg(case when q_id % 3 <> 0 then q_id / 41 end) a, avg(case when q_id % 4 = 0 then q_id / 82 end) b from runs where q_id % 3 <> 0 or q_id % 4 = 0 group by all)
 select model, count(*)::bigint splits, round(avg(a), 6) f1_all, round(avg(b), 6) f1_sampled from m group by model""")
def tree_averages(t):
    """Metrics of a tree of runs, averaged within each split and then over the splits of a model."""
    pairs = files.paired_metrics(files.metrics_tree(t("predictions").sparkSession, _tree(t), ["f1"]), ["f1"], ("all", "sampled"))
    per = pairs.groupBy("model", "split").agg(F.avg("f1_all").alias("a"), F.avg("f1_sampled").alias("b"))
    return per.groupBy("model").agg(F.count("*").alias("splits"), F.round(F.avg("a"), 6).alias("f1_all"), F.round(F.avg("b"), 6).alias("f1_sampled"))


@C.add(f"""with {_FACTS}, s as (select q_id, type, {_ROW} from f) select q_id, round(avg(iou), 6) iou, count(*)::bigint n from s where type = 1 group by q_id""")
def clause_curve(t):
    """One kind's mean overlap by clause, in the order of clauses."""
    return S.scored(_facts(t).filter("type = 1")).groupBy("q_id").agg(F.round(F.avg("iou"), 6).alias("iou"), F.count("*").alias("n")).orderBy("q_id")  # 41 rows


@C.add("""with n as (select source, length(text) n from paras where text is not null), q as (select source, quantile_cont(n, [0.0, 0.25, 0.5, 0.75, 1.0]) q from n group by source)
 select n.source, round(q[1], 4) least, round(q[2], 4) q1, round(q[3], 4) median, round(q[4], 4) q3, round(q[5], 4) most, count(*) filter (n < q[2] - 1.5 * (q[4] - q[2]) or n > q[4] + 1.5 * (q[4] - q[2]))::bigint outside from n join q on n.source is not distinct from q.source group by all""")
def length_boxplot(t):
    """What a box plot of paragraph lengths by source shows."""
    n = t("paras").filter("text is not null").select("source", F.length("text").alias("n"))
    q = n.groupBy("source").agg(F.percentile("n", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q")).withColumnRenamed("source", "_s")  # a row a source
    wide = 1.5 * (F.col("q")[3] - F.col("q")[1])
    both = n.join(F.broadcast(q), F.col("source").eqNullSafe(F.col("_s")))
    outside = F.sum(((F.col("n") < F.col("q")[1] - wide) | (F.col("n") > F.col("q")[3] + wide)).cast("bigint")).alias("outside")
    rows = both.groupBy("source").agg(F.first("q").alias("q"), outside)
    return rows.select("source", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("least", "q1", "median", "q3", "most"))], "outside")


@C.add("""with c as (select title, unnest(qas) q, generate_subscripts(qas, 1) - 1 q_id from cuadv1), a as (select title, q_id, unnest(q.answers) a from c), w as (select title, q_id, string_agg(a.text, '' order by a.start_pos, a.text) x from a group by all),
 p as (select title, para_idx, para_id, unnest(qas) q from paras), b as (select title, para_idx, para_id, q.q_id q_id, unnest(q.answers) a from p), y as (select title, q_id, string_agg(a.text, '' order by para_idx, para_id, a.start_pos, a.text) x from b group by all)
 select coalesce(w.title, y.title) title, coalesce(w.q_id, y.q_id)::int q_id, length(w.x)::int n_whole, length(y.x)::int n_parts, w.x is not distinct from y.x same, levenshtein(w.x, y.x)::int edits from w full join y on w.title = y.title and w.q_id = y.q_id""")
def clause_agreement(t):
    """Answers of each contract and clause put together, before and after the division into paragraphs, and how far they differ."""
    glue = lambda rows, *order: rows.groupBy("title", "q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "a.start_pos", "a.text"))), lambda v: v["text"]), "").alias("x"))  # noqa: E731  (answers of one clause of a contract)
    whole = glue(t("cuadv1").select("title", F.posexplode("qas").alias("q_id", "q")).select("title", "q_id", F.explode("q.answers").alias("a")))
    parts = glue(t("paras").select("title", "para_idx", "para_id", F.explode("qas").alias("q")).select("title", "para_idx", "para_id", "q.q_id", F.explode("q.answers").alias("a")), "para_idx", "para_id")
    both = whole.join(parts.withColumnRenamed("x", "y"), ["title", "q_id"], "full_outer")
    return both.select("title", "q_id", F.length("x").alias("n_whole"), F.length("y").alias("n_parts"), F.col("x").eqNullSafe(F.col("y")).alias("same"), F.levenshtein("x", "y").alias("edits"))


@C.add(f"""with {_RAW}, q as (select title, unnest(qas) q, generate_subscripts(qas, 1) - 1 q_id from cuadv1), o as (select title, q_id, unnest(q.answers) a from q),
 l as (select title, i, x, sum(length(x) + 1) over (partition by title order by i) - length(x) - 1 o from (select title, unnest(string_split(t, chr(10))) x, generate_subscripts(string_split(t, chr(10)), 1) i from raw)),
 p as (select title, row_number() over (partition by title order by i) - 1 para_idx, x, o from l where x <> ''),
 c as (select p.title, para_idx, q_id, x, greatest(a.start_pos, o) - o s, least(a.end_pos, o + length(x) - 1) - o e from o a1(title, q_id, a) join p on p.title = a1.title and greatest(a.start_pos, o) <= least(a.end_pos, o + length(x) - 1))
 select title, para_idx::int para_idx, q_id::int q_id, (greatest(length(regexp_replace(substr(x, 1, (s + 1)::bigint), ' +', ' ', 'g')) - 1, 0))::int start_pos, (length(regexp_replace(substr(x, 1, (e + 1)::bigint), ' +', ' ', 'g')) - 1)::int end_pos from c""")
def paragraph_examples(t):
    """Annotations cut to the paragraphs of a text and moved to where they are once its blanks are single."""
    docs = _raw(t)
    paras = G.paragraphs(docs, "title", "t").withColumn("key", F.concat_ws("#", "title", "para_idx"))
    q = t("cuadv1").select("title", F.posexplode("qas").alias("q_id", "q")).select("title", "q_id", F.explode("q.answers").alias("a"))
    answers = q.select("title", "q_id", "a.start_pos", "a.end_pos", F.col("a.text").alias("answer_text"))
    cut = annotate.clip(answers, paras.select("title", "key", "para_idx", "offset", "length"), "title").select("key", "title", "para_idx", "q_id", F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    used = paras.select("key", "text").join(cut.select("key").distinct(), "key", "left_semi")
    runs = rebase.kept_runs(used, "key", "text", "(?<= ) +")
    moved = rebase.moved(rebase.moved(cut, runs, "key", "s"), runs, "key", "e")
    return moved.select("title", "para_idx", "q_id", F.col("new_s").alias("start_pos"), F.col("new_e").alias("end_pos"))


# gold spans, and predictions found in their paragraph, as labelled spans of the contract
_BOTH = """d as (select title, length(doc_text)::int n from cuadv1 where doc_text <> ''), pr as (select p.title, p.q_id, x."offset" + instr(x.text, p.prediction) - 1 s, length(p.prediction) n from predictions p
 join (select title, para_idx, any_value(text order by para_id) text, any_value("offset" order by para_id) "offset" from paras group by all) x on x.title = p.title and x.para_idx = p.para_idx where p.prediction <> '' and instr(x.text, p.prediction) > 0),
 sp as (select a.title, start_pos s, end_pos + 1 e, 'gold_' || q_id l from answers a join d using (title) where start_pos is not null and end_pos is not null union all select pr.title, s, s + pr.n, 'pred_' || q_id from pr join d using (title)),
 pt as (select title, s p from sp union select title, e from sp union select title, 0 from d union select title, n from d), pc as (select * from (select title, p a, lead(p) over (partition by title order by p) b from pt) where b is not null),
 st as (select pc.title, a, b, list_sort(list_distinct(list(l) filter (l is not null))) labels from pc left join sp on pc.title = sp.title and s <= a and e >= b group by pc.title, a, b),
 mk as (select *, case when lag(labels) over (partition by title order by a) = labels then 0 else 1 end nw from st), gr as (select *, sum(nw) over (partition by title order by a rows unbounded preceding) g from mk),
 atoms as (select title, min(a) s, max(b) e, coalesce(labels, []) labels from gr group by title, g, labels),
 ty as (select *, list_transform(list_filter(labels, lambda x: starts_with(x, 'gold_')), lambda x: x[6:]) gold, list_transform(list_filter(labels, lambda x: starts_with(x, 'pred_')), lambda x: x[6:]) pred from atoms)"""


def _both_atoms(t):
    docs = t("cuadv1").filter("doc_text <> ''").select("title", F.length("doc_text").alias("n"))
    gold = t("answers").filter("start_pos is not null and end_pos is not null").select("title", F.col("start_pos").alias("s"), (F.col("end_pos") + 1).alias("e"), F.concat(F.lit("gold_"), "q_id").alias("l"))
    paras = t("paras").groupBy("title", "para_idx").agg(F.min_by(F.struct("text", "offset"), "para_id").alias("x")).select("title", "para_idx", "x.*")
    said = t("predictions").filter("prediction <> ''").join(paras, ["title", "para_idx"]).withColumn("at", F.expr("instr(text, prediction)")).filter("at > 0")
    said = said.select("title", (F.col("offset") + F.col("at") - 1).alias("s"), (F.col("offset") + F.col("at") - 1 + F.length("prediction")).alias("e"), F.concat(F.lit("pred_"), "q_id").alias("l"))
    both = gold.unionByName(said).join(docs.select("title"), "title", "left_semi")
    atoms = spans.atoms(both, docs, "title", "s", "e", "l", "n")
    return atoms.withColumns({"gold": T.with_prefix(F.col("labels"), "gold_"), "pred": T.with_prefix(F.col("labels"), "pred_")})


@C.add(f"""with {_BOTH} select title, s::int s, e::int e, labels, case when len(gold) = 0 then 'none' when len(gold) = 1 then 'one' else 'many' end shown, list_has_any(gold, pred) correct, list_contains(gold, '3') clause_3 from ty""")
def atom_spans_predicted(t):
    """Contracts cut into runs under the same annotated and predicted clauses, how each is to be shown, whether a prediction is right, and whether one clause is in it."""
    n = F.size("gold")
    shown = F.when(n == 0, "none").when(n == 1, "one").otherwise("many")
    return _both_atoms(t).select("title", "s", "e", "labels", shown.alias("shown"), F.arrays_overlap("gold", "pred").alias("correct"), F.array_contains("gold", "3").alias("clause_3"))


@C.add(f"""with {_LOG}, n as (select title, row_number() over (order by title) - 1 idx, count(*) over () n from cuadv1), v as (select user_id, event_id, greatest(0, least(step * 7, (select max(n) from n) - 1)) idx from l),
 u as (select user_id, idx, max(event_id) event_id from v group by all), k as (select *, row_number() over (partition by user_id order by event_id desc, idx) place from u), a as (select title, count(*) k, sum(len(q))::bigint s from (select title, list_filter(qas, lambda q: not coalesce(q.is_impossible, true)) q from cuadv1) group by title)
 select k.user_id, n.title, k.event_id, k.place::int place, a.s answerable from k join n using (idx) join a using (title) where place <= 10""")
def view_history(t):
    """The ten contracts that each user viewed last, with their answerable questions."""
    docs = t("cuadv1").select("title", F.size(F.filter("qas", lambda q: ~F.coalesce(q["is_impossible"], F.lit(True)))).cast("bigint").alias("answerable"))
    numbered = runs.running_sums(docs.withColumn("one", F.lit(1)), "title", ["one"]).select("title", "answerable", (F.col("sum_one") - 1).alias("idx"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    viewed = _log(t).crossJoin(n).select("user_id", "event_id", F.greatest(F.lit(0), F.least(F.col("step") * 7, F.col("n") - 1)).alias("idx"))
    last = runs.recently_used(viewed, ["user_id"], "idx", "event_id").filter("place <= 10")
    return last.join(numbered, "idx").select("user_id", "title", "event_id", "place", "answerable")


@C.add("""with p as (select md5(title) || '.txt' name from cuadv1 where doc_text <> '') select name, md5('5|' || name) lot, (('0x' || substr(md5('5|' || name), 1, 8))::bigint % 4)::int part, (row_number() over (order by name) - 1)::int idx from p""")
def source_file_order(t):
    """Files of a folder, sorted by name and numbered, with their place in a seeded order and the reader of four that takes them."""
    docs = t("cuadv1").filter("doc_text <> ''").select(F.concat(F.md5("title"), F.lit(".txt")).alias("name"), F.col("doc_text").alias("content"))
    at = scratch(docs.sparkSession)
    files.write_files(docs, at)
    listed = seeded_order(files.files(docs.sparkSession, at, "*.txt").select("name"), 5, 4, "name")
    return runs.running_sums(listed.withColumn("one", F.lit(1)), "name", ["one"]).select("name", "lot", "part", (F.col("sum_one") - 1).cast("int").alias("idx"))


@C.add("""select title, regexp_extract(title, '-EX-([0-9.]+)-', 1) exhibit, length(doc_text)::bigint n from cuadv1 where doc_text <> ''""")
def source_master_join(t):
    """A folder of contracts joined with the table that lists them, by the names of their files as keys."""
    docs = t("cuadv1").filter("doc_text <> ''").withColumn("key", T.file_key(F.concat("title", F.lit(".pdf"))))
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    files.write_files(docs.select(F.concat(F.lit("texts/"), F.md5("key"), F.lit(".txt")).alias("name"), F.col("doc_text").alias("content")), at)
    files.write_csv(docs.select(F.concat("title", F.lit(".pdf")).alias("file"), F.regexp_extract("title", "-EX-([0-9.]+)-", 1).alias("exhibit")), f"{at}/master")
    master = files.csv(spark, f"{at}/master", "file string, exhibit string").select(F.md5(T.file_key(F.col("file"))).alias("name"), F.regexp_replace("file", "\\.pdf$", "").alias("title"), "exhibit")
    return files.texts(spark, f"{at}/texts").join(master, "name").select("title", "exhibit", F.length("content").cast("bigint").alias("n"))


@C.add(f"""with {_FACTS}, q as (select q_id, sum(n_joint) j, sum(n_gold) g, sum(n_pred) p from f group by q_id), m as (select c.q_id, case when q.q_id is not null then coalesce(2 * j / nullif(g + p, 0), 1) end f1 from clauses c left join q using (q_id))
 select count(*)::bigint classes, count(*) filter (f1 is null)::bigint absent, round(avg(f1), 6) mean_present, case when count(*) = count(f1) then round(avg(f1), 6) end mean_strict from m""")
def macro_all_classes(t):
    """The mean score over all clauses: over those that occur, and, as the strict form has it, of none if one is absent."""
    per = S.scored(S.total(_facts(t), "q_id")).select("q_id", "f1")
    rows = t("clauses").select("q_id").join(per, "q_id", "left")
    mean = F.round(F.avg("f1"), 6)
    return rows.agg(F.count("*").alias("classes"), (F.count("*") - F.count("f1")).alias("absent"), mean.alias("mean_present"), F.when(F.count("*") == F.count("f1"), mean).alias("mean_strict"))


@C.add(f"""with ti as (select distinct title from test_meta_id where title is not null), x as (select title, para_idx, any_value(text order by para_id) text from paras where text <> '' group by all)
 select title, para_idx, c.q_id, case when c.q_id in {_ONLY} then 'id' else 'ood' end part, md5('Text: ' || text || chr(10) || 'Clause: ' || clause_type || chr(10) || clause_quest || chr(10) || 'Answer:' || chr(10)) source_md5 from x join ti using (title), clauses c""")
def test_grid_prompts(t):
    """A prompt for every paragraph of the test contracts and every clause, told apart by whether the clause was kept for training."""
    titles = t("test_meta_id").select("title").distinct()
    texts = t("paras").filter("text <> ''").join(titles, "title", "left_semi").groupBy("title", "para_idx").agg(F.min_by("text", "para_id").alias("text"))
    grid = texts.crossJoin(F.broadcast(t("clauses").select("q_id", "clause_type", "clause_quest")))  # 41 clauses
    source = T.render("Text: {text}\nClause: {clause}\n{quest}\nAnswer:\n", text=F.col("text"), clause=F.col("clause_type"), quest=F.col("clause_quest"))
    return grid.select("title", "para_idx", "q_id", F.when(F.col("q_id").isin(_TRAIN), "id").otherwise("ood").alias("part"), F.md5(source).alias("source_md5"))


@C.add(f"""with {_POS}, lab as (select doc, part, list("label" order by "label") labels from pos group by all), n as (select doc, part, row_number() over (partition by doc order by part) - 1 chunk_index from parts)
 select n.doc, n.part, chunk_index::int chunk_index, coalesce(labels, []) labels from n left join lab using (doc, part)""")
def contract_chunks(t):
    """The paragraphs of each contract in a row, numbered, with the clauses of each: what prompts of one contract are built from."""
    from pyspark.sql.window import Window

    labels = _positives(t).groupBy("doc", "part").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # 41 at most
    numbered = _parts(t).withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc").orderBy("part")) - 1)
    return numbered.join(labels, ["doc", "part"], "left").select("doc", "part", "chunk_index", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))


@C.add("""with g as (select title, para_idx, string_agg(gold, chr(10) order by q_id) gold from (select title, para_idx, q_id, array_to_string(answers, chr(10)) gold, row_number() over (partition by title, para_idx, q_id order by loaded_at, written_at nulls first) rn from test_meta_id) where rn = 1 and gold <> '' group by all)
 select p.title, p.para_idx, p.q_id, md5(coalesce(g.gold, '')) gold_md5 from predictions p left join g on g.title = p.title and g.para_idx = p.para_idx""")
def gold_by_paragraph(t):
    """Predictions with all that is annotated in their paragraph, '' where nothing is."""
    rows = _gold(t).filter("gold <> ''").groupBy("title", "para_idx").agg(F.array_sort(F.collect_list(F.struct("q_id", "gold"))).alias("x"))  # 41 at most
    gold = rows.select("title", "para_idx", F.array_join(F.transform("x", lambda v: v["gold"]), "\n").alias("gold"))
    return t("predictions").join(gold, ["title", "para_idx"], "left").select("title", "para_idx", "q_id", F.md5(F.coalesce("gold", F.lit(""))).alias("gold_md5"))


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@C.add()
def word_subwords(t):
    """Which word each subword token of a paragraph belongs to, and where each word's tokens begin."""
    from ..functions.subwords import word_maps

    maps = t("paras").select("para_id", word_maps(F.col("text"), *_tokenizer()).alias("m"))
    return maps.select("para_id", "m.token_word", "m.word_token")


@C.add()
def tokenizer_round_trip(t):
    """Paragraphs by source, and how many of them come back unchanged from their tokens."""
    from ..functions.subwords import round_trips

    rows = t("paras").select("source", round_trips(F.col("text"), *_tokenizer()).alias("same"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("same").alias("texts"), F.sum(F.col("same").cast("bigint")).alias("unchanged"))
