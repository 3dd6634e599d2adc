"""Queries over positive and negative samples, and memory frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import prompts, sampling
from .common import Catalogue

C = Catalogue()
SEED = 42

_POS = """pos as (select distinct title doc, para_idx part, q.q_id "label" from (select title, para_idx, unnest(qas) q from paras) where len(q.answers) > 0),
 parts as (select distinct title doc, para_idx part from paras where text <> '')"""
_LOT = "md5('42|' || {keys})"
_U = "((('0x' || substr(md5('42|' || {keys}), 1, 13))::bigint + 1)::double / 4503599627370497::double)"


def _positives(t):
    q = t("paras").select(F.col("title").alias("doc"), F.col("para_idx").alias("part"), F.explode("qas").alias("q"))
    return q.filter(F.size("q.answers") > 0).select("doc", "part", F.col("q.q_id").alias("label")).distinct()


def _parts(t):
    return t("paras").filter("text <> ''").select(F.col("title").alias("doc"), F.col("para_idx").alias("part")).distinct()


@C.add("""with q as (select title, para_idx, unnest(qas) q from paras), a as (select title, para_idx, q.q_id q_id, unnest(q.answers) a from q)
 select title, para_idx, q_id, list(a.text order by a.span_i, a.start_pos, a.text) answers, 0 "type" from a group by title, para_idx, q_id""")
def positives(t):
    """A row for each paragraph and clause with answers."""
    a = t("paras").select("title", "para_idx", F.explode("qas").alias("q")).select("title", "para_idx", "q.q_id", F.explode("q.answers").alias("a"))
    lists = a.groupBy("title", "para_idx", "q_id").agg(F.array_sort(F.collect_list(F.struct("a.span_i", "a.start_pos", "a.text"))).alias("x"))
    return lists.select("title", "para_idx", "q_id", F.transform("x", lambda v: v["text"]).alias("answers"), F.lit(0).alias("type"))


@C.add(f"""with {_POS}, w as (select doc, count(*) w from parts group by doc), n as (select "label", floor(count(*) * 1.0)::bigint want from pos group by "label"),
 g as (select p.doc, p.part, n."label", want, w from parts p join w using (doc), n where not exists (select 1 from pos where pos.doc = p.doc and pos.part = p.part and pos."label" = n."label")),
 r as (select *, row_number() over (partition by "label" order by round(-ln({_U.format(keys="doc || '|' || part || '|' || \"label\"")}) * w, 9), doc, part) k from g) select doc, part, "label" from r where k <= want""")
def neg_per_question(t):
    """As many paragraphs without a clause as with it, contracts equally likely."""
    return sampling.negatives_per_label(_positives(t), _parts(t), 1.0, SEED)


@C.add(f"""with {_POS}, p as (select distinct doc, part from pos), g as (select p.doc, p.part, c.q_id "label" from p, clauses c where not exists (select 1 from pos where pos.doc = p.doc and pos.part = p.part and pos."label" = c.q_id)),
 r as (select *, row_number() over (partition by doc, part order by {_LOT.format(keys="doc || '|' || part || '|' || \"label\"")}, doc, part, "label") k from g) select doc, part, "label" from r where k <= 2""")
def neg_per_paragraph(t):
    """Two clauses that a positive paragraph doesn't have."""
    return sampling.negatives_per_part(_positives(t), t("clauses").select(F.col("q_id").alias("label")), 2, SEED)


@C.add(f"""with x as (select title, para_idx, q_id, type, min(loaded_at) loaded_at from train_meta where title is not null group by all), k as (select *, (type = 0)::int pos, sum((type = 0)::int) over (partition by q_id) k from x),
 r as (select *, row_number() over (partition by q_id, pos order by {_LOT.format(keys="title || '|' || para_idx || '|' || q_id || '|' || type")}, title, para_idx, q_id, type) n from k)
 select title, para_idx, q_id, type from r where pos = 1 or n <= case when k > 0 then k else 1 end""")
def balance_windows(t):
    """All positive samples of each clause and as many negative ones."""
    rows = t("train_meta").filter("title is not null").groupBy("title", "para_idx", "q_id", "type").agg(F.min("loaded_at").alias("loaded_at"))
    return sampling.balance(rows, ["q_id"], ["title", "para_idx", "q_id", "type"], F.col("type") == 0, SEED).select("title", "para_idx", "q_id", "type")


@C.add(f"""with {_POS}, ti as (select distinct title doc from test_meta_id), pt as (select * from parts where doc in (select doc from ti)), np as (select doc, count(*) n from pt group by doc),
 g as (select p.doc, p.part, c.q_id "label", exists (select 1 from pos where pos.doc = p.doc and pos.part = p.part and pos."label" = c.q_id) is_pos from pt p, clauses c),
 h as (select *, max(is_pos::int) over (partition by doc, part) any_pos from g), ty as (select *, case when is_pos then 1 when any_pos = 1 then 2 else 0 end ty from h),
 r as (select ty.*, np.n, row_number() over (partition by ty.doc, "label", ty order by {_LOT.format(keys="ty.doc || '|' || part || '|' || \"label\"")}, part) k from ty join np using (doc))
 select (case when ty = 0 and k <= n // 10 then 3 else ty end)::int "type", "label", count(*)::bigint n, sum(part)::bigint part_sum from r group by 1, 2""")
def grid_test_types(t):
    """The grid of test paragraphs and clauses by kind of cell, a tenth of the plain ones drawn."""
    docs = t("test_meta_id").select(F.col("title").alias("doc")).distinct()
    parts = _parts(t).join(docs, "doc", "left_semi")
    pos = _positives(t).withColumn("is_pos", F.lit(True))
    grid = parts.crossJoin(F.broadcast(t("clauses").select(F.col("q_id").alias("label"))))  # 41 clauses
    has = pos.select("doc", "part").distinct().withColumn("any_pos", F.lit(True))
    cells = grid.join(pos, ["doc", "part", "label"], "left").join(has, ["doc", "part"], "left")
    kind = F.when(F.col("is_pos"), 1).when(F.col("any_pos"), 2).otherwise(0)
    cells = cells.withColumn("ty", kind).join(parts.groupBy("doc").agg(F.floor(F.count("*") / 10).alias("draw")), "doc")
    from pyspark.sql.window import Window

    drawn = F.row_number().over(Window.partitionBy("doc", "label", "ty").orderBy(sampling.lot(SEED, "doc", "part", "label"), "part"))
    typed = cells.withColumn("k", drawn).select(F.when((F.col("ty") == 0) & (F.col("k") <= F.col("draw")), 3).otherwise(F.col("ty")).alias("type"), "label", "part")
    return typed.groupBy("type", "label").agg(F.count("*").alias("n"), F.sum("part").alias("part_sum"))


@C.add("select * from (values " + ", ".join(f"({i}, '{s}')" for i, s in sampling.label_split(41, 29, SEED)) + ") v(q_id, part)")
def label_split(t):
    """Clauses split into 29 for training and 12 held out."""
    rows = sampling.label_split(41, 29, SEED)
    return t("clauses").select("q_id").join(F.broadcast(t("clauses").sparkSession.createDataFrame(rows, "q_id int, part string")), "q_id")


@C.add(f"""select para_id, (row_number() over (order by {_LOT.format(keys="para_id")}, para_id) - 1)::int place from (select distinct para_id from paras where source is not null) qualify place < 100""")
def seeded_sample(t):
    """A hundred paragraphs in a seeded order."""
    first = t("paras").filter("source is not null").select("para_id").orderBy(sampling.lot(SEED, "para_id"), "para_id").limit(100)  # a sampling operator
    from pyspark.sql.window import Window

    return first.select("para_id", (F.row_number().over(Window.orderBy(sampling.lot(SEED, "para_id"), "para_id")) - 1).alias("place"))


_HEAD = "array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: array_to_string(list_filter(string_split(x, ' '), lambda y: y <> '')[1:5], ' ')), '. ')"


@C.add(f"""with p as (select title, para_idx, para_id, {_HEAD} h from paras where text <> '') select para_id, coalesce(list(h) over (partition by title order by para_idx, para_id rows between 10 preceding and 1 preceding), []) memory from p""")
def memory_frame(t):
    """The first words of the ten paragraphs before each."""
    heads = t("paras").filter("text <> ''").select("title", "para_idx", "para_id", T.head(F.col("text")).alias("h"))
    return prompts.preceding(heads, "title", ["para_idx", "para_id"], "h", 10).select("para_id", "memory")


@C.add(f"""with p as (select title, para_idx, para_id, {_HEAD} h from paras where text <> ''), m as (select para_id, coalesce(list(h) over (partition by title order by para_idx, para_id rows between 10 preceding and 1 preceding), []) m from p),
 r as (select para_id, m, list_transform(m, lambda x, i: coalesce(list_sum(list_transform(m[i + 1:], lambda y: len(string_split(y, ' ')))), 0)) later from m)
 select para_id, 'Before: ' || array_to_string(list_filter(m, lambda x, i: later[i] <= 20), chr(10)) || chr(10) || 'Now:' memory_prompt from r""")
def memory_budget(t):
    """The same memory within twenty words, rendered; the item that crosses the budget is kept."""
    heads = t("paras").filter("text <> ''").select("title", "para_idx", "para_id", T.head(F.col("text")).alias("h"))
    framed = prompts.preceding(heads, "title", ["para_idx", "para_id"], "h", 10)
    kept = prompts.within_budget("memory", lambda x: F.size(F.split(x, " ")), 20)
    return framed.select("para_id", T.render("Before: {memory}\nNow:", memory=F.array_join(kept, "\n")).alias("memory_prompt"))


@C.add(f"""with {_POS}, t2 as (select title, count(distinct source) s from paras group by title), u as (select 'train' part, title, q_id, type from train_meta union all select 'test', title, q_id, type from test_meta_id)
 select part, type, count(*)::bigint n, count(distinct title)::bigint titles, count(distinct q_id)::bigint questions from u group by part, type""")
def sample_union(t):
    """Training and test samples in one table, counted by kind."""
    cols = ("title", "q_id", "type")
    both = t("train_meta").select(F.lit("train").alias("part"), *cols).unionByName(t("test_meta_id").select(F.lit("test").alias("part"), *cols))
    return both.groupBy("part", "type").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"), F.countDistinct("q_id").alias("questions"))


@C.add("""with s as (select distinct title, para_idx, q_id from test_meta_id), p as (select distinct title, para_idx, q_id from predictions) select 'missing' kind, count(*)::bigint n from (select * from s except select * from p)
 union all select 'extra', count(*)::bigint from (select * from p except select * from s) union all select 'both', count(*)::bigint from (select * from s intersect select * from p)""")
def sample_set_operations(t):
    """Samples only asked for, only answered, and both."""
    keys = ("title", "para_idx", "q_id")
    s, p = t("test_meta_id").select(*keys), t("predictions").select(*keys)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(s.subtract(p), "missing").unionByName(count(p.subtract(s), "extra")).unionByName(count(s.intersect(p), "both"))


_TRAIN = [i for i, part in sampling.label_split(41, 29, SEED) if part == "train"]
_ONLY = f"({', '.join(map(str, _TRAIN))})"
_SAMPLES = f"""{_POS}, lp as (select * from pos where "label" in {_ONLY}), w as (select doc, count(*) w from parts group by doc), n as (select "label", count(*) want from lp group by "label"),
 g1 as (select p.doc, p.part, n."label", want, w from parts p join w using (doc), n where not exists (select 1 from lp where lp.doc = p.doc and lp.part = p.part and lp."label" = n."label")),
 r1 as (select *, row_number() over (partition by "label" order by round(-ln({_U.format(keys="doc || '|' || part || '|' || \"label\"")}) * w, 9), doc, part) k from g1),
 g2 as (select p.doc, p.part, c.q_id "label" from (select distinct doc, part from lp) p, clauses c where c.q_id in {_ONLY} and not exists (select 1 from lp where lp.doc = p.doc and lp.part = p.part and lp."label" = c.q_id)),
 r2 as (select *, row_number() over (partition by doc, part order by {_LOT.format(keys="doc || '|' || part || '|' || \"label\"")}, doc, part, "label") k from g2),
 ans as (select title doc, para_idx part, q.q_id "label", q.answers a from (select title, para_idx, unnest(qas) q from paras) where len(q.answers) > 0),
 al as (select doc, part, "label", list(x.text order by x.span_i, x.start_pos, x.text) answers from (select doc, part, "label", unnest(a) x from ans) group by doc, part, "label"),
 u as (select doc, part, "label", answers, 0 "type" from lp join al using (doc, part, "label") union all select doc, part, "label", null, 1 from r1 where k <= want union all select doc, part, "label", null, 2 from r2 where k <= 1)"""
_PAST = "array_to_string(list_transform(answers, lambda x: '- ' || x), chr(10))"


def _typed_samples(t):
    """Positives (0), parts without a clause that others have (1), and clauses that a part doesn't have (2), over the clauses kept for training."""
    labels = t("clauses").select(F.col("q_id").alias("label")).filter(F.col("label").isin(_TRAIN))
    pos = _positives(t).join(F.broadcast(labels), "label")  # 29 labels
    lists = t("paras").select("title", "para_idx", F.explode("qas").alias("q")).select("title", "para_idx", "q.q_id", F.explode("q.answers").alias("a"))
    lists = lists.groupBy(F.col("title").alias("doc"), F.col("para_idx").alias("part"), F.col("q_id").alias("label")).agg(F.array_sort(F.collect_list(F.struct("a.span_i", "a.start_pos", "a.text"))).alias("x"))
    found = pos.join(lists, ["doc", "part", "label"]).select("doc", "part", "label", F.transform("x", lambda v: v["text"]).alias("answers"), F.lit(0).alias("type"))
    none = F.lit(None).cast("array<string>").alias("answers")
    other = sampling.negatives_per_label(pos, _parts(t), 1.0, SEED).select("doc", "part", "label", none, F.lit(1).alias("type"))
    lacking = sampling.negatives_per_part(pos, labels, 1, SEED).select("doc", "part", "label", none, F.lit(2).alias("type"))
    return found.unionByName(other).unionByName(lacking)


@C.add(f"""with {_SAMPLES}, x as (select title doc, para_idx part, any_value(text order by para_id) text from paras group by all)
 select doc, part, "label", "type", md5('Text: ' || coalesce(x.text, '') || chr(10) || 'Clause: ' || clause_type || chr(10) || clause_quest || chr(10) || 'Answer:' || chr(10)) source_md5,
 case when len(coalesce(answers, [])) > 0 then {_PAST} else 'No' end target from u join x using (doc, part) join clauses c on c.q_id = u."label\"""")
def sample_prompts(t):
    """Positive and both kinds of negative samples in one table, with their prompts and targets."""
    texts = t("paras").groupBy(F.col("title").alias("doc"), F.col("para_idx").alias("part")).agg(F.min_by("text", "para_id").alias("text"))
    rows = _typed_samples(t).join(texts, ["doc", "part"]).join(F.broadcast(t("clauses").select(F.col("q_id").alias("label"), "clause_type", "clause_quest")), "label")  # 41 clauses
    source = T.render("Text: {text}\nClause: {clause}\n{quest}\nAnswer:\n", text=F.col("text"), clause=F.col("clause_type"), quest=F.col("clause_quest"))
    return rows.select("doc", "part", "label", "type", F.md5(source).alias("source_md5"), T.target(F.col("answers"), "list").alias("target"))


@C.add(f"""with {_POS}, n as (select doc, "label", count(*) want from pos group by all), g as (select p.doc, p.part, n."label", want from parts p join n using (doc) where not exists (select 1 from pos where pos.doc = p.doc and pos.part = p.part and pos."label" = n."label")),
 r as (select *, row_number() over (partition by doc, "label" order by {_LOT.format(keys="doc || '|' || part || '|' || \"label\"")}, doc, part, "label") k from g) select doc, part, "label" from r where k <= want""")
def neg_within_contract(t):
    """For each contract and clause, as many of its paragraphs without the clause as with it."""
    return sampling.negatives_within(_positives(t), _parts(t), SEED)


@C.add(f"""with nm as (select map_from_entries(list({{'k': q_id, 'v': clause_type}})) m from clauses), p as (select title, para_idx, para_id, text, qas, '[' || {_HEAD} || '] (' || array_to_string(list_transform(qas, lambda q: m[q.q_id]), ', ') || ')' || chr(10) note from paras, nm where text <> ''),
 m as (select *, coalesce(list(note) over (partition by title order by para_idx, para_id rows between 10 preceding and 1 preceding), []) notes from p),
 r as (select *, list_transform(notes, lambda x, i: coalesce(list_sum(list_transform(notes[i + 1:], lambda y: len(string_split(y, ' ')))), 0)) later from m),
 e as (select para_id, text, array_to_string(list_filter(notes, lambda x, i: later[i] <= 40), '') memory, unnest(qas) q from r)
 select para_id, q.q_id q_id, md5('Earlier parts:' || chr(10) || (case when memory = '' then 'None' else memory end) || chr(10) || 'Text:' || chr(10) || text || chr(10) || c.clause_quest || chr(10) || 'Answer:' || chr(10)) source_md5,
 len(string_split(memory, chr(10))) - 1 n_notes from e join clauses c on c.q_id = e.q.q_id""")
def memory_prompts(t):
    """Prompts of each paragraph and clause that begin with notes of up to ten paragraphs before: their first words and the names of their clauses, within forty words."""
    clauses = t("clauses").select("q_id", "clause_type", "clause_quest")
    names = F.broadcast(clauses.agg(F.map_from_entries(F.collect_list(F.struct("q_id", "clause_type"))).alias("names")))  # one row of 41 names
    paras = t("paras").filter("text <> ''").crossJoin(names)
    note = F.concat(F.lit("["), T.head(F.col("text")), F.lit("] ("), F.array_join(F.transform("qas", lambda q: F.col("names")[q["q_id"]]), ", "), F.lit(")\n"))
    framed = prompts.preceding(paras.select("title", "para_idx", "para_id", "text", "qas", note.alias("note")), "title", ["para_idx", "para_id"], "note", 10)
    kept = prompts.within_budget("memory", lambda x: F.size(F.split(x, " ")), 40)
    rows = framed.select("para_id", "text", "qas", kept.alias("kept")).select("para_id", "text", "kept", F.explode("qas").alias("q")).select("para_id", "text", "kept", "q.q_id").join(F.broadcast(clauses), "q_id")
    memory = F.when(F.size("kept") == 0, F.lit("None")).otherwise(F.array_join("kept", ""))
    source = T.render("Earlier parts:\n{memory}\nText:\n{text}\n{quest}\nAnswer:\n", memory=memory, text=F.col("text"), quest=F.col("clause_quest"))
    return rows.select("para_id", "q_id", F.md5(source).alias("source_md5"), F.size("kept").cast("bigint").alias("n_notes"))
