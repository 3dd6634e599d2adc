"""Queries over spans and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, spans
from .common import Catalogue

C = Catalogue()

PARTS = "parts as (select para_id, title, para_idx, \"offset\" o, length(text) n from paras where text <> '')"
ANSWERS = "ans as (select answer_id, title, q_id, text, start_pos s, end_pos e from answers where start_pos is not null and end_pos is not null)"


def _parts(t):
    return t("paras").filter("text <> ''").select("para_id", "title", "para_idx", "offset", F.length("text").alias("length"))


def _answers(t):
    return t("answers").filter("start_pos is not null and end_pos is not null").select("answer_id", "title", "q_id", F.col("text").alias("answer_text"), "start_pos", "end_pos")


@C.add("""with d as (select title, unnest(qas, recursive := false) q from cuadv1), a as (select title, q.qa_id qa_id, unnest(q.answers) a from d)
 select 'contracts' source, count(*)::bigint checked, count(*) filter (a.text is distinct from substr(c.doc_text, a.start_pos + 1, a.end_pos - a.start_pos + 1))::bigint differing
 from a join cuadv1 c using (title) union all
 select 'answers', count(*)::bigint, count(*) filter (a.text is distinct from substr(c.doc_text, a.start_pos + 1, a.end_pos - a.start_pos + 1))::bigint from answers a join cuadv1 c using (title)""")
def gold_span_check(t):
    """How many annotated texts aren't the text at their place."""
    at = lambda start, end: F.substr("doc_text", start + 1, end - start + 1)
    all_ = F.flatten(F.transform("qas", lambda q: F.coalesce(q["answers"], F.lit(None).cast("array<struct<text:string,start_pos:int,end_pos:int>>"))))
    own = t("cuadv1").select(F.filter("qas", lambda q: q["answers"].isNotNull()).alias("qas"), "doc_text").select(all_.alias("a"), "doc_text")
    differing = F.size(F.filter("a", lambda a: ~at(a["start_pos"], a["end_pos"]).eqNullSafe(a["text"])))
    own = own.agg(F.lit("contracts").alias("source"), F.coalesce(F.sum(F.size("a")), F.lit(0)).alias("checked"), F.coalesce(F.sum(differing), F.lit(0)).alias("differing"))
    flat = t("answers").select("title", "text", "start_pos", "end_pos").join(t("cuadv1").select("title", "doc_text"), "title")
    flat = flat.agg(F.lit("answers").alias("source"), F.count("*").alias("checked"), F.sum((~at(F.col("start_pos"), F.col("end_pos")).eqNullSafe(F.col("text"))).cast("bigint")).alias("differing"))
    return own.unionByName(flat)


@C.add(f"""with {PARTS}, {ANSWERS} select p.para_id, answer_id, q_id, s - o start_pos, e - o end_pos from ans join parts p on ans.title = p.title and s >= o and e <= o + n - 1""")
def answers_in_paragraph(t):
    """Answers that lie wholly in a paragraph, in its coordinates."""
    return annotate.contained(_answers(t).drop("answer_text"), _parts(t), "title").select("para_id", "answer_id", "q_id", "start_pos", "end_pos")


@C.add(f"""with {ANSWERS}, parts as (select title, unnest(range(0, length(doc_text)::bigint, 500))::int o, length(doc_text) n from cuadv1 where doc_text <> ''),
 p as (select title, o, least(500, n - o) m, (o // 500) chunk_index from parts)
 select answer_id, p.title, chunk_index::bigint chunk_index, (greatest(s, o) - o)::int start_pos, (least(e, o + m - 1) - o)::int end_pos, substr(text, (greatest(s, o) - s + 1)::int, (least(e, o + m - 1) - greatest(s, o) + 1)::int) answer_text
 from ans join p on ans.title = p.title and greatest(s, o) <= least(e, o + m - 1)""")
def answers_clip_to_chunk(t):
    """Answers cut to every chunk of 500 signs that they overlap."""
    chunks = t("cuadv1").filter("doc_text <> ''").select("title", F.length("doc_text").alias("n")).select("title", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(500))).alias("offset"))
    chunks = chunks.select("title", "offset", F.least(F.lit(500), F.col("n") - F.col("offset")).alias("length"), F.floor(F.col("offset") / 500).alias("chunk_index"))
    return annotate.clip(_answers(t), chunks, "title").select("answer_id", "title", "chunk_index", F.col("start_pos").cast("int"), F.col("end_pos").cast("int"), "answer_text")


@C.add(f"""with {ANSWERS}, o as (select title, s, e + 1 e, max(e + 1) over (partition by title order by s, e rows between unbounded preceding and 1 preceding) m from ans),
 g as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by title order by s, e rows unbounded preceding) g from o)
 select title, min(s) s, max(e) e from g group by title, g""")
def span_union(t):
    """Annotated stretches of each contract, united where they overlap or touch."""
    return spans.union(_answers(t).select("title", F.col("start_pos").alias("s"), (F.col("end_pos") + 1).alias("e")), "title", "s", "e")


@C.add(f"""with {ANSWERS}, o as (select title, s, e + 1 e, max(e + 1) over (partition by title order by s, e rows between unbounded preceding and 1 preceding) m from ans),
 u as (select title, min(s) s, max(e) e from (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by title order by s, e rows unbounded preceding) g from o) group by title, g),
 d as (select title, coalesce(length(doc_text), 0) n from cuadv1), r as (select title, coalesce(lag(e) over (partition by title order by s), 0) s, s e from u
 union all select d.title, coalesce(max(u.e), 0), n from d left join u using (title) group by d.title, n) select title, s, e from r where e > s""")
def span_complement(t):
    """What no answer covers of each contract."""
    own = _answers(t).select("title", F.col("start_pos").alias("s"), (F.col("end_pos") + 1).alias("e"))
    return spans.complement(own, t("cuadv1").select("title", F.coalesce(F.length("doc_text"), F.lit(0)).alias("n")), "title", "s", "e", "n")


_ATOMS = f"""with {ANSWERS}, d as (select title, length(doc_text)::int n from cuadv1 where doc_text <> ''), sp as (select ans.title, s, e + 1 e, q_id::varchar l from ans join d using (title)),
 pt as (select title, s p from sp union select title, e from sp union select title, 0 from d union select title, n from d),
 pc as (select * from (select title, p a, lead(p) over (partition by title order by p) b from pt) where b is not null),
 st as (select pc.title, a, b, list_sort(list_distinct(list(l) filter (l is not null))) labels from pc left join sp on pc.title = sp.title and s <= a and e >= b group by pc.title, a, b),
 mk as (select *, case when lag(labels) over (partition by title order by a) = labels then 0 else 1 end nw from st),
 gr as (select *, sum(nw) over (partition by title order by a rows unbounded preceding) g from mk), atoms as (select title, min(a) s, max(b) e, coalesce(labels, []) labels from gr group by title, g, labels)"""


def _atoms(t):
    docs = t("cuadv1").filter("doc_text <> ''").select("title", F.length("doc_text").alias("n"))
    own = _answers(t).join(docs.select("title"), "title", "left_semi").select("title", F.col("start_pos").alias("s"), (F.col("end_pos") + 1).alias("e"), "q_id")
    return spans.atoms(own, docs, "title", "s", "e", "q_id", "n")


@C.add(_ATOMS + " select title, s, e, labels from atoms")
def atom_spans(t):
    """Contracts cut into the longest runs under the same clauses."""
    return _atoms(t)


@C.add(_ATOMS + " select title, sum(case when len(labels) > 1 then e - s else 0 end)::bigint chars_many, sum(case when len(labels) = 1 then e - s else 0 end)::bigint chars_one, sum(e - s)::bigint chars from atoms group by title")
def overlap_coverage(t):
    """How many signs of each contract stand under one clause, and under several."""
    n = F.col("e") - F.col("s")
    part = lambda c: F.sum(F.when(c, n).otherwise(0))
    return _atoms(t).groupBy("title").agg(part(F.size("labels") > 1).alias("chars_many"), part(F.size("labels") == 1).alias("chars_one"), F.sum(n).alias("chars"))


@C.add(f"""with {ANSWERS} select answer_id, s - lag(e) over (partition by title order by s, e, answer_id) gap from ans""")
def span_gap(t):
    """The distance of each answer from the one before it in its contract."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("title").orderBy("start_pos", "end_pos", "answer_id")
    return _answers(t).select("answer_id", (F.col("start_pos") - F.lag("end_pos").over(order)).alias("gap"))


_TOKENS = """w as (select para_id, text, unnest(list_transform(string_split(text, ' '), lambda x, i: struct_pack(i := i, n := length(x)))) u from paras where text <> ''),
 c as (select para_id, u.i i, u.n n, sum(u.n + 1) over (partition by para_id order by u.i) - u.n - 1 c from w), tok as (select para_id, row_number() over (partition by para_id order by i) - 1 tok_i, c::int c_start, (c + n)::int c_end from c where n > 0)"""


@C.add(f"""with {_TOKENS}, ch as (select para_id, tok_i, unnest(range(c_start, c_end)) char_i from tok) select para_id, char_i::int char_i, min(tok_i)::int tok_first, (max(tok_i) + 1)::int tok_end from ch group by para_id, char_i""")
def token_char_invert(t):
    """Which word covers each sign of a paragraph."""
    from ..operators.segment import words_with_places

    return spans.invert_token_map(words_with_places(t("paras").filter("text <> ''"), "para_id", "text"), "para_id")


@C.add("""with f as (select title, unnest(new2old_map) o, generate_subscripts(new2old_map, 1) - 1 n from cuadv1), g as (select title, n, o, lead(o) over (partition by title order by n) - o - 1 r from f)
 select title, o + 1 old_start, r removed, n::int new_pos from g where r > 0""")
def position_map_old_new(t):
    """Signs of the raw contract that the clean one dropped, and the place they fall back to."""
    return spans.removed_ranges(t("cuadv1"), "title", "new2old_map")


@C.add(f"""{_ATOMS}, p as (select title, q_id, para_idx from predictions where coalesce(prediction, '') <> ''), x as (select title, list(distinct q_id::varchar) q from p group by title)
 select title, s, e, case when len(labels) = 0 then 'none' when len(labels) = 1 then 'one' else 'many' end shown, coalesce(list_has_any(labels, q), false) predicted from atoms left join x using (title)""")
def span_highlight(t):
    """How each run is to be shown, and whether a prediction names one of its clauses."""
    said = t("predictions").filter("coalesce(prediction, '') <> ''").groupBy("title").agg(F.collect_set(F.col("q_id").cast("string")).alias("q"))  # 41 at most
    n = F.size("labels")
    shown = F.when(n == 0, "none").when(n == 1, "one").otherwise("many")
    return _atoms(t).join(said, "title", "left").select("title", "s", "e", shown.alias("shown"), F.coalesce(F.arrays_overlap("labels", "q"), F.lit(False)).alias("predicted"))
