"""Queries that build a corpus: cleaning with annotations, merging and cutting with answers, windows with labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import annotate, rebase, sampling
from ..operators import segment as S
from .common import Catalogue
from .samples import _LOT, SEED
from .spans import _TOKENS

C = Catalogue()

_CLEAN = "regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), '\\n+', chr(10), 'g')"
# texts as they may come, with blanks and line ends repeated; places of the annotations move with them
_RAW = """raw as (select title, regexp_replace(regexp_replace(doc_text, '([.,])', '\\1  ', 'g'), '\\n', chr(10) || chr(10) || chr(10), 'g') t from cuadv1 where doc_text is not null)"""


def _raw(t):
    wide = F.regexp_replace(F.regexp_replace("doc_text", "([.,])", "$1  "), "\n", "\n\n\n")
    return t("cuadv1").filter("doc_text is not null").select("title", wide.alias("t"))


@C.add(f"""with {_RAW}, c as (select title, t, unnest(string_split(t, '')) ch, generate_subscripts(string_split(t, ''), 1) - 1 old_pos from raw),
 k as (select *, not (ch in (' ', chr(10)) and coalesce(lag(ch) over (partition by title order by old_pos), '') = ch) keep from c where ch <> ''),
 n as (select title, old_pos, row_number() over (partition by title order by old_pos) - 1 new_pos from k where keep),
 r as (select title, old_pos - new_pos shift, min(old_pos) old_start, min(new_pos) new_start, count(*) "length" from n group by title, old_pos - new_pos)
 select title, old_start::int old_start, new_start::int new_start, "length"::int "length" from r""")
def clean_runs(t):
    """What stays of each text when repeated blanks and line ends go, as runs with their old and new places."""
    return rebase.kept_runs(_raw(t), "title", "t").filter("length > 0").select("title", "old_start", "new_start", "length")


@C.add(f"""with {_RAW}, q as (select title, unnest(qas) q, generate_subscripts(qas, 1) - 1 q_id from cuadv1), o as (select title, q_id, unnest(q.answers) a from q),
 x as (select title, q_id, greatest(length({_CLEAN.format(x="substr(t, 1, a.start_pos + 1)")}) - 1, 0) s, length({_CLEAN.format(x="substr(t, 1, a.end_pos + 1)")}) e from o join raw using (title) where a.start_pos <= a.end_pos),
 m as (select *, max(e) over (partition by title, q_id order by s, e rows between unbounded preceding and 1 preceding) m from x),
 g as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by title, q_id order by s, e rows unbounded preceding) g from m), u as (select title, q_id, min(s) s, max(e) e from g group by title, q_id, g)
 select title, q_id::int q_id, s::int start_pos, (e - 1)::int end_pos, substr({_CLEAN.format(x="t")}, s + 1, e - s) answer_text from u join raw using (title)""")
def clean_with_spans(t):
    """Annotations moved to the cleaned text and united."""
    q = t("cuadv1").select("title", F.posexplode("qas").alias("q_id", "q")).select("title", "q_id", F.explode("q.answers").alias("a"))
    return rebase.cleaned(_raw(t), q.select("title", "q_id", "a.start_pos", "a.end_pos"), "title", "t", ["q_id"])


@C.add(f"""with {_RAW}, p as (select a.answer_id, a.title, a.start_pos p, length(r.t) n, {_CLEAN.format(x="substr(r.t, 1, a.start_pos + 1)")} c from answers a join raw r using (title) where a.start_pos is not null)
 select answer_id, title, p, greatest(length(c) - 1, 0)::int new_p from p""")
def reverse_map(t):
    """The new place of an old one, also where the character there is gone."""
    places = t("answers").join(_raw(t).select("title"), "title").select("title", "answer_id", F.col("start_pos").alias("p"))
    return rebase.moved(places, rebase.kept_runs(_raw(t), "title", "t"), "title", "p").select("answer_id", "title", "p", "new_p")


_GROUPS = """p as (select title, para_idx, para_id, text, row_number() over (partition by title order by para_idx, para_id) - 1 i, length(text) n from paras where text <> ''),
 f as (select title, i, 0 g, n cur from p where i = 0 union all select p.title, p.i, case when f.cur >= 300 then f.g + 1 else f.g end, case when f.cur >= 300 then p.n else f.cur + 1 + p.n end from f join p on p.title = f.title and p.i = f.i + 1),
 h as (select p.*, f.g, sum(n + 1) over (partition by title, g order by i) - n - 1 shift from p join f using (title, i))"""


def _grouped(t):
    """Paragraphs with the number of their merged group and their place in it."""
    paras = t("paras").filter("text <> ''").select("title", "para_idx", "para_id", F.length("text").alias("n"))
    paras = paras.withColumn("i", F.row_number().over(Window.partitionBy("title").orderBy("para_idx", "para_id")) - 1)
    groups = S.merge_short(paras, "title", "i", "n", 300)
    before = Window.partitionBy("title", "group").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return paras.join(groups, ["title", "i"]).withColumn("shift", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("int"))


@C.add(f"""with recursive {_GROUPS}, q as (select title, para_id, unnest(qas) q from paras), a as (select title, para_id, q.q_id q_id, unnest(q.answers) a from q)
 select a.title, g::int "group", q_id, list((a.start_pos + shift)::int order by i, a.span_i, a.start_pos) starts, list((a.end_pos + shift)::int order by i, a.span_i, a.start_pos) ends,
 list(a.text order by i, a.span_i, a.start_pos) answers from a join h using (title, para_id) group by a.title, g, q_id""")
def merge_with_answers(t):
    """Answers carried through the merging of short paragraphs, one list for each clause."""
    flat = t("paras").select("title", "para_id", F.explode("qas").alias("q")).select("title", "para_id", "q.q_id", F.explode("q.answers").alias("a"))
    rows = flat.join(_grouped(t).select("title", "para_id", "group", "i", "shift"), ["title", "para_id"])
    item = F.struct("i", "a.span_i", "a.start_pos", F.col("a.end_pos").alias("e"), "shift", "a.text")
    lists = rows.groupBy("title", "group", "q_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return lists.select(
        "title", "group", "q_id", F.transform("x", lambda v: v["start_pos"] + v["shift"]).alias("starts"), F.transform("x", lambda v: v["e"] + v["shift"]).alias("ends"), F.transform("x", lambda v: v["text"]).alias("answers")
    )


@C.add(f"""with {_TOKENS}, b as (select para_id, (tok_i // 50)::int block, min(c_start) s, max(c_end) e from tok group by para_id, tok_i // 50),
 q as (select para_id, unnest(qas) q from paras), a as (select para_id, q.q_id q_id, unnest(q.answers) a from q)
 select para_id, block, q_id, a.span_i span_i, (greatest(a.start_pos, s) - s)::int start_pos, (least(a.end_pos, e - 1) - s)::int end_pos,
 substr(a.text, (greatest(a.start_pos, s) - a.start_pos + 1)::bigint, (least(a.end_pos, e - 1) - greatest(a.start_pos, s) + 1)::bigint) answer_text
 from a join b using (para_id) where greatest(a.start_pos, s) <= least(a.end_pos, e - 1)""")
def block_answers(t):
    """Answers cut to the blocks of 50 words that a paragraph is divided into."""
    blocks = S.token_blocks(S.words_with_places(t("paras").filter("text <> ''"), "para_id", "text"), "para_id", 50)
    parts = blocks.select("para_id", "block", F.col("c_start").alias("offset"), (F.col("c_end") - F.col("c_start")).alias("length"))
    flat = t("paras").select("para_id", F.explode("qas").alias("q")).select("para_id", "q.q_id", F.explode("q.answers").alias("a"))
    answers = flat.select("para_id", "q_id", "a.span_i", "a.start_pos", "a.end_pos", F.col("a.text").alias("answer_text")).filter("start_pos is not null and end_pos is not null")
    out = annotate.clip(answers, parts, "para_id")
    return out.select("para_id", "block", "q_id", "span_i", F.col("start_pos").cast("int"), F.col("end_pos").cast("int"), "answer_text")


@C.add(f"""with {_TOKENS}, b as (select para_id, (tok_i // 50)::int block, min(c_start) s from tok group by para_id, tok_i // 50), n as (select para_id, length(text) n from paras where text <> '')
 select para_id, block, (case when block = 0 then 0 else s end)::int chunk_start, (coalesce(lead(s) over (partition by para_id order by block), n) - 1)::int chunk_end from b join n using (para_id)""")
def gapless_chunks(t):
    """The same blocks without gaps: blanks between two belong to the one before, and the text's edges to the first and last."""
    paras = t("paras").filter("text <> ''").select("para_id", "text")
    blocks = S.token_blocks(S.words_with_places(paras, "para_id", "text"), "para_id", 50)
    return S.without_gaps(blocks, paras.select("para_id", F.length("text").alias("n")), "para_id", "n").select("para_id", "block", "chunk_start", "chunk_end")


# windows of 300 words, 256 apart; the words of the first answer of each question; a label in places of the window, behind 12 words of question
_WINDOWS = """d as (select title, string_split_regex(doc_text, '[ \\t\\r\\n\\x{202f}]') parts from cuadv1 where doc_text <> ''), w0 as (select title, unnest(parts) w, generate_subscripts(parts, 1) i from d),
 w1 as (select title, w, i, sum(length(w) + 1) over (partition by title order by i) - length(w) - 1 s from w0), w as (select title, row_number() over (partition by title order by i) - 1 k, s, s + length(w) e from w1 where w <> ''),
 n as (select title, count(*) n from w group by title), win as (select title, n, unnest(range(0, n, 256)) s from n), ws as (select * from win where s = 0 or s - 256 + 300 < n),
 q as (select title, unnest(qas) q, generate_subscripts(qas, 1) - 1 q_id from cuadv1), a as (select title, q_id, q.qa_id qa_id, coalesce(q.is_impossible, false) none, q.answers[1].start_pos p, q.answers[1].end_pos z from q),
 l as (select a.*, x.k a0, y.k a1 from a left join w x on x.title = a.title and not none and p >= x.s and p < x.e left join w y on y.title = a.title and not none and z >= y.s and z < y.e),
 o as (select l.title, l.q_id, qa_id, none, ws.s, least(300, n - ws.s) m, a0, a1, coalesce(a0 >= ws.s and a1 <= ws.s + least(300, n - ws.s) - 1, false) inside from l join ws on ws.title = l.title)"""


def _windows(t):
    docs = t("cuadv1").filter("doc_text <> ''")
    words = S.words_with_places(docs, "title", "doc_text", "[ \t\r\n ]")
    n = words.groupBy("title").agg(F.count("*").cast("int").alias("n"))
    q = t("cuadv1").select("title", F.posexplode("qas").alias("q_id", "q"))
    first = F.get("q.answers", F.lit(0))
    q = q.select("title", "q_id", "q.qa_id", F.coalesce("q.is_impossible", F.lit(False)).alias("none"), first["start_pos"].alias("p"), first["end_pos"].alias("z"))
    return S.labelled_windows(q, words, n, "title", 300, 256, 12)


@C.add(f"""with {_WINDOWS} select title, q_id::int q_id, qa_id, s::int "start", m::int "length", (case when inside then a0 - s + 12 else 0 end)::int start_position, (case when inside then a1 - s + 12 else 0 end)::int end_position, not inside is_impossible from o""")
def window_labels(t):
    """Windows over each contract for each question, with the first answer's place in them, or none."""
    return _windows(t).select("title", "q_id", "qa_id", "start", "length", "start_position", "end_position", "is_impossible")


@C.add(f"""with {_WINDOWS}, k as (select *, sum(inside::int) over (partition by title, q_id) k from o),
 r as (select *, row_number() over (partition by title, q_id, inside order by {_LOT.format(keys="title || '|' || q_id || '|' || s")}, title, q_id, s) r from k)
 select title, q_id::int q_id, s::int "start", not inside is_impossible from r where inside or r <= case when none then 1 else k end""")
def sampled_windows(t):
    """Per question the windows with its answer and as many without; one of a question without answer, none where the answer is in no window."""
    rows = _windows(t).select("title", "q_id", "none", "start", "is_impossible")
    return sampling.balance(rows, ["title", "q_id"], ["title", "q_id", "start"], ~F.col("is_impossible"), SEED, F.when(F.max("none"), 1).otherwise(0), spread=False).select("title", "q_id", "start", "is_impossible")


@C.add("""with g as (select title, old_para_idx, count(*) parts, string_agg(coalesce(text, ''), '' order by para_idx, para_id) whole, min("offset") o from paras where old_para_idx is not null group by all),
 f as (select g.title, old_para_idx, parts, length(whole)::int n, substr(c.doc_text, (o + 1)::bigint, length(whole)::bigint) src, whole from g left join cuadv1 c using (title))
 select title, old_para_idx, parts::bigint parts, n, whole is not distinct from src same, list_sum(list_transform(string_split(whole, ''), lambda c, i: (c = substr(coalesce(src, ''), i, 1))::int))::bigint agreeing from f where whole <> ''""")
def split_agreement(t):
    """Parts of a divided paragraph put together and compared with the contract at their place: equal or not, and how many signs agree."""
    rows = t("paras").filter("old_para_idx is not null")
    whole = rows.groupBy("title", "old_para_idx").agg(
        F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "para_id", F.coalesce("text", F.lit("")).alias("x")))), lambda v: v["x"]), "").alias("whole"), F.min("offset").alias("o")
    )
    whole = whole.filter("whole <> ''").join(t("cuadv1").select("title", "doc_text"), "title", "left").withColumn("n", F.length("whole"))
    whole = whole.withColumn("src", F.substr("doc_text", F.col("o") + 1, F.col("n")))
    agree = F.aggregate(F.zip_with(F.split("whole", ""), F.split(F.coalesce("src", F.lit("")), ""), lambda a, b: (a.eqNullSafe(b) & (a != "")).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return whole.select("title", "old_para_idx", "parts", "n", F.col("whole").eqNullSafe(F.col("src")).alias("same"), agree.alias("agreeing"))


@C.add(f"""with recursive {_GROUPS}, c as (select title, count(*) chunks, count(distinct g) merged from h group by title),
 r as (select title, chunks, merged, sum(chunks) over (order by title rows unbounded preceding) a, sum(merged) over (order by title rows unbounded preceding) b, row_number() over (order by title) k from c)
 select title, chunks::bigint chunks, merged::bigint merged, round(a / k, 6) running_chunks, round(b / k, 6) running_merged from r""")
def running_chunk_ratio(t):
    """Parts per contract before and after merging, and their running means in the order of titles."""
    per = _grouped(t).groupBy("title").agg(F.count("*").alias("chunks"), F.countDistinct("group").alias("merged"))
    from ..operators.runs import running_sums

    ran = running_sums(per.withColumn("one", F.lit(1)), "title", ["chunks", "merged", "one"])
    return ran.select("title", "chunks", "merged", F.round(F.col("sum_chunks") / F.col("sum_one"), 6).alias("running_chunks"), F.round(F.col("sum_merged") / F.col("sum_one"), 6).alias("running_merged"))
