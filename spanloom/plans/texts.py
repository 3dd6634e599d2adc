"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .common import Catalogue

C = Catalogue()

#: Words of a text for comparing answers, in DuckDB.  Articles are replaced twice, as a match uses up the sign after it.
TOKENS = r"""list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\[-`{{-~]', '', 'g'),
 '(^|[^\p{{L}}\p{{N}}])(?:a|an|the)([^\p{{L}}\p{{N}}]|$)', '\1 \2', 'g'), '(^|[^\p{{L}}\p{{N}}])(?:a|an|the)([^\p{{L}}\p{{N}}]|$)', '\1 \2', 'g'),
 '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"""


@C.add(r"""select doc_id, length(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n+', chr(10), 'g'))::bigint n_compressed,
 md5(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n+', chr(10), 'g')) compressed_md5,
 md5(regexp_replace(regexp_replace(text, '^ {2,}| {2,}$', '', 'g'), ' {2,}', ' ', 'g')) trimmed_md5,
 md5(regexp_replace(text, ' {2,}', ' ', 'g')) line_md5,
 md5(regexp_replace(regexp_replace(text, '\n{2,}', chr(10) || chr(10), 'g'), ' {4,}', '    ', 'g')) display_md5 from documents""")
def space_newline_compress(t):
    """Four ways of collapsing blanks and line ends."""
    x = F.col("text")
    return t("documents").select(
        "doc_id", F.length(T.compress(x)).cast("bigint").alias("n_compressed"), F.md5(T.compress(x)).alias("compressed_md5"), F.md5(T.drop_outer_runs(x)).alias("trimmed_md5"),
        F.md5(T.single_blanks(x)).alias("line_md5"), F.md5(T.for_display(x)).alias("display_md5"),
    )


@C.add(f"""with t as (select answer_id, {TOKENS.format(x="text")} w, text from answers)
 select answer_id, len(w)::bigint n_tokens, md5(array_to_string(w, ' ')) tokens_md5,
 len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n\\x{{202f}}]+'), lambda x: x <> ''))::bigint n_words from t""")
def normalize_tokens(t):
    """Answer tokens and words between blanks."""
    w = T.tokens(F.col("text"))
    return t("answers").select("answer_id", F.size(w).cast("bigint").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"), F.size(T.blank_words(F.col("text"))).cast("bigint").alias("n_words"))


@C.add(r"""with w as (select para_id, text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n\x{202f}]+'), lambda x: x <> '') w,
 list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: array_to_string(list_filter(string_split(x, ' '), lambda y: y <> '')[1:5], ' ')) h from paras)
 select para_id, array_to_string(h, '. ') head, case when len(w) > 40 then array_to_string(w[1:20], ' ') || ' ... ' || array_to_string(w[len(w) - 19:], ' ') else text end shortened,
 case when len(w) > 30 then rtrim(array_to_string(w[1:30], ' '), chr(65533)) else text end cut from w""")
def head_and_shortening(t):
    """First words of each line, the middle left out, and the first words only."""
    x = F.col("text")
    return t("paras").select("para_id", T.head(x).alias("head"), T.omit_middle(x, 40).alias("shortened"), T.keep_words(x, 30).alias("cut"))


_KEY = r"regexp_replace(regexp_replace(trim(case when contains({x}, '.') then regexp_replace({x}, '\.[^.]*$', '') when {x} is not null then '' end), '[&'']', '_', 'g'), '-$', '')"


@C.add(f"""select distinct title, {_KEY.format(x="(title || ' --.contract')")} file_key, {_KEY.format(x="title")} bare_key,
 regexp_extract(title, '-EX-([0-9.]+)-', 1) exhibit from paras""")
def filename_normalize(t):
    """File names as keys, of a name with an extension and of a plain title."""
    return t("paras").select(
        "title", T.file_key(F.concat("title", F.lit(" --.contract"))).alias("file_key"), T.file_key(F.col("title")).alias("bare_key"), F.regexp_extract("title", "-EX-([0-9.]+)-", 1).alias("exhibit")
    ).distinct()


@C.add(r"""select q_id, regexp_extract(clause_quest, '"(.+)"', 1) clause_name, 'Does this part concern "' || clause_type || '"?' ask_plain, clause_quest || ' Details: ' || coalesce(readme_group, '') ask_detail,
 replace(regexp_extract(clause_quest || ' Details: ' || coalesce(readme_group, '') || chr(160) || 'x', 'Details: ([^\n]+)', 1), chr(160), '') detail,
 'Highlight what is related to "' || clause_type || '".' ask_mark from clauses""")
def clause_name_extract(t):
    """Clause names out of questions, and questions out of clause names."""
    name = F.col("clause_type")
    return t("clauses").select(
        "q_id", T.quoted(F.col("clause_quest")).alias("clause_name"), F.format_string('Does this part concern "%s"?', name).alias("ask_plain"),
        T.render("{q} Details: {g}", q=F.col("clause_quest"), g=F.col("readme_group")).alias("ask_detail"),
        T.details(T.render("{q} Details: {g}\u00a0x", q=F.col("clause_quest"), g=F.col("readme_group"))).alias("detail"), F.format_string('Highlight what is related to "%s".', name).alias("ask_mark"),
    )


@C.add(r"""select answer_id, split_part(qa_id, '__', 1) p_title, regexp_replace(split_part(qa_id, '__', 2), '_[0-9]+$', '') p_clause,
 try_cast(nullif(regexp_extract(split_part(qa_id, '__', 2), '_([0-9]+)$', 1), '') as integer) p_number, c.q_id found_q_id
 from answers a left join clauses c on c.clause_type = split_part(a.qa_id, '__', 2)""")
def qa_id_parse(t):
    """Question ids taken apart and joined with the clause list."""
    p = t("answers").select("answer_id", "qa_id", T.qa_parts(F.col("qa_id")).alias("p"))
    p = p.select("answer_id", F.col("p.title").alias("p_title"), F.col("p.clause").alias("p_clause"), F.col("p.number").alias("p_number"), F.split_part("qa_id", F.lit("__"), F.lit(2)).alias("clause_type"))
    return p.join(t("clauses").select("clause_type", F.col("q_id").alias("found_q_id")), "clause_type", "left").drop("clause_type")


@C.add(r"""with s as (select title, para_idx, q_id, type, answers from train_meta), p as (select title, para_idx, any_value(text order by para_id) text from paras group by all),
 a as (select s.*, coalesce(p.text, '') text, c.clause_type, c.clause_quest from s left join p using (title, para_idx) join clauses c using (q_id))
 select title, para_idx, q_id, type, md5('Text: ' || text || chr(10) || 'Clause: ' || clause_type || chr(10) || clause_quest || chr(10) || 'Answer:' || chr(10)) source_md5,
 case when len(coalesce(answers, [])) > 0 then array_to_string(list_transform(answers, lambda x: '- ' || x), chr(10)) else 'No' end target_list,
 case when len(coalesce(answers, [])) > 0 then 'Yes. ' || array_to_string(list_transform(answers, lambda x: '- ' || x), chr(10)) else 'No.' end target_yes,
 case when len(coalesce(answers, [])) > 0 then 'There are such clauses. They are:' || chr(10) || array_to_string(list_transform(answers, lambda x: '- ' || x), chr(10)) else 'There is no such clause.' end target_sentence
 from a""")
def prompt_render(t):
    """Prompts and, in three styles, targets of every training sample."""
    paras = t("paras").groupBy("title", "para_idx").agg(F.min_by("text", "para_id").alias("text"))
    rows = t("train_meta").select("title", "para_idx", "q_id", "type", "answers").join(paras, ["title", "para_idx"], "left")
    rows = rows.join(F.broadcast(t("clauses").select("q_id", "clause_type", "clause_quest")), "q_id")  # one row for each of the 41 clauses
    source = T.render("Text: {text}\nClause: {clause}\n{quest}\nAnswer:\n", text=F.col("text"), clause=F.col("clause_type"), quest=F.col("clause_quest"))
    a = F.col("answers")
    return rows.select(
        "title", "para_idx", "q_id", "type", F.md5(source).alias("source_md5"), T.target(a, "list").alias("target_list"), T.target(a, "yes").alias("target_yes"), T.target(a, "sentence").alias("target_sentence")
    )


@C.add(r"""with w as (select title, para_idx, q_id, type, written_at, loaded_at, answers is null gone,
 list_transform(answers, lambda a: struct_pack(a := a, w := list_filter(string_split_regex(a, '[ \t\r\n\x{202f}]+'), lambda x: x <> ''))) s from test_meta_id)
 select title, para_idx, q_id, type, loaded_at, case when gone then 'None' else array_to_string(list_transform(s, lambda x: case when len(x.w) > 10 then
 array_to_string(x.w[1:5], ' ') || ' ... ' || array_to_string(x.w[len(x.w) - 4:], ' ') else x.a end), chr(10)) end answer from w""")
def answer_shorten(t):
    """Answers of the test samples, each with its middle left out."""
    return t("test_meta_id").select("title", "para_idx", "q_id", "type", "loaded_at", T.joined_answers(F.col("answers"), 10).alias("answer"))


@C.add(r"""with p as (select title, para_idx, q_id, coalesce(prediction, '') c, prediction from predictions), x as (select title, para_idx, any_value(text order by para_id) text from paras group by all)
 select p.title, p.para_idx, p.q_id, case when prediction is null or starts_with(prediction, 'None') then [] else string_split(prediction, chr(10)) end lines,
 case when c in ('No', 'No.') then '' else regexp_replace(c, '^Yes\.', '') end plain,
 array_to_string(list_transform(list_filter(string_split(case when c in ('No', 'No.') then '' else regexp_replace(c, '^Yes\.', '') end, chr(10)), lambda l: l <> ''), lambda l: regexp_replace(l, '^- ', '')), ' ') bullets,
 md5(case when contains(c, 'No') and not contains(c, 'Yes') then '' else c end) chat_md5,
 md5(case when c = 'No' then '' when c = 'Yes' then coalesce(x.text, '') else c end) plain_md5, md5(coalesce(x.text, '')) whole_md5
 from p left join x on x.title = p.title and x.para_idx = p.para_idx""")
def prediction_parse(t):
    """Predictions read in five ways, and what a plain Yes would be read as."""
    paras = t("paras").groupBy("title", "para_idx").agg(F.min_by("text", "para_id").alias("text"))
    p, text = F.col("prediction"), F.col("text")
    return t("predictions").join(paras, ["title", "para_idx"], "left").select(
        "title", "para_idx", "q_id", T.predicted_lines(p).alias("lines"), T.predicted_text(p).alias("plain"), T.predicted_bullets(p).alias("bullets"),
        F.md5(T.zero_shot_chat(p)).alias("chat_md5"), F.md5(T.zero_shot_plain(p, text)).alias("plain_md5"), F.md5(T.zero_shot_plain(F.lit("Yes"), text)).alias("whole_md5"),
    )


@C.add(r"""with p as (select para_id, 'Text: ' || coalesce(text, '') || chr(10) || 'Answer:' || chr(10) || source s from paras)
 select para_id, md5(substr(s, 1, instr(s, 'Answer:' || chr(10)) + 7)) source_md5, md5(substr(s, instr(s, 'Answer:' || chr(10)) + 8)) target_md5 from p""")
def source_target_split(t):
    """Prompts cut at the mark before the answer."""
    prompt = F.concat(F.lit("Text: "), F.coalesce("text", F.lit("")), F.lit("\nAnswer:\n"), F.col("source"))
    cut = T.source_and_target(prompt)
    return t("paras").select("para_id", F.md5(cut["source"]).alias("source_md5"), F.md5(cut["target"]).alias("target_md5"))


@C.add(r"""with g as (select title, list_sort(list_distinct(list('gold_' || q_id))) g from answers group by title), l as (select title, list_concat(g, ['pred_' || length(title)]) labels from g)
 select title, list_transform(list_filter(labels, lambda x: starts_with(x, 'gold_')), lambda x: x[6:]) gold, list_transform(list_filter(labels, lambda x: starts_with(x, 'pred_')), lambda x: x[6:]) pred,
 regexp_extract_all('<q1>' || title || '</q1> and <q2>' || len(g_) || '</q2>', '<q[0-9]+>(.*?)</q[0-9]+>', 1) marked from (select title, labels, labels g_ from l)""")
def label_prefix_and_tags(t):
    """Labels told apart by prefix, and texts within numbered tags."""
    labels = t("answers").groupBy("title").agg(F.array_sort(F.collect_set(F.concat(F.lit("gold_"), F.col("q_id").cast("string")))).alias("g"))  # 41 labels at most
    labels = labels.select("title", F.concat("g", F.array(F.concat(F.lit("pred_"), F.length("title").cast("string")))).alias("labels"))
    text = F.concat(F.lit("<q1>"), "title", F.lit("</q1> and <q2>"), F.size("labels").cast("string"), F.lit("</q2>"))
    return labels.select("title", T.with_prefix(F.col("labels"), "gold_").alias("gold"), T.with_prefix(F.col("labels"), "pred_").alias("pred"), T.tagged(text, "q").alias("marked"))


_SHOWN = "case when abs({x}) > 0.001 and abs({x}) < 1000 then format('{{:.5g}}', {x}) when abs({x}) < 1e-6 then '0.0' else format('{{:.3e}}', {x}) end"


@C.add(f"""with e as (select event_id, value::double v from events) select event_id, {_SHOWN.format(x="v")} shown, {_SHOWN.format(x="(v / 1e5)")} small, {_SHOWN.format(x="(v * 1e4)")} large from e""")
def number_format(t):
    """Numbers written by magnitude."""
    v = F.col("value").cast("double")
    return t("events").select("event_id", T.short_number(v).alias("shown"), T.short_number(v / 1e5).alias("small"), T.short_number(v * 1e4).alias("large"))


@C.add(r"""select c, count(*) n, count(distinct doc_id) docs from (select doc_id, unnest(string_split(text, '')) c from documents where text is not null) where c <> '' and (unicode(c) > 126 or unicode(c) < 32) group by c""")
def char_histogram(t):
    """How often documents hold each sign that isn't printable ASCII."""
    odd = F.regexp_replace("text", "[ -~]", "")  # first in place, so that few signs are exploded
    chars = t("documents").select("doc_id", F.explode(F.filter(F.split(odd, ""), lambda x: x != "")).alias("c"))
    per = chars.groupBy("c", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@C.add(r"""with s as (select answer_id, text, [c for c in string_split(text, '') if c <> ''] cs from answers where text is not null),
 u as (select answer_id, unnest(cs) c, generate_subscripts(cs, 1) i from s), b as (select *, c in (' ', chr(9), chr(13), chr(10), chr(8239)) g from u),
 n as (select answer_id, i, sum(case when not g and coalesce(p, true) then 1 else 0 end) over (partition by answer_id order by i) - 1 w from (select *, lag(g) over (partition by answer_id order by i) p from b))
 select s.answer_id, coalesce(list(w::int order by i) filter (i is not null), []) word_of from s left join n using (answer_id) group by s.answer_id""")
def char_word_index(t):
    """The word of every sign of an answer."""
    return t("answers").filter("text is not null").select("answer_id", T.word_of_signs(F.col("text")).alias("word_of"))
