"""Queries over segmentation and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import segment as S
from .common import Catalogue
from .spans import _TOKENS

C = Catalogue()

_LINES = """l as (select title, i, length(x) n, x from (select title, unnest(string_split(doc_text, chr(10))) x, generate_subscripts(string_split(doc_text, chr(10)), 1) i from cuadv1)),
 o as (select *, coalesce(sum(n + 1) over (partition by title order by i rows between unbounded preceding and 1 preceding), 0)::int o from l),
 p as (select title, (row_number() over (partition by title order by i) - 1)::int para_idx, o, n::int n, x from o where n > 0)"""
_MERGE = f"""with recursive {_LINES}, f as (select title, para_idx, 0 g, n cur from p where para_idx = 0 union all
 select p.title, p.para_idx, case when f.cur >= 300 then f.g + 1 else f.g end, case when f.cur >= 300 then p.n else f.cur + 1 + p.n end from f join p on p.title = f.title and p.para_idx = f.para_idx + 1)"""


def _paras(t):
    return S.paragraphs(t("cuadv1"), "title", "doc_text")


@C.add(f"""with {_LINES} select title, para_idx, o "offset", n length, md5(x) text_md5 from p""")
def paragraph_split(t):
    """Non-empty lines of the contracts with their places."""
    return _paras(t).select("title", "para_idx", "offset", "length", F.md5("text").alias("text_md5"))


@C.add(f"""{_MERGE} select title, g::int "group", count(*)::bigint parts, md5(string_agg(x, chr(10) order by para_idx)) text_md5, min(o)::int "offset" from f join p using (title, para_idx) group by title, g""")
def paragraph_merge_short(t):
    """Short paragraphs merged with the next until 300 signs."""
    paras = _paras(t)
    groups = S.merge_short(paras, "title", "para_idx", "length", 300)
    texts = paras.join(groups, ["title", "para_idx"]).groupBy("title", "group").agg(
        F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), "\n").alias("x"), F.min("offset").alias("offset")
    )
    return texts.select("title", "group", "parts", F.md5("x").alias("text_md5"), "offset")


@C.add(f"""{_MERGE}, m as (select title, g, sum(n) + count(*) - 1 n from f join p using (title, para_idx) group by title, g)
 select 'before' stage, count(*)::bigint paragraphs, count(distinct title)::bigint docs, round(count(*) / count(distinct title), 6) per_doc, round(avg(n), 6) mean_length from p
 union all select 'after', count(*)::bigint, count(distinct title)::bigint, round(count(*) / count(distinct title), 6), round(avg(n), 6) from m""")
def paragraph_merge_stats(t):
    """Paragraphs per contract and their mean length, before and after merging short ones."""
    lengths = F.filter(F.transform(F.split("doc_text", "\n"), F.length), lambda n: n > 0)
    docs = t("cuadv1").select(lengths.alias("ns")).filter(F.size("ns") > 0)  # a row a contract, never a row a paragraph
    docs = docs.select(F.size("ns").alias("k"), F.aggregate("ns", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"), S.merged_count(F.col("ns")).alias("g"))
    one = docs.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.sum("n").alias("n"), F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.count("*").alias("docs"))
    row = lambda name, count, total: F.struct(
        F.lit(name).alias("stage"), F.col(count).alias("paragraphs"), F.col("docs"), F.round(F.col(count) / F.nullif("docs", F.lit(0)), 6).alias("per_doc"), F.round(total / F.nullif(count, F.lit(0)), 6).alias("mean_length")
    )
    return one.select(F.inline(F.array(row("before", "k", F.col("n")), row("after", "g", F.col("n") + F.col("k") - F.col("g")))))


@C.add("""select para_id, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::bigint words from paras where len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 0""")
def paragraph_words(t):
    """Words of each paragraph."""
    w = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    return t("paras").filter("text <> ''").select("para_id", w.cast("bigint").alias("words")).filter("words > 0")


@C.add(f"""with {_TOKENS} select para_id, (tok_i // 50)::int block, min(c_start)::int c_start, max(c_end)::int c_end, count(*)::int n_tokens from tok group by para_id, tok_i // 50""")
def token_block_chunks(t):
    """Blocks of 50 words of each paragraph as spans of signs."""
    return S.token_blocks(S.words_with_places(t("paras").filter("text <> ''"), "para_id", "text"), "para_id", 50)


@C.add(f"""with {_TOKENS}, b as (select para_id, (tok_i // 50)::int block, min(c_start)::int s, max(c_end)::int e from tok group by para_id, tok_i // 50)
 select p.title, p.para_id, block, (row_number() over (partition by p.title order by p.para_idx, p.para_id, block) - 1)::int chunk_index, md5(substr(p.text, s + 1, e - s)) text_md5, p."offset" + s chunk_offset from b join paras p using (para_id)""")
def chunk_flat_index(t):
    """The same blocks as flat rows, numbered through each contract."""
    paras = t("paras").filter("text <> ''").select("para_id", "title", "para_idx", "offset", "text")
    blocks = S.token_blocks(S.words_with_places(paras, "para_id", "text"), "para_id", 50)
    order = Window.partitionBy("title").orderBy("para_idx", "para_id", "block")
    return blocks.join(paras, "para_id").select(
        "title", "para_id", "block", (F.row_number().over(order) - 1).alias("chunk_index"), F.md5(F.substr("text", F.col("c_start") + 1, F.col("c_end") - F.col("c_start"))).alias("text_md5"), (F.col("offset") + F.col("c_start")).alias("chunk_offset")
    )


@C.add(f"""with recursive {_LINES}, f as (select title, para_idx, 0 g, n cur from p where para_idx = 0 union all
 select p.title, p.para_idx, case when f.cur + p.n > 1000 then f.g + 1 else f.g end, case when f.cur + p.n > 1000 then p.n else f.cur + p.n end from f join p on p.title = f.title and p.para_idx = f.para_idx + 1)
 select title, g::int "group", min(para_idx)::int first_para, (max(para_idx) + 1)::int end_para, sum(n)::bigint total from f join p using (title, para_idx) group by title, g""")
def greedy_pack_chunks(t):
    """Neighbouring paragraphs packed into groups of at most 1,000 signs."""
    paras = _paras(t).select("title", "para_idx", "length")
    groups = S.pack_greedy(paras, "title", "para_idx", "length", 1000)
    return paras.join(groups, ["title", "para_idx"]).groupBy("title", "group").agg(F.min("para_idx").alias("first_para"), (F.max("para_idx") + 1).alias("end_para"), F.sum("length").alias("total"))


_WORDS = "w as (select title, list_filter(string_split_regex(coalesce(doc_text, ''), '[ \\t\\r\\n\\x{202f}]+'), lambda x: x <> '') w from cuadv1)"


@C.add(f"""with {_WORDS}, s as (select title, len(w) n, unnest(range(0, len(w), 256)) s from w) select title, s::int "start", least(300, n - s)::int length, (s // 256)::int window_i from s where s = 0 or s - 256 + 300 < n""")
def stride_windows(t):
    """Windows of 300 words, 256 apart, over each contract."""
    n = t("cuadv1").select("title", F.size(T.blank_words(F.col("doc_text"))).alias("n"))
    rows = n.select("title", "n", F.explode(S.windows(F.col("n"), 300, 256)).alias("start"))
    return rows.select("title", "start", F.least(F.lit(300), F.col("n") - F.col("start")).alias("length"), F.floor(F.col("start") / 256).cast("int").alias("window_i"))


@C.add(f"""with {_WORDS}, b as (select title, unnest(range(0, len(w), 128)) s, w from w) select title, (s // 128)::int block, least(128, len(w) - s)::int n_real, md5(array_to_string(list_resize(w[s + 1:s + 128], 128, '<pad>'), ' ')) block_md5 from b where len(w) - s >= 2""")
def overflow_blocks(t):
    """Blocks of 128 words, the last filled up; blocks under two words are left out."""
    w = t("cuadv1").select("title", T.blank_words(F.col("doc_text")).alias("w")).filter(F.size("w") > 0)
    rows = w.select("title", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(128))).alias("s"))
    real = F.least(F.lit(128), F.size("w") - F.col("s"))
    block = F.slice("w", F.col("s") + 1, F.lit(128))
    full = F.concat(block, F.array_repeat(F.lit("<pad>"), F.greatest(F.lit(128) - F.size(block), F.lit(0))))
    return rows.select("title", F.floor(F.col("s") / 128).cast("int").alias("block"), real.alias("n_real"), F.md5(F.array_join(full, " ")).alias("block_md5")).filter("n_real >= 2")


@C.add("""with q as (select title, unnest(qas) q, generate_subscripts(qas, 1) - 1 q_id from cuadv1) select q.qa_id qa_id, title, q_id::int q_id, coalesce(q.is_impossible, false) is_impossible, len(coalesce(q.answers, []))::int n_answers,
 q.answers[1].text first_answer from q""")
def qa_examples(t):
    """One example for each contract and question, with its first answer."""
    q = t("cuadv1").select("title", F.posexplode("qas").alias("q_id", "q"))
    return q.select("q.qa_id", "title", "q_id", F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"), F.size(F.coalesce("q.answers", F.array())).alias("n_answers"), F.get("q.answers", F.lit(0))["text"].alias("first_answer"))


@C.add("""with w as (select title, para_idx, q_id, type, written_at, loaded_at, [q_id + 100, type + 200] src, list_transform(coalesce(answers, []), lambda a: length(a)) tgt,
 (row_number() over (partition by title order by para_idx, q_id, type, loaded_at, written_at nulls first, array_to_string(list_transform(coalesce(answers, []), lambda a: length(a)), '|')) - 1) // 8 batch from test_meta_id where title is not null),
 s as (select *, list_concat(list_concat(src, tgt), [2]) ids from w), m as (select *, max(len(ids)) over (partition by title, batch) m from s)
 select title, batch::bigint batch, para_idx, q_id, type, loaded_at, list_resize(ids, m, 0) input_ids, list_concat(list_transform(range(m - len(ids)), lambda x: 0::bigint), ids) left_ids,
 list_resize(list_concat(list_transform(src, lambda x: -100), list_concat(tgt, [2])), m, -100) labels, list_resize(list_transform(ids, lambda x: 1), m, 0) mask,
 len(src)::int n_source, list_concat(src, [7, 8]) headed from m""")
def pad_collate(t):
    """Source and target ids in batches of eight samples of a contract, each batch as wide as its longest; labels hidden on the source; and the source with a given target."""
    rows = t("test_meta_id").filter("title is not null").select(
        "title", "para_idx", "q_id", "type", "loaded_at", "written_at", F.array(F.col("q_id") + 100, F.col("type") + 200).alias("src"), F.transform(F.coalesce("answers", F.array().cast("array<string>")), F.length).alias("tgt")
    )
    order = Window.partitionBy("title").orderBy("para_idx", "q_id", "type", "loaded_at", "written_at", F.array_join(F.col("tgt").cast("array<string>"), "|"))
    rows = rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / 8)).withColumn("ids", F.concat("src", "tgt", F.array(F.lit(2))))
    rows = rows.withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("title", "batch")))
    hidden = S.padded(F.concat(F.transform("src", lambda x: F.lit(-100)), "tgt", F.array(F.lit(2))), F.col("width"), -100)
    ids = S.padded(F.col("ids"), F.col("width"), 0)
    source = F.size(F.filter(F.slice(hidden, F.lit(1), F.size("ids")), lambda x: x == -100))
    return rows.select(
        "title", "batch", "para_idx", "q_id", "type", "loaded_at", ids.alias("input_ids"), S.padded(F.col("ids"), F.col("width"), 0, left=True).alias("left_ids"), hidden.alias("labels"),
        S.padded(F.transform("ids", lambda x: F.lit(1)), F.col("width"), 0).alias("mask"), source.alias("n_source"), F.concat(F.slice(ids, F.lit(1), source), F.array(F.lit(7), F.lit(8))).alias("headed"),
    )


@C.add("""with g as (select old_para_idx, title, list(para_id order by para_idx, para_id) ids, count(*)::bigint parts, sum(length(text))::bigint n from paras where old_para_idx is not null group by all)
 select title, old_para_idx, parts, n, ids from g""")
def split_reconcile(t):
    """Parts of a paragraph that was divided, gathered by the old number."""
    rows = t("paras").filter("old_para_idx is not null")
    return rows.groupBy("title", "old_para_idx").agg(F.count("*").alias("parts"), F.sum(F.length("text")).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "para_id"))), lambda x: x["para_id"]).alias("ids")).select("title", "old_para_idx", "parts", "n", "ids")


@C.add("""with x as (select title, para_idx, para_id, unnest(qas) q from paras), a as (select title, para_idx, para_id, q.q_id q_id, unnest(q.answers) a from x)
 select title, para_id, q_id, a.span_i span_i, a.start_pos start_pos, a.end_pos end_pos, a.text answer_text from a""")
def paragraph_flatten(t):
    """Annotations nested in paragraphs as flat rows."""
    q = t("paras").select("title", "para_id", F.explode("qas").alias("q"))
    return q.select("title", "para_id", "q.q_id", F.explode("q.answers").alias("a")).select("title", "para_id", "q_id", "a.span_i", "a.start_pos", "a.end_pos", F.col("a.text").alias("answer_text"))
