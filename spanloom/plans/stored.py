"""Queries over sources and sinks: tables written in each format to the shared folder and read back, and trees of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring as S
from ..sources import files
from ..streaming.files import scratch
from .common import Catalogue
from .scores import _FACTS, _gold

C = Catalogue()


@C.add("select para_id, title, para_idx, source, md5(text) text_md5, \"offset\" from paras")
def source_json_lines(t):
    """Paragraphs as JSON lines, in two appends."""
    rows = t("paras").select("para_id", "title", "para_idx", "source", "text", "offset")
    at = scratch(rows.sparkSession)
    for lot in (0, 1):
        files.write_json_lines(rows.filter(F.pmod("para_id", F.lit(2)) == lot), at, append=lot > 0)
    return files.json_lines(rows.sparkSession, at, rows.schema.simpleString()[7:-1].replace(":", " ")).select("para_id", "title", "para_idx", "source", F.md5("text").alias("text_md5"), "offset")


@C.add("""with q as (select title, doc_text, unnest(qas) q from cuadv1 where doc_text is not null), a as (select title, q.qa_id qa_id, coalesce(q.is_impossible, false) none, unnest(q.answers) a from q)
 select title, qa_id, a.text answer, a.start_pos start_pos, a.start_pos + length(a.text) end_pos from a""")
def source_corpus(t):
    """The contracts as nested question corpora, a hundred or so in a document, read as one row per contract and flattened."""
    docs = t("cuadv1").filter("doc_text is not null")
    span = lambda a: F.struct(a["text"].alias("text"), a["start_pos"].alias("answer_start"))
    qas = F.transform("qas", lambda q: F.struct(q["qa_id"].alias("id"), q["question"].alias("question"), q["is_impossible"].alias("is_impossible"), F.transform(q["answers"], span).alias("answers")))
    one = F.struct("title", F.array(F.struct(F.col("doc_text").alias("context"), qas.alias("qas"))).alias("paragraphs"))
    lots = docs.select(one.alias("d"), F.pmod(F.xxhash64("title"), F.lit(max(1, docs.count() // 100))).alias("lot")).groupBy("lot").agg(F.collect_list("d").alias("data"))
    at = scratch(docs.sparkSession)
    files.write_files(lots.select(F.concat(F.lit("corpus-"), "lot", F.lit(".json")).alias("name"), F.to_json(F.struct(F.lit("1").alias("version"), "data")).alias("content")), at)
    read = files.corpus(docs.sparkSession, at).select("title", F.explode("qas").alias("q")).select("title", "q.qa_id", F.explode("q.answers").alias("a"))
    return read.select("title", "qa_id", F.col("a.text").alias("answer"), "a.start_pos", "a.end_pos")


@C.add("""select title, para_idx, q_id, type, answers from train_meta where title is not null""")
def source_csv_lists(t):
    """Samples as CSV with lists as text."""
    rows = t("train_meta").filter("title is not null").select("title", "para_idx", "q_id", "type", "answers")
    at = scratch(rows.sparkSession)
    files.write_csv(rows, at)
    return files.csv(rows.sparkSession, at, "title string, para_idx int, q_id int, type int, answers string", ("answers",))


@C.add("""select md5(title) "name", strlen(doc_text)::bigint n_bytes, length(doc_text)::bigint n, md5(doc_text) text_md5 from cuadv1 where doc_text <> ''""")
def source_text_folder(t):
    """The contracts as a folder of text files: listed, and read whole."""
    docs = t("cuadv1").filter("doc_text <> ''").select(F.concat(F.lit("contracts/"), F.md5("title"), F.lit(".txt")).alias("name"), F.col("doc_text").alias("content"))
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    files.write_files(docs, at)
    listed = files.files(spark, at, "*.txt").select(F.regexp_replace("name", "\\.txt$", "").alias("name"), F.col("length").alias("n_bytes"))
    return files.texts(spark, at).select("name", F.length("content").cast("bigint").alias("n"), F.md5("content").alias("text_md5")).join(listed, "name")


@C.add("""with a as (select title, q_id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') x, row_number() over (partition by title order by answer_id) - 1 line_no from answers) select md5(title) doc, line_no::int line_no, q_id::varchar question, x answer from a""")
def source_field_folders(t):
    """Annotations as a folder of questions and one of answers, with a file per contract, read side by side line by line."""
    a = t("answers").select("title", "answer_id", "q_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " ").alias("x"))
    per = a.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("answer_id", F.col("q_id").cast("string").alias("question"), F.col("x").alias("answer")))).alias("r"))  # the annotations of one contract
    lines = lambda f: F.array_join(F.transform("r", lambda v: v[f]), "\n")
    both = per.select("title", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), lines(f).alias("content")) for f in ("question", "answer")))).alias("f"))
    at = scratch(a.sparkSession)
    files.write_files(both.select(F.concat("f.field", F.lit("/"), F.md5("title"), F.lit(".txt")).alias("name"), "f.content"), at)
    return files.lines(files.field_folders(a.sparkSession, at, ["question", "answer"]), "doc", ["question", "answer"])


@C.add("""select event_id::bigint step, value::double loss from events""")
def source_loss_log(t):
    """Log lines as Python writes dictionaries, others between them left out."""
    rows = t("events").select("event_id", F.col("value").cast("double").alias("v"))
    text = F.when(F.col("event_id") % 2 == 0, F.format_string("{'loss': %s, 'step': %s}", F.col("v").cast("string"), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("event_id").alias("step"), F.col("v").alias("loss"))))
    at = scratch(rows.sparkSession)
    rows.select(F.explode(F.array(F.lit("saving checkpoint ..."), text)).alias("value")).write.text(at)
    return files.loss_log(rows.sparkSession, at, "step bigint, loss double").select("step", "loss")


# a run for each clause; what its checkpoint holds depends on the clause's number
_HAS = "q_id % 2 = 0 pred_sampled, q_id % 3 <> 0 metric_all, q_id % 4 = 0 metric_sampled"


def _tree(t) -> str:
    """A tree of runs with the predictions of one clause each, in files of some hundred rows, and metrics for some of them."""
    p = t("predictions").select("q_id", F.to_json(F.struct("title", "para_idx", "q_id", "type", "prediction"), {"ignoreNullFields": "false"}).alias("j"), F.pmod(F.conv(F.substring(F.md5("title"), 1, 4), 16, 10).cast("int"), F.lit(max(1, t("predictions").count() // 20_000))).alias("lot"))
    spark = p.sparkSession
    at = scratch(spark)
    place = lambda name: F.concat(F.lit("m"), F.col("q_id") % 3, F.lit("/s"), F.col("q_id") % 2, F.lit("/r"), F.col("lot"), F.lit("/checkpoint-"), F.col("q_id"), F.lit(f"/{name}")).alias("name")
    per = p.groupBy("q_id", "lot").agg(F.array_join(F.collect_list("j"), "\n").alias("content"))  # some 500 rows
    files.write_files(per.select(place("predictions_all.jsonl"), "content"), at)
    files.write_files(per.filter("q_id % 2 = 0").select(place("predictions_sampled.jsonl"), "content"), at)
    number = lambda k: F.to_json(F.struct((F.col("q_id") / k).alias("f1"), F.col("q_id").cast("double").alias("n"))).alias("content")
    files.write_files(per.filter("q_id % 3 <> 0").select(place("metrics_all.json"), number(41)), at)
    files.write_files(per.filter("q_id % 4 = 0").select(place("metrics_sampled.json"), number(82)), at)
    return at


_RUNS = """k as (select greatest(count(*) // 20000, 1) k from predictions), runs as (select distinct q_id, ('0x' || substr(md5(title), 1, 4))::int % k lot from predictions, k)"""


@C.add(f"""with {_RUNS} select 'm' || (q_id % 3) model, 's' || (q_id % 2) "split", 'r' || lot run, q_id "checkpoint", true pred_all, {_HAS}, q_id % 3 = 0 or (q_id % 2 = 0 and q_id % 4 <> 0) missing from runs""")
def source_run_registry(t):
    """What the checkpoints of a tree of runs have, and which still lack metrics."""
    registered = files.registry(files.run_tree(t("predictions").sparkSession, _tree(t)))
    lacking = files.to_score(registered).select("model", "split", "run", "checkpoint", F.lit(True).alias("missing"))
    return registered.join(lacking, ["model", "split", "run", "checkpoint"], "left").fillna(False, ["missing"])


@C.add(f"""with {_RUNS} select 'm' || (q_id % 3) model, 's' || (q_id % 2) "split", 'r' || lot run, q_id "checkpoint", case when q_id % 3 <> 0 then q_id / 41 end f1_all, case when q_id % 3 <> 0 then q_id::double end n_all,
 case when q_id % 4 = 0 then q_id / 82 end f1_sampled, case when q_id % 4 = 0 then q_id::double end n_sampled from runs where q_id % 3 <> 0 or q_id % 4 = 0""")
def source_metrics_tree(t):
    """Metrics of all checkpoints of a tree, of both kinds side by side."""
    found = files.metrics_tree(t("predictions").sparkSession, _tree(t), ["f1", "n"])
    return files.paired_metrics(found, ["f1", "n"], ("all", "sampled"))


@C.add(f"""with {_FACTS}, {_RUNS}, x as (select f.*, ('0x' || substr(md5(title), 1, 4))::int % k lot from f, k where q_id % 3 = 0), s as (select q_id, lot, sum(n_gold) g, sum(n_pred) p, sum(n_joint) j, count(*) n from x group by all)
 select 'm' || (q_id % 3) model, 's' || (q_id % 2) "split", 'r' || lot run, q_id "checkpoint", n::bigint n, round(coalesce(j / nullif(p, 0), 1), 6)::double p, round(coalesce(j / nullif(g, 0), 1), 6)::double r, round(coalesce(2 * j / nullif(g + p, 0), 1), 6)::double f1 from s""")
def score_missing_runs(t):
    """Scores of the checkpoints of a tree that have predictions but no metrics yet."""
    spark, at = t("predictions").sparkSession, _tree(t)
    run = ["model", "split", "run", "checkpoint"]
    lacking = files.registry(files.run_tree(spark, at)).filter("pred_all and not metric_all").select(*run)
    said = files.run_predictions(spark, at, "all", "title string, para_idx int, q_id int, type int, prediction string").join(lacking, run)
    gold = _gold(t).select("title", "para_idx", "q_id", "gold")
    rows = S.M.with_counts(said.join(gold, ["title", "para_idx", "q_id"], "left"), F.col("gold"), T.predicted_text(F.col("prediction")))
    counts = rows.groupBy(*run).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in S.COUNTS])
    return S.scored(counts).select(*run, "n", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])
