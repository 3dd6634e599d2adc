"""Small cases worked by hand, nulls, empty tables, and invariants."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import metrics as M
from spanloom.functions import subwords
from spanloom.functions import text as T
from spanloom.operators import annotate, decode, prompts, rebase, runs, sampling, scoring, segment, spans
from spanloom.sources import files
from spanloom.streaming import files as stream
from spanloom.streaming.state import sequential


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_space_compression(spark):
    df = spark.createDataFrame([("one  two    three\n\n\nfour\tfive ß\n",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.compress(F.col("t"))).collect()] == ["one two three\nfour\tfive ß\n", None, ""]
    df = spark.createDataFrame([("   a   b  ",)], "t string")
    assert df.select(T.drop_outer_runs(F.col("t"))).first()[0] == "a b"


def test_atoms_of_a_document(spark):
    s = spark.createDataFrame([("d", 1, 6, "fee"), ("d", 2, 4, "term"), ("d", 4, 9, "term"), ("d", None, 9, "x")], "k string, s int, e int, l string")
    n = spark.createDataFrame([("d", 12), ("empty", 0)], "k string, n int")
    got = rows(spans.atoms(s, n, "k", "s", "e", "l", "n"), "k", "s")
    assert got == [("d", 0, 1, []), ("d", 1, 2, ["fee"]), ("d", 2, 6, ["fee", "term"]), ("d", 6, 9, ["term"]), ("d", 9, 12, [])]


def test_union_and_complement(spark):
    s = spark.createDataFrame([("d", 0, 10), ("d", 2, 3), ("d", 10, 12), ("d", 14, 15)], "k string, s int, e int")
    assert rows(spans.union(s, "k", "s", "e"), "s") == [("d", 0, 12), ("d", 14, 15)]
    n = spark.createDataFrame([("d", 20), ("e", 5)], "k string, n int")
    assert rows(spans.complement(s, n, "k", "s", "e", "n"), "k", "s") == [("d", 12, 14), ("d", 15, 20), ("e", 0, 5)]
    assert spans.union(s.limit(0), "k", "s", "e").count() == 0


def test_union_against_sets(spark):
    rng = random.Random(1)
    data = [(k, (a := rng.randrange(200)), a + rng.randrange(1, 9)) for k in range(5) for _ in range(30)]
    got = rows(spans.union(spark.createDataFrame(data, "k int, s int, e int"), "k", "s", "e"), "k", "s")
    for k in range(5):
        cover = {p for kk, a, b in data if kk == k for p in range(a, b)}
        assert {p for kk, a, b in got if kk == k for p in range(a, b)} == cover


def test_greedy_merge_and_packing(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([10, 20, 400, 5])], "k string, i int, n int")
    assert rows(segment.merge_short(df, "k", "i", "n", 300), "i") == [("d", 0, 0), ("d", 1, 0), ("d", 2, 0), ("d", 3, 1)]
    assert rows(segment.pack_greedy(df, "k", "i", "n", 35), "i") == [("d", 0, 0), ("d", 1, 0), ("d", 2, 1), ("d", 3, 2)]
    assert segment.merge_short(df.limit(0), "k", "i", "n").count() == 0


def test_stride_windows(spark):
    df = spark.createDataFrame([(600,), (0,), (300,), (301,)], "n int")
    assert [r[0] for r in df.select(segment.windows(F.col("n"), 300, 256)).collect()] == [[0, 256, 512], None, [0], [0, 256]]


def test_paragraphs_keep_places(spark):
    df = spark.createDataFrame([("a", "x\n\nyy\n"), ("b", None), ("c", "")], "k string, t string")
    assert rows(segment.paragraphs(df, "k", "t"), "k", "para_idx") == [("a", 0, 0, 1, "x"), ("a", 1, 3, 2, "yy")]


def test_clip_in_buckets(spark):
    a = spark.createDataFrame([("d", 1, 3, 12, "0123456789")], "title string, q_id int, start_pos int, end_pos int, answer_text string")
    p = spark.createDataFrame([("d", 0, 5, 0), ("d", 5, 5, 1), ("d", 10, 5, 2), ("d", 15, 0, 3)], "title string, offset int, length int, c int")
    for bucket in (2, 7, 1 << 16):
        got = rows(annotate.clip(a, p, "title", bucket).select("c", "start_pos", "end_pos", "answer_text"), "c")
        assert got == [(0, 3, 4, "01"), (1, 0, 4, "23456"), (2, 0, 2, "789")]


def test_scores_of_empty_sides(spark):
    df = spark.createDataFrame([("", ""), ("a b", ""), ("", "x"), (None, None), ("x y y", "y y z")], "g string, p string")
    c = M.counts(F.col("g"), F.col("p"))
    got = [tuple(r) for r in df.select(*M.lenient(*c).values()).collect()]
    assert got[:4] == [(1, 1, 1, 1), (1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 1, 1)]
    assert [tuple(r) for r in df.select(*M.strict(*c).values()).collect()][0] == (0, 0, 0, 0)
    assert [tuple(r) for r in df.select(*M.agreeing(*c).values()).collect()][:3] == [(1, 1, 1), (0, 0, 0), (0, 0, 0)]
    assert df.select(c[2]).collect()[4][0] == 2


def test_a_sample_delivered_twice_counts_once(spark):
    df = spark.createDataFrame([("t", 1, 1, 5, "a"), ("t", 1, 1, 3, "b")], "title string, para_idx int, q_id int, loaded_at int, x string")
    assert [r.x for r in scoring.first_delivery(df).collect()] == ["b"]


def test_loss_restart(spark):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate([10, 20, 30, 10, 20, 5, 15, 25, 35])], "r string, i int, s int")
    assert [r.s for r in runs.last_restart(df, ["r"], "i", "s").orderBy("i").collect()] == [5, 15, 25, 35]


def test_samples_are_seeded_and_whole(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, i int")
    one = rows(sampling.take(df, ["g"], ["g", "i"], F.lit(4), 7), "i")
    assert one == rows(sampling.take(df.repartition(5), ["g"], ["g", "i"], F.lit(4), 7), "i") and len(one) == 12
    assert sampling.take(df, ["g"], ["g", "i"], F.lit(99), 7).count() == 30
    assert sum(p == "train" for _, p in sampling.label_split(41, 29, 42)) == 29


def test_memory_budget_keeps_the_item_that_crosses(spark):
    df = spark.createDataFrame([(["a b", "c d", "e f"],)], "m array<string>")
    size = lambda x: F.size(F.split(x, " "))
    assert df.select(prompts.within_budget("m", size, 2)).first()[0] == ["c d", "e f"]
    assert df.select(prompts.within_budget("m", size, 99)).first()[0] == ["a b", "c d", "e f"]


def test_no_answer_wins_and_loses(spark):
    schema = "qa int, feature int, start_scores array<double>, end_scores array<double>, context_offset int, context_length int"
    df = spark.createDataFrame([(1, 0, [9.0, 1.0, 2.0], [9.0, 1.0, 2.0], 1, 2), (2, 0, [0.0, 1.0, 2.0], [0.0, 1.0, 2.0], 1, 2)], schema)
    got = {r.qa: (r.start, r.end) for r in decode.answers(decode.n_best(df, 3, 5)).collect()}
    assert got == {1: (-1, -1), 2: (2, 2)}


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, ["a", "é"]), ("u", None, None)], "title string, i int, answers array<string>")
    files.write_json_lines(df, f"{tmp_path}/j")
    files.write_json_lines(df, f"{tmp_path}/j", append=True)
    assert files.json_lines(spark, f"{tmp_path}/j", "title string, i int, answers array<string>").count() == 4
    (tmp_path / "m.csv").write_text("title,answers\nt,\"['it''s', \"\"b\"\"]\"\nu,None\nv,oops(\n")
    got = rows(files.csv(spark, f"{tmp_path}/m.csv", "title string, answers string", ("answers",)), "title")
    assert got[0][1] in (["its", "b"], ["it's", "b"]) and got[1][1] is None and got[2][1] is None
    files.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    (tmp_path / "corpus.json").write_text('{"version": "1", "data": [{"title": "t", "paragraphs": [{"context": "abc", "qas": [{"id": "t__x", "question": "?", "is_impossible": false, "answers": [{"text": "bc", "answer_start": 1}]}]}]}]}')
    doc = files.corpus(spark, f"{tmp_path}/corpus.json").first()
    assert doc.doc_text == "abc" and doc.qas[0].answers[0].end_pos == 3
    log = tmp_path / "log.txt"
    log.write_text("start\n{'step': 1, 'loss': 0.5}\n{\"step\": 2, \"loss\": 0.25}\n")
    assert [(r.step, r.loss) for r in files.loss_log(spark, str(log)).orderBy("line").collect()] == [(1, 0.5), (2, 0.25)]


def test_run_tree_and_registry(spark, tmp_path):
    for name in ("predictions_all.jsonl", "metrics_all.json"):
        at = tmp_path / "m" / "s1" / "r1" / "checkpoint-12"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_text("{}")
    at = tmp_path / "m" / "s1" / "r1" / "checkpoint-3"
    at.mkdir(parents=True)
    (at / "predictions_all.jsonl").write_text("{}")
    found = files.registry(files.run_tree(spark, str(tmp_path)))
    assert rows(found.select("checkpoint", "pred_all", "metric_all"), "checkpoint") == [(3, True, False), (12, True, True)]
    assert [r.checkpoint for r in files.to_score(found).collect()] == [3]


def test_field_folders_and_lines(spark, tmp_path):
    for field, text in (("label", "1\n-1"), ("text", "one\ntwo\nthree")):
        (tmp_path / field).mkdir()
        (tmp_path / field / "doc1.txt").write_text(text)
    wide = files.field_folders(spark, str(tmp_path), ["label", "text"])
    assert rows(files.lines(wide, "doc", ["label", "text"]), "line_no") == [("doc1", 0, "1", "one"), ("doc1", 1, "-1", "two")]


def test_cached_is_made_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert files.cached(make, spark, f"{tmp_path}/c").count() == 3 and files.cached(make, spark, f"{tmp_path}/c").count() == 3
    assert len(made) == 1


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"text {i}")
        stream.append_available(stream.text_files(spark, str(source)), target, checkpoint)
    assert sorted(r.value for r in spark.read.parquet(target).collect()) == ["text 0", "text 1", "text 2"]
    seen = []
    stream.each_batch(stream.text_files(spark, str(source), 1), lambda df, i: seen.append(df.count()), f"{tmp_path}/cp2")
    assert sum(seen) == 3


def test_position_filter_is_the_tail_of_a_full_scan(spark):
    df = spark.createDataFrame([(f, c) for f in range(3) for c in range(4)], "file_index int, chunk_index int")
    assert rows(stream.after(df, 1, 2), "file_index", "chunk_index") == [(1, 3), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_sequential_state(spark):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "k string, i int")
    got = sequential(df.repartition(3), "k", ["i"], lambda row, memory: f"{row['i']}:{len(memory)}", 2)
    assert [r.said for r in got.orderBy("k", "i").collect()] == ["0:0", "1:1", "2:2", "3:2", "4:2"] * 2


def test_predictions_stay_with_their_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i int, text string").repartition(3)
    got = scoring.predicted(df, lambda rows: [None if r["i"] % 7 == 0 else r["text"].upper() for r in rows], batch=4)
    assert all(r.prediction == (None if r.i % 7 == 0 else f"T{r.i}") for r in got.collect()) and got.count() == 50


def test_special_ids(spark):
    df = spark.createDataFrame([([1, 5, 2],), ([5],), ([],), ([1],)], "ids array<int>")
    assert [r[0] for r in df.select(T.without_special(F.col("ids"), first=1, last=2)).collect()] == [[5], [5], [], []]


def test_clamped_index(spark):
    df = spark.createDataFrame([(-1, 5), (-9, 5), (99, 5), (3, 5)], "i int, last int")
    assert [r[0] for r in df.select(runs.clamped(F.col("i"), F.lit(10), F.col("last"))).collect()] == [5, 0, 9, 3]


def test_tokens_drop_articles_at_word_boundaries_before_cutting(spark):
    rows = [("the “a” party–an x", ["“", "”", "party–", "x"]), ("The a the A an", []), ("the_a an-other", ["thea", "another"]), ("x\x1cy", ["x", "y"]), (None, []), ("", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", T.tokens(F.col("t")).alias("w"))
    assert {r.i: r.w for r in df.collect()} == {i: w for i, (_, w) in enumerate(rows)}


def test_predictions_are_read_as_given(spark):
    rows = ["No", " No", "No.", "Yes. - a\n\n- b", "Yes", "Yes. - the answer", "None of it", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    p = F.col("t")
    got = df.select("i", T.predicted_text(p), T.predicted_bullets(p), T.zero_shot_chat(p), T.zero_shot_plain(p, F.lit("WHOLE"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("", "", "", ""), (" No", " No", "", " No"), ("", "", "", "No."), (" - a\n\n- b", " - a b", "Yes. - a\n\n- b", "Yes. - a\n\n- b"), ("Yes", "Yes", "Yes", "WHOLE"),
        (" - the answer", " - the answer", "Yes. - the answer", "Yes. - the answer"), ("None of it", "None of it", "", "None of it"), ("", "", "", ""),
    ]


def test_short_numbers(spark):
    def plain(x):
        return f"{x:.5g}" if 0.001 < abs(x) < 1000 else "0.0" if abs(x) < 1e-6 else f"{x:.3e}"

    values = [0.0, 5.0, -5.0, 12345.0, 12.3457, 1e-7, 0.001, 0.0010001, 999.9999, 1000.0, 99.99999, 0.0123456789, float("nan"), float("inf"), -0.00234, 120.0, 9.9995e5]
    got = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double").select("i", T.short_number(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [*map(plain, values), None]


def test_file_keys(spark):
    df = spark.createDataFrame([(0, " a&b.c'd--.longext"), (1, "no extension"), (2, None), (3, "x-.pdf")], "i int, t string")
    assert [r.k for r in df.select("i", T.file_key(F.col("t")).alias("k")).orderBy("i").collect()] == ["a_b.c_d-", "", None, "x"]


def test_overlapping_windows_share_answers(spark):
    scores = lambda *at: [float(dict(at).get(i, -5.0)) for i in range(6)]
    rows = [
        ("q", 0, scores((0, 1.0), (3, 4.0)), scores((0, 1.0), (3, 4.0)), 2, 3, -2),  # token 1, score 8
        ("q", 1, scores((0, 0.5), (2, 4.5)), scores((0, 0.5), (2, 4.5)), 2, 3, -1),  # token 1 again, score 9; no answer 1
        ("none", 0, scores((0, 5.0), (2, 1.0)), scores((0, 5.0), (2, 1.0)), 2, 1, -2),
    ]
    df = spark.createDataFrame(rows, "qa string, feature int, start_scores array<double>, end_scores array<double>, context_offset int, context_length int, context_shift int")
    tokens = spark.createDataFrame([(q, i, 3 * i, 3 * i + 2) for q in ("q", "none") for i in range(4)], "qa string, tok_i int, c_start int, c_end int")
    texts = spark.createDataFrame([("q", "ab cd ef gh"), ("none", "xx yy zz ww")], "qa string, text string")
    got = decode.with_text(decode.n_best(df, 2, 3, tokens), texts)
    best = [(r.qa, r.rank, r.feature, r.start, r.char_start, r.char_end, r.score, r.text) for r in got.orderBy("qa", "rank").collect()]
    assert best[0] == ("none", 1, 0, -1, -1, -1, 10.0, "") and best[1] == ("none", 2, 0, 0, 0, 1, 2.0, "xx") and len([r for r in best if r[0] == "none"]) == 2
    assert best[2] == ("q", 1, 1, 1, 3, 4, 9.0, "cd") and len({r[3:6] for r in best if r[0] == "q"}) == len([r for r in best if r[0] == "q"])
    assert ("q", -1) in {(r[0], r[3]) for r in best}
    assert {r.qa: r.text for r in decode.answers(got, "text").collect()} == {"q": "cd", "none": ""}
    assert decode.n_best(df.limit(0), 2, 3, tokens).count() == 0


def test_places_of_words_within_the_row(spark):
    texts = ["ab cd ef", "  ab   cd ", "äö\u200bü 😀😀  x", "one", "", " ", None, "a  b c" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "qa int, text string")
    words = segment.words_with_places(docs, "qa", "text")
    counts = {r.qa: r.n or 0 for r in docs.select("qa", segment.word_count(F.col("text")).alias("n")).collect()}
    assert counts == {i: len((t or "").split(" ")) - (t or "").split(" ").count("") for i, t in enumerate(texts)}
    score = lambda q, f, k: float((q * 7 + f * 5 + k * 11) % 13)
    vectors = [(q, f, [score(q, f, k) for k in range(7)], [score(q, f + 3, k) for k in range(7)]) for q, n in counts.items() for f in range(n)]
    rows = [(q, f, a, b, 3, min(4, counts[q] - f), f - 3) for q, f, a, b in vectors]
    df = spark.createDataFrame(rows, "qa int, feature int, start_scores array<double>, end_scores array<double>, context_offset int, context_length int, context_shift int")
    want = decode.with_text(decode.n_best(df, 4, 3, words), docs)
    for features in (df, decode.proposals(df, 4, 3)):
        for small in (False, True):
            got = decode.with_words(decode.n_best(features, 4, 3, small=small), docs)
            assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    assert want.filter("start >= 0").count() > 10
    empty = spark.createDataFrame([(1, 0, None, None, 0, 2), (1, 1, [1.0], [None], 0, 1), (2, 0, [0.5, 3.0], [0.25, 1.0], 0, 2), (2, 1, [0.5, 1.0], [0.0, 2.0], 0, 2)], "qa int, feature int, start_scores array<double>, end_scores array<double>, context_offset int, context_length int")
    assert sorted(map(str, decode.n_best(empty, 2, 2, small=True).collect())) == sorted(map(str, decode.n_best(empty, 2, 2).collect()))
    assert "BroadcastHashJoin" not in want._jdf.queryExecution().executedPlan().toString()  # small tables, which Spark itself would broadcast


def test_cleaning_moves_and_unites_annotations(spark):
    docs = spark.createDataFrame([("d", "  a   b\n\n\nc  d"), ("n", None), ("e", "")], "k string, t string")
    runs = rebase.kept_runs(docs, "k", "t")
    assert [r for r in rows(runs.filter("length > 0"), "k", "run")] == [("d", 0, 0, 0, 1), ("d", 1, 2, 1, 2), ("d", 2, 6, 3, 2), ("d", 3, 10, 5, 2), ("d", 4, 13, 7, 1)]
    chars = {r.old_pos: r.new_pos for r in rebase.character_map(runs, "k").collect()}
    old, new = "  a   b\n\n\nc  d", " a b\nc d"
    assert all(old[o] == new[n] for o, n in chars.items()) and sorted(chars.values()) == list(range(len(new)))
    places = spark.createDataFrame([("d", i, "x") for i in range(len(old))], "k string, p int, note string")
    got = {r.p: r.new_p for r in rebase.moved(places, runs, "k", "p").collect()}
    last = 0
    for i in range(len(old)):
        last = chars.get(i, last)
        assert got[i] == last
    answers = spark.createDataFrame([("d", 1, 2, 4), ("d", 1, 3, 6), ("d", 2, 10, 13), ("d", 2, None, 3), ("n", 1, 0, 1)], "k string, q int, start_pos int, end_pos int")
    assert rows(rebase.cleaned(docs, answers, "k", "t", ["q"]), "q") == [("d", 1, 1, 3, "a b"), ("d", 2, 5, 7, "c d")]
    assert rebase.cleaned(docs.limit(0), answers, "k", "t", ["q"]).count() == 0


def test_folds_without_python(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 6, 20, 3, 4, 100])] + [("b", 0, 1), ("c", 0, None)], "k string, i int, n int").filter("n is not null")
    assert [r.group for r in segment.merge_short(df, "k", "i", "n", 10).orderBy("k", "i").collect()] == [0, 0, 1, 2, 2, 2, 0]
    assert [r.group for r in segment.pack_greedy(df, "k", "i", "n", 11).orderBy("k", "i").collect()] == [0, 0, 1, 2, 2, 3, 0]
    assert segment.merge_short(df.limit(0), "k", "i", "n").count() == 0


def test_running_sums_in_buckets(spark):
    df = spark.createDataFrame([(f"t{i:04}", i % 7) for i in range(3000)], "t string, v int").repartition(7)
    got = runs.running_sums(df, "t", ["v"]).orderBy("t").collect()
    total = 0
    for i, r in enumerate(got):
        total += i % 7
        assert r.sum_v == total
    assert runs.running_sums(df.limit(0), "t", ["v"]).count() == 0


def test_windows_with_labels(spark):
    words = spark.createDataFrame([("d", i, 3 * i, 3 * i + 2) for i in range(10)], "k string, tok_i int, c_start int, c_end int")
    n = spark.createDataFrame([("d", 10)], "k string, n int")
    q = spark.createDataFrame([("d", 1, False, 12, 16), ("d", 2, True, None, None), ("d", 3, False, 2, 4)], "k string, q int, none boolean, p int, z int")
    got = [tuple(r) for r in segment.labelled_windows(q, words, n, "k", 6, 4, 2).select("q", "start", "length", "start_position", "end_position", "is_impossible").orderBy("q", "start").collect()]
    # words 4 and 5 are in both windows; question 3 begins at a blank
    assert got == [(1, 0, 6, 6, 7, False), (1, 4, 6, 2, 3, False), (2, 0, 6, 0, 0, True), (2, 4, 6, 0, 0, True), (3, 0, 6, 0, 0, True), (3, 4, 6, 0, 0, True)]


def test_subwords_of_words(spark):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = str(P.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["The indemnification clause  naïve\n漢字 x", "", None, "word"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = df.select("i", subwords.word_maps(F.col("t"), path, P.PATTERN).alias("m"), subwords.round_trips(F.col("t"), path, P.PATTERN).alias("same")).orderBy("i").collect()
    for r, text in zip(got, texts, strict=True):
        if text is None:
            assert r.m is None and r.same is None
            continue
        pieces = [encoding.encode_ordinary(w) for w in text.split()]
        assert r.m.token_word == [i for i, p in enumerate(pieces) for _ in p] and r.same
        assert r.m.word_token == [sum(map(len, pieces[:i])) for i in range(len(pieces))]
