"""The training-data operators: hand cases, brute force, nulls, empty tables, ties, long texts, clashing names."""

import base64
import bisect
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanloom.llm import cutting, encode, language, leaks, overlap, packing, queries_p9, scans, together
from spanloom.llm.asread import as_read, match_key, span_key, words
from spanloom.llm.canonical import canonical, fold_key, lookalike_spans
from spanloom.llm.shared import kept

WORDS = [f"w{i}" for i in range(60)]


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# 1


def near_texts(rng, n):
    base = [[rng.choice(WORDS) for _ in range(rng.randrange(8, 40))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(1, len(w) // 3))):
            k = rng.randrange(3)
            at = rng.randrange(len(w))
            w[at : at + (k != 0)] = [rng.choice(WORDS)] if k != 2 else []
        out.append(" ".join(w))
    return out


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    texts = near_texts(rng, 150)
    rows = [(i, "test" if i % 3 == 0 else "train", "s", t, 1, "x") for i, t in enumerate(texts)]
    rows += [(900, "train", None, None, 1, "x"), (901, "test", None, "", 1, "x"), (902, "test", "s", texts[0].upper() + " !", 1, "x"), (903, "train", "s", texts[0], 1, "x"), (904, None, "s", texts[0], 1, "x")]
    df = spark.createDataFrame(rows, "rec long, side string, src string, body string, n int, h string")  # n and h clash with inner names
    got = {(r.query_id, r.corpus_id) for r in overlap.cross_split_pairs(kept(overlap.coded_records(df, "body", "rec", "side", "src"))).collect()}
    want = set()
    for i, p, _, t, *_ in rows:
        for j, q, _, u, *_ in rows:
            a, b = words(t), words(u)
            if p == "test" and q == "train" and min(len(a), len(b)) >= 10 and slow_distance(a, b) <= max(len(a), len(b)) // 5:
                want.add((i, j))
    assert got == want and len(want) > 20
    empty = overlap.coded_records(df.limit(0), "body", "rec", "side", "src")
    assert overlap.cross_split_pairs(empty).count() == 0


def test_blocks_by_length_and_cells_of_hot_classes(spark, monkeypatch):
    rng = random.Random(21)
    texts = near_texts(rng, 60) + [" ".join(f"hot{i}" for i in range(20))] * 40 + [" ".join(f"hot{i}" for i in range(19)) + " cold"] * 30
    rows = [(i, "test" if i % 4 == 0 else "train", "s" + str(i % 3), t) for i, t in enumerate(texts)] + [(5, "test", "s2", texts[5]), (100, "train", "s1", texts[100])]
    coded = kept(overlap.coded_records(spark.createDataFrame(rows, "rec long, side string, src string, body string"), "body", "rec", "side", "src"))
    one = sorted(map(tuple, overlap.cross_split_pairs(coded).collect()))
    monkeypatch.setattr(overlap, "BLOCK_WORDS", 100)
    monkeypatch.setattr(overlap, "CELL", 4)
    classes = kept(overlap.cross_split_classes(coded))
    assert sorted(map(tuple, overlap.expanded(classes, coded).collect())) == one and len(one) > 700
    want = {}
    for i, p, src, _ in rows:
        own = [(q, c, e) for q, c, e in one if (q if p == "test" else c) == i and q != c]
        a = want.setdefault((p, src), [0, 0, 0, 0])
        if len(words(dict((r[0], r[3]) for r in rows)[i])) >= overlap.MIN_WORDS:
            for k, v in enumerate((1, any(e == 0 for *_, e in own), any(e > 0 for *_, e in own), len(own))):
                a[k] += v
    got = {(r.split, r.source): [r.records, r.with_equal, r.with_near, r.pairs] for r in overlap.overlap_counts(coded, classes).collect()}
    assert got == {k: v for k, v in want.items() if v[0]}
    assert overlap._ranges({1: 60, 2: 30, 3: 50, 7: 250, 8: 1}) == [(1, 2, 1), (3, 3, 1), (7, 7, 3), (8, 8, 1)]


def test_edit_distance_and_long_texts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint32) for _ in range(2))
        d = slow_distance(a.tolist(), b.tolist())
        assert overlap.edit_distance(a, b, 99) == d and overlap.edit_distance(a, b, 5) == min(d, 6)
    long = rng.integers(0, 2**30, 20_000).astype(np.uint32)
    at = overlap.pivots(long, np.zeros(overlap.SLOTS, np.int64))
    assert len(set(at.tolist()) | set((at + 1).tolist())) == 2 * len(at)


def test_slices_of_hits_lose_and_repeat_no_pair(tmp_path):
    rng = random.Random(9)
    coded = [np.array([int(w[1:]) % 12 for w in t.split()], np.uint64) for t in near_texts(rng, 120)]
    ours, theirs = [c for c in coded[:40] if len(c) >= 10], [c for c in coded[40:] if len(c) >= 10]
    at = [overlap.pivots(c, np.zeros(overlap.SLOTS, np.int64)).astype(np.int32).tobytes() for c in ours]
    pq.write_table(pa.table({"h": [bytes([i]) for i in range(len(ours))], "seq": [c.tobytes() for c in ours], "at": at}), tmp_path / "x.parquet")
    block = overlap._Block(f"file://{tmp_path}/x.parquet")
    want = [(i, j) for i, a in enumerate(theirs) for j, b in enumerate(ours) if slow_distance(a.tolist(), b.tolist()) <= max(len(a), len(b)) // 5]
    for size in (1, 7, 40, 500, 1 << 20):
        assert sorted((x, y) for x, y, *_ in overlap._match(theirs, block, size)) == want and len(want) > 20
    who = np.array([0, 0, 0, 1, 2, 2, 5])
    for size in range(1, 12):
        runs = list(overlap._slices(np.cumsum([1, 2, 1, 5, 1, 1, 9]), who, size))
        assert runs[0][0] == 0 and runs[-1][1] == 7 and all(p[1] == q[0] and who[q[0]] != who[q[0] - 1] for p, q in zip(runs, runs[1:], strict=False))


# 2


def test_forms_that_look_the_same():
    same = [("ｔｅｓｔ", "test"), ("jοint", "joint"), ("cоnѕеnt", "consent"), ("é", "é"), ("of﻿fice", "office"), ("a­b", "ab"), ("ﬁt", "fit"), ("a b", "a b"), ("3‑x", "3-x"), ("µ", "μ")]
    for a, b in same:
        assert span_key(a) == span_key(b), (a, b)
    for a, b in [("11⑤", "115"), ("x²", "x2"), ("é", "e"), ("May", "MAY"), ("€", "USD")]:
        assert span_key(a) != span_key(b), (a, b)
    assert match_key("Straße  X") == match_key("STRASSE x") and as_read(None) is None and as_read("") == "" and words(None) == []


def test_lookalike_spans_and_nulls(spark):
    docs = spark.createDataFrame([("t", "the joint office", 1), ("n", None, 1), (None, "x", 1)], "title string, doc_text string, text int")
    rows = [(1, "t", "jοint", 4, 8), (2, "t", "joint", 4, 8), (3, "t", "Joint", 4, 8), (4, "t", None, 4, 8), (5, "n", "x", 0, 0), (6, "t", "x", None, 8), (7, None, "x", 0, 0), (8, "t", "x", 99, 100), (9, "t", "", 0, 2)]
    answers = spark.createDataFrame(rows, "answer_id long, title string, text string, start_pos int, end_pos int")
    assert [r.answer_id for r in lookalike_spans(answers, docs).collect()] == [1]
    assert lookalike_spans(answers.limit(0), docs).count() == 0
    df = spark.createDataFrame([(None,), ("",), ("Ａ" * 100_000,)], "t string")
    got = df.select(canonical(F.col("t")).alias("c"), fold_key(F.col("t")).alias("k")).collect()
    assert [r.c for r in got] == [None, "", "A" * 100_000] and got[2].k == "a" * 100_000


# 3


def test_filer_keys():
    same = ["Getfutfol-Robotics-Ltd", "GETFUTFOL ROBOTICS, INCORPORATED", "getfutfolroboticscorp", "Getfutfol  Robotics L.L.C.", "Getfutfol Robotics"]
    assert {together.filer_key(x) for x in same} == {"getfutfolrobotics"}
    assert together.filer_key("Getfutfol Energy") != together.filer_key("Getfutfol Robotics")
    assert together.filers("A One Inc & B Two_01_01_2000-EX-1-X") == ["aone", "btwo"] and together.filers("X F-K-A Y_1") == ["x", "y"] and together.filers(None) == [] == together.filers("_x")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("x", "y"), ("z", "z")], "a string, b string")
    got = {r.node: r.component for r in together.components(edges).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["y"] == "x" == got["x"]
    assert together.components(edges.limit(0)).count() == 0


def test_groups_stay_together_and_shares_are_met(spark, monkeypatch):
    rng = random.Random(2)
    titles = [f"F{chr(65 + i // 26)}{chr(65 + i % 26)} Co{'' if rng.random() < 0.8 else f' & F{chr(65 + i % 7)}A Co'}_1-{k}" for i in range(150) for k in range(rng.randrange(1, 4))]
    rows = [(t, rng.randrange(5), "l", 1) for t in titles for _ in range(rng.randrange(1, 6))] + [(None, 1, "l", 1), ("_nobody", None, "l", 1)]
    df = spark.createDataFrame(rows, "title string, q_id int, label string, rows int")  # label and rows clash with inner names
    got = together.grouped_split(df, F.col("q_id")).collect()
    assert {r.title for r in got} == set(titles) | {"_nobody"} and len(got) == len(set(titles)) + 1  # a title without a filer is a group of its own
    assert [r.component for r in got if r.title == "_nobody"] == ["title _nobody"]
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    n = {s: sum(1 for t, *_ in rows if t in {r.title for r in got if r.split == s}) for s in together.SHARES}
    assert all(abs(n[s] / sum(n.values()) - share) < 0.02 for s, share in together.SHARES.items())
    even = together.balance(df, F.col("q_id"), together.grouped_split(df, F.col("q_id"))).collect()
    assert sum(r.rows for r in even) == len(rows) - 1 and all(abs(r.share - together.SHARES[r.split]) < 0.1 for r in even if r.label is not None)
    monkeypatch.setattr(together, "CELL", 3)  # filers with more titles are joined in another way
    hot = {(r.title, r.component) for r in together.title_components(df).collect()}
    assert hot == {(r.title, r.component) for r in got}
    assert together.grouped_split(df.limit(0), F.col("q_id")).count() == 0


# 4


def best_fit(sizes, room):
    free, bins = [], 0
    for x in sorted(sizes, reverse=True):
        i = bisect.bisect_left(free, x)
        bins, left = (bins, free.pop(i)) if i < len(free) else (bins + 1, room)
        bisect.insort(free, left - x)
    return bins


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    n = np.minimum(rng.integers(1, 900, 3000), 1000 if seed else 300)
    length, count = np.unique(n, return_counts=True)
    load, seen = {}, {}
    for size, a, b, shift, per, base in packing.configurations(length, count, 1000):
        for r in range(a, b):
            c = base + (r + shift) // per
            load[c] = load.get(c, 0) + size
            seen[size] = seen.get(size, 0) + 1
    assert seen == dict(zip(length.tolist(), count.tolist(), strict=True)) and max(load.values()) <= 1000
    assert len(load) <= 1.01 * best_fit(n.tolist(), 1000) + 1 and set(load) == set(range(len(load)))


def test_packed_rows(spark):
    texts = ["x" * k for k in [10, 10, 10, 25, 20, 3, 3, 1]] + [None, ""]
    df = spark.createDataFrame([(i, t, 7, 7) for i, t in enumerate(texts)], "id long, body string, n int, container int")
    got = packing.packed(df, "id", "body", 20).collect()
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.end_pos - r.start_pos
    assert max(load.values()) <= 20 and sum(load.values()) == 82 and len(load) == 5
    assert [r.item_id for r in got if r.piece > 0] == [3] and {r.item_id for r in got} == set(range(8))
    assert packing.packed(df.limit(0), "id", "body", 20).count() == 0
    same = spark.createDataFrame([(i, "abc") for i in range(100)], "id long, body string")
    assert packing.packed(same, "id", "body", 7).select("container").distinct().count() == 50


# 5


def test_cut_covers_with_overlap():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "End. ", "New\n", "x" * 60, ", ", "\n\n", "。"]) for _ in range(rng.randrange(1, 120)))
        own = cutting.cut(len(text), cutting.boundaries(text), 50, 8)
        assert own[0][0] == 0 and own[-1][1] == len(text) and all(b - a <= 50 for a, b in own)
        assert all(p[1] - q[0] == 8 for p, q in zip(own, own[1:], strict=False))
    assert cutting.cut(30, cutting.boundaries("First one. Second is longer xx"), 20, 2)[0] == (0, 10)


def test_ranges_give_the_same_pieces(spark):
    rng = random.Random(5)
    long = "".join(rng.choice(["word ", "End. Next ", "New\n", "y" * 50, "é "]) for _ in range(3000))
    df = spark.createDataFrame([("a", long, 1, "k"), ("b", "short", 1, "k"), ("c", None, 1, "k"), ("d", "", 1, "k"), (None, "no key", 1, "k"), ("a", long, 1, "k")], "id string, body string, n int, key string")
    key = lambda rows: sorted((r.key or "", r.piece, r.start_pos, r.end_pos) for r in rows)
    one = key(cutting.pieces(df, "id", "body", 300, 20).collect())
    assert one == key(cutting.pieces(df, "id", "body", 300, 20, size=1000).collect())
    assert ("b", 0, 0, 5) in one and ("", 0, 0, 6) in one and not any(k in "cd" and k for k, *_ in one)
    assert cutting.pieces(df.limit(0), "id", "body", 300, 20).count() == 0


def test_ranges_agree_over_long_runs_of_blanks(spark):
    rng = random.Random(11)
    parts = ["word ", "End. ", "New\n", "x" * 60, "\n\n", "。", "\u2003", "a.'\" "]
    texts = ["".join(rng.choice(parts) + " " * (rng.randrange(0, 300) if rng.random() < 0.2 else 0) + rng.choice(["", "x", "X"]) for _ in range(rng.randrange(1, 150))) for _ in range(40)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, body string")
    want = {(str(i), k, a, z) for i, t in enumerate(texts) for k, (a, z) in enumerate(cutting.cut(len(t), cutting.boundaries(t), 70, 9) if len(t) > 70 else [(0, len(t))])}
    for size in (30, 64, 500, None):
        assert {tuple(r) for r in cutting.pieces(df, "id", "body", 70, 9, size).collect()} == want


def test_boundary_tables_are_short():
    rng = random.Random(12)
    mixed = "".join("Word " * rng.randrange(3, 30) + "end. " for _ in range(9000))
    for text, most in ((mixed, 0.03), ("A sentence of some words stands here. " * 20_000, 0.3)):  # chains over a text with a period never meet
        runs, nodes = cutting.range_table(cutting.Cutter(cutting.boundaries(text), len(text), None, 900, 90), len(text) - 900, False)
        assert runs.shape[1] < 40 and nodes.nbytes < most * len(text)


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(8)
    text = "".join(rng.choice(["word ", "End. Next ", "New\n", "漢字。", "é " * 5, "😀 "]) for _ in range(4000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "empty.txt").write_text("")
    paths = [f"file://{tmp_path}/{n}.txt" for n in ("a", "empty")]
    want = cutting.cut(len(text), cutting.boundaries(text), 300, 20)
    for size in (100, 1000, 1 << 24):
        got = cutting.file_pieces(spark, paths, 300, 20, size).orderBy("piece").collect()
        assert [(r.start_pos, r.end_pos) for r in got] == want


# 6


def scanned_contract(name, page):
    body = ["The supplier shall deliver the returnable goods to the buyer without any further notice in", "writing and the buyer shall promptly inspect the returnable goods at the registered off-", "ice of the supplier before the warehouse in question is closed for the season by the owner", "and the supplier shall at 1east once deliver the retumable goods with the non-", "exclusive labels to the buyer who may return them until the end of the following month"]
    return "\n".join([*body[:3], f"Page {page}", f"{name} Proprietary", *body[3:], "or later."])


def test_scanned_lines(spark):
    clean = "The supplier shall deliver the returnable goods at least once. The registered office is closed. The buyer takes non-exclusive labels."
    rows = [(f"c{i}", clean, 1) for i in range(12)] + [(f"Abcdef {k}_1-EX-1-X", scanned_contract(f"Abcdef {k}", i + 1), 1) for i, k in enumerate(["One", "Two", "Six"])]
    rows += [("n", None, 1), ("e", "", 1), (None, clean, 1), ("long", "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "title string, doc_text string, line_no int").select("title", "doc_text")
    lexicon, scanned = scans.vocabulary(df), scans.scanned_contracts(df)
    pages = kept(scans.page_lines(scanned))
    facts = scans.line_facts(scanned, pages)
    assert {r.title for r in scanned.collect()} == {t for t, *_ in rows if t and t.startswith("Abcdef")} and scans.page_lines(df).count() == pages.count()
    split, fixes, signs = kept(scans.split_words(facts, lexicon)), scans.repairs(facts, lexicon), scans.sign_repairs(facts, lexicon)
    assert {r.line_no for r in pages.collect()} == {3, 4} and pages.count() == 6
    assert {r.line_no for r in split.collect()} == {1}
    assert {r.line_no for r in scans.misread_lines(facts, fixes, signs, split).collect()} == {5}
    text = " ".join(r.text for r in scans.repaired(df, pages, split, facts, fixes, signs).orderBy("title", "para_no").collect())
    assert "registered office of" in text and "at least once deliver the returnable goods with the non-exclusive labels" in text and "Page" not in text
    none = df.limit(0)
    assert scans.page_lines(none).count() == 0 and scans.line_facts(scans.scanned_contracts(none), kept(scans.page_lines(none))).count() == 0


def test_headers_as_wide_as_the_text(spark):
    narrow = ["the supplier shall promptly deliver goods to", "the buyer without any further notice in that", "case and the buyer shall inspect the goods as"]
    wide = [f"{x} soon as they have been received at the warehouse" for x in narrow]
    rows = [
        (f"{f}_1-EX-1-TOLL AGREEMENT", "\n".join([body[0], "TOLL AGREEMENT, Draft of September 7, 2014", *body, f"{f} Proprietary Material of Owner  Page 2", *body]))
        for f, body in (("Abcdefgh", narrow), ("Bcdefghi", wide), ("Cdefghij", wide))
    ]
    rows += [(f"Dxyzefgh {k}_1-EX-1-X", "\n".join([narrow[0], "CONTRACT BETWEEN ALL THE NAMED PARTIES", *narrow])) for k in "ab"]
    df = spark.createDataFrame(rows, "title string, doc_text string")
    got = {}
    for r in scans.page_lines(df).collect():
        got.setdefault(r.title, set()).add(r.line_no)
    assert [got.get(t) for t, _ in rows] == [{1, 5}] * 3 + [{1}] * 2


def test_a_pair_seen_once_decides_a_tie(spark):
    df = spark.createDataFrame([("a", "Prices fall. Leaves fall. Nights fall. Stars fall. All fall. Pumps fail. Tests fail. Nobody should fail. It may fail.")], "title string, doc_text string")
    facts = spark.createDataFrame([("b", 0, "word", "fa1l", "", before) for before in ("may", "rates")], scans._FACTS)
    assert {(r.before, r.fix) for r in scans.repairs(facts, scans.vocabulary(df)).collect()} == {("may", "fail"), ("rates", "fall")}


def test_confusions_are_cheap():
    for read, true in [("retumable", "returnable"), ("vvith", "with"), ("c0st", "cost"), ("closcd", "closed"), ("dosed", "closed"), ("confidenfial", "confidential"), ("hstings", "listings"), ("wbere", "where")]:
        assert scans.weighed_distance(read, true) < 0.5 and set(scans.delete_keys(read)) & set(scans.delete_keys(true))
    assert scans.weighed_distance("cat", "dog") > 2
    assert scans.numeric_misread("20l4") and scans.numeric_misread("2O01") and not scans.numeric_misread("1,234") and not scans.numeric_misread("KA-1414") and not scans.numeric_misread("first")


# 7


def test_encoder_against_the_public_library(spark):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = str(P.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", " ", "\n\n  x", "naïve 漢字 😀 é", "<|endoftext|>", "a" * 5000, "0123456789" * 50, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(2000)), "The quick brown fox.", None]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in encode.encoded(df, path, P.PATTERN).collect()}
    assert all(got[i] == theirs.encode_ordinary(t or "") for i, t in enumerate(texts)) and got[9] == []
    assert encode.encoded(df.limit(0), path, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = encode.PerfectHash(keys)
    assert all(h.get(k) == i for i, k in enumerate(keys)) and sorted(h.slot_list) == list(range(5000)) and h.get(b"none") is None


# 8


def slow_cover(item, doc, least):
    cover = set()
    for i in range(len(item)):
        for j in range(len(doc)):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            if n >= least:
                cover.update(range(i, i + n))
    return len(cover)


def test_automaton_equals_brute_force():
    rng = random.Random(7)
    for _ in range(30):
        items = [(k, [rng.choice("abc") for _ in range(rng.randrange(0, 25))]) for k in range(6)]
        machine = leaks.Automaton(items, 3)
        doc = [rng.choice("abcd") for _ in range(60)]
        got = {machine.items[k][0]: bits.bit_count() for k, bits in machine.covered(doc).items()}
        assert got == {k: n for k, w in items if (n := slow_cover(w, doc, 3))}


def test_repetitive_items_take_linear_time():
    n = 20_000  # what takes the square of this would not end
    machine = leaks.Automaton([(1, ["x"] * n), (2, ["x", "y"] * 40)])
    assert {machine.items[k][0]: b.bit_count() for k, b in machine.covered(["x"] * n).items()} == {1: n}
    assert {machine.items[k][0]: b.bit_count() for k, b in machine.covered(["x", "y"] * 6).items()} == {2: 80}


def test_several_blocks_give_what_one_gives(spark):
    rng = random.Random(13)
    texts = [" ".join(f"t{rng.randrange(8)}" for _ in range(rng.randrange(12, 40))) for _ in range(30)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string")
    rows = [(i, " ".join(rng.choice(texts).split()[rng.randrange(0, 9) :] + ["tail", rng.choice(texts)])) for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, texts[0]), (3, texts[1]), (3, texts[1])], "doc_id long, text string")
    one, three = leaks.item_blocks(items), leaks.item_blocks(items, most=sum(map(len, texts)) // 3)
    assert len(one) == 1 and len(three) >= 3
    held = [sorted(map(tuple, leaks.held_items(docs, p).collect()), key=str) for p in (one, three)]
    clean = [sorted(map(tuple, leaks.without_leaks(docs, p, drop=0.5).collect()), key=str) for p in (one, three)]
    assert held[0] == held[1] and clean[0] == clean[1] and any(r[2] is None for r in clean[0]) and [r[0] for r in clean[0]].count(3) == 3
    want = set()
    for d, t in rows:
        for i, item in enumerate(texts):
            if slow_cover(words(item), words(t), 10) >= len(words(item)) / 2:
                want.add((d, i))
    assert {(r[0], r[1]) for r in held[0] if r[0] is not None} >= want


def test_held_items(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, passage, "x"), (2, "too short", "x"), (3, None, "x"), (4, "", "x"), (5, passage, "x")], "item_id long, item_text string, doc_id string")
    half = " ".join(f"WORD{i}," for i in range(15))
    rows = [(1, f"before {half} after"), (2, " ".join(f"word{i}" for i in range(14))), (3, None), (4, ""), (5, "x " * 100_000 + passage), (6, " ".join(f"wоrd{i}​" for i in range(10)) + " and " + " ".join(f"word{i}" for i in range(20, 30)))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    paths = leaks.item_blocks(items)
    assert {(r.doc_id, r.item_id) for r in leaks.held_items(docs, paths).collect()} == {(d, i) for d in (1, 5, 6) for i in (1, 5)}
    clean = {r.doc_id: r.clean_text for r in leaks.without_leaks(docs, paths).collect()}
    assert "WORD" not in clean[1] and clean[1].startswith("before") and clean[1].endswith("after")
    assert leaks.held_items(docs, leaks.item_blocks(items.limit(0))).count() == 0 and leaks.held_items(docs.limit(0), paths).count() == 0


# 9

LINES = {
    "en": "The supplier shall deliver the goods to the buyer within thirty days after written notice of the other party.",
    "de": "Der Lieferant muss die Waren innerhalb von dreißig Tagen nach schriftlicher Mitteilung an die Käuferin liefern.",
    "fr": "Le fournisseur doit livrer les marchandises dans les trente jours suivant la mise en demeure de l'autre partie.",
}


def test_languages(spark):
    rows = [(i * 3 + k, LINES[c] + f" ({i} pro rata).", c if i % 7 else "en", 0.5) for i in range(30) for k, c in enumerate(LINES)]
    rows += [(900, f"{LINES['en']}\n{LINES['fr']}", "en-US", 0.5), (901, None, "en", 0.5), (902, "", None, 0.5), (903, "KA-12 4,5 9.9", "xx", 0.5), (904, LINES["de"], "unknown", 0.5), (905, LINES["de"], "GER", 0.5), (906, LINES["fr"], None, 0.5), (907, "z" * 100_000, "de", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence double")
    model = language.fitted(df)
    got = {}
    for r in language.full(language.classified(df, model)).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got[900] == {"en", "fr"} and got[904] == got[905] == {"de"} and got[906] == {"fr"} and not {901, 902, 903, 907} & set(got)
    assert all(got[i * 3 + k] == {c} for i in range(30) for k, c in enumerate(LINES))
    labels = [r.c for r in spark.createDataFrame([("English",), ("pt-BR",), ("",), (None,), ("N/A",), ("nl",)], "l string").select(language.label_code(F.col("l")).alias("c")).collect()]
    assert labels == ["en", "pt", "", "", "", "nl"]
    assert language.fitted(df.limit(0)) is None and language.classified(df.limit(0), model).count() == 0


def test_segments_need_no_full_sentence(spark, tmp_path):
    rows = [(i * 3 + k, LINES[c] + f" ({i} pro rata).", c) for i in range(30) for k, c in enumerate(LINES)]
    rows += [(900, f"{LINES['en']}\n{LINES['fr'][:-1]}", "en"), (901, f"{LINES['en']} Die Waren an die Käuferin liefern.", "en"), (902, LINES["en"], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.segment, r.lang) for r in queries_p9.p9_segments(spark, str(tmp_path)).collect())
    assert got == [(900, 1, "en"), (900, 2, "fr"), (901, 1, "en"), (901, 2, "de")]


def test_sentences_do_not_end_at_abbreviations():
    text = "The firm Abc Inc. confirms receipt of Section 4.11. Next one am 21. Juli ends here (pro rata). Open end"
    assert [text[a:b].strip() for a, b, _ in language.sentences(text)] == ["The firm Abc Inc. confirms receipt of Section 4.11.", "Next one am 21. Juli ends here (pro rata).", "Open end"]


def test_quoted_fragments_are_no_sentences():
    text = 'Article 6 Scope "suivent la résiliation, en 53 versements égaux. Si" and "This quoted part is one whole sentence of its own."'
    assert [language.plain_words(language.shown(text)[a:b]) for a, b, _ in language.sentences(language.shown(text))] == ["article scope and this quoted part is one whole sentence of its own".split()]
