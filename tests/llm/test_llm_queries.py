"""Every query of the subpackage over the smallest tables, whole, with its production parameters, against brute force or what its definition demands."""

import base64
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from spanloom.llm import catalogue, cutting, leaks, together
from spanloom.llm.asread import as_read, span_key, words

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def table():
    return lambda name: duckdb.sql(f"select * from '{DATA}/{name}.parquet'").df().to_dict("records")


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def run(name):
        if name not in done:
            done[name] = [r.asDict() for r in catalogue.QUERIES[name](spark, str(DATA)).collect()]
        return done[name]

    return run


def text_of(v):
    return v if isinstance(v, str) else None


def distance(a, b, limit):
    if abs(len(a) - len(b)) > limit or sum((Counter(a) & Counter(b)).values()) < max(len(a), len(b)) - limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def overlaps(table):
    sides = {p: {text_of(r["title"]) for r in table(t)} - {None} for p, t in (("train", "train_meta"), ("test", "test_meta_id"))}
    paras = [(r["para_id"], r["source"], text_of(r["title"]), w) for r in table("paras") if len(w := words(text_of(r["text"]))) >= 10]
    of = {p: [x for x in paras if x[2] in titles] for p, titles in sides.items()}
    found = {}
    for i, _, _, a in of["test"]:
        for j, _, _, b in of["train"]:
            limit = max(len(a), len(b)) // 5
            if i != j and (d := distance(a, b, limit)) <= limit:
                found[i, j] = d
    return of, found


def test_p1_found(result, overlaps):
    assert {(r["para_id_a"], r["para_id_b"]) for r in result("p1_found")} == {(min(p), max(p)) for p in overlaps[1]}


def test_p1_overlap_by_source(result, overlaps):
    of, found = overlaps
    for r in result("p1_overlap_by_source"):
        own = [x[0] for x in of[r["split"]] if x[1] == r["source"]]
        at = 0 if r["split"] == "test" else 1
        near, equal = Counter(p[at] for p, d in found.items() if d), Counter(p[at] for p, d in found.items() if not d)
        assert r["paragraphs"] == len(own) and r["with_equal"] == sum(i in equal for i in own) and r["with_near"] == sum(i in near for i in own)
        assert r["pairs"] == sum(near[i] + equal[i] for i in own)


def test_p2(result, table):
    docs = {r["title"]: text_of(r["doc_text"]) for r in table("cuadv1")}
    want = set()
    for r in table("answers"):
        text, doc = text_of(r["text"]), docs.get(r["title"])
        if text is not None and doc is not None:
            span = doc[int(r["start_pos"]) : int(r["end_pos"]) + 1]
            if span != text and span_key(span) == span_key(text):
                want.add(r["answer_id"])
    assert {r["answer_id"] for r in result("p2_found")} == want
    forms = {(r["field"], r["key"]): r["form"] for r in result("p2_canonical")}
    assert len(forms) == len(docs) + len(table("answers")) and all(forms["cuadv1.doc_text", t] == as_read(x) for t, x in docs.items())


def test_p3(result, table):
    train, test = ({text_of(r["title"]) for r in table(t)} - {None} for t in ("train_meta", "test_meta_id"))
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for t in train | test:
        keys = together.filers(t) or [("alone", t)]
        for k in keys:
            group[top(k)] = top(keys[0])
    of = {t: top((together.filers(t) or [("alone", t)])[0]) for t in train | test}
    tied = {of[t] for t in train}
    assert {r["title"] for r in result("p3_found")} == {t for t in test if of[t] in tied}
    split = {r["title"]: r["split"] for r in result("p3_split")}
    assert set(split) == train | test and len(result("p3_split")) == len(split)
    assert all(split[a] == split[b] for a in split for b in split if of[a] == of[b])
    shares = Counter()
    for r in result("p3_balance"):
        shares[r["split"]] += r["rows"]
    assert sum(shares.values()) == sum(text_of(r["title"]) is not None for t in ("train_meta", "test_meta_id") for r in table(t))


def test_p4(result, table):
    paras = {r["para_id"]: len(text_of(r["text"]) or "") for r in table("paras")}
    settings = {r["setting"]: r["capacity"] for r in table("size_limits") if r["problem"] == 4}
    for name, capacity in settings.items():
        load, seen, parts = Counter(), Counter(), Counter()
        for r in result("p4_containers"):
            if r["setting"] == name:
                n = r["end_pos"] - r["start_pos"]
                load[r["container"]] += n
                seen[r["para_id"]] += n
                parts[r["para_id"]] += 1
        assert seen == {k: n for k, n in paras.items() if n} and max(load.values()) <= capacity
        assert all(paras[k] > capacity for k, n in parts.items() if n > 1) and len(load) <= -(-sum(paras.values()) // capacity) + 2


def test_p5(result, table):
    texts = {("paras", str(r["para_id"])): text_of(r["text"]) for r in table("paras")} | {("cuadv1", r["title"]): text_of(r["doc_text"]) for r in table("cuadv1")}
    own = {}
    for r in result("p5_pieces"):
        own.setdefault((r["table_name"], r["key"]), []).append((r["piece"], r["start_pos"], r["end_pos"]))
    limits = {r["table_name"]: (r["capacity"], r["overlap"]) for r in table("size_limits") if r["problem"] == 5}
    assert set(own) == {k for k, t in texts.items() if t}
    for k, p in own.items():
        capacity, overlap = limits[k[0]]
        text = texts[k]
        want = cutting.cut(len(text), cutting.boundaries(text), capacity, overlap) if len(text) > capacity else [(0, len(text))]
        assert sorted(p) == [(i, a, z) for i, (a, z) in enumerate(want)]


def test_p6(result, table):
    lines = {r["title"]: (text_of(r["doc_text"]) or "").split("\n") for r in table("cuadv1")}
    found = result("p6_found")
    assert {r["kind"] for r in found} <= {"page_line", "split_word", "misread"} and len({tuple(r.values()) for r in found}) == len(found)
    assert all(0 <= r["line_no"] < len(lines[r["title"]]) for r in found)
    assert all(lines[r["title"]][r["line_no"]].rstrip()[-1] in "-‐\xad¬" for r in found if r["kind"] == "split_word")
    repaired = {}
    for r in result("p6_paragraphs"):
        repaired.setdefault(r["title"], []).append(r["text"])
    assert {r["title"] for r in found} <= set(repaired) and all("\n" not in x for p in repaired.values() for x in p)


def test_p7(result, table):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(str(P.path("byte_bpe_50k.tiktoken")), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in result("p7_ids")}
    docs = {r["doc_id"]: text_of(r["text"]) for r in table("documents")}
    assert set(got) == set(docs) and all(got[d] == theirs.encode_ordinary(x or "") for d, x in docs.items())


def test_p8(result, table):
    items = [(r["item_id"], words(text_of(r["item_text"]))) for r in table("eval_items")]
    docs = {r["doc_id"]: words(text_of(r["text"])) for r in table("documents")}
    starts = {}
    for k, (_, w) in enumerate(items):
        for i in range(len(w) - 9):
            starts.setdefault(tuple(w[i : i + 10]), []).append((k, i))
    want, touched = set(), set()
    for d, w in docs.items():
        cover = {}
        for j in range(len(w) - 9):
            for k, i in starts.get(tuple(w[j : j + 10]), ()):
                cover.setdefault(k, set()).update(range(i, i + 10))
                touched.add(d)
        want |= {(d, items[k][0]) for k, c in cover.items() if len(c) >= len(items[k][1]) / 2}
    assert {(r["doc_id"], r["item_id"]) for r in result("p8_found")} == want
    assert {r["item_id"]: r["docs"] for r in result("p8_leaked_items")} == {i: sum(x == i for _, x in want) for i, _ in items}
    clean = result("p8_clean")
    assert {r["doc_id"] for r in clean} == touched and all(0 < r["removed"] <= len(docs[r["doc_id"]]) for r in clean)
    for r in clean:
        kept = len(docs[r["doc_id"]]) - r["removed"]
        assert len(words(r["clean_text"])) == kept if r["clean_text"] is not None else kept < leaks.DROP * len(docs[r["doc_id"]])


def test_p9(result, table):
    docs = {r["doc_id"]: text_of(r["text"]) for r in table("documents")}
    rows = {r["doc_id"]: r for r in result("p9_documents")}
    assert set(rows) == set(docs) and all(0 <= r["confidence"] <= 1 and (r["lang"] is None) == (r["confidence"] == 0) for r in rows.values())
    assert all(r["lang"] is None for d, r in rows.items() if not (docs[d] or "").strip())
    assert {r["lang"] for r in result("p9_found")} <= {"en", "de", "fr", "es", "it", "pt"}
    many = Counter(r["doc_id"] for r in result("p9_segments"))
    assert all(n > 1 for n in many.values()) and set(many) == {d for d, r in rows.items() if r["languages"] > 1}


def test_columns(result):
    want = {
        "p1_found": {"para_id_a", "para_id_b"}, "p2_found": {"answer_id"}, "p3_found": {"title"}, "p6_found": {"title", "line_no", "kind"}, "p7_ids": {"doc_id", "ids"},
        "p8_found": {"doc_id", "item_id"}, "p9_found": {"doc_id", "lang"},
    }
    assert all(not result(name) or set(result(name)[0]) == columns for name, columns in want.items())
