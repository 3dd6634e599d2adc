"""Problem 6: readable paragraphs from text that was read off page images.

A contract counts as scanned when most of its longer lines break off in the middle of a sentence.
Page numbers are known by their form; running headers and footers by the mask of their line (names
of the filer and kind of agreement, dates and numbers blotted out), when that mask stands next to page
numbers, or between two halves of a sentence, in enough contracts of the whole corpus.  Masks are learnt
from lines that are shorter than the text or written as a title, and hold for lines of any width.  A word cut by a
line end is told from a compound written with a hyphen by counts over the corpus.

Misread words: every word of a scanned contract that the unscanned ones hardly have is looked up in a
symmetric-delete index over the corpus lexicon (folded so that confusable signs are equal).
Candidates are weighed by an edit distance in which confusable pairs cost little; ties are
decided by how often the pair with the word before is found in the corpus, then by frequency.  All lookups are
joins on words; nothing of the corpus is collected.

Null and empty texts, and unscanned contracts, have no lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asread import as_read
from .shared import kept, small

WRAPPED = 0.65  # share of longer lines that must break off within a sentence
KNOWN = 3  # times that unscanned contracts must have a word for it to be beyond doubt
MASK_DOCS = 2  # contracts in which a header's mask must interrupt a sentence or touch a page number
LEAST_LINE = 40
PAGE_WIDTH = 140  # signs that a line of a page has at most; nine in ten of a scanned contract's longer lines keep to it

# What scanning confuses, as (true, read); either may stand for the other.
CONFUSED = (
    ("l", "1"), ("i", "1"), ("i", "!"), ("l", "!"), ("l", "i"), ("I", "l"), ("o", "0"), ("e", "c"), ("h", "b"), ("g", "9"), ("s", "5"),
    ("b", "8"), ("t", "f"), ("z", "2"), ("rn", "m"), ("w", "vv"), ("u", "ii"), ("li", "h"), ("l", "|"), ("cl", "d"),
)
# Every sign, or pair of signs, that may be taken for another comes out the same.
_FOLD = str.maketrans({"1": "i", "!": "i", "|": "i", "l": "i", "0": "o", "5": "s", "9": "g", "2": "z", "c": "e", "f": "t", "m": "rn", "w": "vv", "u": "ii", "h": "ii", "b": "ii", "8": "ii", "d": "ei"})
_DIGIT_LIKE = str.maketrans("OoQlIi!|SsBZzgqb", "0001111155822996")
_NUM = r"[0-9OolI!|SBZ]{1,3}"
_ROMAN = r"[ivxl]{1,6}"
_PAGE = re.compile(rf"{_ROMAN}|(?:[P][a-z0-9]{{2,3}}[a-z] )?{_NUM}(?: [o0][ft] {_NUM}|/{_NUM})?|[-–] ?{_NUM} ?[-–]|\[{_NUM}\]|[A-Z]-{_NUM}")
_AFTER = re.compile(rf"\s{{2,}}(?:{_PAGE.pattern})$")
_TERMINAL = re.compile(r"[.:;!?。][\"')\]]*$")
_TOKEN = re.compile(r"[^\s|]+")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_HYPHENS = "-‐\xad¬"


def fold(word: str) -> str:
    """The word with confusable signs made equal."""
    return word.lower().translate(_FOLD)


def delete_keys(word: str) -> list[str]:
    """The folded word and all of it that is left when one sign is deleted."""
    f = fold(word)
    return [f, *({f[:i] + f[i + 1 :] for i in range(len(f))} - {f} if len(f) > 4 else ())]


_COST = {(a, b): 0.2 for x, y in CONFUSED for a, b in ((x, y), (y, x), (x.upper(), y), (y, x.upper()))}


def weighed_distance(read: str, true: str, limit: float = 2.0) -> float:
    """Edit distance in which confusable signs, or pairs of signs, cost a fifth."""
    n, m = len(read), len(true)
    if abs(n - m) > 3:
        return limit + 1
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                d[i][j] = float(i + j)
                continue
            a, b = read[i - 1], true[j - 1]
            best = d[i - 1][j - 1] + (0.0 if a == b else _COST.get((a, b), 1.0))
            best = min(best, d[i - 1][j] + 1, d[i][j - 1] + 1)
            if i > 1 and (read[i - 2 : i], b) in _COST:
                best = min(best, d[i - 2][j - 1] + 0.2)
            if j > 1 and (a, true[j - 2 : j]) in _COST:
                best = min(best, d[i - 1][j - 2] + 0.2)
            d[i][j] = best
    return d[n][m]


def _width(lines: list[str]) -> int:
    """The length of the longest line of plain text."""
    return max((len(x) for x in lines if len(x) <= PAGE_WIDTH and " " in x and "|" not in x), default=0)


def is_scanned(lines: list[str]) -> bool:
    """Whether most longer lines (as read) break off within a sentence, and nine in ten fit on a page."""
    long = [x for x in lines if len(x) >= LEAST_LINE and "|" not in x and " " in x]
    return bool(long) and sum(not _TERMINAL.search(x) for x in long) >= WRAPPED * len(long) and len(long) > 2 and sum(len(x) <= PAGE_WIDTH for x in long) >= 0.9 * len(long)


def _shown(text: str) -> list[str]:
    """Lines of a text, cut at every line feed, as read."""
    return [as_read(x.replace("\xad", "¬")).replace("\n", " ").strip() if x.endswith("\xad") else as_read(x).replace("\n", " ").strip() for x in text.split("\n")]


def numeric_misread(token: str) -> bool:
    """Whether a token is a number, or an item's code, with a letter in the place of a digit."""
    if not any(c.isdigit() for c in token) or token.isdigit():
        return False
    head, _, tail = token.rpartition("-")
    if head and not (head.isalpha() and head.isupper() and len(head) <= 3):
        return False
    if head and re.search(r"[^\d.,]", tail) is None:
        return False
    return re.search(r"[^\d.,]", tail) is not None and re.fullmatch(r"\d[\d.,]*", tail.translate(_DIGIT_LIKE)) is not None and any(c.isdigit() for c in tail)


_VOCAB = "word string, clean long, scanned long"
_MASKS = "title string, line_no int, mask string, number boolean, beside boolean, apart boolean"
_FACTS = "title string, line_no int, kind string, word string, other string, before string"


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in names.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clean, scanned = Counter(), Counter()
    flush = lambda: _rows(_VOCAB, [(w, clean[w], scanned[w]) for w in {**clean, **scanned}])
    for b in small(batches):
        for text in b.column(1).to_pylist():
            lines = _shown(text)
            into = scanned if is_scanned(lines) else clean
            for line in lines:
                found = _WORD.findall(line.lower())
                into.update(found)
                into.update(f"{x} {y}" for x, y in zip(found, found[1:], strict=False))
                into.update(p for w in found if "-" in w for p in w.split("-"))
        if len(clean) + len(scanned) > 600_000:
            yield flush()
            clean.clear()
            scanned.clear()
    yield flush()


def _mask(line: str, filer: set[str], kind: str) -> str:
    """A line with the filer's name, the kind of agreement, dates and numbers blotted out, folded."""
    low = fold(re.sub(r"(?<!\w)(?=[^\W]*\d)[0-9OolI!SB]{1,4}(?!\w)", "#", _AFTER.sub("", line.strip())))
    low = low.replace(fold(kind), "@") if len(kind) > 3 else low
    out: list[str] = []
    for w in re.findall(r"[^\W_]+|[^\w\s]", low):
        w = "#" if w in _MONTHS else "~" if w in filer else w
        if not (out and w == out[-1] == "~"):
            out.append(w)
    return " ".join(out)


def _titled(line: str) -> bool:
    """Whether all longer words of a line begin with a capital."""
    long = re.findall(r"[^\W\d_]{4,}", _AFTER.sub("", line))
    return bool(long) and all(w[0].isupper() for w in long)


_MONTHS = {fold(m) for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")}


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = []
        for title, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lines = _shown(text)
            if not is_scanned(lines):
                continue
            width = _width(lines)
            filer = set(re.findall(r"[^\W_]+", (title or "").partition("_")[0].lower()))
            glued = "".join(sorted(filer, key=len)[-1:])
            kind = title.lower().partition("-ex-")[2].lstrip("0123456789.-") if title else ""
            number = [bool(x) and _PAGE.fullmatch(x) is not None and (any(c.isdigit() for c in x) or re.fullmatch(_ROMAN, x) is not None or "/" in x or x[0] in "[-") for x in lines]
            at = [i for i, x in enumerate(lines) if x]
            for k, i in enumerate(at):
                x = lines[i]
                if number[i]:
                    rows.append((title, i, "", True, False, True))
                elif not _TERMINAL.search(x) and not re.match(r"\d+\.|\(|ARTICLE ", x):
                    own = {fold(w) for w in filer} | {f for w in re.findall(r"[^\W_]+", x) if len(w) > 3 and (f := fold(w)) in fold(glued)}
                    near = any(0 <= j < len(at) and number[at[j]] for j in (k - 1, k + 1))
                    cut = 0 < k < len(at) - 1 and not _TERMINAL.search(lines[at[k - 1]]) and len(lines[at[k - 1]]) > 0.6 * width and lines[at[k + 1]][:1].islower()
                    rows.append((title, i, _mask(x, own, kind), False, near or cut, len(x) < 0.85 * width or _titled(x)))
        if rows:
            yield _rows(_MASKS, rows)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows: list[tuple] = []
        for title, text, pages in zip(*(c.to_pylist() for c in b.columns), strict=True):
            skip, lines = set(pages or ()), _shown(text)
            at = [i for i, x in enumerate(lines) if x and i not in skip]
            carried, before = None, ""  # the first half of a word that the line before left open
            for k, i in enumerate(at):
                line = lines[i]
                tokens = _TOKEN.findall(line)
                following = lines[at[k + 1]] if k + 1 < len(at) else ""
                open_word = None
                if tokens and tokens[-1][-1] in _HYPHENS and (a := re.search(r"([^\W_][\w!'-]*?)[-‐\xad¬]$", tokens[-1])) and (z := re.match(r"[^\W\d_][\w!-]*", following)):
                    head, tail = a[1].rpartition("-")[2], z[0]
                    open_word = (head, i, tokens[-1][-1])
                    rows.append((title, i, "join", (head + tail.partition("-")[0]).lower(), f"{head}-{tail.partition('-')[0]}".lower(), tokens[-1][-1]))
                    tokens = tokens[:-1]
                if carried and tokens:
                    first = re.match(r"[\w!]+", tokens[0])
                    whole = carried[0] + (first[0] if first else "")
                    rows.append((title, i, "joined", whole, str(carried[1]), carried[0]))
                    tokens = tokens[1:]
                carried = open_word
                for t in tokens:
                    core = t.strip("()[]{},.;:?\"'“”’-—–_|") if not t.endswith("!") or t[:-1].isalpha() else t
                    core = core.rstrip("!") if core.endswith("!") else core
                    if numeric_misread(core):
                        rows.append((title, i, "number", core, "", before))
                    else:
                        for part in re.findall(r"[\w!]+", core):
                            part = part.strip("_")
                            if part and not part.isdigit():
                                rows.append((title, i, "word", part, "", before))
                                before = part.lower()
        if rows:
            yield _rows(_FACTS, rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        words = b.column(0).to_pylist()
        rows = [(w, k) for w in words for k in delete_keys(w)]
        if rows:
            yield _rows("word string, k string", rows)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        cols = [c.to_pylist() for c in b.columns]
        rows = [(w, c, weighed_distance(w, c)) for w, c in zip(*cols, strict=True)]
        if rows:
            yield _rows("word string, fix string, cost double", rows)


def vocabulary(contracts: DataFrame) -> DataFrame:
    """(word, clean, scanned): how often unscanned and scanned contracts have each word and each pair of words, in lower case."""
    texts = contracts.select("title", "doc_text").filter("doc_text <> ''")
    return kept(texts.mapInArrow(_vocabulary, _VOCAB).groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned")))


def page_lines(contracts: DataFrame) -> DataFrame:
    """(title, line_no) of page numbers, running headers and running footers."""
    lines = kept(contracts.select("title", "doc_text").filter("doc_text <> ''").mapInArrow(_masks, _MASKS))
    masks = lines.filter("not number and apart").groupBy("mask").agg(
        F.countDistinct(F.when(F.col("beside"), F.col("title"))).alias("docs"), F.avg(F.col("beside").cast("double")).alias("share")
    )
    running = masks.filter((F.col("docs") >= MASK_DOCS) & (F.col("share") >= 0.5)).select("mask")
    return lines.filter("number").select("title", "line_no").unionByName(lines.filter("not number").join(running, "mask", "left_semi").select("title", "line_no"))


def scanned_contracts(contracts: DataFrame) -> DataFrame:
    """(title, doc_text) of the contracts that were read off page images, written once so that what follows doesn't look at the others again."""

    def only_scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            keep = [is_scanned(_shown(t)) for t in b.column(1).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return kept(contracts.select("title", "doc_text").filter("doc_text <> ''").mapInArrow(only_scanned, "title string, doc_text string"))


def line_facts(scanned: DataFrame, pages: DataFrame) -> DataFrame:
    """Words, numbers and joins of the contract text of scanned contracts, line by line."""
    per = pages.groupBy("title").agg(F.collect_list("line_no").alias("pages"))  # the page lines of one contract
    return kept(scanned.join(per, "title", "left").mapInArrow(_facts, _FACTS))


def split_words(facts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(title, line_no) of lines whose last word goes on in the next line."""
    joins = facts.filter("kind = 'join'")
    single = lexicon.filter("not contains(word, ' ')").select("word", (F.col("clean") + F.col("scanned")).alias("times"))
    both = joins.join(single.withColumnsRenamed({"times": "whole"}), "word", "left")
    both = both.join(single.select(F.col("word").alias("other"), F.col("times").alias("compound")), "other", "left").fillna(0, ["whole", "compound"])
    hyphen = F.col("before").isin("-", "‐")
    return both.filter(~hyphen | (F.col("compound") <= F.col("whole"))).select("title", "line_no")


def repairs(facts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, before, fix): the correction of each misread word, as it stands in the text, after that word."""
    used = facts.filter("kind in ('word', 'joined')").groupBy("word", F.when(F.col("kind") == "word", F.col("before")).alias("before")).count()
    single = lexicon.filter("not contains(word, ' ') and length(word) > 1")
    low = F.lower("word")
    seen = used.withColumn("low", low).join(single.select(F.col("word").alias("low"), "clean", "scanned"), "low", "left").fillna(0, ["clean", "scanned"])
    doubtful = kept(seen.filter((F.col("clean") < KNOWN) & (F.length("low") > 1) & (F.length("low") < 40)))
    keys = "word string, k string"
    theirs = kept(single.filter((F.col("clean") + F.col("scanned") > 2) & (F.length("word") < 40) & ~F.col("word").contains("-")))
    index = theirs.select("word").filter("not word rlike '[0-9]'").mapInArrow(_keys, keys)
    asked = doubtful.select(F.col("low").alias("word")).distinct().mapInArrow(_keys, keys)
    pairs = asked.join(index.withColumnRenamed("word", "fix"), "k").filter("word <> fix").select("word", "fix").distinct()
    costs = pairs.mapInArrow(_weigh, "word string, fix string, cost double").filter("cost <= 1.0")
    costs = costs.join(theirs.select(F.col("word").alias("fix"), F.col("clean").alias("fix_clean"), (F.col("clean") + F.col("scanned")).alias("fix_times")), "fix")
    found = doubtful.join(costs.withColumnRenamed("word", "low"), "low")
    name = F.col("word").rlike("^[A-ZÄÖÜÁÉÍÓÚ]") & ~F.col("word").rlike("^[^a-z]+$")
    sound = F.when(
        F.col("cost") < 0.7, (F.col("fix_times") > 2 * (F.col("clean") + F.col("scanned"))) & ((F.length("low") > 2) | ((F.col("fix_clean") > 50) & (F.col("clean") == 0)))
    ).otherwise(
        ~name & (F.col("fix_clean") > 50) & (F.col("clean") == 0) & (F.col("scanned") < 3) & (F.length("low") > 5)
    )
    pair = F.concat_ws(" ", "before", "fix")
    known = lexicon.filter("contains(word, ' ')").select(F.col("word").alias("pair"), F.col("clean").alias("context"))
    ranked = found.filter(sound).withColumn("pair", pair).join(known, "pair", "left").fillna(0, ["context"])
    best = Window.partitionBy("word", "before").orderBy("cost", F.desc("context"), F.desc("fix_times"), "fix")
    return kept(ranked.withColumn("r", F.row_number().over(best)).filter("r = 1").select("word", "before", "fix"))


_SIGNS = "kind string, word string, fix string, cost double"
_MIXED = "word rlike '^[^0-9!]*[^\\\\W\\\\d_][^0-9!]*[0-9!]|^[0-9!]+[^\\\\W\\\\d_]{2}' and length(word) < 25 and not word rlike '^[0-9]+(st|nd|rd|th)$' and not word rlike '[0-9].*[0-9].*[0-9]' and not word rlike '^[A-Z]{1,3}[0-9]{1,2}$'"


def _sign_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = []
        for kind, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fix = _as_number(w) if kind == "number" else _as_letters(w)
            if fix != w:
                rows.append((kind, w, fix, weighed_distance(w, fix, float(len(w)))))
        if rows:
            yield _rows(_SIGNS, rows)


def sign_repairs(facts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(kind, word, fix) for numbers with letters in them, and for words with digits in them that unscanned contracts hardly have.

    The candidate has the confusable sign of the other kind in each such place; it stands where the weighed distance is half a sign for each place at most, or one sign.
    """
    known = lexicon.filter(f"not contains(word, ' ') and clean >= {KNOWN}").select(F.col("word").alias("low"))
    words = facts.filter("kind = 'word'").filter(_MIXED).select("kind", "word", F.lower("word").alias("low")).distinct().join(known, "low", "left_anti")
    asked = facts.filter("kind = 'number'").select("kind", "word").distinct().unionByName(words.select("kind", "word"))
    found = asked.mapInArrow(_sign_candidates, _SIGNS)
    return kept(found.filter(F.col("cost") <= F.greatest(F.lit(1.0), F.levenshtein("fix", "word") / 2)).select("kind", "word", "fix"))


def misread_lines(facts: DataFrame, fixes: DataFrame, signs: DataFrame, split: DataFrame) -> DataFrame:
    """(title, line_no) of lines of contract text with a wrongly read character in a word or number: those that hold a word with a repair."""
    odd = facts.filter("kind in ('word', 'number')").join(signs, ["kind", "word"], "left_semi").select("title", "line_no")
    words = facts.filter("kind = 'word'").join(fixes, ["word", "before"], "left_semi").select("title", "line_no")
    # of a word cut by the line end, the line that holds the first sign that differs
    cut = split.select("title", F.col("line_no").cast("string").alias("other"))
    joined = facts.filter("kind = 'joined'").join(cut, ["title", "other"], "left_semi").join(fixes.filter("before is null").select("word", "fix"), "word")
    same = F.expr("aggregate(sequence(1, length(fix)), 0, (n, i) -> if(n = i - 1 and substr(lower(word), i, 1) = substr(fix, i, 1), i, n))")
    halves = joined.select("title", F.when(same < F.length("before"), F.col("other").cast("int")).otherwise(F.col("line_no")).alias("line_no"))
    return odd.unionByName(words).unionByName(halves).distinct()


_PARAGRAPHS = "title string, para_no int, text string"


def repaired(contracts: DataFrame, pages: DataFrame, split: DataFrame, facts: DataFrame, fixes: DataFrame, signs: DataFrame) -> DataFrame:
    """(title, para_no, text): scanned contracts as continuous paragraphs, without page furniture, cut words or known misreadings."""
    words = facts.filter("kind = 'word'").join(fixes, ["word", "before"]).select("title", "line_no", "word", "fix")
    joined = facts.filter("kind = 'joined'").join(fixes.filter("before is null").select("word", "fix"), "word").select("title", F.col("other").cast("int").alias("line_no"), "word", "fix")
    other = facts.filter("kind in ('word', 'number')").join(signs, ["kind", "word"])
    other = other.join(fixes.select("word", "before").distinct(), ["word", "before"], "left_anti").select("title", "line_no", "word", "fix")
    changes = words.unionByName(joined).unionByName(other).groupBy("title").agg(F.collect_set(F.struct("line_no", "word", "fix")).alias("changes"))
    per = pages.groupBy("title").agg(F.collect_set("line_no").alias("pages")).join(split.groupBy("title").agg(F.collect_set("line_no").alias("cuts")), "title", "full").join(changes, "title", "full")
    scanned = contracts.join(facts.select("title").distinct(), "title", "left_semi").select("title", "doc_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for title, text, gone, cuts, changed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fix: dict[int, dict[str, str]] = {}
                for c in changed or ():
                    fix.setdefault(c["line_no"], {})[c["word"]] = c["fix"]
                rows += [(title, i, p) for i, p in enumerate(_paragraphs(_shown(text), set(gone or ()), set(cuts or ()), fix))]
            if rows:
                yield _rows(_PARAGRAPHS, rows)

    return scanned.join(per, "title", "left").select("title", "doc_text", "pages", "cuts", "changes").mapInArrow(run, _PARAGRAPHS)


def _as_number(token: str) -> str:
    head, dash, tail = token.rpartition("-")
    return head + dash + tail.translate(_DIGIT_LIKE)


_LETTER_LIKE = str.maketrans("0156892!|", "olsbbgzil")


def _as_letters(token: str) -> str:
    return token.translate(_LETTER_LIKE)


def _like(read: str, true: str) -> str:
    """The correction with the case of what was read."""
    return true.upper() if len(read) > 2 and read.isupper() else true[:1].upper() + true[1:] if read[:1].isupper() else true


def _paragraphs(lines: list[str], gone: set[int], cuts: set[int], fix: dict[int, dict[str, str]]) -> Iterator[str]:
    """Lines put together: a paragraph ends at a blank line, and after a closing sign or a line that is no sentence."""
    text, open_cut, changes = "", False, {}
    width = _width(lines)
    for i, line in enumerate(lines):
        if i in gone:
            continue
        if not line:
            if text and _TERMINAL.search(text):
                yield text
                text, open_cut = "", False
            continue
        for read, true in fix.get(i, {}).items():
            line = re.sub(rf"(?<![\w!]){re.escape(read)}(?![\w!])", lambda m, t=true: _like(m[0], t), line)
        text = text + line if open_cut else f"{text} {line}".strip()
        for read, true in changes.items():
            text = re.sub(rf"(?<![\w!]){re.escape(read)}(?![\w!])", lambda m, t=true: _like(m[0], t), text)
        open_cut, changes = i in cuts, {}
        if open_cut:
            text, changes = re.sub(r"[-‐\xad¬]$", "", text), fix.get(i, {})
        elif re.search(r"[^\W_]-$", text):
            open_cut = True  # a compound written with a hyphen
        elif (_TERMINAL.search(line) and len(line) < 0.8 * width) or re.fullmatch(r"(ARTICLE [IVXL]+ .*|\d+\. .{3,40}|[^a-z]{4,60})", text):
            yield text
            text = ""
    if text:
        yield text
