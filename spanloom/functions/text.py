"""Scalar text functions as Column expressions.  Null in, null out unless said otherwise; '' is a text like any other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, and English articles, that don't count when answers are compared.
PUNCTUATION = "[!-/:-@\\[-`{-~]"
ARTICLES = ("a", "an", "the")
# Blanks of any script and the four separators of ASCII; needs the flag (?U).
BLANKS = "[\\s\\x1c-\\x1f]"


def compress(text: Column) -> Column:
    """Runs of blanks become one blank, runs of line ends one line end; tabs stay."""
    return F.regexp_replace(F.regexp_replace(text, " +", " "), "\n+", "\n")


def drop_outer_runs(text: Column) -> Column:
    """Runs of two blanks or more: dropped at either end, one blank within."""
    return F.regexp_replace(F.regexp_replace(text, "^ {2,}| {2,}$", ""), " {2,}", " ")


def single_blanks(text: Column) -> Column:
    """Runs of two blanks or more become one, line by line."""
    return F.regexp_replace(text, " {2,}", " ")


def for_display(text: Column) -> Column:
    """At most two line ends and four blanks in a row."""
    return F.regexp_replace(F.regexp_replace(text, "\n{2,}", "\n\n"), " {4,}", "    ")


def tokens(text: Column) -> Column:
    """Words for comparing answers: lower case, punctuation out, then articles out where they stand between signs that are
    no letters or digits, then cut at blanks; none for null or ''."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    bare = F.regexp_replace(bare, "(?<![\\p{L}\\p{N}])(" + "|".join(ARTICLES) + ")(?![\\p{L}\\p{N}])", " ")
    return F.filter(F.split(bare, f"(?U){BLANKS}+"), lambda w: w != "")


def blank_words(text: Column) -> Column:
    """Words between blanks, tabs, line ends and narrow no-break spaces; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\r\n ]+"), lambda w: w != "")


def word_of_signs(text: Column) -> Column:
    """For each sign the number of the blank-separated word it is in or follows, -1 before the first; null for null."""
    blank = lambda c: c.isin(" ", "\t", "\r", "\n", "\u202f")
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda acc, c: F.struct(
        F.when(blank(c), acc["n"]).when(acc["gap"], acc["n"] + 1).otherwise(acc["n"]).alias("n"), blank(c).alias("gap")
    )
    begin = F.struct(F.lit(-1).alias("n"), F.lit(True).alias("gap"))
    return F.aggregate(signs, F.struct(begin.alias("at"), F.array().cast("array<int>").alias("all")), lambda a, c: F.struct(step(a["at"], c).alias("at"), F.concat(a["all"], F.array(step(a["at"], c)["n"])).alias("all")), lambda a: a["all"])


def head(text: Column, n: int = 5) -> Column:
    """The first ``n`` blank-separated words of each non-empty line, joined by '. '."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.array_join(F.slice(F.filter(F.split(x, " "), lambda w: w != ""), 1, n), " ")), ". ")


def omit_middle(text: Column, most: int) -> Column:
    """Texts above ``most`` words keep the first and last half of that number, with ' ... ' between."""
    w = blank_words(text)
    half = most // 2
    short = F.concat(F.array_join(F.slice(w, 1, half), " "), F.lit(" ... "), F.array_join(F.slice(w, -half, half), " "))
    return F.when(F.size(w) > most, short).otherwise(text)


def keep_words(text: Column, most: int) -> Column:
    """The first ``most`` words; a broken last sign goes."""
    w = blank_words(text)
    return F.when(F.size(w) > most, F.rtrim(F.array_join(F.slice(w, 1, most), " "), F.lit("�"))).otherwise(text)


def without_special(ids: Column, first: int | None = None, last: int | None = None) -> Column:
    """Ids without a given first or last special id."""
    if first is not None:
        ids = F.when(F.get(ids, F.lit(0)) == first, F.slice(ids, 2, 1 << 30)).otherwise(ids)
    if last is not None:
        ids = F.when(F.try_element_at(ids, F.lit(-1)) == last, F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
    return ids


def file_key(name: Column) -> Column:
    """A file's name for matching: all from the last full stop off, trimmed, quotes and ampersands to '_', one closing '-' off; '' without a full stop."""
    bare = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, "\\.[^.]*$", "")).otherwise(F.when(name.isNotNull(), F.lit("")))
    bare = F.regexp_replace(bare, f"(?U)^{BLANKS}+|{BLANKS}+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[&']", "_"), "-$", "")


def quoted(text: Column) -> Column:
    """What stands between the first and the last quotation mark, '' without two."""
    return F.regexp_extract(text, '"(.+)"', 1)


def details(text: Column) -> Column:
    """What follows 'Details: ' in its line, without no-break spaces; '' if nothing does."""
    return F.replace(F.regexp_extract(text, "Details: ([^\n]+)", 1), F.lit("\u00a0"), F.lit(""))


def qa_parts(qa_id: Column) -> Column:
    """(title, clause, number) of ``title__clause`` with an optional number at the end."""
    clause = F.split_part(qa_id, F.lit("__"), F.lit(2))
    return F.struct(
        F.split_part(qa_id, F.lit("__"), F.lit(1)).alias("title"),
        F.regexp_replace(clause, "_[0-9]+$", "").alias("clause"),
        F.nullif(F.regexp_extract(clause, "_([0-9]+)$", 1), F.lit("")).cast("int").alias("number"),
    )


def render(template: str, **slots: Column) -> Column:
    """A template with its {slots} filled, in the order they are given."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def target(answers: Column, style: str) -> Column:
    """What a model should answer, in one of three styles; null and empty lists mean there is nothing."""
    found = F.size(F.coalesce(answers, F.array())) > 0
    # The words of the three styles.
    bullets = F.array_join(F.transform(answers, lambda a: F.concat(F.lit("- "), a)), "\n")
    some, none = {
        "list": (bullets, "No"),
        "yes": (F.concat(F.lit("Yes. "), bullets), "No."),
        "sentence": (F.concat(F.lit("There are such clauses. They are:\n"), bullets), "There is no such clause."),
    }[style]
    return F.when(found, some).otherwise(F.lit(none))


def joined_answers(answers: Column, most: int) -> Column:
    """Answers, the middle of long ones left out, one per line; 'None' for null."""
    return F.coalesce(F.array_join(F.transform(answers, lambda a: omit_middle(a, most)), "\n"), F.lit("None"))


def predicted_lines(prediction: Column) -> Column:
    """Lines of a prediction; none when it is null or begins with 'None'."""
    return F.when(prediction.isNull() | prediction.startswith("None"), F.array().cast("array<string>")).otherwise(F.split(prediction, "\n"))


def predicted_text(prediction: Column) -> Column:
    """A prediction without its 'Yes.', '' for exactly 'No' or 'No.' and for null."""
    p = F.coalesce(prediction, F.lit(""))
    return F.when(p.isin("No", "No."), F.lit("")).otherwise(F.regexp_replace(p, "^Yes\\.", ""))


def predicted_bullets(prediction: Column) -> Column:
    """The same as one line: its non-empty lines without the bullets, joined by blanks."""
    lines = F.filter(F.split(predicted_text(prediction), "\n"), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^- ", "")), " ")


def zero_shot_chat(prediction: Column) -> Column:
    """'' when the prediction holds No and no Yes, and for null; else the prediction."""
    p = F.coalesce(prediction, F.lit(""))
    return F.when(p.contains("No") & ~p.contains("Yes"), F.lit("")).otherwise(p)


def zero_shot_plain(prediction: Column, paragraph: Column) -> Column:
    """'' for exactly No and for null, the whole paragraph for exactly Yes ('' without one), else the prediction."""
    p = F.coalesce(prediction, F.lit(""))
    return F.when(p == "No", F.lit("")).when(p == "Yes", F.coalesce(paragraph, F.lit(""))).otherwise(p)


def is_positive(prompt: Column, target: Column) -> Column:
    """Whether a sample has an answer: by its prompt, if there is one (it doesn't end in None), else by its target (it doesn't begin with None)."""
    return F.coalesce(~prompt.endswith("None"), ~target.startswith("None"))


def tokenizer_of(path: Column) -> Column:
    """The tokenizer that the runs below a path use, by the model's name in it; null for others."""
    # Part of the path, and the tokenizer's name, the first that fits.
    out = None
    for part, name in (("t5", "flan-t5"), ("llama3", "llama3"), ("mistral", "mistral")):
        out = F.when(path.contains(part), name) if out is None else out.when(path.contains(part), name)
    return out


def answer_or_none(text: Column) -> Column:
    """'None' for an empty answer."""
    return F.when(text == "", F.lit("None")).otherwise(text)


def source_and_target(prompt: Column, mark: str = "Answer:\n") -> Column:
    """(source, target) around the first mark; all is source without one."""
    at = F.instr(prompt, mark)
    end = at + len(mark) - 1
    return F.struct(
        F.when(at > 0, F.substring(prompt, F.lit(1), end)).otherwise(prompt).alias("source"),
        F.when(at > 0, F.substring(prompt, end + 1, F.length(prompt))).otherwise(F.lit("")).alias("target"),
    )


def tagged(text: Column, tag: str) -> Column:
    """Texts within <tag1>…</tag1>, whatever the number."""
    return F.regexp_extract_all(text, F.lit(f"<{tag}[0-9]+>(.*?)</{tag}[0-9]+>"), F.lit(1))


def short_number(value: Column) -> Column:
    """Five significant digits between 0.001 and 1000, without closing zeros; '0.0' under 0.000001; else three decimals and a power of ten.

    Ties, as the number's shortest digits show them, go to the even digit.
    """
    x, exact = F.abs(value), value.cast("double").try_cast("decimal(38,20)")
    fixed = None
    for most, digits in ((0.01, 7), (0.1, 6), (1.0, 5), (10.0, 4), (100.0, 3), (1000.0, 2)):
        own = F.bround(exact, digits).cast("string")
        fixed = F.when(x < most, own) if fixed is None else fixed.when(x < most, own)
    fixed = F.regexp_replace(fixed, "\\.?0+$", "")
    long = F.format_string("%.12e", value.cast("double"))
    mantissa = F.bround(F.split_part(long, F.lit("e"), F.lit(1)).try_cast("decimal(20,12)"), 3)
    power = F.when(F.abs(mantissa) < 10, F.concat(mantissa.cast("string"), F.lit("e"), F.split_part(long, F.lit("e"), F.lit(2)))).otherwise(F.format_string("%.3e", value.cast("double")))
    odd = F.when(F.isnan(value), F.lit("nan")).when(value == float("inf"), F.lit("inf")).when(value == float("-inf"), F.lit("-inf"))
    return F.when(value.isNotNull(), odd.when((x > 0.001) & (x < 1000), fixed).when(x < 1e-6, F.lit("0.0")).otherwise(power))


def with_prefix(labels: Column, prefix: str) -> Column:
    """The labels of a list that begin with the prefix, without it."""
    return F.transform(F.filter(labels, lambda x: x.startswith(prefix)), lambda x: F.substring(x, F.lit(len(prefix) + 1), F.length(x)))
