"""Text as a reader sees it: one form for everything that looks the same.

``as_read`` keeps case, accents, words and visible signs (raised and circled digits
included) and removes only differences nobody can see: full-width forms, look-alike
letters of other scripts, composed against combining accents, ligatures, kinds of
blanks, and characters without any picture.  ``match_key`` folds case on top of it.

Null stays null, an empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts whose usual picture is that of a Latin letter.
LOOK_ALIKE_FROM = "АВЕЅІЈКМНОРСТХУԌԚԜаеѕіјкорсухԁһԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳԱՕՏօսոհ"
LOOK_ALIKE_TO = "ABESIJKMHOPCTXYGQWaesijкopcyxdhqwlABEZHIKMNOPTYXocjԱOSounh"

# Decomposition types that change how a character is drawn, so stay apart.
VISIBLE_TYPES = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")

# Ranges of the Unicode property Default_Ignorable_Code_Point.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Hyphens drawn like the plain one.
HYPHENS = "‐‑﹣－"

_LATIN = dict(zip(LOOK_ALIKE_FROM, LOOK_ALIKE_TO, strict=True))
_WORD = re.compile(r"[^\W_]+")


def _drawn(cp: int) -> str:
    """The plain characters that one decomposed code point is read as."""
    c = chr(cp)
    if any(a <= cp <= b for a, b in IGNORABLE):
        return ""
    if c in "\t\n":
        return c
    if c in "\r\v\f\x1c\x1d\x1e\x85  ":
        return "\n"
    if c.isspace() or unicodedata.category(c) == "Zs":
        return " "
    if unicodedata.category(c) == "Cc":
        return ""
    if c in HYPHENS:
        return "-"
    if c in _LATIN:
        return _LATIN[c]
    kind = unicodedata.decomposition(c)
    if kind.startswith("<") and not kind.startswith(VISIBLE_TYPES) and c != "ſ":
        plain = unicodedata.normalize("NFKD", c)
        if plain.strip() == plain:  # a spacing accent would else become a blank with an accent on it
            return "".join(_LATIN.get(x, "-" if x in HYPHENS else x) for x in plain)
    return c


class _Table(dict):
    """Filled as code points are met; never larger than Unicode."""

    def __missing__(self, cp: int) -> str:
        self[cp] = out = _drawn(cp)
        return out


_TABLE = _Table()


class _Steady(dict):
    """Whether a character stays as it is, whatever stands beside it; filled as characters are met."""

    def __missing__(self, c: str) -> bool:
        joins = unicodedata.category(c)[0] == "M" or "\u1100" <= c <= "\u11ff"  # marks and parts of syllables
        self[c] = out = not joins and unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).translate(_TABLE)) == c
        return out


_STEADY = _Steady()
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")


def as_read(text: str | None) -> str | None:
    """The one form of a text; line ends become \\n, other blanks but tabs one blank each."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if text.isascii():
        return text.translate(_TABLE) if _CONTROL.search(text) else text
    if all(map(_STEADY.__getitem__, set(text))):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE))


def match_key(text: str | None) -> str | None:
    """``as_read`` with full case folding, blanks at either end off and runs of blanks as one."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFC", as_read(text).casefold()).split())


def span_key(text: str | None) -> str | None:
    """``as_read`` for comparing a span: kinds and numbers of blanks don't count, case does."""
    return None if text is None else " ".join(as_read(text).split())


def words(text: str | None) -> list[str]:
    """Runs of letters or digits as read, in lower case; none for null."""
    return _WORD.findall(as_read(text).lower()) if text else []
