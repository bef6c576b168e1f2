"""Text keys: the tolerant key that finds a block, the strict key that verifies it, slugs and masks.

All are JVM-side Column expressions. Spark has no Unicode normalisation builtin, so the tables are
derived at import from the Unicode database of the driver: one-to-one foldings go through
``translate``; one-to-many foldings and composition of combining marks run only on rows whose text
contains such a character. Not covered: composition of Hangul syllables from single letters, and
characters beyond the Basic Multilingual Plane.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dash and quote variants folded by the tolerant key.
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„«»"
_WS = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
# only what has to change: other blanks, and a space followed by more of them; single spaces are left
SPACE = rf"[{_WS}&&[^ ]][{_WS}]*| [{_WS}]+"
# Fixed patterns: a typed heading number, a form-question number.
HEADING_NUMBER = r"^\s*(?:\d+(?:\.\d+)*|[IVXLC]+|[A-Za-z])[.)]?(?:\s+|\s*[-\x{2013}]\s*)(?=\S)"
QUESTION_NUMBER = r"^\s*\(?\d{1,3}\)?\s*[-\x{2010}\x{2012}-\x{2015}.:)]\s*(?=\S)"


def _chars(codes) -> str:
    """Code points as a regex character class body, runs as ranges."""
    out: list[str] = []
    codes = sorted(codes)
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[i]:x}}}" + (f"-\\x{{{codes[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


def _scope():
    return (c for c in range(0x80, 0xFFFE) if not (0xD800 <= c <= 0xDFFF or 0xAC00 <= c <= 0xD7A3))


@lru_cache
def _tables(form: str) -> tuple[str, str, str, str]:
    """``(from, to, json of longer foldings, regex of pieces)`` for a normal form."""
    src, dst, many, wide = [], [], {}, []
    for code in _scope():
        ch = chr(code)
        to = unicodedata.normalize(form, ch)
        if to == ch or unicodedata.category(ch) == "Cf":
            continue
        if len(to) == 1 and ord(to) < 0x10000:
            src.append(ch)
            dst.append(to)
        else:
            many[ch] = to
            wide.append(code)
    for code in _scope():
        ch = chr(code)
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and unicodedata.normalize("NFC", ch) == ch:
            # marks in any order, and half-composed letters, are the same character
            for marks in permutations(apart[1:]):
                for k in range(len(marks)):
                    spelt = unicodedata.normalize("NFC", apart[0] + "".join(marks[:k])) + "".join(marks[k:])
                    if unicodedata.normalize("NFC", spelt) == ch:
                        many[spelt] = ch
    special = f"[{_chars(wide)}]|\\P{{M}}\\p{{M}}+"
    return "".join(src), "".join(dst), json.dumps(many, ensure_ascii=False), f"(?s){special}|(?:(?!{special}).)+"


@lru_cache
def _needs_work() -> str:
    """Any character beyond the Latin letters and signs that every fold leaves alone."""
    folded = DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + "…"
    calm = [c for c in range(0x250) if unicodedata.normalize("NFKC", chr(c)) == chr(c)
            and unicodedata.category(chr(c)) != "Cf" and chr(c) not in folded]
    return f"(?![ -~])[^{_chars(c for c in calm if c > 31)}]"


def _plain(text: Column) -> Column:
    """Text that every fold leaves alone. Most of it is told by searches without alternatives, which cost little a character."""
    blanks = F.contains(text, F.lit("  ")) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    return ~blanks & ~(text.rlike("[^ -~]") & text.rlike(_needs_work()))


def _normal(text: Column, form: str) -> Column:
    """Single foldings by ``translate``; runs that need more are looked up, the rest stays whole."""
    src, dst, many, pieces = _tables(form)
    lookup = F.from_json(F.lit(many), "map<string,string>")
    found = F.regexp_extract_all(F.translate(text, src, dst), F.lit(pieces), F.lit(0))
    return F.array_join(F.transform(found, lambda g: F.coalesce(F.try_element_at(lookup, g), g)), "")


def _without_format_chars(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cf}", "")


def collapse(text: Column) -> Column:
    """Whitespace runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def match_key(text: Column) -> Column:
    """B1: tolerant key, for finding a block. Case is kept; plain text takes a short path."""
    folded = F.translate(
        _normal(_without_format_chars(text), "NFKC"),
        DASHES + SINGLE_QUOTES + DOUBLE_QUOTES,
        "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    full = F.replace(folded, F.lit("…"), F.lit("..."))
    return F.when(_plain(text), text).otherwise(collapse(full))


def exact_key(text: Column) -> Column:
    """B2: strict key, for verifying required wording."""
    full = _normal(_without_format_chars(text), "NFC")
    return F.when(_plain(text), text).otherwise(collapse(full))


def heading_key(text: Column) -> Column:
    """The tolerant key without one leading typed number, lower-cased.

    The pattern asks for a character after the number, so nothing is ever emptied by it.
    """
    return F.lower(F.regexp_replace(match_key(text), HEADING_NUMBER, ""))


def _slug_body(lowered: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _or(text: Column, fallback: str) -> Column:
    return F.regexp_replace(text, "^$", fallback)


def slug(text: Column) -> Column:
    """Identifier form of a name."""
    return _or(_slug_body(F.lower(collapse(text))), "field")


def question_slug(text: Column) -> Column:
    """Slug of a form question: its number dropped, 48 characters at most."""
    bare = F.regexp_replace(collapse(text), QUESTION_NUMBER, "")
    return _or(F.substring(_slug_body(F.lower(bare)), 1, 48), "field")


def style_key(name: Column) -> Column:
    """Cross-document identity of a style name."""
    return F.lower(collapse(name))


def humanise(name: Column) -> Column:
    """``report_number`` to ``Report Number``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def bookmark(label: Column) -> Column:
    """A label restricted to letters, digits and underscores, starting with a letter."""
    safe = F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9_]", "_"), "^_+", "")
    led = F.regexp_replace(_or(safe, "ref"), "^(?![A-Za-z])", "b")
    return F.substring(led, 1, 40)


def mask(value: Column) -> Column:
    """The shape of a value: digits to 0, capitals to A, small letters to a, 40 characters."""
    shape = F.substring(value, 1, 40)
    for pattern, sign in ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), (r"\p{Nd}", "0")):
        shape = F.regexp_replace(shape, pattern, sign)
    return shape


# Private-use bullet glyphs of symbol fonts and the characters they show.
BULLETS = {
    "symbol": ("\uf0b7\uf0a7\uf0d8\uf0fc\uf0fe\uf02d", "•▪➢✔❑–"),
    "wingdings": ("\uf0a7\uf075\uf0fc\uf0a8", "▪◆✔□"),
}


def canonical_bullet(glyph: Column, font: Column) -> Column:
    """The character a list marker shows; unlisted ones pass through."""
    key = F.lower(F.trim(F.coalesce(font, F.lit(""))))
    out = glyph
    for name, (src, dst) in BULLETS.items():
        out = F.when(key == name, F.translate(glyph, src, dst)).otherwise(out)
    return out
