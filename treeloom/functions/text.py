"""Text columns: sizes, hashes, escaping, words and lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware word, as the word pattern is meant for names in any language.
WORD = r"(?U)(\w+)"


# White-space characters that are removed at the ends of a text.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """All words, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def line_count(text: Column) -> Column:
    """Number of newline-separated pieces; an empty text has one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a one-character string."""
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def _scaled(size: Column, units: list[str]) -> Column:
    exact = size.cast("decimal(20,0)")
    out = None
    for power, unit in enumerate(units):
        # bround works on exact decimals, so ties go to the even digit as they should.
        shown = F.concat(
            F.bround(exact / F.lit(1024**power), 2).cast("decimal(24,2)").cast("string"), F.lit(f" {unit}")
        )
        fits = size < 1024 ** (power + 1)
        if out is None:
            out = F.when(fits, shown)
        elif power < len(units) - 1:
            out = out.when(fits, shown)
        else:
            out = out.otherwise(shown)
    return out


def human_size(size: Column) -> Column:
    """``1.12 KB`` style size, units B to TB."""
    return _scaled(size, ["B", "KB", "MB", "GB", "TB"])


def browser_size(size: Column) -> Column:
    """The same for display, units B to GB and ``0 B`` for null."""
    return F.coalesce(_scaled(size, ["B", "KB", "MB", "GB"]), F.lit("0 B"))


def after(value: Column, pattern: str) -> Column:
    """The pieces of a text that follow each match of ``pattern``, up to the next match."""
    pieces = F.split(value, pattern, -1)
    return F.slice(pieces, F.lit(2), F.size(pieces))


def escape_html(text: Column) -> Column:
    """Replace the five HTML-special characters, the ampersand first."""
    # Entity per character.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight(text: Column, query: str) -> Column:
    """Wrap every case-insensitive literal occurrence of ``query`` in a mark element."""
    if not query:
        return text
    return F.regexp_replace(text, "(?iu)(" + re.escape(query) + ")", "<mark>$1</mark>")


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole`` with two decimals; zero when ``whole`` is zero."""
    return F.when(whole > 0, F.round(part.cast("double") / whole * 100, 2)).otherwise(F.lit(0.0))


def is_language_code(code: Column) -> Column:
    """Two lower-case letters, optionally a region."""
    return code.rlike("^[a-z]{2}(-[A-Z]{2})?$")
