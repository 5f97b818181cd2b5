"""Folding for comparison, tolerant matching and search, with and without offsets.

The column forms stay in the JVM. The plain Python forms keep offsets and serve the
operators that work on whole texts in Arrow batches; both give the same folded text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish letters and what they fold to.
_FROM, _TO = "çğıöşüâîûÇĞİIÖŞÜÂÎÛ", "cgiosuaiucgiiosuaiu"
_SEPARATORS = r"[\s\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000_.\-\u2013\u2014]+"
_separator = re.compile(r"[\s_.\-\u2013\u2014]")


def fold(x: Column) -> Column:
    """Separators become one space, Turkish letters ASCII, format characters and marks go, the rest is lower-cased."""
    bare = F.regexp_replace(F.translate(x, _FROM, _TO), r"[\p{Cf}\p{M}]", "")
    return F.lower(F.regexp_replace(bare, _SEPARATORS, " "))


def comparison(x: Column) -> Column:
    return F.trim(fold(x))


def tolerance(length: Column, exact: Column | None = None) -> Column:
    """Edits that a token of this length may differ by."""
    by_length = F.when(length < 5, 0).when(length < 8, 1).otherwise(2)
    return by_length if exact is None else F.when(exact, 0).otherwise(by_length)


def deletions(token: Column) -> Column:
    """The token and all strings that one deletion makes of it."""
    cut = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.array_distinct(F.when(F.length(token) > 0, F.concat(F.array(token), cut)).otherwise(F.array(token)))


def deletion_variants(token: Column, edits: Column | int) -> Column:
    """All strings from at most ``edits`` (0 to 2) deletions."""
    edits = F.lit(edits) if isinstance(edits, int) else edits
    twice = F.array_distinct(F.flatten(F.transform(deletions(token), deletions)))
    return F.when(edits <= 0, F.array(token)).when(edits == 1, deletions(token)).otherwise(twice)


def tokens(x: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# --- plain Python, with offsets ------------------------------------------------------

_TABLE = dict(zip(map(ord, _FROM), _TO, strict=True))


@lru_cache(maxsize=4096)
def fold_char(c: str) -> str:
    if ord(c) in _TABLE:
        return _TABLE[ord(c)]
    if _separator.match(c):
        return " "
    kind = unicodedata.category(c)
    return "" if kind == "Cf" or kind[0] == "M" else "".join(x for x in c.lower() if unicodedata.category(x)[0] != "M")


def fold_text(text: str) -> tuple[str, list[int]]:
    """Folded text, and for each of its characters the place in the text that it comes from."""
    out, where, space = [], [], False
    for i, c in enumerate(text):
        f = fold_char(c)
        if f == " ":
            if space:
                continue
            space = True
        elif f:
            space = False
        out.append(f)
        where += [i] * len(f)
    return "".join(out), where


def is_word(c: str) -> bool:
    return bool(c) and (c.isalnum() or unicodedata.category(c)[0] == "M")


def occurrences(text: str, folded: str, where: list[int], needle: str) -> Iterator[tuple[int, int]]:
    """Whole-word places of a folded needle in the text, left to right and without overlap.

    A side is guarded only where the needle's own edge is a letter, digit or mark. A place
    that fails its guard is passed by one character, so that a later place that overlaps
    it is still found.
    """
    at = folded.find(needle) if needle.strip() else -1
    while at >= 0:
        stop = at + len(needle)
        first, last = where[at], where[stop - 1] + 1
        while last < len(text) and fold_char(text[last]) == "" and unicodedata.category(text[last])[0] == "M":
            last += 1
        clear = not (is_word(needle[0]) and first and is_word(text[first - 1])) and not (is_word(needle[-1]) and last < len(text) and is_word(text[last]))
        if clear:
            yield first, last
        at = folded.find(needle, stop if clear else at + 1)


def strip_format(text: str) -> tuple[str, list[int] | None]:
    """The text without format characters, and the places of what is left (None where nothing was taken out)."""
    if text.isascii():
        return text, None
    keep = [i for i, c in enumerate(text) if unicodedata.category(c) != "Cf"]
    return (text, None) if len(keep) == len(text) else ("".join(text[i] for i in keep), keep)
