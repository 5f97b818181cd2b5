"""Pattern detection over text units.

A unit is a row (doc_id, unit_ix, text, allowed): ``allowed`` names the categories that
may be sought in it (null: all). Units without an at sign or digits are dropped in the
JVM; the others go to Python in Arrow batches, because a rejected candidate resumes the
search one character later and offsets must survive the removal of format characters.
Offsets are code points of the raw text, half-open.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.folding import strip_format
from ..functions.validators import RANK, TR_AREA_CODES, WHITE

_AREAS = frozenset(TR_AREA_CODES)
_LOCAL = r"\p{L}\p{M}\p{N}._%+-"
_SPACE = rf"[{WHITE}]"
_GAP = r"[ \-\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\u2010-\u2015]"
_BREAK = r"[ .\-\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\u2010-\u2015]"

PATTERNS = (
    ("email", regex.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@(?:[\p{{L}}\p{{M}}\p{{N}}-]++\.)+\p{{L}}{{2,63}}+(?!\p{{L}})")),
    ("iban", regex.compile(rf"(?<![A-Za-z0-9])[Tt][Rr][0-9]{{2}}(?:{_SPACE}?[0-9]{{4}}){{5}}{_SPACE}?[0-9]{{2}}(?![A-Za-z0-9])")),
    ("iban", regex.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}(?![A-Za-z0-9])")),
    ("national_id", regex.compile(r"(?<![0-9])[0-9]{11}(?![0-9])")),
    ("card", regex.compile(rf"(?<![0-9])[0-9](?:{_GAP}?[0-9]){{12,18}}(?![0-9])")),
    ("phone", regex.compile(
        rf"(?<![0-9+])(?:(?:\+90|0090|0){_BREAK}?\(?[0-9]{{3}}\)?{_BREAK}?|\(?[0-9]{{3}}\)?{_BREAK})[0-9]{{3}}{_BREAK}?[0-9]{{2}}{_BREAK}?[0-9]{{2}}(?![0-9])"
    )),
)


#: A card written as one run of digits, and the customary groups of cards written with gaps.
_CARD_RUN = regex.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_CARD_GROUPS = regex.compile(rf"(?:[0-9]{{4}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}|[0-9]{{4}}{_GAP}[0-9]{{6}}{_GAP}[0-9]{{5}})(?![0-9])")
_WHITE = regex.compile(_SPACE)


def _digits(raw: str) -> str:
    return "".join(c for c in raw if "0" <= c <= "9")


def luhn(d: str) -> bool:
    doubled = sum((2 * int(c)) // 10 + (2 * int(c)) % 10 for c in d[-2::-2])
    return (doubled + sum(map(int, d[-1::-2]))) % 10 == 0


def national_id(d: str) -> bool:
    if len(d) != 11 or d[0] == "0" or len(set(d)) == 1:
        return False
    n = [int(c) for c in d]
    left = 7 * sum(n[0:9:2]) - sum(n[1:8:2])
    return left >= 0 and left % 10 == n[9] and sum(n[:10]) % 10 == n[10]


def iban(raw: str) -> bool:
    x = _WHITE.sub("", raw).upper()
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def phone_digits(raw: str) -> str | None:
    d = _digits(raw).removeprefix("00")
    d = d[2:] if len(d) == 12 and d.startswith("90") else d[1:] if len(d) == 11 and d[0] == "0" else d
    return d if len(d) == 10 else None


def accepted(category: str, raw: str) -> bool:
    if category == "card":
        d = _digits(raw)
        return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d)
    if category == "phone":
        return (phone_digits(raw) or "")[:3] in _AREAS
    return {"national_id": national_id, "iban": iban}.get(category, lambda _: True)(raw)


def normal_form(category: str, raw: str) -> str:
    if category == "email":
        return unicodedata.normalize("NFC", raw).lower()
    if category == "iban":
        return _WHITE.sub("", raw).upper()
    if category == "phone":
        return "+90" + (phone_digits(raw) or _digits(raw))
    return _digits(raw)


def _scan(pattern: regex.Pattern, category: str, text: str) -> Iterator[tuple[int, int]]:
    """Accepted places from left to right; after a rejected one the search resumes one character later."""
    at = 0
    while m := pattern.search(text, at):
        ok = accepted(category, m.group())
        if ok:
            yield m.span()
        at = m.end() if ok else m.start() + 1


def _scan_cards(pattern: regex.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Accepted cards from left to right. A run that is a card by itself isn't joined with the numbers around it.

    Between such runs the pattern takes as many digits as fit; where those are rejected, the
    customary groups at the same place are tried, so that a number behind a card doesn't hide it.
    """
    runs = list(_scan(_CARD_RUN, "card", text))
    at = 0
    for start, end in [*runs, (len(text), len(text))]:
        while m := pattern.search(text, at, start):
            tried = (m, _CARD_GROUPS.match(text, m.start(), start))
            ok = next((x for x in tried if x and accepted("card", x.group())), None)
            if ok:
                yield ok.span()
            at = ok.end() if ok else m.start() + 1
        if start < end:
            yield start, end
        at = end


def detect_text(text: str, allowed: list[str] | None = None) -> list[tuple[str, int, int, str, str]]:
    """(category, start, end, raw, normalized) of all matches, overlaps resolved, in order of place."""
    bare, keep = strip_format(text)
    found = []
    for category, pattern in PATTERNS:
        if allowed is None or category in allowed:
            places = _scan_cards(pattern, bare) if category == "card" else _scan(pattern, category, bare)
            found += [(a, RANK[category], -b, category) for a, b in places]
    out, free = [], 0
    for a, _, b, category in sorted(set(found)):
        if a >= free:
            free = -b
            start = keep[a] if keep else a
            # trailing format characters belong to the match: it ends where the next visible one stands
            stop = free if not keep else keep[free] if free < len(keep) else len(text)
            out.append((category, start, stop, text[start:stop], normal_form(category, bare[a:free])))
    return out


def unbroken(raw: Column) -> Column:
    """Whether a match is one run of digits (format characters behind it belong to the match)."""
    return raw.rlike("^[0-9]+[^0-9]*$")


@F.arrow_udf(IntegerType())
def matched_chars(x: pa.Array) -> pa.Array:
    """How many characters of a text its pattern matches take."""
    return pa.array([sum(b - a for _, a, b, _, _ in detect_text(t)) if t else 0 for t in x.to_pylist()], pa.int32())


MATCHES = "doc_id long, unit_ix int, category string, start int, end int, raw string, normalized string"


def detect(units: DataFrame) -> DataFrame:
    """Matches of all patterns in units(doc_id, unit_ix, text[, allowed])."""
    allowed = F.col("allowed") if "allowed" in units.columns else F.lit(None).cast("array<string>")
    likely = units.filter(F.col("text").rlike(r"@|[0-9][^0-9]{0,3}[0-9]")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("unit_ix").cast("int").alias("unit_ix"), "text", allowed.alias("allowed")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        names = [f.split(" ")[0] for f in MATCHES.split(", ")]
        for batch in batches:
            rows = [(d, u, *m) for d, u, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in detect_text(t, a)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return likely.mapInArrow(run, MATCHES)
