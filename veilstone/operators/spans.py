"""Spans of a model's answer: aligned to the text, cleaned, extended to words, checked for coverage."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

MOST_JUMP, MOST_REACH, MOST_PASSES = 64, 24, 3
TRIM = "()[]{}<>\"'“”‘’«»,.;:!?-–—/|\\ \t\r\n"


def lower_tr(text: str) -> str:
    """NFC, then lower case by Turkish rules."""
    return unicodedata.normalize("NFC", text).replace("I", "ı").replace("İ", "i").lower()


def align_pieces(text: str, pieces: list[str]) -> list[tuple[int, int] | None]:
    """Places of word pieces ('##' continues a word) in the text, left to right.

    A piece that doesn't stand within ``MOST_JUMP`` characters of the last one (a
    continuation: right behind it) has no place.
    """
    low = "".join(lower_tr(c) if len(lower_tr(c)) == 1 else c for c in text)
    out: list[tuple[int, int] | None] = []
    at = 0
    for piece in pieces:
        bare = lower_tr(piece.removeprefix("##"))
        found = low.find(bare, at) if bare else -1
        if found < 0 or found - at > (0 if piece.startswith("##") else MOST_JUMP):
            out.append(None)
            continue
        at = found + len(bare)
        out.append((found, at))
    return out


def clean_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Without brackets, quotes and punctuation at its ends."""
    while start < end and text[start] in TRIM:
        start += 1
    while end > start and text[end - 1] in TRIM:
        end -= 1
    return start, end


def expand_span(text: str, start: int, end: int, reach: int = MOST_REACH) -> tuple[int, int]:
    """Out to the edges of the words that it begins and ends in, at most ``reach`` characters each way."""
    wordy = lambda c: c.isalnum() or unicodedata.category(c)[0] == "M"
    left, right = start, end
    while left > 0 and start - left < reach and wordy(text[left - 1]):
        left -= 1
    while right < len(text) and right - end < reach and wordy(text[right]):
        right += 1
    # an edge that the reach doesn't get to is left as it was
    left = start if left > 0 and wordy(text[left - 1]) else left
    right = end if right < len(text) and wordy(text[right]) else right
    return left, right


def covered(text: str, provider: Callable[[str], list[tuple[str, str, float, int, int]]], passes: int = MOST_PASSES) -> list[tuple[str, str, float, int, int]]:
    """A model's tokens for the whole text: where they stop before its last word, the tail is asked about again, up to ``passes`` times."""
    out: list[tuple[str, str, float, int, int]] = []
    at, end = 0, len(text.rstrip())
    for _ in range(passes):
        found = [(w, t, s, a + at, b + at) for w, t, s, a, b in provider(text[at:])]
        out += found
        reached = max((b for *_, b in found), default=at)
        if reached >= end or reached <= at:
            break
        at = reached
    return out
