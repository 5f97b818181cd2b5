"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IPv4 addresses, payment cards and
international phone numbers; what they find stays. The random field adds spans in
other shapes (local phone numbers, spelled-out addresses, ...). It scores whole
candidate segments: a segment's features are its shape, length, digit count,
checksum, edge characters and the word before it, not a tag for each token. One
dynamic programme over the tokens, with entities of at most ``MOST_TOKENS`` tokens,
chooses boundaries and types together; it is trained by exact likelihood (forward and
backward sums over all segmentations) on sentences that a seeded generator makes.

Only stretches that could hold an entity at all are decoded (enough digits, or an at
sign), and the cost is linear in their length. Offsets are code points, end exclusive.

Defined results: a null text counts as empty and has no spans; an added span that
overlaps a base span is left out; a null doc_id stays null; repeated rows get equal
rows; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- base patterns -----------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# possessive forms and the look-behind leave out only starts that can't match: same matches in linear time
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, found from their at signs so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        tail = _domain.match(text, at + 1) if start < at else None
        free = tail.end() if tail else at + 1
        if tail:
            yield "email", start, free
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_digit.findall(text))


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """In order of start, then kind as listed."""
    found = list(emails(text)) if "@" in text else []
    if _digit.search(text):
        found += [("ip", *m.span()) for m in _ip.finditer(text) if octets(m.group())]
        for m in _card.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _phone.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- the random field --------------------------------------------------------------

MOST_TOKENS = 32
_token = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
#: A stretch of characters that an entity can be made of, with a spelled-out "at" or "dot" inside.
_stretch = re.compile(r"(?:[0-9@][^\s]*|\([0-9][^\s]*|\+[0-9][^\s]*|[\[({]\s?(?:at|AT)\s?[\])}])")
_at = re.compile(r"@|[\[({]\s?(?:at|AT)\s?[\])}]")
_spelled = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[({]\s?(?:at|AT)\s?[\])}])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({]\s?(?:dot|DOT)\s?[\])}])\s?[A-Za-z0-9-]+)+\Z")
_dotted = re.compile(r"[0-9]{1,3}(?:\s?(?:\.|[\[({]\.[\])}]|[\[({]dot[\])}])\s?[0-9]{1,3}){3}\Z")
_dots = re.compile(r"\.|[\[({]\s?(?:dot|DOT)\s?[\])}]")
_cardlike = re.compile(r"[0-9]{4}(?:[ ._/-]{0,2}[0-9]){9,15}\Z")
_phonelike = re.compile(r"(?:\+|00)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}\Z")
_CUES = {"mail": "email", "email": "email", "e": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
         "card": "card", "visa": "card", "pay": "card", "phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone"}


def possible(kind: str, text: str) -> bool:
    """Whether a segment can be of the kind at all; others are no candidates."""
    return bool({"email": _spelled, "ip": _dotted, "card": _cardlike, "phone": _phonelike}[kind].match(text))


def shape(text: str) -> str:
    out = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text))))
    return re.sub(r"( ?[\[({]a[\])}] ?a)\1+", r"\1", out)[:24]  # spelled-out parts count once, however many


def segment_features(kind: str, text: str, start: int, stop: int, cue: str | None) -> list[str]:
    """Of the whole segment text[start:stop] as the kind."""
    body = text[start:stop]
    d = digits_of(body)
    before, after = text[start - 1 : start], text[stop : stop + 1]
    edge = lambda c: "none" if not c else "word" if c.isalnum() else "space" if c.isspace() else c
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    out = ["bias", f"digits={min(len(d), 20)}", f"before={edge(before)}", f"after={edge(after)}", f"cue={cue == kind}", f"shape={shape(body)}"]
    if kind == "card":
        out += [f"luhn={luhn(d)}", f"even={len(set(groups)) == 1 or groups[0] == 4}", f"groups={min(len(groups), 6)}"]
    elif kind == "phone":
        out += [f"plus={body[0] in '+('}", f"ends={groups[-1] == 4 and len(groups) >= 2}", f"groups={min(len(groups), 6)}", f"luhn={luhn(d)}", f"dotted={bool(_dotted.match(body))}"]
    elif kind == "ip":
        out += [f"octets={all(g <= 3 for g in groups) and all(int(g) <= 255 for g in re.findall('[0-9]+', body))}"]
    else:
        out += [f"sign={'@' in body}", f"known={body.rsplit('.', 1)[-1].lower() in ('com', 'org', 'net', 'edu')}"]
    return [f"{kind}:{x}" for x in out]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """(first token, token after the last, kind, features) of every possible segment of at most MOST_TOKENS tokens."""
    out = []
    cue, n = None, len(tokens)
    for i, (a, b) in enumerate(tokens):
        first = text[a:b]
        if not first.isspace() and (first[0].isascii() and (first[0].isalnum() or first[0] in "+(")) and not (a and text[a - 1].isalnum()):
            for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
                stop = tokens[j - 1][1]
                last = text[stop - 1]
                if not (last.isascii() and last.isalnum()) or text[stop : stop + 1].isalnum():
                    continue
                body = text[a:stop]
                out += [(i, j, k, segment_features(k, text, a, stop, cue)) for k in KINDS if possible(k, body)]
        if first.isalpha():
            cue = _CUES.get(first.lower(), cue if i and text[a - 1] in "-" else None)
    return out


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + float(np.log(sum(np.exp(v - top) for v in x)))


class Field:
    """Weights by feature; segments outside entities are single tokens of score 0."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def decode(self, text: str) -> list[Span]:
        """The best segmentation's entities."""
        tokens = [m.span() for m in _token.finditer(text)]
        ending: dict[int, list] = {}
        for i, j, kind, features in candidates(text, tokens):
            ending.setdefault(j, []).append((i, kind, sum(self.weights.get(f, 0.0) for f in features)))
        if not ending:
            return []
        best, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            choice, step = best[j - 1], None
            for i, kind, s in ending.get(j, ()):
                if best[i] + s > choice or s > 0 and best[i] + s == choice:  # of equals, the one that ends later
                    choice, step = best[i] + s, (i, kind)
            best.append(choice)
            back.append(step)
        out, j = [], len(tokens)
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]


def _sentence(r: random.Random) -> tuple[str, list[Span]]:
    """An invented sentence and the personal data in it, among numbers that are none."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(good: bool) -> str:
        while True:
            d = r.choice("3456") + num(15)
            if luhn(d) == good:
                return r.choice([d, *[s.join(d[i : i + 4] for i in range(0, 16, 4)) for s in " -."]])

    def phone() -> str:
        a, b, c = r.choice("23456789") + num(2), num(3), num(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"001 {a} {b} {c}", f"+{num(11)}", f"1-{a}-{b}-{c}"])

    def email() -> str:
        user, host, tld = word() + r.choice(["", "." + word(), num(2)]), word(), r.choice(["com", "org", "net", "edu", "io"])
        return r.choice([f"{user}@{host}.{tld}", f"{user} (at) {host} (dot) {tld}", f"{user}[at]{host}.{tld}", f"{user}@{host}[dot]{tld}", f"{user} @ {host}.{tld}"])

    def ip() -> str:
        return r.choice([".", ".", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))

    def noise() -> str:
        return r.choice([
            f"version {r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            num(r.randint(3, 9)), num(r.randint(17, 24)), card(False), f"${r.randint(1, 999)},{num(3)}.{num(2)}", f"{num(4)}-{num(4)}", f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}",
            f"isbn 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(3)} {num(3)} {num(3)} {num(3)}", "".join(r.choice("0123456789abcdef") for _ in range(32)), f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{num(5)}",
        ])

    text, spans = "", []
    for _ in range(r.randint(3, 7)):
        text += " ".join(word() for _ in range(r.randint(1, 3))) + " "
        kind = r.choice([*KINDS, None, None])
        cue = r.choice([c for c, k in _CUES.items() if k == (kind or r.choice(KINDS))]) + r.choice([" ", ": "]) if r.random() < 0.3 else ""
        body = noise() if kind is None else {"email": email, "ip": ip, "phone": phone, "card": lambda: card(True)}[kind]()
        text += cue
        if kind:
            spans.append((kind, len(text), len(text) + len(body)))
        text += body + r.choice([" ", " ", ", ", ". "])
    return text, spans


@lru_cache(maxsize=1)
def trained(sentences: int = 250, epochs: int = 12, rate: float = 0.5, decay: float = 1e-3, seed: int = 11) -> Field:
    """Fits the field by stochastic gradient on the log-likelihood of the right segmentations."""
    r = random.Random(seed)
    weights: dict[str, float] = {}
    data = []
    for _ in range(sentences):
        text, gold = _sentence(r)
        tokens = [m.span() for m in _token.finditer(text)]
        found = candidates(text, tokens)
        where = {(tokens[i][0], tokens[j - 1][1], k) for i, j, k, _ in found}
        data.append((len(tokens), found, {(a, b, k) for k, a, b in gold} & where, tokens))
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        r.shuffle(data)
        for n, found, gold, tokens in data:
            scores = [sum(weights.get(f, 0.0) for f in fs) for *_, fs in found]
            ends: dict[int, list[int]] = {}
            starts: dict[int, list[int]] = {}
            for c, (i, j, _, _) in enumerate(found):
                ends.setdefault(j, []).append(c)
                starts.setdefault(i, []).append(c)
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _logsum([ahead[j - 1], *(ahead[found[c][0]] + scores[c] for c in ends[j])]) if j in ends else ahead[j - 1]
            for i in range(n - 1, -1, -1):
                behind[i] = _logsum([behind[i + 1], *(behind[found[c][1]] + scores[c] for c in starts[i])]) if i in starts else behind[i + 1]
            for c, (i, j, kind, fs) in enumerate(found):
                odds = float(np.exp(ahead[i] + scores[c] + behind[j] - ahead[n]))
                error = ((tokens[i][0], tokens[j - 1][1], kind) in gold) - odds
                if abs(error) > 1e-3:
                    for f in fs:
                        w = weights.get(f, 0.0)
                        weights[f] = w + step * (error - decay * w)
    return Field(weights)


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that could hold an entity, with the words around them; linear in the text."""
    start = stop = -1
    for m in _stretch.finditer(text):
        a, b = m.span()
        if start >= 0 and a - stop > 12:
            yield start, stop
            start = -1
        start, stop = (a if start < 0 else start), b
    if start >= 0:
        yield start, stop


class Finder:
    """Base spans and the field's own, with the answers for stretches seen so far."""

    def __init__(self, field: Field, cache: int = 50_000):
        self.field, self.known, self.cache = field, {}, cache

    def added(self, text: str, base: list[Span]) -> list[Span]:
        out = []
        for a, b in zones(text):
            body = text[a:b]
            if len(_digit.findall(body)) < 7 and not _at.search(body) and len(_dots.findall(body)) < 3:
                continue
            left = max(0, a - 80)
            lead = max(text.rfind("\n", left, a), left - 1) + 1
            while lead == left and 0 < left and text[left - 1].isalnum() and text[left].isalnum():
                lead = left = left - 1
            end = b
            for _ in range(MOST_TOKENS):  # whole tokens, as many as a segment can hold
                end = m.end() if (m := _token.match(text, end)) else end
            part = text[lead:end]
            if part not in self.known:
                if len(self.known) >= self.cache:
                    self.known.clear()
                self.known[part] = self.field.decode(part)
            out += [(k, lead + i, lead + j) for k, i, j in self.known[part]]
        free, last = [], -1
        taken = sorted((s[1], s[2]) for s in base)
        at = 0
        for k, i, j in sorted(set(out), key=lambda s: (s[1], -s[2])):
            while at < len(taken) and taken[at][1] <= i:
                at += 1
            clash, t = False, at
            while not clash and t < len(taken) and taken[t][0] < j:
                clash, t = taken[t][1] > i, t + 1
            if i >= last and not clash:
                free.append((k, i, j))
                last = j
        return free

    def find(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans; all spans. Both in order."""
        base = base_spans(text)
        if not _digit.search(text) and not _at.search(text):
            return base, base
        return base, in_order(base + self.added(text, base))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added for every row of docs."""
    work.small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(trained().weights)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Field(shipped.value))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = finder.find(text or "")
                kinds = [s[0] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
