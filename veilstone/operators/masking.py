"""Masking: one table of resolved spans gives both the masked text and the counts.

Candidates come from three sources: literals and rules wherever their variants stand
(priority 0), patterns found anew whose value is selected (1), and entities and labelled
fields wherever their variants stand (2). ``resolve`` turns candidates into disjoint spans.

A document can have many units and many findings, so a unit only meets the findings
that can concern it: patterns by an equi-join of its own matches on the value, variants
by an equi-join of its words on their first word. Units that nothing concerns pass
through unchanged, without going to Python.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import fold, fold_text, occurrences
from ..functions.validators import RANK
from ..session import broadcast_if, stored
from .findings import LAYERS
from .patterns import detect


class Candidate(NamedTuple):
    start: int
    end: int
    priority: int
    rank: int
    finding_id: str
    label: str


def resolve(candidates: list[Candidate], cell: int = 32) -> list[Candidate]:
    """Disjoint spans in order of place that cover every candidate.

    Wider candidates come first, then lower priority, place and category. One that is free
    of the accepted spans is accepted; any other widens the span, of those it touches, that
    was accepted first. At the end spans that overlap are joined under the left one's label.
    Accepted spans are filed by cells of the text, so a candidate looks only at its own place.
    """
    accepted: list[Candidate] = []
    filed: dict[int, list[int]] = defaultdict(list)

    def put(i: int, start: int, end: int) -> None:
        for c in range(start // cell, (end - 1) // cell + 1):
            filed[c].append(i)

    for c in sorted(candidates, key=lambda c: (c.start - c.end, c.priority, c.start, c.rank, c.finding_id)):
        near = {i for k in range(c.start // cell, (c.end - 1) // cell + 1) for i in filed.get(k, ())}
        clashes = [i for i in near if accepted[i].start < c.end and c.start < accepted[i].end]
        if not clashes:
            accepted.append(c)
            put(len(accepted) - 1, c.start, c.end)
            continue
        i = min(clashes)
        old = accepted[i]
        wide = old._replace(start=min(old.start, c.start), end=max(old.end, c.end))
        if wide != old:
            accepted[i] = wide
            put(i, wide.start, wide.end)
    out: list[Candidate] = []
    for c in sorted(accepted, key=lambda c: (c.start, -c.end)):
        if out and c.start < out[-1].end:
            out[-1] = out[-1]._replace(end=max(out[-1].end, c.end))
        else:
            out.append(c)
    return out


def candidates_of(text: str, hits: list[dict], named: list[dict]) -> list[Candidate]:
    """Candidates from a unit's pattern hits, and from the places of the variants of named findings."""
    out = [Candidate(h["start"], h["end"], 1, RANK[h["category"]], h["finding_id"], h["placeholder"]) for h in hits]
    if named:
        folded, where = fold_text(text)
        for f in named:
            priority = 0 if f["layer"] in (LAYERS["rules"], LAYERS["literals"]) else 2
            for needle in {fold_text(v)[0].strip() for v in f["variants"]} - {""}:
                out += [Candidate(a, b, priority, RANK.get(f["category"], 99), f["finding_id"], f["placeholder"]) for a, b in occurrences(text, folded, where, needle)]
    return out


def replaced(text: str, spans: list[Candidate]) -> str:
    at, out = 0, []
    for s in spans:
        out += [text[at : s.start], s.label]
        at = s.end
    return "".join([*out, text[at:]])


SPAN = "array<struct<start:int,end:int,finding_id:string,label:string>>"
NAMED = "array<struct<layer:int,category:string,finding_id:string,placeholder:string,variants:array<string>>>"
_FOLDED_WORDS = r"[\p{L}\p{N}]+"


def _concerned(units: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, unit_ix, hits, named: for each unit that some finding can concern, its pattern hits and those findings."""
    by_value = F.col("layer").isin(LAYERS["patterns"], LAYERS["filename"])
    hit = detect(units).join(findings.filter(by_value).select("doc_id", "category", "normalized", "finding_id", "placeholder"), ["doc_id", "category", "normalized"])
    finding = F.struct("layer", "category", "finding_id", "placeholder", "variants")
    first = F.regexp_extract(fold(F.col("variant")), r"[\p{L}\p{N}]+", 0)
    needles = findings.filter(~by_value).select("doc_id", finding.alias("finding"), F.explode("variants").alias("variant")).select("doc_id", "finding", first.alias("word")).distinct()
    span = F.struct("start", "end", "category", "finding_id", "placeholder")
    spans = hit.select("doc_id", "unit_ix", span.alias("hit"))
    needles = stored(needles)
    if not needles.limit(1).count():
        return spans.groupBy("doc_id", "unit_ix").agg(F.collect_list("hit").alias("hits"), F.array().cast(NAMED).alias("named"))
    words = units.filter("text is not null").select("doc_id", "unit_ix", F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col("text")), F.lit(_FOLDED_WORDS), F.lit(0)))).alias("word"))
    by_word = words.join(broadcast_if(needles.filter("word <> ''")), ["doc_id", "word"]).select("doc_id", "unit_ix", "finding").distinct()
    # a variant without a letter or digit has no word to meet by
    wordless = units.select("doc_id", "unit_ix").join(needles.filter("word = ''"), "doc_id").select("doc_id", "unit_ix", "finding")
    every = spans.unionByName(by_word.union(wordless).distinct(), allowMissingColumns=True)
    return every.groupBy("doc_id", "unit_ix").agg(F.collect_list("hit").alias("hits"), F.collect_list("finding").alias("named"))


def mask(units: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, unit_ix, masked, spans of every unit(doc_id, unit_ix, text[, allowed]); findings are the selected ones, numbered."""
    kept = ["allowed"] if "allowed" in units.columns else []
    units = units.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("unit_ix").cast("int").alias("unit_ix"), "text", *kept)
    joined = units.drop("allowed").join(_concerned(units, findings), ["doc_id", "unit_ix"], "left")
    untouched = joined.filter("hits is null").select("doc_id", "unit_ix", F.col("text").alias("masked"), F.array().cast(SPAN).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("finding_id", pa.string()), ("label", pa.string())])
        for batch in batches:
            masked, spans = [], []
            for text, hits, named in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                own = resolve(candidates_of(text, hits, named))
                masked.append(replaced(text, own))
                spans.append([{"start": s.start, "end": s.end, "finding_id": s.finding_id, "label": s.label} for s in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masked, pa.string()), pa.array(spans, pa.list_(span))], names=["doc_id", "unit_ix", "masked", "spans"])

    return joined.filter("hits is not null").mapInArrow(run, f"doc_id long, unit_ix int, masked string, spans {SPAN}").union(untouched)


def counts(masked: DataFrame) -> DataFrame:
    """doc_id, finding_id, replaced: how many spans each finding has."""
    return masked.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id", F.col("s.finding_id").alias("finding_id")).agg(F.count(F.lit(1)).alias("replaced"))


def residual(units: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, finding_id of selected findings whose value still stands in a masked unit(doc_id, masked)."""
    return units.join(findings, "doc_id").filter(F.contains("masked", "value")).select("doc_id", "finding_id").distinct()
