"""Toxicity by maximum-scoring segments.

Learning: over a bounded labelled sample, every feature (a word, or the first 4, 5 or 6
letters of a longer word) gets the log-odds of toxic against clean documents under a
Dirichlet prior in proportion to its overall frequency; features whose log-odds stand
``LEAST_Z`` deviations above zero are toxic terms. A token scores the log-odds of its
surest term; any other token scores the (slightly negative) log-odds of not being a term.

Scoring: one linear scan finds all maximal scoring segments of the token scores. By
extreme-value theory a segment of score S in n tokens has E = K n exp(-lambda S)
chance equals; lambda solves sum p exp(lambda s) = 1 over the clean documents' scores.
A document's score is a logistic function, fitted on the sample, of its best segment's
calibrated score and of how many segments are significant.

Neither labels nor lang, source or doc_id enter a score. Defined results: a null or
empty text has no segment and gets the score of a text without one; repeated rows are
scored alike; a null doc_id stays null and isn't held out; without labels of both
kinds every text scores 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .labelled import LIMIT, labelled_sample, remainder

MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
PREFIXES = (6, 5, 4)
LEAST_Z, LEAST_DOCS, PRIOR = 2.5, 5, 0.05
#: Size bound of the model: the surest so many terms.
MOST_TERMS = 50_000
K, SIGNIFICANT = 0.1, 0.05
CACHE = 1_000_000
_token = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Terms:
    """log-odds by term ('^' marks a prefix), the score of other tokens, and lambda."""

    odds: dict[str, float]
    other: float
    decay: float


@dataclass(frozen=True)
class Model:
    terms: Terms
    weights: tuple[float, float, float]


class Scanner:
    """Token scores, with the answers for words seen so far."""

    def __init__(self, terms: Terms):
        self.terms, self.known = terms, {}

    def odds(self, word: str) -> float:
        odds = self.terms.odds
        found = odds.get(word)
        if found is None:
            found = next((odds[p] for k in PREFIXES if len(word) > k and (p := "^" + word[:k]) in odds), 0.0)
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = found
        return found

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(position, log-odds) of the toxic terms; a word that repeats the one before it scores as any other token."""
        known, odds = self.known, self.odds
        out, last = [], None
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = odds(w)
            if s and w != last:
                out.append((i, s))
            last = w
        return out

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """How many tokens the text has; its maximal scoring segments as (first token, last token, score)."""
        words = _token.findall(text.lower())
        return len(words), maximal_segments(self.hits(words), self.terms.other)


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments when tokens between the hits score ``other`` (< 0), in linear time.

    A stack holds candidates as (first, last, total before, total after). A new hit
    looks back for the latest candidate that starts from a lower total; if that one
    also ends lower, all from there on merge into one candidate, and it looks back again.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, -1
    for i, score in hits:
        total += other * (i - at - 1)
        first, before = i, total
        total += score
        at = i
        after = total
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((first, i, before, after, j))
                break
            first, before = stack[j][0], stack[j][2]
            back = stack[j][4]
            del stack[j:]
            j = back
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def features(n: int, segments: list[tuple[int, int, float]], decay: float) -> tuple[float, float]:
    """Calibrated score of the best segment; log of one plus the number of significant segments."""
    if not segments:
        return 0.0, 0.0
    base = math.log(K * max(n, 1))
    scores = [decay * s - base for _, _, s in segments]
    return max(0.0, max(scores)), math.log1p(sum(math.exp(-min(x, 700)) < SIGNIFICANT for x in scores))


def learn_terms(sample: DataFrame) -> Terms | None:
    """Term statistics over the whole sample, gathered by Spark; the terms that pass come to the driver."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    cut = [F.expr(f"transform(filter(w, x -> length(x) > {k}), x -> concat('^', substring(x, 1, {k})))") for k in PREFIXES]
    held = sample.select("y", words.alias("w")).select("y", F.array_distinct(F.concat("w", *cut)).alias("terms"))
    counts = held.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b")
    )
    counts = work.written(counts, "term-counts")
    n1, n0 = counts.agg(F.sum("a"), F.sum("b")).first()
    if not n1 or not n0:
        return None
    prior = PRIOR * (F.col("a") + F.col("b"))
    p1, p0 = F.col("a") + prior, F.col("b") + prior
    m1, m0 = n1 + PRIOR * (n1 + n0), n0 + PRIOR * (n1 + n0)
    odds = F.log(p1 / (m1 - p1)) - F.log(p0 / (m0 - p0))
    sure = counts.filter(F.col("a") + F.col("b") >= LEAST_DOCS).select("term", odds.alias("odds"), (odds / F.sqrt(1 / p1 + 1 / p0)).alias("z"), (p1 / m1).alias("q1"), (p0 / m0).alias("q0"))
    rows = sure.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MOST_TERMS).collect()
    if not rows:
        return None
    words = [r for r in rows if r["term"][0] != "^"] or rows
    q1, q0 = (min(0.5, sum(r[k] for r in words)) for k in ("q1", "q0"))
    other = min(math.log((1 - q1) / (1 - q0)), -1e-3)
    low, high = 1e-6, 10.0
    excess = lambda x: sum(r["q0"] * math.exp(min(700, x * r["odds"])) for r in words) + (1 - q0) * math.exp(x * other) - 1
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return Terms({r["term"]: r["odds"] for r in rows}, other, max(low, 0.05))


def _scan(spark: SparkSession, terms: Terms) -> Column:
    """best and several (see ``features``) of the column text; only that column goes to Python."""
    work.small_batches(spark)
    shipped = spark.sparkContext.broadcast(terms)

    @F.arrow_udf("best double, several double")
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(shipped.value)
        for batch in texts:
            found = [features(*scanner.segments(t or ""), scanner.terms.decay) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)], ["best", "several"])

    return scan(F.col("text"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with the intercept first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pull = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pull @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Model | None:
    """None where the labels don't hold both kinds or no term tells them apart."""
    sample = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, limit)
    terms = learn_terms(sample)
    if terms is None:
        return None
    scanned = sample.select("y", _scan(docs.sparkSession, terms).alias("s")).select("y", "s.best", "s.several")
    seen = np.array(sorted(map(tuple, scanned.collect())), dtype=float)
    return Model(terms, tuple(_logistic(seen[:, 1:], seen[:, 0])))


def with_score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with a score in [0, 1] under a name that docs doesn't have."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    a, b, c = (F.lit(float(w)) for w in model.weights)
    (seen,) = work.free_names(docs, f"{name}_parts")
    margin = a + b * F.col(seen)["best"] + c * F.col(seen)["several"]
    return docs.withColumn(seen, _scan(docs.sparkSession, model.terms)).withColumn(name, 1 / (1 + F.exp(-margin))).drop(seen)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, stop (code points of the lower-cased text), score, expected: every significant toxic passage."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.terms)
    work.small_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner(shipped.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = scanner.segments(text or "")
                if not found:
                    continue
                spans = [m.span() for m in _token.finditer(text.lower())]
                for a, b, s in found:
                    e = K * n * math.exp(-scanner.terms.decay * s)
                    if e < SIGNIFICANT:
                        rows.append((doc, spans[a][0], spans[b][1], s, e))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "stop", "score", "expected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start int, stop int, score double, expected double")


def keep_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with docs' own columns."""
    model = learn(docs, labels)
    if model is None:
        return docs
    (name,) = work.free_names(docs, "score")
    return with_score(docs, model, name).filter(F.col(name) < threshold).select(*work.own_columns(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_score(ids, model).select(
        "doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
