"""Quality by a factorisation machine.

Inputs: hashed distinct words (each 1 / sqrt of their number) and statistics of the
text's structure, standardised. The machine adds a bias, a weight for each input and,
for each pair of inputs, the inner product of their ``RANK`` factors; the pairs are
summed in linear time as half of (square of sums - sum of squares) over the factors.
It is fitted with Adam on a bounded labelled sample on the driver.

Neither labels nor lang, source or doc_id enter a score. Defined results: a null text
counts as empty and gets a score like any text; repeated rows are scored alike; a null
doc_id stays null and isn't held out; without labels of both kinds every text scores
0.5; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .labelled import labelled_sample, remainder

MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.5
#: Rows that the machine is fitted on, at most.
LIMIT = 6_000
BUCKETS, RANK = 1 << 14, 8
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
CACHE = 500_000
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def structure(text: str, words: list[str], distinct: int) -> list[float]:
    """Statistics that don't depend on which words the text has."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256).astype(float)
    size, n = max(1.0, raw.sum()), max(1, len(words))
    letters = max(1.0, raw[_LETTER].sum())
    lines = text.split("\n")
    marks = size - raw[_LETTER].sum() - raw[_DIGIT].sum() - raw[_SPACE].sum()
    return [
        np.log1p(len(words)),
        np.log1p(n / len(lines)),
        len(text) / n,
        distinct / n,
        np.log1p(n) * (1 - distinct / n),
        sum(map(eq, words, words[1:])) / n,
        raw[_UPPER].sum() / letters,
        raw[_DIGIT].sum() / size,
        marks / size,
        marks / n,
        (raw[33] + raw[63]) / n,
        raw[124] / n,
        (raw[44] + raw[46]) / n,
        1 - len(set(lines)) / len(lines),
        float(len(words) == 0),
    ]


STATISTICS = len(structure("", [], 0))


class Inputs:
    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = found
        return found

    def of(self, text: str) -> tuple[list[int], list[float]]:
        """Buckets of the distinct words; statistics."""
        words = text.split()
        distinct = set(words)
        known = self.known
        buckets = [b if (b := known.get(w)) is not None else self.bucket(w) for w in distinct]
        return buckets, structure(text, words, len(distinct))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # BUCKETS + STATISTICS
    factors: np.ndarray  # (BUCKETS + STATISTICS, RANK)
    mean: np.ndarray
    spread: np.ndarray

    def scale(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.spread, -3, 3) / np.sqrt(STATISTICS)

    def margin(self, buckets: list[list[int]], statistics: np.ndarray) -> np.ndarray:
        dense = self.scale(statistics)
        sizes = np.array([len(b) for b in buckets])
        flat = np.fromiter((x for b in buckets for x in b), np.int64, sizes.sum())
        value = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
        rows = np.repeat(np.arange(len(buckets)), sizes)
        v, d = self.factors[flat] * value[:, None], self.factors[BUCKETS:]
        sums = np.stack([np.bincount(rows, v[:, f], len(buckets)) for f in range(RANK)], 1) + dense @ d
        squares = np.bincount(rows, (v * v).sum(1), len(buckets)) + (dense**2) @ (d * d).sum(1)
        linear = np.bincount(rows, self.linear[flat] * value, len(buckets)) + dense @ self.linear[BUCKETS:]
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)


def fit(buckets: list[np.ndarray], statistics: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)), statistics.mean(0), statistics.std(0) + 1e-6)
    dense = m.scale(statistics)
    state = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in (("linear", m.linear), ("factors", m.factors), ("bias", np.zeros(1)))}
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            own = [np.concatenate([buckets[i], np.arange(BUCKETS, size)]) for i in rows]
            val = [np.concatenate([np.full(len(buckets[i]), 1 / np.sqrt(max(1, len(buckets[i])))), dense[i]]) for i in rows]
            lens = np.array([len(o) for o in own])
            idx, x = np.concatenate(own), np.concatenate(val)
            row = np.repeat(np.arange(len(rows)), lens)
            v = m.factors[idx] * x[:, None]
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            sums = np.add.reduceat(v, starts, 0)
            out = m.bias + np.bincount(row, m.linear[idx] * x, len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (v * v).sum(1), len(rows)))
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]) / len(rows)
            used, back = np.unique(idx, return_inverse=True)
            gl = np.bincount(back, g[row] * x, len(used)) + DECAY * m.linear[used]
            each = (g[row] * x)[:, None] * (sums[row] - v)
            gf = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(RANK)], 1) + DECAY * m.factors[used]
            t += 1
            for key, part, grad, target in (("linear", used, gl, m.linear), ("factors", used, gf, m.factors)):
                first, second = state[key]
                first[part] = 0.9 * first[part] + 0.1 * grad
                second[part] = 0.99 * second[part] + 0.01 * grad * grad
                target[part] -= RATE * (first[part] / (1 - 0.9**t)) / (np.sqrt(second[part] / (1 - 0.99**t)) + 1e-8)
            first, second = state["bias"]
            first[:] = 0.9 * first + 0.1 * g.sum()
            second[:] = 0.99 * second + 0.01 * g.sum() ** 2
            m.bias -= float(RATE * (first[0] / (1 - 0.9**t)) / (np.sqrt(second[0] / (1 - 0.99**t)) + 1e-8))
    return m


def learn(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Machine | None:
    """None where the labels don't hold both kinds."""
    work.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = Inputs()
        for batch in batches:
            found = [inputs.of(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(set(b)) for b, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64())), batch.column(1)], names=["buckets", "statistics", "y"]
            )

    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, limit)
    rows = sample.mapInArrow(run, "buckets array<int>, statistics array<double>, y int").toArrow()  # at most ``limit`` rows of at most BUCKETS ints
    y = np.array(rows["y"].to_pylist(), float)
    if len(np.unique(y)) < 2:
        return None
    buckets = [np.asarray(b.values) for b in rows["buckets"]]
    statistics = np.array(rows["statistics"].to_pylist())
    order = sorted(range(len(y)), key=lambda i: (y[i], tuple(statistics[i]), buckets[i].tobytes()))  # rows come in any order
    return fit([buckets[i] for i in order], statistics[order], y[order])


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if machine is None:
        return ids.select("doc_id", F.lit(0.5).alias("score"))
    work.small_batches(spark)
    shipped = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, machine = Inputs(), shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [inputs.of(t or "") for t in batch.column(1).to_pylist()]
            margin = machine.margin([list(set(b)) for b, _ in found], np.array([s for _, s in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["doc_id", "score"])

    return ids.mapInArrow(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select(
        "doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
