"""Exact candidate search for texts that share most of their shingles: a prefix-filter join.

The distinct shingles of all texts stand in one order: the common ones last, by how common
they are, the others by their hash. Of n shingles, texts with a Jaccard similarity of s
share one among each other's first n - ceil(s n) + 1; under these keys texts meet. Any
order gives the same pairs, so how the common ones are told bears on the cost only: an
occurrence in ``RATE`` of every row's shingles is counted, and those counted ``OFTEN`` times
are common, up to ``MOST_COMMON`` of the commonest.

Under keys that aren't common few texts meet, so the rows of a key are sorted together,
every pair is looked at, and the keys that a pair shares are counted. Common keys never become rows of a shuffle at first: each text
meets one leader of each key, so that a large group becomes one component at a cost linear
in its size. Where several components still meet, every text is paired with every one of
another component, large keys cut into blocks. Sizes and places rule pairs out beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: They bear on the cost only: one of so many occurrences is counted, counts from which a shingle is common, most common ones.
RATE, OFTEN, MOST_COMMON = 16, 4, 1_000_000
#: Common keys of more texts than MANY go through leader rounds, the largest MOST_LED of them; keys of more than BLOCK texts are cut into blocks.
MANY, MOST_LED, BLOCK = 16, 100_000, 1_000
BROADCAST_ROWS = 500_000
#: Pairs looked at in one go.
AT_ONCE = 1 << 20
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of the runs of so many words, in order, repeats included; of all words where there are fewer. A-Z are lower-cased."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.zeros(len(found) - size + 1, np.uint64)
    for k in range(size):
        out = out * _ODD + single[k : k + len(out)]
    return _mixed(out)


def _places(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in sorted_keys, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return at, sorted_keys[at] == x


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int, int]:
    """Of a text's distinct shingles in hash order: the first in the common order that a similar text can't all lack, how many of these aren't common, how many of all aren't."""
    if not len(found):
        found = np.zeros(1, np.int64)  # texts without words meet under one key
    at, there = _places(common, found)
    long = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    own = int(len(found) - there.sum())
    if own >= long:
        return found[~there][:long], long, own
    rest, often = found[there], counts[at[there]]
    return np.concatenate([found[~there], rest[np.lexsort((rest, often))][: long - own]]), own, own


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles of texts(key long, text), in order, and how often each was counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = batch.column(0).to_numpy().astype(np.uint64)
            taken = [np.zeros(0, np.uint64)]
            for salt, text in zip(salts, batch.column(1).to_pylist(), strict=True):
                found = np.unique(shingle_hashes(text, words))
                taken.append(found[_mixed((found ^ salt) * _ODD) % np.uint64(RATE) == 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(taken).view(np.int64))], names=["x"])

    held = texts.mapInArrow(run, "x long").groupBy("x").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= OFTEN)
    told = held.orderBy(F.desc("c"), "x").limit(MOST_COMMON).toArrow()
    x, c = (told.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(x)
    return x[order], c[order]


def cold_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """u > v: pairs of nodes(node, label, n, cold, p) of different labels that meet under as many keys that aren't common as similar texts must; written.

    Of what two texts share, all up to the nearer end of their keys here is under such keys,
    so at most what one of them has beyond its own keys isn't counted.
    """
    spark, share = nodes.sparkSession, similarity / (1 + similarity)

    def pairs_of(key, node, label, n, rest):
        """All rows in order of their keys with all others of the same key, and how many keys both must meet under."""
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        long = np.diff(np.append(edge, len(key)))
        for size in np.unique(long[long > 1]):
            starts = edge[long == size]
            for later in range(1, size):
                for cut in range(0, len(starts), max(1, AT_ONCE // (size - later))):
                    i = (starts[cut : cut + max(1, AT_ONCE // (size - later)), None] + np.arange(size - later)).reshape(-1)
                    j = i + later
                    fit = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                    i, j = i[fit], j[fit]
                    if len(i):
                        need = np.ceil(share * (n[i] + n[j]) - 1e-9).astype(np.int64) - np.maximum(rest[i], rest[j])
                        yield np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on in the next batch
            for met in pairs_of(*(x[:last] for x in held)) if last else ():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in met], names=["u", "v", "need"])
            held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            for met in pairs_of(*held):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in met], names=["u", "v", "need"])

    rows = nodes.select(F.explode(F.slice("p", F.lit(1), F.col("cold"))).alias("key"), "node", "label", "n", (F.col("n") - F.col("cold")).alias("rest"))
    rows = rows.repartition("key").sortWithinPartitions("key")
    with work.batch_rows(spark, work.NUMBER_ROWS):
        met = rows.mapInArrow(run, "u long, v long, need long").groupBy("u", "v", "need").agg(F.count(F.lit(1)).alias("k"))
        return work.written(met.filter("k >= need").select("u", "v"), "cold-pairs")


def _flat(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))


def common_nodes(nodes: DataFrame) -> DataFrame:
    """node, n, own, cold, p for nodes with common keys; p has only these; written."""
    held = nodes.filter(F.size("p") > F.col("cold"))
    return work.written(held.select("node", "n", "own", "cold", F.slice("p", F.col("cold") + 1, F.size("p") - F.col("cold")).alias("p")), "common-nodes")


def led_pairs(nodes: DataFrame, keys: np.ndarray, turn: int, similarity: float) -> DataFrame:
    """u > v: each of nodes(node, n, own, label, p) with the leaders of those of its keys that are among the given (in order), where they are of another label; written."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            node, n, own, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            key, row = _flat(batch, 4)
            here = _places(keys, key)[1]
            first = own if not turn else (_mixed(node.astype(np.uint64) + np.uint64(turn) * _ODD) >> np.uint64(1)).astype(np.int64)  # from the second turn on, by lot
            key, row = key[here], row[here]
            order = np.lexsort((node[row], first[row], key))
            key, row = key[order], row[order]
            for i in np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else ():
                mine = (int(first[row[i]]), int(node[row[i]]), int(n[row[i]]), int(label[row[i]]))
                k = int(key[i])
                if k not in best or mine < best[k]:
                    best[k] = mine
        rows = [(k, *x) for k, x in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["key", "first", "node", "n", "label"])

    shape = nodes.select("node", F.col("n").cast("long"), F.col("own").cast("long"), "label", "p")
    told = shape.mapInArrow(firsts, "key long, first long, node long, n long, label long").groupBy("key").agg(F.min(F.struct("first", "node", "n", "label")).alias("o"))
    told = told.select("key", "o.node", "o.n", "o.label").toArrow()
    led, lead, size, group = (told.column(i).to_numpy().astype(np.int64) for i in range(4))
    order = np.argsort(led)
    led, lead, size, group = led[order], lead[order], size[order], group[order]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, _, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            key, row = _flat(batch, 4)
            at, there = _places(led, key)
            at, row = at[there], row[there]
            fit = (group[at] != label[row]) & (np.minimum(size[at], n[row]) >= similarity * np.maximum(size[at], n[row]) - 1e-9) if len(at) else np.zeros(0, bool)
            pairs = np.unique(np.column_stack([node[row[fit]], lead[at[fit]]]), axis=0) if fit.any() else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    met = shape.mapInArrow(meet, "u long, v long")
    return work.written(met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "led-pairs")


def open_keys(nodes: DataFrame) -> DataFrame:
    """key, c: keys of nodes(label, p) under which several labels meet, and how many nodes; written."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            key, row = _flat(batch, 1)
            order = np.argsort(key, kind="stable")
            key, label = key[order], label[row[order]]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            c = np.diff(np.append(at, len(key)))
            lo, hi = (f.reduceat(label, at) if len(at) else label[:0] for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(c.astype(np.int64)), pa.array(lo), pa.array(hi)], names=["key", "c", "lo", "hi"])

    told = nodes.select("label", "p").mapInArrow(sums, "key long, c long, lo long, hi long")
    told = told.groupBy("key").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return work.written(told.filter("lo <> hi").select("key", "c"), "open-keys")


def large_keys(keys: DataFrame) -> np.ndarray:
    """The largest open keys, in order."""
    many = keys.filter(F.col("c") > MANY).orderBy(F.desc("c"), "key").limit(MOST_LED).select("key").toArrow()
    return np.sort(many.column(0).to_numpy().astype(np.int64))


def open_pairs(nodes: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """u > v: all pairs of nodes(node, n, label, cold, p) of different labels that meet under open keys and can be similar; written."""
    rows = nodes.select("node", "n", "label", "cold", F.posexplode("p").alias("k", "key")).join(work.broadcast_if(keys, BROADCAST_ROWS), "key")
    rows = work.written(rows.withColumn("at", F.col("cold") + F.col("k")).drop("cold", "k"), "open-rows")
    # the largest component of a key needs no look within itself
    most = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    most = work.written(most.groupBy("key").agg(F.max(F.struct("k", "label")).alias("most"), F.min("least").alias("least")).select("key", F.col("most.label").alias("most"), "least"), "key-components")
    share = similarity / (1 + similarity)  # of both sizes together, what similar texts have in common at least
    rows = rows.join(work.broadcast_if(most, BROADCAST_ROWS), "key").filter(F.col("n") - F.col("at") >= share * (F.col("n") + F.col("least")) - 1e-9)
    blocks = F.ceil(F.col("c") / BLOCK).cast("long")
    mine, every = F.pmod("node", blocks), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    left = rows.filter("label <> most").select("key", mine.alias("a"), every.alias("b"), *[F.col(x).alias(f"{x}_u") for x in ("node", "n", "at", "label")])
    right = rows.select("key", every.alias("a"), mine.alias("b"), "most", *[F.col(x).alias(f"{x}_v") for x in ("node", "n", "at", "label")])
    met = left.join(right, ["key", "a", "b"]).filter("label_u <> label_v and (label_v = most or node_u < node_v)")
    met = met.filter(F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v")) >= share * (F.col("n_u") + F.col("n_v")) - 1e-9)
    met = met.filter(F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v") - 1e-9)
    return work.written(met.select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v")).distinct(), "open-pairs")
