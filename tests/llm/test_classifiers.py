import random
import zlib

import numpy as np
import pytest

from veilstone.llm import quality_fm, toxicity


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best segment, then left and right of it."""

    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            s = 0.0
            for b in range(a, hi):
                s += scores[b]
                if s > 1e-12 and (top is None or s > top[0] + 1e-12):
                    top = (s, a, b)
        return top

    def walk(lo, hi):
        t = best(lo, hi)
        return [] if t is None else [*walk(lo, t[1]), (t[1], t[2], t[0]), *walk(t[2] + 1, hi)]

    return walk(0, len(scores))


def test_maximal_segments():
    r = random.Random(1)
    for _ in range(400):
        n, other = r.randint(0, 14), -r.choice([0.3, 0.7, 1.1])
        hits = {i: r.choice([0.5, 1.3, 2.1]) + i * 1e-6 for i in range(n) if r.random() < 0.4}
        got = toxicity.maximal_segments(sorted(hits.items()), other)
        want = brute_segments([hits.get(i, other) for i in range(n)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").toPandas()
    return docs, toxicity.op6_toxicity(spark, d).toPandas().merge(labels, on="doc_id"), quality_fm.op10_quality(spark, d).toPandas().merge(labels, on="doc_id")


def test_held_out_accuracy(scored):
    _, toxic, quality = scored
    for told, label, mod, out in ((toxic, "toxic", 4, 2), (quality, "quality", 3, 1)):
        assert all((zlib.crc32(str(i).encode()) % mod == out) == h for i, h in zip(told.doc_id, told.held_out, strict=True))
        held = told[told.held_out]
        assert (held.predicted == held[label]).mean() > 0.9
        assert told.score.between(0, 1).all()


def test_passages(spark):
    words = [f"w{i}" for i in range(200)]
    terms = toxicity.Terms({"vile": 4.0, "foul": 4.0}, -0.05, 1.0)
    text = " ".join([*words[:50], "vile", "x", "foul", *words[50:150], "vile", *words[150:]])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean"), (None, "vile foul vile foul")], "doc_id long, text string")
    got = {(r.doc_id, text[r.start : r.stop] if r.doc_id else None) for r in toxicity.passages(docs, toxicity.Model(terms, (0, 1, 1))).collect()}
    assert (1, "vile x foul") in got and {d for d, _ in got} == {1, None}


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "text " * 50_000), (None, "x"), (4, "same"), (4, "same")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    for labels in (none, odd):
        assert toxicity.learn(docs, labels) is None
        assert toxicity.keep_rows(docs, labels).count() == 6
        assert quality_fm.learn(docs, labels) is None
    assert {r.score for r in quality_fm.score(docs, None).collect()} == {0.5}
    train = docs_of([(i, ("vile foul " if i % 2 else "kind fine ") + f"word{i % 7} " * (i % 5 + 3)) for i in range(1, 120)])
    labels = spark.createDataFrame([(i, (i + 1) % 2, i % 2) for i in range(1, 120)] + [(1, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(train, labels)
    kept = toxicity.keep_rows(docs.union(train), labels)
    assert kept.columns == docs.columns
    assert toxicity.with_score(docs, model, "own").count() == 6
    assert all("vile" not in (r.text or "") for r in kept.select("text").collect())
    machine = quality_fm.learn(train, labels)
    assert quality_fm.score(docs, machine).count() == 6
    assert quality_fm.score(docs_of([]), machine).count() == 0
    assert toxicity.with_score(docs_of([]), model, "own").count() == 0


def test_factorisation_identity():
    r = np.random.default_rng(2)
    m = quality_fm.Machine(0.1, r.normal(size=quality_fm.BUCKETS + quality_fm.STATISTICS), r.normal(size=(quality_fm.BUCKETS + quality_fm.STATISTICS, quality_fm.RANK)), np.zeros(quality_fm.STATISTICS), np.ones(quality_fm.STATISTICS))
    buckets, stats = [3, 17, 40], r.normal(size=quality_fm.STATISTICS)
    x = np.concatenate([np.full(3, 1 / np.sqrt(3)), m.scale(stats)])
    idx = np.concatenate([buckets, np.arange(quality_fm.BUCKETS, quality_fm.BUCKETS + quality_fm.STATISTICS)])
    want = m.bias + m.linear[idx] @ x + sum(m.factors[idx[a]] @ m.factors[idx[b]] * x[a] * x[b] for a in range(len(x)) for b in range(a))
    assert np.isclose(m.margin([buckets], stats[None, :])[0], want)
