"""The pipeline on a small corpus, each stage against what it must do by itself."""

import random

import corpus_pipeline
import pytest
from veilstone.llm import simhash_dedup, work

from .test_decontamination import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda n=5: "".join(r.choice("abcdefghij") for _ in range(n))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        t = text(r.randint(40, 160))
        if i % 10 == 0:
            t = t.split()
            for _ in range(5):
                t.insert(r.randrange(len(t)), r.choice(["vile", "foul", "nasty"]))
            t = " ".join(t)
        docs.append((i, t))
        if i < 280:
            labels.append((i, 1, int(i % 10 == 0)))
    docs += [(1000 + i, docs[i][1]) for i in range(1, 40, 3)]  # exact copies
    for i in range(2, 60, 7):  # near copies
        w = docs[i][1].split()
        w[len(w) // 2] = word()
        docs.append((2000 + i, " ".join(w)))
    docs += [(3000 + i, text(20) + " " + items[i][1] + " " + text(20)) for i in range(5)]
    docs += [(4000, None), (4001, "")]
    at = tmp_path_factory.mktemp("corpus")
    rows = [(d, t, "en", ["a", "b", None][d % 3], len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict(docs), items


def test_stages(spark, corpus):
    at, texts, items = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, before = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES:
        docs = work.written(stage(spark, docs, at), f"test-{name}")
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        if name != "mixing":
            assert docs.columns == columns and len(rows) == len(now)
        gone = before - now
        if name == "toxicity":
            assert gone == {d for d in texts if "vile" in (texts[d] or "") or "foul" in (texts[d] or "") or "nasty" in (texts[d] or "")}
        elif name == "exact_dedup":
            last = {}
            for d in sorted(before):
                last[texts[d] or ""] = d
            assert now == set(last.values())
        elif name == "simhash_near_dedup":
            sets = {d: frozenset(simhash_dedup.shingles(texts[d], 5)) for d in before}
            alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            assert gone and all(any(x != d and alike(d, x) for x in before) for d in gone)
            assert not [(a, b) for a in now for b in now if a < b and alike(a, b)]
        elif name == "benchmark_decontamination":
            assert gone == set(brute([(d, texts[d]) for d in before], items))
        else:
            words = lambda d: len((texts[d] or "").split())
            assert abs(sum(words(r.doc_id) for r in rows) - 1.5 * sum(map(words, before))) < 500
        before = now


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
