import random

import numpy as np
import xxhash

from veilstone.llm import components, simhash_dedup as s


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_fingerprints():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50):
        t = " ".join(r.choice(["Ab", "c", "éÉ", "dd"]) for _ in range(n))
        assert s.fingerprint(t) & (2**64 - 1) == brute_fp(t)
    assert s.fingerprint(None) == 0


def test_links_against_brute_force(spark):
    """Random fingerprints around a few centres; a low cap sends the large keys to the midpoint search."""
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(60)} | {0}
    for c in [r.getrandbits(64) for _ in range(4)]:
        for _ in range(80):
            x = c
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    want = union_find(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    for cap in (64, 3):
        links = s.link(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, cap)
        got = dict(components.components(links).collect())
        assert {x: got.get(x, x) for x in signed} == want


def test_query(spark, docs_of):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (9, base), (3, base + " tail"), (4, None), (8, ""), (6, "a b"), (None, "A B"), (7, "unrelated words stand here alone"), (6, "a b")]
    docs = docs_of(rows)
    got = [(r.doc, r.fp & (2**64 - 1), r.component) for r in s.near_duplicates(docs).collect()]
    fp = {}
    for d, t, *_ in rows:
        fp[d if d is not None else s.work.NO_ID] = brute_fp(t)
    want = union_find(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert len(got) == len(rows)
    assert {(d, f) for d, f, _ in got} == set(fp.items())
    assert {(d, c) for d, _, c in got} == set(want.items())
    assert s.near_duplicates(docs_of([])).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(120)] + [(200, 201), (201, 202), (300, 300)]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(121), 0), 200: 200, 201: 200, 202: 200}


def test_similar_texts(spark, docs_of):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 300))]
        for _ in range(r.randint(1, 5)):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 12])):
                own[r.randrange(len(own))] = word()
            n += 1
            rows.append((n, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One two"), (None, "three"), (904, "one two")]
    docs = docs_of(rows)
    ids = [d if d is not None else s.work.NO_ID for d, _ in rows]
    sets = {i: frozenset(s.shingles(t, 5)) for i, (_, t) in zip(ids, rows, strict=True)}
    jac = lambda a, b: 1.0 if not sets[a] | sets[b] else len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = union_find(sorted(ids), lambda a, b: jac(a, b) >= 0.8)
    got = {x.doc: x.keep_doc for x in s.similar_groups(docs).collect()}
    assert set(got) == set(ids)
    assert got == want
    kept = s.keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id if x.doc_id is not None else s.work.NO_ID for x in kept.collect()) == sorted(set(got.values()))
    assert s.keep_rows(docs_of([])).count() == 0


def test_common_shingles_and_strangers(spark, docs_of, monkeypatch):
    """A template in every text, so that common keys stay open and strangers meet: every planted pair and no other is found, however little counts as common."""
    r = random.Random(12)
    word = lambda: f"t{r.getrandbits(40):x}"
    template, rows = [word() for _ in range(120)], []
    for n in range(150):
        own = [word() for _ in range(70)]
        rows.append((n, " ".join(template + own)))
        if n % 3 == 0:
            twin = list(own)
            for k in range(1 + n % 4):
                twin[10 + 12 * k] = word()
            rows.append((1_000 + n, " ".join(template + twin)))
    sets = {i: frozenset(s.shingles(t, 5)) for i, t in rows}
    want = union_find(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(set(want.values())) == 150
    for setting in ({}, {"MANY": 0, "BLOCK": 20, "OFTEN": 1}, {"OFTEN": 10**9}):
        for k, v in setting.items():
            monkeypatch.setattr(s.similar_texts, k, v)
        assert {x.doc: x.keep_doc for x in s.similar_groups(docs_of(rows)).collect()} == want


def edited(r, words, runs):
    """words with so many single words replaced by new ones, six or more apart."""
    own, step = list(words), len(words) // runs
    for k in range(runs):
        own[k * step + r.randrange(max(1, step - 5))] = f"n{r.getrandbits(48):x}"
    return " ".join(own)


def test_edits_of_one_base(spark, docs_of):
    """Each edit is similar to the base (0.82) and to no other edit (0.67): only the base holds them together."""
    r = random.Random(8)
    base = [f"b{r.getrandbits(40):x}" for _ in range(400)]
    rows = [(i, edited(r, base, 8)) for i in range(2_000)] + [(2_000, " ".join(base))]
    got = s.similar_groups(docs_of(rows, extra=False)).collect()
    assert len(got) == len(rows)
    assert {x.keep_doc for x in got} == {0}
