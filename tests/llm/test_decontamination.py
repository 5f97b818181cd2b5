import random
import re
from collections import Counter

from veilstone.llm import decontamination as d


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, similarity=0.8):
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, t in items:
            i = words(t)
            if not i:
                continue
            k = min(5, len(i))
            own = Counter(tuple(i[x : x + k]) for x in range(len(i) - k + 1))
            s = [tuple(w[x : x + k]) for x in range(len(w) - k + 1)]
            m = len(i) - k + 1
            for at in range(len(s) - m + 1):
                o = sum((Counter(s[at : at + m]) & own).values())
                if o / (2 * m - o) >= similarity:
                    out.setdefault(doc, set()).add(item)
                    break
    return out


def make(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 45)))) for i in range(12)] + [(50, "one two three"), (51, ""), (52, None), (53, "lorem " * 30)]
    docs = []
    for n in range(60):
        text = [word() for _ in range(r.randint(0, 80))]
        if n % 2:
            inner = words(items[r.randrange(12)][1])
            for _ in range(r.randint(0, 3)):
                k = r.randrange(3)
                at = r.randrange(len(inner))
                inner[at : at + (k != 1)] = [] if k == 2 else [word()]
            at = r.randint(0, len(text))
            text[at:at] = inner
        docs.append((n, r.choice([" ", ", ", "\n"]).join(x.upper() if n % 5 == 0 else x for x in text)))
    docs += [(100, items[3][1] + " " + items[5][1]), (101, None), (102, ""), (103, "x One, two; THREE y"), (104, "lorem " * 200), (105, items[0][1]), (106, items[0][1])]
    return docs, items


def test_against_brute_force(spark, docs_of):
    rows, items = make()
    docs = docs_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    got = d.contaminated(docs, bench).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: set(r["items"]) for r in got if r.contaminated} == want
    kept = d.keep_rows(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x for x, _ in rows} - set(want))


def test_nulls_repeats_and_empty(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    got = d.contaminated(docs_of([(None, item), (7, item), (7, item), (8, "no")]), bench).collect()
    assert sorted((r.doc_id or 0, r.contaminated) for r in got) == [(0, True), (7, True), (7, True), (8, False)]
    assert d.contaminated(docs_of([]), bench).count() == 0
    assert not d.contaminated(docs_of([(1, item)]), bench.limit(0)).first().contaminated
    assert d.keep_rows(docs_of([(1, item)]), bench.limit(0)).count() == 1


def test_documents_shorter_than_the_item(spark, docs_of):
    """An item without its last words: the whole text is the window."""
    item = [f"w{i}" for i in range(38)]
    small = [f"s{i}" for i in range(9)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(small))], "item_id long, text string")
    rows = [(n, " ".join(item[: 38 - n])) for n in range(1, 9)] + [(20, " ".join(item[3:])), (21, " ".join(small[1:])), (22, " ".join(small[2:])), (23, "w0 w1 w2")]
    got = {r.doc_id: r.similarity for r in d.contaminated(docs_of(rows), bench).collect() if r.contaminated}
    want = {n: (34 - n) / 34 for n in range(1, 7)} | {20: 31 / 34, 21: 4 / 5}  # 27/34 is below
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_common_passage_long_text_and_ties(spark, docs_of):
    """A passage in a third of the rows, copies, 20,000 words, items that are the same but for their ids."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(40)]
    items = [(1, " ".join(item)), (2, " ".join(item)), (3, " ".join([*item[:39], word()])), (None, " ".join(word() for _ in range(8)))]
    rows = []
    for n in range(240):
        text = [word() for _ in range(r.randint(30, 60))]
        if n % 3 == 0:
            text[10:10] = item
        rows.append((n, " ".join(text)))
    rows += [(500 + n, rows[0][1]) for n in range(60)]
    rows += [(600, " ".join([*(word() for _ in range(20_000)), *item])), (601, " ".join(word() for _ in range(20_000))), (602, "Z" * 300_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in d.contaminated(docs_of(rows), bench).collect()}
    assert len(got) == len(rows)
    assert {k for k, x in got.items() if x.contaminated} == {n for n in range(0, 240, 3)} | set(range(500, 560)) | {600}
    assert all(x["items"] == [1, 2, 3] and x.similarity == 1.0 for x in got.values() if x.contaminated)
    starts = {x.start for x in d.leaks(docs_of(rows), bench).collect() if x.item_id == 1}
    assert starts == {10, 20_000}


def test_short_items_near_the_radius(spark, docs_of):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(6 + i % 7))) for i in range(30)]
    docs = []
    for n in range(120):
        inner = words(items[n % 30][1])
        for _ in range(n // 30):
            inner[r.choice([0, -1])] = word()
        docs.append((n, " ".join([*(word() for _ in range(5)), *inner, *(word() for _ in range(5))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: set(x["items"]) for x in d.contaminated(docs_of(docs), bench).collect() if x.contaminated}
    assert got == brute(docs, items)


def test_index_discards_what_chance_would_fetch(spark):
    """2,000 items of one length: the index fetches a small multiple of the pairs that are within the radius."""
    from pyspark.sql import functions as F

    r = random.Random(11)
    items = [(i, " ".join(f"x{r.getrandbits(30):x}" for _ in range(24))) for i in range(2_000)]
    held = d.items_of(spark.createDataFrame(items, "item_id long, text string"))
    windows = held.filter("item_id % 20 = 0").select(F.col("item_id").alias("w1"), F.lit(0).alias("w2"), "family", "m", "h")
    got = d.fetched(windows, held, d.RADIUS)
    assert got.count() == 8 * 100  # each window's own item, once for each block; chance pairs would be over 200,000
    assert held.select("family").distinct().count() == 2_000
