from collections import defaultdict

from veilstone.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left, open_ = left - sum(target[s] for s in over), open_ - over
    return target


ROWS = [(i, "w " * (i % 17), ["a", "b", None, "ü"][i % 4]) for i in range(400)] + [(400, None, "a"), (None, "x y", "a"), (7, "w " * 7, "ü"), (500, "big " * 3000, "b"), (501, "", "empty")]


def test_targets_and_copies(docs_of):
    rows = mixing.mix_report(docs_of(ROWS)).collect()
    assert len(rows) == len(ROWS)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(want[s] - target[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s)


def test_reruns_agree(docs_of):
    a, b = (sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix_report(docs_of(ROWS).repartition(n)).collect()) for n in (1, 7))
    assert a == b


def test_mix_emits_the_plan(docs_of):
    docs = docs_of(ROWS)
    report = mixing.mix_report(docs).collect()
    out = mixing.mix(docs).collect()
    assert len(out) == sum(r.copies for r in report)
    assert sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in report)


def test_empty_and_wordless(docs_of):
    assert mixing.mix_report(docs_of([])).count() == 0
    assert mixing.mix(docs_of([])).count() == 0
    assert {(r.target, r.taken) for r in mixing.mix_report(docs_of([(1, ""), (2, None)])).collect()} == {(0.0, 0)}
