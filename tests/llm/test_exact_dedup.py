import hashlib

import pytest

from veilstone.llm import exact_dedup, work

ROWS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b"), (5, "b"), (None, "a"), (None, "solo"), (6, "x" * 200_000), (7, "x" * 200_000), (8, "A")]


def test_groups(docs_of):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs_of(ROWS)).collect()}
    assert got == {
        (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True),
        (None, None, 1, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True),
    }


def test_digest_is_of_the_text(docs_of):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_duplicates(docs_of([(1, "é"), (2, None)])).collect()}
    assert got == {1: hashlib.sha256("é".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_keep_rows_keeps_one_of_each(docs_of):
    docs = docs_of(ROWS)
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), len(r.text or "")) for r in kept.collect()) == [(0, 4), (2, 1), (4, 0), (5, 1), (7, 200_000), (8, 1)]


def test_empty(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).count() == 0
    assert exact_dedup.keep_rows(docs_of([])).count() == 0


def test_index_persists(spark, docs_of, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    exact_dedup.ingest(docs_of([(1, "a"), (2, "b")]), index)
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    batch = exact_dedup.digests_of(docs_of([(9, "a"), (10, "c")]))
    assert [r.keep_id for r in again.new_groups(batch).collect()] == [10]
    exact_dedup.ingest(docs_of([(9, "a"), (10, "c")]), again)
    assert again.rows().count() == 3
    plan = again.new_groups(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_index_keeps_its_number_of_buckets(spark, docs_of, tmp_path):
    """Opened with 4, 16 and 4 buckets, out of the catalogue in between: every known text is found."""
    path, texts = str(tmp_path / "index"), [(i, f"text {i}") for i in range(200)]
    batch = exact_dedup.digests_of(docs_of(texts))
    for n, wanted in enumerate((4, 16, 4)):
        index = exact_dedup.DigestIndex(spark, path, wanted)
        assert index.buckets == 4
        assert index.new_groups(batch).count() == (0 if n else 200)
        exact_dedup.ingest(docs_of([*texts, (1_000 + n, f"more {n}")]), index)
        assert index.rows().count() == 201 + n
        index.forget()
    next((tmp_path / "index").glob("_buckets-*")).unlink()
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 4)


def test_shared_folder_is_the_sessions(spark):
    told = spark.conf.get("spark.checkpoint.dir", None)
    assert work.shared_dir(spark) == (told.rstrip("/") if told else work._local)
