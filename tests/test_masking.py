"""Properties of resolution and masking, and single operators at their edges."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilstone.functions import folding, validators
from veilstone.operators import findings, masking, patterns, rules

spans = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20), st.integers(0, 2), st.integers(0, 9)), max_size=12)


@settings(max_examples=400, deadline=None)
@given(spans)
def test_resolved_spans_are_disjoint_and_cover(held):
    candidates = [masking.Candidate(a, a + n, p, k, str(i), f"[{i}]") for i, (a, n, p, k) in enumerate(held)]
    out = masking.resolve(candidates)
    assert all(x.end <= y.start for x, y in zip(out, out[1:], strict=False))
    covered = {i for s in out for i in range(s.start, s.end)}
    assert covered == {i for c in candidates for i in range(c.start, c.end)}
    shuffled = list(candidates)
    random.Random(1).shuffle(shuffled)
    assert masking.resolve(shuffled) == out


def test_many_candidates_are_quick():
    masking.resolve([masking.Candidate(i, i + 6, 1, 0, "f", "[X]") for i in range(0, 300_000, 3)])


UNITS = [
    (1, 0, "Mail a@x.org and A@X.org, card 4111 1111 1111 1111."), (1, 1, "Again a@x.org; iban TR33 0006 1005 1978 6457 8413 26"), (2, 0, "id 10000000146 phone +90 212 555 12 34"), (3, 0, "nothing"), (4, 0, None), (5, 0, ""), (6, 0, "a​@x.org​ tail"),
]


def found(spark):
    units = spark.createDataFrame(UNITS, "doc_id long, unit_ix int, text string")
    return units, findings.number_placeholders(findings.merge_layers(findings.aggregate_findings(patterns.detect(units))))


def test_masking_end_to_end(spark):
    units, numbered = found(spark)
    masked = {(r.doc_id, r.unit_ix): r.masked for r in masking.mask(units, numbered).collect()}
    assert masked[(1, 0)] == "Mail [EMAIL_1] and [EMAIL_1], card [CARD_1]."
    assert masked[(1, 1)] == "Again [EMAIL_1]; iban [IBAN_1]"
    assert masked[(2, 0)] == "id [NATIONAL_ID_1] phone [PHONE_1]"
    assert masked[(3, 0)] == "nothing" and masked[(4, 0)] is None and masked[(5, 0)] == ""
    assert masked[(6, 0)] == "[EMAIL_1] tail"


def test_a_card_stands_beside_other_numbers():
    card, other = "4111111111111111", "4366089147969128"
    at = lambda text: [(c, raw) for c, _, _, raw, _ in patterns.detect_text(text)]
    assert at(f"{card} 53.121.55.90") == [("card", card)]  # eighteen digits that fail
    assert at(f"38.211.12.42 {other} x") == [("card", other)]  # eighteen digits that pass
    assert at("4495589438270767 42.73.240.87") == [("card", "4495589438270767")]
    assert at(f"{card} {other}-{card}") == [("card", card), ("card", other), ("card", card)]
    assert at("4111 1111 1111 1111 53 and 3782-822463-10005 7") == [("card", "4111 1111 1111 1111"), ("card", "3782-822463-10005")]
    assert at("12 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]
    assert at("4111111111111112 53.121") == []


CARD_TEXTS = ["4111111111111111 53.121", "1.42 4366089147969128", "4495589438270767 42.7", "4111 1111 1111 1111", "4111111111111111\u200b 4111111111111111", None, "", "plain"]


def same_as_sql(spark, path, texts, name):
    """The query's rows, which are those of its SQL."""
    import duckdb

    from veilstone.plans import catalogue

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(path))
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
    return got


def test_card_query_counts_runs_as_its_sql(spark, tmp_path):
    """Cards between other numbers, with gaps, with a format character behind and in an e-mail name."""
    assert len(same_as_sql(spark, tmp_path, [*CARD_TEXTS, "4111111111111111@x.org"], "q_card_valid")) == 5


def test_decisions_count_cards_as_their_sql(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, [*CARD_TEXTS, CARD_TEXTS[0]], "q_document_decisions") == [("clean", 4, 0), ("mask", 5, 5)]


def test_document_scan_finds_cards_as_its_sql(spark, tmp_path):
    assert len(same_as_sql(spark, tmp_path, CARD_TEXTS, "q_document_scan")) == 4


def test_without_selection_nothing_changes(spark):
    units, numbered = found(spark)
    masked = masking.mask(units, numbered.limit(0)).collect()
    assert {(r.doc_id, r.unit_ix): r.masked for r in masked} == {(d, u): t for d, u, t in UNITS}


def test_no_selected_value_is_left_and_counts_agree(spark):
    units, numbered = found(spark)
    masked = masking.mask(units, numbered)
    assert masking.residual(masked, numbered).count() == 0
    labels = sum((r.masked or "").count("[") for r in masked.collect())
    assert labels == masking.counts(masked).agg(F.sum("replaced")).first()[0]


def test_entity_and_literal_variants(spark):
    units = spark.createDataFrame([(1, 0, "ADA met Işıl; Adam and isil")], "doc_id long, unit_ix int, text string")
    cols = "doc_id long, layer int, category string, normalized string, variants array<string>, finding_id string, placeholder string"
    told = spark.createDataFrame([(1, 5, "person", "ada", ["Ada"], "f1", "[PERSON_1]"), (1, 6, "custom", "isil", ["ışıl"], "f2", "[X]")], cols)
    assert masking.mask(units, told).first().masked == "[PERSON_1] met [X]; Adam and [X]"


def test_variants_meet_by_their_first_word(spark):
    """Format characters inside a word, variants of several words, and a variant without any word."""
    units = spark.createDataFrame([(1, 0, "A\u200bda Love-lace & co"), (1, 1, "Lovelace alone, ada"), (1, 2, "*** stars"), (2, 0, "ada of another document")], "doc_id long, unit_ix int, text string")
    cols = "doc_id long, layer int, category string, normalized string, variants array<string>, finding_id string, placeholder string"
    told = spark.createDataFrame([(1, 5, "person", "ada", ["Ada"], "f1", "[P]"), (1, 5, "person", "love lace", ["love lace & CO"], "f2", "[Q]"), (1, 6, "custom", "***", ["***"], "f3", "[S]")], cols)
    got = {(r.doc_id, r.unit_ix): r.masked for r in masking.mask(units, told).collect()}
    assert got == {(1, 0): "[P] [Q]", (1, 1): "Lovelace alone, [P]", (1, 2): "[S] stars", (2, 0): "ada of another document"}


def test_overlapping_occurrence_after_a_failed_guard():
    text = "xana ana ana"
    folded, where = folding.fold_text(text)
    assert list(folding.occurrences(text, folded, where, "ana ana")) == [(5, 12)]


def test_fold_agrees_with_its_column_form(spark):
    texts = ["Işıl  ÇAĞRI", "a_b.c-d", "", "x – y", "İstanbul", "tab\tend ", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folding.fold(F.col("t")).alias("f"))
    assert all(folding.fold_text(r.t)[0] == r.f for r in df.collect())


def test_rejected_candidates_resume():
    assert [m[0] for m in patterns.detect_text("14111111111111111")] == []
    assert patterns.detect_text("x 4111 1111 1111 1112 4111111111111111")[0][3] == "4111111111111111"
    assert patterns.detect_text("12345678901234567890123456789 a@b.org", ["card"]) == []
    assert [m[1] for m in patterns.detect_text("4465758382889437 4465758382889437")] == [0, 17]
    assert patterns.detect_text("4111x1111x1111x1111") == [] and len(patterns.detect_text("4111\u20131111\u00a01111\u20091111")) == 1


def test_word_places(spark):
    rows = [(1, 0, "Ab, c-d\n é1  x"), (2, 0, ""), (3, 0, None), (4, 0, "\x01a\x02b"), (5, 0, "one")]
    units = spark.createDataFrame(rows, "doc_id long, unit_ix int, text string")
    got = sorted((r.doc_id, r.word_ix, r.start, r.raw) for r in rules.unit_words(units).collect())
    assert got == [(d, i, m.start(), m.group()) for d, _, t in rows for i, m in enumerate(re.finditer(r"[^\W_]+", t or ""))]


def test_deletion_variants(spark):
    df = spark.range(1).select(folding.deletion_variants(F.lit("abcd"), 2).alias("v")).first().v
    assert set(df) == {"abcd", "bcd", "acd", "abd", "abc", "cd", "bd", "bc", "ad", "ac", "ab"}


def test_validators_agree_with_plain_forms(spark):
    r = random.Random(2)
    ids = ["".join(r.choice("0123456789") for _ in range(11)) for _ in range(300)] + ["10000000146"]
    df = spark.createDataFrame([(i,) for i in ids], "x string").select("x", validators.national_id_valid(F.col("x")).alias("a"), validators.card_valid(F.col("x")).alias("c"))
    assert all(patterns.national_id(x.x) == x.a for x in df.collect())


def test_pasted_values_are_found():
    found = lambda text: [(c, text[a:b]) for c, a, b, _, _ in patterns.detect_text(text)]
    assert found("'ada@x.org' or ada@x.org") == [("email", "ada@x.org")] * 2
    spaced = "TR33\u00a00006\u00a01005\u202f1978\u00a06457\u00a08413\u00a026"
    assert found(f"iban {spaced}, {spaced.lower()}") == [("iban", spaced), ("iban", spaced.lower())]
    assert {patterns.normal_form("iban", x) for x in (spaced, spaced.lower())} == {"TR330006100519786457841326"}
    for area in ("510", "516", "570", "575", "800"):
        assert found(f"call 0 {area} 555 12 34") == [("phone", f"0 {area} 555 12 34")]
    assert found("call 0 520 555 12 34") == []
