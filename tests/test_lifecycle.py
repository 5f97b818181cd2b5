"""The whole way of a document: every layer, selection, file names, warnings, audit without values."""

from pyspark.sql import functions as F

from veilstone.operators import entities, fields, findings, masking, rules, spans
from veilstone.plans import lifecycle

UNITS = [
    (1, 0, "Name: Ada Lovelace\nmail ada@x.org"), (1, 1, "Ada Lovelace wrote to ADA@X.ORG about North Harbour"), (2, 0, "card 4111 1111 1111 1111 and 4111-1111-1111-1111"), (3, 0, "nothing at all"),
]


def scanned(spark, tokens=None):
    units = spark.createDataFrame(UNITS, "doc_id long, unit_ix int, text string")
    own = rules.normalize_rules(spark.createDataFrame([(0, "p", "North Harbour", "[PROJECT]", False)], "rule_ord int, rule_id string, find string, replacement string, exact boolean"))
    names = spark.createDataFrame([(2, -1, "10000000146 report")], "doc_id long, unit_ix int, text string")
    return lifecycle.scan(units, own, fields.label_table(spark), tokens, names)


def test_all_layers(spark):
    got = scanned(spark)
    masked = {(r.doc_id, r.unit_ix): r.masked for r in lifecycle.mask(got).collect()}
    assert masked[(1, 0)] == "Name: [PERSON_1]\nmail [EMAIL_1]"
    assert masked[(1, 1)] == "[PERSON_1] wrote to [EMAIL_1] about [PROJECT]"
    assert masked[(2, 0)] == "card [CARD_1] and [CARD_1]"
    assert masked[(2, -1)] == "[NATIONAL_ID_1] report"
    assert masked[(3, 0)] == "nothing at all"
    decisions = {r.doc_id: r.decision for r in lifecycle.decide(got, spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long")).collect()}
    assert decisions == {1: "mask", 2: "mask", 3: "clean"}


def test_selection_and_counts(spark):
    got = scanned(spark)
    chosen = got.findings.filter("category = 'email'").select("doc_id", "finding_id")
    masked = lifecycle.mask(got, chosen)
    texts = {(r.doc_id, r.unit_ix): r.masked for r in masked.collect()}
    assert texts[(1, 1)] == "Ada Lovelace wrote to [EMAIL_1] about North Harbour"
    assert [r.replaced for r in masking.counts(masked).collect()] == [2]
    assert findings.select_findings(got.findings, chosen).count() == 1


def test_a_failed_model_blocks(spark):
    tokens = spark.createDataFrame([(3, 0, 0, 0, None, None, None, None, None, "RuntimeError: no model")], "doc_id long, unit_ix int, chunk_ix int, tok_ix int, word string, tag string, score double, start int, end int, status string")
    got = scanned(spark, tokens)
    decisions = {r.doc_id: r.decision for r in lifecycle.decide(got, spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long")).collect()}
    assert decisions[3] == "block"


def test_audit_holds_no_values(spark):
    rows = [str(r) for r in lifecycle.audit(scanned(spark), "claude", "file").collect()]
    assert len(rows) == 2 and not any(v in r for r in rows for v in ("ada", "Ada", "4111", "Harbour"))


def test_results_do_not_depend_on_partitions(spark):
    units = spark.createDataFrame(UNITS, "doc_id long, unit_ix int, text string")
    a, b = (sorted(tuple(r) for r in lifecycle.mask(lifecycle.scan(units.repartition(n, F.rand(n)))).select("doc_id", "unit_ix", "masked").collect()) for n in (1, 9))
    assert a == b


STEPS = "doc_id long, unit_ix int, text string"
TOKENS = "doc_id long, unit_ix int, chunk_ix int, tok_ix int, word string, tag string, score double, start int, end int"


def found_in(spark, rows, **layers):
    units = spark.createDataFrame(rows, STEPS)
    return {(r.doc_id, r.category, r.value) for r in lifecycle.scan(units, **layers).findings.collect()}


def test_a_field_value_is_no_label_and_no_pattern_match(spark):
    labels = fields.label_table(spark)
    rows = [(1, 0, "Address: ada@x.org"), (2, 0, "Name"), (2, 1, "Surname"), (3, 0, "Address: 12 Long Street")]
    assert found_in(spark, rows, labels=labels) == {(1, "email", "ada@x.org"), (3, "location", "12 Long Street")}


def test_data_cells_are_not_read_as_labels(spark):
    labels = fields.label_table(spark)
    texts = ["Kind", "Town", "Name", "Note", "a1", "b2", "City", "Bern"]
    rows = [(1, i, t) for i, t in enumerate(texts)]
    cells = spark.createDataFrame([(1, i, "g", i // 4, i % 4, t) for i, t in enumerate(texts)], "doc_id long, unit_ix int, grid string, row int, column int, text string")
    assert (1, "location", "Bern") in found_in(spark, rows, labels=labels)
    assert (1, "location", "Bern") not in found_in(spark, rows, labels=labels, cells=cells)


def test_user_literals_are_a_layer(spark):
    own = rules.normalize_rules(spark.createDataFrame([(0, "l", "Blue Heron", "[LITERAL]", True)], "rule_ord int, rule_id string, find string, replacement string, exact boolean"))
    units = spark.createDataFrame([(1, 0, "the blue  heron flew")], STEPS)
    got = lifecycle.scan(units, literals=own)
    assert [r.layer for r in got.findings.collect()] == [findings.LAYERS["literals"]]
    assert lifecycle.mask(got).first().masked == "the [LITERAL] flew"


def test_entities_are_cleaned_and_code_and_addresses_left_out(spark):
    rows = [(1, 0, "met (Ada Lovelace) today"), (2, 0, "CREATE TABLE Ankara -- by Turing"), (3, 0, "Long Road 34710 Kadife"), (4, 0, "")]
    spots = [(1, "person", 4, 15), (2, "location", 13, 19), (2, "person", 26, 32), (3, "person", 0, 9)]
    tag = {"person": "B-PER", "location": "B-LOC"}
    tokens = [(d, 0, 0, i, rows[d - 1][2][a:b], tag[c], 0.99, a, b) for i, (d, c, a, b) in enumerate(spots)]
    got = found_in(spark, rows, tokens=spark.createDataFrame(tokens, TOKENS))
    assert got == {(1, "person", "Ada Lovelace"), (2, "person", "Turing")}


def test_settled_spans_are_the_cleaned_and_expanded_ones(spark):
    rows = [(1, 0, "«Grace Hopper», in [Alan"), (2, 0, "x" * 40 + " Ada" + "y" * 30), (3, 0, "élan (Zoë Wu)."), (4, 0, "...")]
    places = [(d, a, b) for d, _, t in rows for a in range(len(t)) for b in range(a + 1, min(len(t), a + 9) + 1)]
    found = spark.createDataFrame([(d, 0, "location", a, b, 0.9) for d, a, b in places], "doc_id long, unit_ix int, category string, start int, end int, score double")
    got = {(r.doc_id, r.start, r.end) for r in entities.settle(found, spark.createDataFrame(rows, STEPS)).collect()}
    texts = {d: t for d, _, t in rows}
    clean = [(d, *spans.clean_span(texts[d], a, b)) for d, a, b in places]
    grown = {(d, *spans.expand_span(texts[d], a, b)) for d, a, b in clean if b > a}
    assert got == {(d, a, b) for d, a, b in grown if b - a >= 2}
