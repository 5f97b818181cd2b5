"""Small tables for what the driver's tables don't hold, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "ids": ("kind string, value string", [
        ("national_id", "10000000146"), ("national_id", "10000000147"), ("national_id", "11111111111"), ("national_id", "01000000146"), ("national_id", "1000000014"), ("national_id", ""),
        ("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1112"), ("card", "0000000000000000"), ("card", "5500000000000004"), ("card", "378282246310005"), ("card", "123"),
        ("iban", "TR330006100519786457841326"), ("iban", "TR33 0006 1005 1978 6457 8413 26"), ("iban", "TR330006100519786457841327"), ("iban", "DE89370400440532013000"), ("iban", "GB82WEST12345698765432"), ("iban", "XX00"), ("iban", "tr33\u00a00006 1005\u202f1978 6457 8413\t26"),
        ("phone", "+90 212 555 12 34"), ("phone", "0(532) 555-12-34"), ("phone", "0090 312 555 1234"), ("phone", "0199 555 12 34"), ("phone", "212"), ("phone", "+1 (017) 555-7713"),
        ("phone", "+90 510 555 12 34"), ("phone", "0 516 555 12 34"), ("phone", "+90 570 555 12 34"), ("phone", "0575 555 12 34"), ("phone", "0800 555 12 34"), ("phone", "0 520 555 12 34"),
    ]),
    "pasted": ("doc_id long, unit_ix int, text string", [
        (1, 0, "from 'ada@x.org' or ada@x.org, o'brien@y.org"), (2, 0, "iban TR33\u00a00006\u00a01005\u00a01978\u00a06457\u00a08413\u00a026 or tr33 0006 1005 1978 6457 8413 26"), (3, 0, "TR33 0006 1005 1978 6457 8413 27"),
        (4, 0, "call +90 510 555 12 34, 0 (570) 555 12 34 or 0800 555 12 34"), (5, 0, "0 199 555 12 34"), (6, 0, "gb82west12345698765432 DE89370400440532013000"), (7, 0, "id 10000000146, 10000000147"), (8, 0, None), (9, 0, ""),
    ]),
    "folds": ("id int, text string", [(1, "Işıl  ÇAĞRI"), (2, "a_b.c-d"), (3, "x – y — z"), (4, "Şükrü\tÖZ"), (5, ""), (6, "Plain text"), (7, "İstanbul"), (8, "  lead and trail ")]),
    "rules": ("rule_ord int, rule_id string, find string, replacement string, exact boolean", [
        (0, "r0", "idiot", "[RULE_A]", False), (1, "r1", "pathetic", "[RULE_B]", False), (2, "r2", "worthless", "[RULE_C]", True), (3, "r3", "scum", "[RULE_D]", False),
        (4, "r4", "  IDIOT ", "[RULE_E]", False), (5, "r5", "", "", False), (6, "r6", "same", "same", False), (7, "r7", "blank", "", False),
    ]),
    "project_rules": ("rule_ord int, rule_id string, find string, replacement string, exact boolean", [(0, "p0", "North Harbour", "[PROJECT_1]", False), (1, "p1", "Falcon", "[PROJECT_2]", False), (2, "p2", "Zeta", "[PROJECT_3]", False)]),
    "project_units": ("doc_id long, unit_ix int, text string", [
        (1, 0, "The North Harbour plan"), (1, 1, "north-harbor and Falkon"), (2, 0, "falcons fly over North... Harbour; falcon falcon"), (3, 0, "zeta zetas ZETA"), (4, 0, "nothing here"), (5, 0, ""),
    ]),
    "cells": ("doc_id long, unit_ix int, grid string, row int, column int, text string", [
        (1, 0, "g", 0, 0, "Name"), (1, 1, "g", 0, 1, "Address"), (1, 2, "g", 1, 0, "Ada Lovelace"), (1, 3, "g", 1, 1, "12 Long Street"), (1, 4, "g", 2, 0, "Alan Turing"), (1, 5, "g", 3, 0, ""), (1, 6, "g", 4, 0, "Grace Hopper"),
        (2, 0, "h", 0, 0, "Passport No"), (2, 1, "h", 1, 0, "U1234567"), (2, 2, "h", 3, 0, "U7654321"), (3, 0, "k", 0, 0, "Other"), (3, 1, "k", 1, 0, "Value"),
    ]),
    "label_units": ("doc_id long, unit_ix int, text string", [(1, 0, "Name:"), (1, 1, "Ada Lovelace"), (2, 0, "Surname"), (2, 1, ":"), (2, 2, "Turing"), (3, 0, "Address"), (4, 0, "Nothing"), (4, 1, "else"), (5, 0, "CITY"), (5, 1, "London")]),
    "lines": ("doc_id long, unit_ix int, text string", [(1, 0, "Name: Ada Lovelace"), (1, 1, "Intro\nSurname: Turing"), (2, 0, "Passport No: U1234567"), (3, 0, "no label here: value"), (4, 0, "Address: 12 Long Street"), (5, 0, "plain")]),
    "labels": ("label string, category string", [("name", "person"), ("surname", "person"), ("address", "location"), ("city", "location"), ("passport no", "document_number")]),
    "layered": ("doc_id long, layer int, ord int, category string, normalized string, value string, count long, score double, replacement string", [
        (1, 1, 1, "custom", "acme", "Acme", 2, None, "[EMAIL_1]"), (1, 2, 1, "email", "a@x.org", "a@x.org", 3, None, None), (1, 2, 2, "email", "b@x.org", "B@x.org", 1, None, None), (1, 4, 1, "email", "a@x.org", "A@X.org", 9, None, None),
        (1, 4, 2, "person", "ada", "Ada", 1, None, None), (1, 5, 1, "person", "ada", "ADA", 4, 0.9, None), (1, 5, 2, "person", "alan", "Alan", 2, 0.95, None), (2, 2, 1, "card", "4111", "4111", 1, None, None), (2, 1, 1, "custom", "k", "k", 1, None, "[CARD_2]"), (2, 2, 2, "card", "42", "42", 1, None, None),
    ]),
    "tokens": ("doc_id long, chunk_ix int, tok_ix int, word string, tag string, score double, start int, end int", [
        (1, 0, 0, "Ada", "B-PER", 0.99, 0, 3), (1, 0, 1, "Love", "I-PER", 0.7, 4, 8), (1, 0, 2, "##lace", "I-PER", 0.8, 8, 12), (1, 0, 3, "met", "O", 0.99, 13, 16), (1, 0, 4, "Alan", "B-PER", 0.83, 17, 21), (1, 0, 5, "in", "O", 0.9, 22, 24), (1, 0, 6, "London", "B-LOC", 0.84, 25, 31),
        (2, 0, 0, "Acme", "B-ORG", 0.9, 0, 4), (2, 0, 1, "Paris", "B-LOC", 0.95, 5, 10), (2, 0, 2, "Rome", "B-LOC", 0.95, 11, 15), (3, 0, 0, "x", "B-PER", 0.99, 0, 1),
    ]),
    "entities": ("doc_id long, unit_ix int, category string, start int, end int, score double, value string", [
        (1, 0, "person", 0, 12, 0.9, "Ada Lovelace"), (1, 0, "person", 4, 12, 0.99, "Lovelace"), (1, 0, "location", 10, 20, 0.95, "ce in Rome"), (1, 0, "person", 30, 34, 0.9, "Alan"), (1, 0, "organization", 30, 34, 0.95, "Alan"), (2, 0, "person", 0, 4, 0.9, "Ada"), (2, 0, "person", 4, 8, 0.9, "Bob"),
    ]),
    "files": ("batch_id long, findings long, warning string, passthrough boolean", [(1, 2, None, False), (1, 0, None, False), (2, 0, None, False), (3, 5, "model failed", False), (4, 0, None, True), (5, None, None, None)]),
    "selected": ("event_id string, category string, source string, scope string, count long", [
        ("e1", "email", "pattern", "document", 3), ("e1", "card", "pattern", "filename", 1), ("e1", "person", "entity", "elsewhere", 0), ("e1", "unknown", "pattern", "document", 2), ("e2", "email", "field", "prompt", None),
    ]),
    "diagnostics": ("operation_id string, site string, artifact string, outcome string, device string, delivery string, file_count string, finding_count string, scan_ms string, mask_ms string, total_ms string, error_code string", [
        ("o1", "claude", "file", "masked", "gpu", "drop", "2", "10", "100", "50", "9999999999", "boom"), ("o2", "evil", "file", "failed", "tpu", "drop", "-1", "x", "5", "5", "10", "timeout"), ("o3", "gemini", "prompt", "blocked", "none", "none", "0", "0", "0", "0", "0", "Has Spaces"),
    ]),
    "hosts": ("host string", [("claude.ai",), ("x.claude.ai",), ("claude.ai.evil.com",), ("notclaude.ai",), ("GEMINI.google.com",), ("google.com",), (None,)]),
    "names": ("name string, size long", [("a.TXT", 10), ("b.pdf", 60_000_000), ("c.exe", 1), ("noextension", 5), ("d.tar.docx", 50 * 1024 * 1024), (None, 3)]),
    "uploads": ("upload_id long, at timestamp, name string, size long, mime string, head string", [
        (1, "2024-01-01 10:00:00", "a.txt", 10, None, None), (2, "2024-01-01 10:00:00", "b.txt", 10, None, None), (3, "2024-01-01 10:00:00", "b.exe", 10, None, None), (4, "2024-01-01 10:00:00", None, 4095, None, None),
        (5, "2024-01-01 10:09:59", None, 5000, "application/pdf", None), (6, "2024-01-01 10:10:00", None, 5000, "application/pdf", None), (7, "2024-01-01 10:05:00", None, 9000, None, "%PDF"), (8, "2024-01-01 10:05:00", None, 9000, None, "text"), (9, "2024-01-01 11:00:00", None, 262144, None, None),
    ]),
    "approvals": ("name string, size long, approved_at timestamp", [("a.txt", 10, "2024-01-01 09:00:00"), ("x.pdf", 6000, "2024-01-01 10:00:00")]),
    "runs": ("doc_id long, page int, run_ix int, str string, x double, right double, y double, height double, eol boolean", [
        (1, 1, 0, "Hello", 0.0, 50.0, 700.0, 10.0, False), (1, 1, 1, "world", 55.0, 105.0, 700.0, 10.0, False), (1, 1, 2, "!", 105.5, 108.0, 700.0, 10.0, False), (1, 1, 3, "Next", 0.0, 40.0, 685.0, 10.0, False), (1, 1, 4, " line", 40.0, 80.0, 685.0, 10.0, True), (1, 1, 5, "End", 90.0, 120.0, 685.0, 10.0, False),
    ]),
    "boxes_layout": ("doc_id long, page int, run_ix int, start int, end int, x double, y double, width double, height double, kind string", [
        (1, 1, 0, 0, 10, 0.0, 700.0, 100.0, 10.0, "run"), (1, 1, 1, 11, 21, 110.0, 700.0, 100.0, 10.0, "run"), (1, 1, 2, 22, 26, 0.0, 680.0, 40.0, 10.0, "word"),
    ]),
    "boxes_spans": ("doc_id long, page int, span_ix int, start int, end int, label string", [(1, 1, 0, 2, 5, "[A]"), (1, 1, 1, 8, 15, "[B]"), (1, 1, 2, 23, 24, "[C]"), (1, 1, 3, 10, 11, "[D]")]),
    "layout_cells": ("doc_id long, page int, line int, cell int, text string, x double, right double", [
        (1, 1, 1, 1, "Name", 0.0, 40.0), (1, 1, 1, 2, "City", 100.0, 140.0), (1, 1, 2, 1, "Ada", 0.0, 30.0), (1, 1, 2, 2, "London", 101.0, 150.0), (1, 1, 3, 1, "Alan", 0.0, 30.0), (1, 1, 3, 2, "Paris", 99.0, 150.0), (1, 1, 4, 1, "alone", 0.0, 30.0), (1, 1, 5, 1, "Late", 0.0, 30.0), (1, 1, 5, 2, "Rome", 100.0, 130.0),
    ]),
    "terms": ("value string", [("SQL Server",), ("Ada Lovelace",), ("abc123",), ("json",), ("Rome",), ("a=b",), ("Python API",)]),
    "agents": ("agent string", [("Mozilla/5.0 (Windows NT 10.0) Chrome/125.0 Safari/537.36 Edg/126.0",), ("Mozilla/5.0 (X11; Linux x86_64) Chrome/125.0",), ("Mozilla/5.0 (Macintosh; Intel Mac OS X) Safari",), ("Mozilla/5.0 (X11; CrOS x86_64) Chrome/124.0",)]),
    "columns": ("letters string", [("A",), ("Z",), ("AA",), ("az",), ("BA",), ("XFD",)]),
    "prompts": ("id long, text string, enabled boolean, approved boolean, model boolean", [(1, "hello", True, False, True), (2, "  ", True, False, True), (3, "hello", False, False, True), (4, "hello", True, True, True), (5, "hello", True, False, False), (6, "x" * 50_001, True, False, False)]),
}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = TABLES[name]
    times = [c.split(" ")[0] for c in ddl.split(", ") if c.endswith(" timestamp")]
    df = spark.createDataFrame(rows, ddl.replace(" timestamp", " string"))
    for c in times:
        df = df.withColumn(c, df[c].cast("timestamp"))
    return df


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def fixture_sql(name: str) -> str:
    """The table as a SELECT that DuckDB can run."""
    ddl, rows = TABLES[name]
    columns = [c.split(" ", 1) for c in ddl.split(", ")]
    casts = ", ".join(f'CAST("{c}" AS {_SQL[k]}) AS "{c}"' for c, k in columns)
    names = ", ".join(f'"{c}"' for c, _ in columns)
    return f"(SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({names}))"
