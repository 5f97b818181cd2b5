"""Files, packages and streams: round trips and refusals."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilstone import session
from veilstone.plans.fixtures import fixture
from veilstone.sources import files, office
from veilstone.streaming import events as streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = package({
    "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Mail a@</w:t></w:r><w:r><w:t>x.org now</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Name</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Ada</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    "word/comments.xml": "<broken", "docProps/core.xml": "<c><creator>b@y.org</creator></c>",
})
XLSX = package({
    "xl/workbook.xml": f"<workbook {S}><sheets><sheet name=\"a@x.org\" sheetId=\"1\"/><sheet name=\"Other\" sheetId=\"2\"/></sheets><definedNames><definedName name=\"n\">'a@x.org'!A1</definedName></definedNames></workbook>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><dimension ref="A1:B7"/><sheetData><row r="1"><c r="A1"><v>10000000146</v></c><c r="B1" t="str"><f>UPPER("a")</f><v>c@z.org</v></c><c r="C1"><v>2125551234</v></c></row></sheetData></worksheet>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>d@w.org</t></si></sst>",
})


def test_document(spark):
    units = list(office.read_document(DOCX))
    assert [u["text"] for u in units] == ["Mail a@x.org now", "Name", "Ada", "b@y.org"]
    assert units[2]["cell"] == {"grid": "table1", "row": 0, "column": 1}
    again = list(office.read_document(office.write_document(DOCX, {units[0]["unit_ix"]: "Mail [EMAIL_1] now"})))
    assert again[0]["text"] == "Mail [EMAIL_1] now" and again[3]["text"] == "b@y.org"
    assert office.Package(DOCX, "word/document.xml").skipped == ["word/comments.xml"]


def test_workbook():
    units = {u["text"]: u for u in office.read_workbook(XLSX)}
    assert units["10000000146"]["allowed"] == ["national_id", "card"]
    masked = office.write_workbook(XLSX, {units["10000000146"]["unit_ix"]: "[ID]", units["c@z.org"]["unit_ix"]: "[EMAIL_1]", units["a@x.org"]["unit_ix"]: "Other"})
    texts = [u["text"] for u in office.read_workbook(masked)]
    assert "[ID]" in texts and "[EMAIL_1]" in texts and "Other_2" in texts and 'UPPER("a")' not in texts and "'Other_2'!A1" in texts
    assert office.estimated_rows(XLSX) == 7


def test_split_over_keeps_whole_text():
    for old, new in ((["ab", "cd", "ef"], "abXef"), (["ab"], ""), (["", "x"], "yx"), (["a", "b"], "ab"), (["aa", "aa"], "a")):
        assert "".join(office.split_over(old, new)) == new
    assert office.split_over(["Mail a@", "x.org now"], "Mail [E] now") == ["Mail [E]", " now"]


@pytest.mark.parametrize("data", [b"", b"PK broken", package({}), package({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"})])
def test_bad_packages_are_refused(data):
    with pytest.raises(Exception):  # noqa: B017
        list(office.read_document(data))


def test_extract_and_apply(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfmail a@x.org\r\n")
    (tmp_path / "b.docx").write_bytes(DOCX)
    (tmp_path / "c.xlsx").write_bytes(XLSX)
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "e.exe").write_bytes(b"MZ")
    (tmp_path / "f.pdf").write_bytes(b"no pdf")
    held = files.read_files(spark, str(tmp_path))
    adapters = [files.text_adapter(), *office.office_adapters()]
    units = files.extract(held, adapters)
    rejected = {r.name for r in units.filter("problem is not null").join(held, "doc_id").collect()}
    assert rejected == {"d.txt", "e.exe", "f.pdf"}
    masked = units.filter("text like '%@%'").select("doc_id", "unit_ix", F.regexp_replace("text", r"\S+@\S+", "[E]").alias("masked"))
    out = {r.name: r.content for r in files.apply(held, masked, adapters).collect()}
    assert out["a-masked.txt"] == b"\xef\xbb\xbfmail [E]\r\n"
    assert next(office.read_document(out["b-masked.docx"]))["text"] == "Mail [E] now"


def test_extract_holds_few_units_at_a_time(spark):
    """Each unit's text tells how many units are held when it is read: a batch's, and its own file's, but not all files'."""

    class Held(str):
        live = 0

        def __new__(cls, text):
            cls.live += 1
            return super().__new__(cls, text)

        def __del__(self):
            type(self).live -= 1

    def read(data):
        for i in range(200):
            yield {"unit_ix": i, "text": Held(Held.live), "kind": "txt"}
        if data == b"bad":
            raise ValueError("breaks off")

    rows = [(i, "a.txt", bytearray(b"bad" if i % 20 == 19 else b"good")) for i in range(80)]
    held = spark.createDataFrame(rows, "doc_id long, name string, content binary").coalesce(1)
    got = files.extract(held, [files.Adapter(("txt",), read)]).selectExpr("problem", "cast(text as int) as live").collect()
    assert sum(r.problem is None for r in got) == 76 * 200 and [r.problem for r in got if r.problem] == ["ValueError: breaks off"] * 4
    assert max(r.live for r in got if r.problem is None) <= files.BATCH_UNITS + 2 * 200
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(session.ARROW_BYTES)


def test_signatures(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + b"\0" * 20 + b"\0\0\0\0IEND\xaeB`\x82"
    rows = [("a.pdf", b"%PDF-1.7\n..\n%%EOF \n"), ("b.pdf", b"%PDF-1.7"), ("c.png", png), ("d.png", b"\x89PNG"), ("e.jpg", b"\xff\xd8\xff..\xff\xd9"), ("f.jpg", b"\xff\xd8\xff"), ("g.txt", b"a\0b"), ("h.txt", b"\x01" + b"a" * 200), ("i.txt", b"\x01" * 5 + b"a" * 95), ("j.txt", b""), ("k.exe", b"x")]
    got = {r.name for r in files.validate(spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c) in enumerate(rows)], "doc_id long, name string, content binary")).filter("problem is null").collect()}
    assert got == {"a.pdf", "c.png", "e.jpg", "h.txt"}


def test_chunks_in_any_order(spark):
    for n in (0, 1, 6, 7, 8, 21, 28):
        data = bytes(range(n))
        sent = files.to_chunks(spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary"), 7)
        assert sent.count() == max(1, -(-n // 7))
        back = files.from_chunks(sent.orderBy(F.desc("seq"))).first()
        assert bytes(back.content) == data and back.problem is None
        if n > 7:
            assert files.from_chunks(sent.filter("seq > 0")).first().problem == "missing chunks"


def test_rules_from_json(spark):
    raw = spark.createDataFrame([('{"rules": [{"id": "1", "find": " Acme ", "replacement": "[A]"}, {"find": "x"}]}',), ("broken",)], "body string")
    assert [(r.find, r.replacement, r.exact) for r in files.rule_table(raw).collect()] == [("Acme", "[A]", False)]


def test_streams_agree_with_tables(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_id", F.col("event_id").cast("string")).withColumnRenamed("ts", "created_at")
    events.union(events.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_source(spark, str(tmp_path / "in"), events.schema)
    q = streams.deliver(streams.audit_queue(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == events.count()
    out = streams.sessions(stream.withColumnRenamed("created_at", "ts"), "user_id", "ts").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(120)
    done = streams.sessions(events.withColumnRenamed("created_at", "ts").union(events.limit(50).withColumnRenamed("created_at", "ts")), "user_id", "ts")
    key = lambda r: (r.user_id, r.session_start)
    assert {key(r) for r in spark.table("sessions").collect()} <= {key(r) for r in done.collect()}


def test_fixtures_are_tables(spark):
    assert fixture(spark, "uploads").schema["at"].dataType.typeName() == "timestamp"
