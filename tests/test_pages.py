"""Page and image providers with deterministic stand-ins."""

import io
import zipfile

import pytest

from veilstone.operators import geometry, spans
from veilstone.plans.fixtures import fixture
from veilstone.sources import pages


def words(data):
    if data == b"bad":
        raise RuntimeError("recogniser failed")
    return data.decode().split()


def test_images():
    read = pages.image_adapter(words).read
    assert [u["text"] for u in read(b" mail  a@x.org ")] == ["mail a@x.org"]
    for data in (b"  ", b"bad"):
        with pytest.raises((ValueError, RuntimeError)):
            list(read(data))


def test_pdf():
    run = lambda t, x, r, y=700.0, eol=False: pages.Run(t, x, r, y, 10.0, eol)
    held = [pages.Page([run("Hello", 0, 50), run("world", 55, 105)], ["v@x.org", " ", None]), pages.Page([], images=1, render=lambda dots, edge: f"scan at {dots}".encode())]
    units = list(pages.pdf_adapter(lambda d: held, words, "fast").read(b""))
    assert [(u["kind"], u["text"], u["address"]) for u in units] == [("pdf", "Hello world", "1"), ("pdf_form", "v@x.org", "1"), ("pdf", "scan at 150", "2")]
    for bad in ([pages.Page([run("x", 0, 5)])], [pages.Page([], images=1)]):
        with pytest.raises(ValueError):
            list(pages.pdf_adapter(lambda d, bad=bad: bad).read(b""))


def test_plain_page_text_agrees_with_the_column_form(spark):
    rows = fixture(spark, "runs").orderBy("run_ix").collect()
    plain = pages.page_text([pages.Run(r.str, r.x, r.right, r.y, r.height, r.eol) for r in rows])
    assert plain == geometry.assemble(geometry.page_text(fixture(spark, "runs"))).first().text


def test_pictures_in_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:p><w:t>body</w:t></w:p></w:document>")
        z.writestr("word/media/image1.png", b"from a picture")
    docx = pages.office_with_images(words)[0]
    assert [u["text"] for u in docx.read(out.getvalue())] == ["body", "from a picture"]
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("word/media/image2.png", b"bad")
    with pytest.raises(RuntimeError):
        list(docx.read(out.getvalue()))


def test_spans_of_a_models_answer():
    text = 'see ("Ada Lovelace"), ok'
    assert spans.clean_span(text, 4, 20) == (6, 18)
    assert spans.expand_span(text, 7, 15) == (6, 18)
    assert spans.expand_span("x" * 100, 40, 50) == (40, 50)
    assert spans.align_pieces("İstanbul'da Işık", ["istanbul", "##'", "##da", "ışık"]) == [(0, 8), (8, 9), (9, 11), (12, 16)]
    asked = []

    def provider(t):
        asked.append(t)
        w = t.split()[0]
        a = t.index(w)
        return [(w, "O", 1.0, a, a + len(w))]

    assert [(a, b) for *_, a, b in spans.covered("one two three four", provider)] == [(0, 3), (4, 7), (8, 13)] and len(asked) == 3
