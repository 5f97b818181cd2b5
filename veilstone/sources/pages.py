"""Pages and images by providers: the engine's part of reading PDFs, pictures and pictures inside packages.

No PDF library and no recogniser ships. A provider is a plain function that an executor
can import; what it returns is checked here, and a failure rejects the file.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from io import BytesIO

from ..operators.entities import DEFAULT_PROFILE, PROFILES
from .files import Adapter
from .office import Package, Workbook

LEAST_TEXT = 8
LONGEST_EDGE = 2400
_MEDIA = re.compile(r"^(word|xl)/media/[^/]+\.(png|jpe?g|webp)$", re.I)

#: From an image's bytes to its words in reading order.
Recogniser = Callable[[bytes], list[str]]


@dataclass(frozen=True)
class Run:
    """A piece of a page's text: where it starts and ends, its line and height, and whether it ends a line."""

    text: str
    x: float
    right: float
    y: float
    height: float
    eol: bool = False


@dataclass(frozen=True)
class Page:
    """What a PDF provider gives for a page; ``render`` makes an image at a resolution for pages without text."""

    runs: list[Run]
    values: list[str | None] = field(default_factory=list)
    images: int = 0
    render: Callable[[int, int], bytes] | None = None


def page_text(runs: list[Run]) -> str:
    """The plain form of ``geometry.page_text``: a line break, a space or nothing between two runs."""
    out: list[str] = []
    for before, run in zip([None, *runs], runs, strict=False):
        if before is not None:
            height = max(before.height, run.height)
            if before.eol or abs(run.y - before.y) > 0.65 * height:
                out.append("\n")
            elif not before.text[-1:].isspace() and not run.text[:1].isspace() and run.x - before.right > 0.16 * height:
                out.append(" ")
        out.append(run.text)
    return "".join(out)


def _joined(words: list[str]) -> str:
    return " ".join(w.strip() for w in words if w.strip())


def image_adapter(recognise: Recogniser) -> Adapter:
    """The whole picture is one unit; a picture without text is an error, never a clean file."""

    def read(data: bytes) -> Iterator[dict]:
        text = _joined(recognise(data))
        if not text:
            raise ValueError("no text was recognised")
        yield {"unit_ix": 0, "text": text, "kind": "image"}

    return Adapter(("png", "jpg", "jpeg"), read)


def pdf_adapter(provide: Callable[[bytes], list[Page]], recognise: Recogniser | None = None, profile: str = DEFAULT_PROFILE) -> Adapter:
    """One unit for each page's text and for each value of its annotations.

    A page with hardly any text and an image is rendered and recognised; a document with
    fewer than ``LEAST_TEXT`` characters in all is an error.
    """
    dots = PROFILES.get(profile, PROFILES[DEFAULT_PROFILE])[2]

    def read(data: bytes) -> Iterator[dict]:
        units, total = [], 0
        for number, page in enumerate(provide(data), 1):
            text = page_text(page.runs)
            if len("".join(text.split())) < LEAST_TEXT and page.images:
                if recognise is None or page.render is None:
                    raise ValueError(f"page {number} is a picture and there is no recogniser")
                text = _joined(recognise(page.render(dots, LONGEST_EDGE)))
            values = [v for v in page.values if v and v.strip()]
            total += len("".join(text.split())) + sum(len("".join(v.split())) for v in values)
            units += [("pdf", number, text)] if text.strip() else []
            units += [("pdf_form", number, v) for v in values]
        if total < LEAST_TEXT:
            raise ValueError("the document has no readable text")
        for i, (kind, number, text) in enumerate(units):
            yield {"unit_ix": i, "text": text, "kind": kind, "address": str(number)}

    return Adapter(("pdf",), read)


def office_with_images(recognise: Recogniser) -> list[Adapter]:
    """Office adapters that also read the pictures inside a package; one that fails, fails the document."""

    def reader(make: Callable[[bytes], Package]) -> Callable[[bytes], Iterator[dict]]:
        def read(data: bytes) -> Iterator[dict]:
            package = make(data)
            yield from package.units()
            with zipfile.ZipFile(BytesIO(data)) as z:
                for i, name in enumerate(n for n in sorted(z.namelist()) if _MEDIA.match(n)):
                    if text := _joined(recognise(z.read(name))):
                        yield {"unit_ix": len(package.slots) + i, "text": text, "kind": "office_image", "part": name}

        return read

    return [Adapter(("docx",), reader(lambda d: Package(d, "word/document.xml"))), Adapter(("xlsx",), reader(Workbook))]
