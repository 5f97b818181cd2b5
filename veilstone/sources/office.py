"""Office packages with the standard library: units in, masked units out.

A package's parts are read by rules (path pattern, elements, attributes, mode): a paragraph's
text nodes make one unit, other elements and attributes one each. The same walk numbers
the slots when the package is written, so a unit's number finds its nodes again.
Packages are refused that are too large, have too many entries, or declare a DTD.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from xml.etree import ElementTree as ET

from .files import Adapter

MOST_ENTRIES, MOST_BYTES = 10_000, 250 * 1024 * 1024
SAFE_INTEGER = 2**53 - 1


@dataclass(frozen=True)
class PartRule:
    """How the parts whose path fits are read. ``grouped``: text nodes (``text``) under each ``group`` element make one slot."""

    path: str
    group: str = ""
    text: tuple[str, ...] = ()
    elements: tuple[str, ...] = ()
    attributes: tuple[tuple[str, str], ...] = field(default=())
    every: bool = False


# Parts of the public package format that carry text. The first rule that fits a path holds.
PART_RULES = (
    PartRule(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments|glossary/document)\.xml$", "p", ("t", "delText", "instrText")),
    PartRule(r"word/people\.xml$", attributes=(("person", "author"),)),
    PartRule(r"(word|xl|ppt)/(charts|diagrams|drawings)/.*\.xml$", "p", ("t",), ("v",)),
    PartRule(r"xl/sharedStrings\.xml$", "si", ("t",)),
    PartRule(r"xl/comments\d*\.xml$", "comment", ("t",), ("author",)),
    PartRule(r"xl/threadedComments/.*\.xml$", elements=("text",)),
    PartRule(r"xl/persons/.*\.xml$", attributes=(("person", "displayName"),)),
    PartRule(r"xl/workbook\.xml$", elements=("definedName",)),
    PartRule(r"docProps/(core|app|custom)\.xml$", every=True),
    PartRule(r"customXml/item\d+\.xml$", every=True),
    PartRule(r"xl/pivotCache/.*\.xml$", attributes=(("s", "v"), ("cacheField", "name"))),
    PartRule(r"xl/tables/.*\.xml$", attributes=(("table", "displayName"), ("tableColumn", "name"))),
    PartRule(r"xl/worksheets/.*\.xml$", elements=("oddHeader", "oddFooter", "evenHeader", "evenFooter"), attributes=(("hyperlink", "display"), ("hyperlink", "tooltip"), ("dataValidation", "prompt"))),
    PartRule(r"xl/connections\.xml$", attributes=(("connection", "name"), ("dbPr", "connection"))),
    PartRule(r"_rels/[^/]*\.rels$", attributes=(("Relationship", "Target"),)),
)


class PackageError(ValueError):
    pass


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def open_package(data: bytes, main: str) -> zipfile.ZipFile:
    """A checked package: magic, entry count, unpacked size, checksums, content types and the main part."""
    if data[:2] != b"PK":
        raise PackageError("not a zip package")
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise PackageError("broken zip package") from e
    entries = package.infolist()
    if len(entries) > MOST_ENTRIES:
        raise PackageError("too many entries")
    if sum(e.file_size for e in entries) > MOST_BYTES:
        raise PackageError("too large when unpacked")
    names = set(package.namelist())
    if "[Content_Types].xml" not in names or main not in names:
        raise PackageError("a main part is missing")
    if package.testzip():
        raise PackageError("a checksum is wrong")
    return package


def parse(xml: bytes) -> ET.Element:
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise PackageError("a part declares a DTD")
    return ET.fromstring(xml)


@dataclass
class Slot:
    """One unit: text nodes that stand for it (element, or element and attribute)."""

    part: str
    nodes: list[tuple[ET.Element, str | None]]
    cell: tuple[str, int, int] | None = None
    address: str | None = None
    allowed: list[str] | None = None
    kind: str = "part"

    def text(self) -> str:
        if len(self.nodes) == 1:
            e, a = self.nodes[0]
            return e.get(a, "") if a else e.text or ""
        return "".join((e.get(a, "") if a else e.text or "") for e, a in self.nodes)

    def write(self, new: str) -> None:
        """The new text goes to the first node whole; the others are emptied where it changed."""
        for (e, a), piece in zip(self.nodes, split_over([(x.get(b, "") if b else x.text or "") for x, b in self.nodes], new), strict=True):
            if a:
                e.set(a, piece)
            else:
                e.text = piece
                if piece != piece.strip():
                    e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def split_over(old: list[str], new: str) -> list[str]:
    """new dealt over the nodes that held old: common ends stay in their nodes, the changed middle goes to the node where it begins."""
    whole = "".join(old)
    left = 0
    while left < min(len(whole), len(new)) and whole[left] == new[left]:
        left += 1
    right = 0
    while right < min(len(whole), len(new)) - left and whole[-1 - right] == new[-1 - right]:
        right += 1
    if whole == new:
        return list(old)
    out, at, placed = [], 0, False
    for piece in old:
        start, stop = at, at + len(piece)
        at = stop
        keep_left = piece[: max(0, min(stop, left) - start)]
        keep_right = piece[max(0, len(whole) - right - start) :] if stop > len(whole) - right else ""
        middle = ""
        if not placed and (stop > left or stop == len(whole)):
            middle, placed = new[left : len(new) - right], True
        out.append(keep_left + middle + keep_right)
    if not placed and out:
        out[-1] += new[left : len(new) - right]
    return out


def _texts_below(node: ET.Element, group: str, wanted: tuple[str, ...]) -> list[ET.Element]:
    """Text nodes in document order, but not those of a group inside this one."""
    out = []
    for child in node:
        name = _local(child.tag)
        if name == group:
            continue
        if name in wanted:
            out.append(child)
        if len(child):
            out += _texts_below(child, group, wanted)
    return out


def _table_cells(root: ET.Element) -> dict[ET.Element, tuple[str, int, int]]:
    """The innermost table, row and column of every paragraph."""
    out: dict[ET.Element, tuple[str, int, int]] = {}
    if all(_local(tag) != "tbl" for tag in {e.tag for e in root.iter()}):
        return out
    count = 0

    def walk(node: ET.Element, where: tuple[str, int, int] | None) -> None:
        nonlocal count
        if _local(node.tag) == "tbl":
            count += 1
            name = f"table{count}"
            for r, row in enumerate(x for x in node if _local(x.tag) == "tr"):
                for c, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                    walk(cell, (name, r, c))
            return
        if _local(node.tag) == "p" and where:
            out[node] = where
        for child in node:
            walk(child, where)

    walk(root, None)
    return out


def slots_of(part: str, root: ET.Element, rule: PartRule) -> Iterator[Slot]:
    cells = _table_cells(root) if rule.group == "p" else {}
    group, elements, every, attributes = rule.group, rule.elements, rule.every, rule.attributes
    for node in root.iter():
        name = _local(node.tag)
        if group and name == group:
            found = _texts_below(node, group, rule.text)
            if found:
                yield Slot(part, [(e, None) for e in found], cells.get(node))
        elif every or name in elements:
            if (node.text or "").strip():
                yield Slot(part, [(node, None)])
        for element, attribute in attributes:
            for key in list(node.attrib):
                if name == element and _local(key) == attribute and node.get(key) and (element != "Relationship" or node.get("TargetMode") == "External"):
                    yield Slot(part, [(node, key)])


def ordered_parts(names: list[str], main: str) -> list[str]:
    return sorted(names, key=lambda n: (n != main, n))


class Package:
    """A package with its parsed parts and all slots in order; side parts that don't parse are listed as skipped."""

    def __init__(self, data: bytes, main: str):
        self.zip, self.main = open_package(data, main), main
        self.roots: dict[str, ET.Element] = {}
        self.skipped: list[str] = []
        self.slots: list[Slot] = []
        for name in ordered_parts(self.zip.namelist(), main):
            rule = next((r for r in PART_RULES if re.search(r.path, name)), None)
            if rule is None:
                continue
            try:
                root = parse(self.zip.read(name))
            except (ET.ParseError, PackageError):
                if name == main:
                    raise
                self.skipped.append(name)
                continue
            self.roots[name] = root
            self.slots += self.extra(name, root)
            self.slots += slots_of(name, root, rule)

    def extra(self, name: str, root: ET.Element) -> list[Slot]:
        return []

    def units(self) -> Iterator[dict]:
        for i, s in enumerate(self.slots):
            if (text := s.text()).strip():
                cell = dict(zip(("grid", "row", "column"), s.cell, strict=True)) if s.cell else None
                yield {"unit_ix": i, "text": text, "kind": s.kind, "part": s.part, "address": s.address, "allowed": s.allowed, "cell": cell}

    def write(self, masked: dict[int, str]) -> bytes:
        """The package with the masked slots; parts without a change keep their bytes."""
        changed = set()
        for i, text in masked.items():
            if self.slots[i].text() != text:
                self.put(self.slots[i], text)
                changed.add(self.slots[i].part)
        self.finish(changed)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for entry in self.zip.infolist():
                name = entry.filename
                z.writestr(entry, ET.tostring(self.roots[name], encoding="utf-8", xml_declaration=True) if name in changed else self.zip.read(name))
        return out.getvalue()

    def put(self, slot: Slot, text: str) -> None:
        slot.write(text)

    def finish(self, changed: set[str]) -> None:
        pass


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


class Workbook(Package):
    """Cells: text, formula and cached value are slots; a safe integer only takes the categories of numbers; sheet names too."""

    def __init__(self, data: bytes):
        super().__init__(data, "xl/workbook.xml")

    def extra(self, name: str, root: ET.Element) -> list[Slot]:
        out = []
        if name == "xl/workbook.xml":
            for sheet in (e for e in root.iter() if _local(e.tag) == "sheet"):
                out.append(Slot(name, [(sheet, "name")], address=sheet.get("name"), kind="sheet_name"))
        if re.search(r"xl/worksheets/[^/]*\.xml$", name):
            for cell in (e for e in root.iter() if _local(e.tag) == "c"):
                address = cell.get("r") or ""
                m = re.match(r"([A-Z]+)(\d+)$", address)
                where = (name, int(m[2]) - 1, column_index(m[1])) if m else None
                for child in cell:
                    kind, text = _local(child.tag), child.text or ""
                    if kind == "f" and text:
                        out.append(Slot(name, [(child, None)], where, address, None, "formula"))
                    elif kind == "v" and cell.get("t") == "str" and text:
                        out.append(Slot(name, [(child, None)], where, address, None, "value"))
                    elif kind == "v" and cell.get("t") in (None, "n") and re.fullmatch(r"-?\d+", text) and abs(int(text)) <= SAFE_INTEGER:
                        out.append(Slot(name, [(child, None)], where, address, ["national_id", "card"], "number"))
                    elif kind == "is":
                        found = [e for e in child.iter() if _local(e.tag) == "t"]
                        if found:
                            out.append(Slot(name, [(e, None) for e in found], where, address, None, "inline"))
        return out

    def put(self, slot: Slot, text: str) -> None:
        """A masked number or value becomes a string cell; a formula whose value alone changed is dropped."""
        if slot.kind == "sheet_name":
            self.rename(slot, text)
            return
        slot.write(text)
        if slot.kind in ("number", "value", "formula"):
            root = self.roots[slot.part]
            cell = next(c for c in root.iter() if _local(c.tag) == "c" and slot.nodes[0][0] in list(c))
            if slot.kind != "formula":
                cell.set("t", "str")
                for f in [x for x in cell if _local(x.tag) == "f" and slot.kind == "value"]:
                    cell.remove(f)

    def rename(self, slot: Slot, text: str) -> None:
        """A free name without forbidden characters, of at most 31; references in formulas and defined names follow."""
        old = slot.text()
        taken = {s.text().lower() for s in self.slots if s.kind == "sheet_name" and s is not slot}
        clean = re.sub(r"[\[\]:*?/\\]", "_", text).strip("'")[:31] or "Sheet"
        name, n = clean, 2
        while name.lower() in taken:
            name, n = f"{clean[: 31 - len(str(n)) - 1]}_{n}", n + 1
        slot.nodes[0][0].set("name", name)
        quoted = re.compile(r"(?:'" + re.escape(old.replace("'", "''")) + r"'|(?<![\w'.])" + re.escape(old) + r")!")
        safe = "'" + name.replace("'", "''") + "'!"
        for part, root in self.roots.items():
            for e in root.iter():
                if _local(e.tag) in ("f", "definedName") and e.text and quoted.search(e.text):
                    e.text = quoted.sub(lambda _: safe, e.text)
                    self.touched.add(part)
                elif part == "docProps/app.xml" and e.text == old:
                    e.text = name
                    self.touched.add(part)

    @property
    def touched(self) -> set[str]:
        return self.__dict__.setdefault("_touched", set())

    def finish(self, changed: set[str]) -> None:
        changed |= self.touched


def read_document(data: bytes) -> Iterator[dict]:
    return Package(data, "word/document.xml").units()


def write_document(data: bytes, masked: dict[int, str]) -> bytes:
    return Package(data, "word/document.xml").write(masked)


def read_workbook(data: bytes) -> Iterator[dict]:
    return Workbook(data).units()


def write_workbook(data: bytes, masked: dict[int, str]) -> bytes:
    return Workbook(data).write(masked)


def estimated_rows(data: bytes) -> int:
    """Rows by the sheets' declared ranges, counted where none is declared."""
    package, total = open_package(data, "xl/workbook.xml"), 0
    for name in package.namelist():
        if re.search(r"xl/worksheets/[^/]*\.xml$", name):
            root = parse(package.read(name))
            declared = next((e.get("ref") for e in root.iter() if _local(e.tag) == "dimension"), None)
            last = re.search(r"(\d+)$", declared or "")
            total += int(last[1]) if last else sum(_local(e.tag) == "row" for e in root.iter())
    return total


def office_adapters() -> list[Adapter]:
    return [Adapter(("docx",), read_document, write_document), Adapter(("xlsx",), read_workbook, write_workbook)]
