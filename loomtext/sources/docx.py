"""DOCX packages: paragraphs as units with their runs as segments, and write-back, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import normalize_segments
from ..shared import ship

#: Fixed values of the format.
W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
PARTS = re.compile(r"word/(?:document|header\d+|footer\d+|footnotes|endnotes|comments)\.xml")
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
STYLES = ("b", "i", "u", "color", "highlight", "vertAlign", "strike", "dstrike", "caps", "smallCaps")
LOCALES = {"fa": "fa-IR", "ar": "ar-SA", "en": "en-US"}
#: Limits of a package: entries, bytes unpacked, bytes of one XML part, ratio of compression of parts above 1 MiB.
MAX_ENTRIES, MAX_BYTES, MAX_XML, MAX_RATIO = 10_000, 512 << 20, 64 << 20, 200

SCHEMA = "path string, ord int, unit_id string, segments array<string>, protected array<int>, entry string, paragraph_index int, error string"


class BadPackage(ValueError):
    """A package that is refused, with the reason."""


def w(local: str) -> str:
    return f"{{{W_NS}}}{local}"


#: What makes a package, or one of its entries, be refused: the reason, and the test.
_PACKAGE_RULES = (
    ("missing parts", lambda entries: not set(REQUIRED) <= {e.filename for e in entries}),
    ("too many entries", lambda entries: len(entries) > MAX_ENTRIES),
    ("too large unpacked", lambda entries: sum(e.file_size for e in entries) > MAX_BYTES),
)
_ENTRY_RULES = (
    ("XML part too large", lambda e: e.file_size > MAX_XML and e.filename.lower().endswith(".xml")),
    ("suspicious compression", lambda e: e.file_size > max(MAX_RATIO * max(1, e.compress_size), 1 << 20)),
)


def open_package(data: bytes) -> zipfile.ZipFile:
    """The package, if it is complete and within the limits."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise BadPackage(f"no zip package: {e}") from e
    entries = z.infolist()
    found = [reason for reason, refuses in _PACKAGE_RULES if refuses(entries)]
    found += [f"{reason}: {e.filename}" for reason, refuses in _ENTRY_RULES for e in filter(refuses, entries)]
    if found:
        raise BadPackage("; ".join(found))
    return z


def parse(name: str, data: bytes) -> ET.Element:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise BadPackage(f"document type declaration in {name}")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise BadPackage(f"cannot parse {name}: {e}") from e


def paragraphs(root: ET.Element) -> Iterator[tuple[int, ET.Element, list[tuple[ET.Element, bool]]]]:
    """(index, paragraph, its text nodes and whether each is protected) in document order; a node belongs to its nearest
    paragraph, and is protected inside a link or a styled run."""
    found: list[tuple[ET.Element, list]] = []

    def walk(e: ET.Element, own: list | None, linked: bool, styled: bool) -> None:
        if e.tag == w("p"):
            own = []
            found.append((e, own))
        elif e.tag == w("hyperlink"):
            linked = True
        elif e.tag == w("r"):
            style = e.find(w("rPr"))
            styled = style is not None and any(c.tag in {w(s) for s in STYLES} for c in style)
        elif e.tag == w("t") and own is not None:
            own.append((e, linked or styled))
        for c in e:
            walk(c, own, linked, styled)

    walk(root, None, False, False)
    for i, (p, nodes) in enumerate(found):
        yield i, p, nodes


def units_of(data: bytes) -> Iterator[tuple[str, list[str], list[int], str, int, ET.Element, list[ET.Element], ET.Element]]:
    with open_package(data) as z:
        n = 0
        for name in (i.filename for i in z.infolist() if PARTS.fullmatch(i.filename)):
            root = parse(name, z.read(name))
            for index, p, nodes in paragraphs(root):
                segments = [t.text or "" for t, _ in nodes]
                if "".join(segments).strip():
                    yield f"docx-{n}", segments, [k for k, (_, held) in enumerate(nodes) if held], name, index, p, [t for t, _ in nodes], root
                    n += 1


def scan_docx(spark: SparkSession, path: str) -> DataFrame:
    """Units of all packages under a path; a package that is refused gives one row with the reason in ``error``."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    own = [(path, k, u, s, p, entry, i, None) for k, (u, s, p, entry, i, *_) in enumerate(units_of(bytes(data)))]
                except BadPackage as e:
                    own = [(path, 0, None, None, None, None, None, str(e))]
                rows += own
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"paragraph_index": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def write_back(data: bytes, translations: dict[str, list[str]], language: str, font: str = "") -> bytes:
    """The package with translated units; a unit without translation, or whose protected segments do not fit, stays."""
    rtl = language in ("fa", "ar")
    roots: dict[str, ET.Element] = {}
    for unit, segments, protected, entry, _, paragraph, nodes, root in units_of(data):
        roots[entry] = root
        values, _ = normalize_segments(translations.get(unit, segments), segments, protected)
        for node, value in zip(nodes, values if values is not None else segments):
            node.text = value
            if value[:1] == " " or value[-1:] == " ":
                node.set(XML_SPACE, "preserve")
            else:
                node.attrib.pop(XML_SPACE, None)
        set_direction(root, paragraph, rtl, language, font)
    out = io.BytesIO()
    with open_package(data) as z, zipfile.ZipFile(out, "w") as target:
        for i in z.infolist():
            target.writestr(i, ET.tostring(roots[i.filename], encoding="UTF-8", xml_declaration=True) if i.filename in roots else z.read(i.filename))
    if zipfile.ZipFile(io.BytesIO(out.getvalue())).testzip() is not None:
        raise BadPackage("the written package is corrupt")
    return out.getvalue()


def _child(parent: ET.Element, name: str, first: bool = False) -> ET.Element:
    e = parent.find(w(name))
    if e is None:
        e = ET.Element(w(name))
        parent.insert(0, e) if first else parent.append(e)
    return e


def _style(paragraph: ET.Element) -> Iterator[ET.Element]:
    """The properties of a paragraph's own runs; those of paragraphs inside it are left out."""
    waiting = list(paragraph)
    while waiting:
        e = waiting.pop(0)
        if e.tag == w("r"):
            yield _child(e, "rPr", first=True)
        if e.tag != w("p"):
            waiting[:0] = list(e)


def set_direction(root: ET.Element, paragraph: ET.Element, rtl: bool, language: str, font: str) -> None:
    """Direction, alignment, language and font of a paragraph and its runs, and of the tables around it.

    A flag of the direction is written for a text from right to left, and else only where there is one to turn."""

    def flag(properties: ET.Element, name: str, always: bool = rtl) -> None:
        if always or properties.find(w(name)) is not None:
            _child(properties, name).set(w("val"), str(int(rtl)))

    def attributes(properties: ET.Element, name: str, values: dict[str, str], first: bool = False) -> None:
        _child(properties, name, first).attrib.update({w(k): v for k, v in values.items()})

    own = _child(paragraph, "pPr", first=True)
    flag(own, "bidi")
    align = own.find(w("jc"))
    if align is not None and align.get(w("val")) == ("left" if rtl else "right"):
        align.set(w("val"), "right" if rtl else "left")
    for table in root.iter(w("tbl")):
        if paragraph in list(table.iter(w("p"))):
            flag(_child(table, "tblPr", first=True), "bidiVisual", always=True)
    for style in _style(paragraph):
        flag(style, "rtl")
        attributes(style, "lang", {"val": LOCALES[language]})
        if font and rtl:
            attributes(style, "rFonts", {"cs": font, "eastAsia": font}, first=True)
        elif font and not _child(style, "rFonts", first=True).get(w("ascii")):
            attributes(style, "rFonts", {"ascii": font, "hAnsi": font}, first=True)


def build_docx(spark: SparkSession, path: str, translations: DataFrame, language: str, font: str = "") -> DataFrame:
    """(path, content, error): every package rewritten with ``translations`` (path, unit_id, segments)."""
    ship(spark)
    per_file = translations.groupBy("path").agg(F.collect_list(F.struct("unit_id", "segments")).alias("units"))  # a package is one file, within the limits above

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data, units in zip(b["path"], b["content"], b["units"]):
                known = {u["unit_id"]: list(u["segments"]) for u in (units if units is not None else [])}
                try:
                    rows.append((path, write_back(bytes(data), known, language, font), None))
                except BadPackage as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").join(per_file, "path", "left")
    return files.mapInPandas(run, "path string, content binary, error string")
