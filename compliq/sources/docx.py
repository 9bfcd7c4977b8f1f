"""Word documents to blocks, from the package's XML. Guards refuse archives that expand unreasonably."""

from __future__ import annotations

import io
import re
import zipfile
from typing import Any
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_MEMBERS, MAX_EXPANDED = 5000, 250 * 1024 * 1024
_HEADING = re.compile(r"heading ?(\d)$", re.I)


class DocxError(ValueError):
    """The bytes are not a Word document that can be read."""


def _cm(twips: str | None) -> float | None:
    return None if twips is None else round(int(float(twips)) * 2.54 / 1440, 2)


def _text(p: ElementTree.Element) -> str:
    """Runs' text; tabs and breaks as white space."""
    parts = []
    for e in p.iter():
        if e.tag == W + "t":
            parts.append(e.text or "")
        elif e.tag == W + "tab":
            parts.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            parts.append("\n")
    return "".join(parts)


class _Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise DocxError("not a valid .docx file (not a ZIP archive)") from None
        members = self.zip.infolist()
        if len(members) > MAX_MEMBERS:
            raise DocxError("too many archive entries to be a normal .docx")
        if sum(m.file_size for m in members) > MAX_EXPANDED:
            raise DocxError("expands to an unreasonable size and was not opened")
        self.names = {m.filename for m in members}
        if "word/document.xml" not in self.names:
            raise DocxError("a ZIP archive but not a Word document")

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        data = self.zip.read(name)
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise DocxError("declares entities and was not opened")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise DocxError(f"could not be opened as a Word document ({e})") from e


def _val(e: ElementTree.Element | None, path: str, attr: str = "val") -> str | None:
    found = None if e is None else e.find(path.replace("w:", W))
    return None if found is None else found.get(W + attr)


class _Styles:
    def __init__(self, root: ElementTree.Element | None):
        styles = [] if root is None else root.findall(W + "style")
        self.by_id = {s.get(W + "styleId"): s for s in styles}
        self.default = next((s for s in styles if s.get(W + "type") == "paragraph" and s.get(W + "default") in ("1", "true")), None)

    def name(self, style_id: str | None) -> str:
        s = self.by_id.get(style_id, self.default if style_id is None else None)
        return (_val(s, "w:name") or "") if s is not None else ""

    def normal(self) -> ElementTree.Element | None:
        return next((s for s in self.by_id.values() if _val(s, "w:name") == "Normal"), None)


def _level(p: ElementTree.Element, style_id: str | None, name: str) -> int | None:
    for n in (name, style_id or ""):
        if m := _HEADING.match(n):
            return int(m[1])
        if n.lower() == "title":
            return 1
    outline = _val(p, "w:pPr/w:outlineLvl")
    return int(outline) + 1 if outline and outline.isdigit() else None


def _marker(p: ElementTree.Element, name: str, numbering: ElementTree.Element) -> str | None:
    low = name.lower()
    if low.startswith("list bullet"):
        return "bullet"
    if low.startswith("list number"):
        return "numbered"
    num = _val(p, "w:pPr/w:numPr/w:numId")
    if num is None:
        return None
    ilvl = _val(p, "w:pPr/w:numPr/w:ilvl") or "0"
    abstract = next((_val(n, "w:abstractNumId") for n in numbering.findall(W + "num") if n.get(W + "numId") == num), None)
    if abstract is None:
        return "unknown"
    for a in numbering.findall(W + "abstractNum"):
        if a.get(W + "abstractNumId") == abstract:
            for level in a.findall(W + "lvl"):
                if level.get(W + "ilvl") == ilvl:
                    return "bullet" if _val(level, "w:numFmt") == "bullet" else "numbered"
    return "numbered"


def _meta(pkg: _Package, body: ElementTree.Element, styles: _Styles) -> dict[str, Any]:
    core = pkg.xml("docProps/core.xml")
    found = {} if core is None else {e.tag.rsplit("}", 1)[-1]: (e.text or None) for e in core}
    meta: dict[str, Any] = {"title": found.get("title"), "author": found.get("creator"), "last_modified_by": found.get("lastModifiedBy"), "created": found.get("created"), "modified": found.get("modified")}
    sections = []
    for s in body.iter(W + "sectPr"):
        sections.append({
            "orientation": "landscape" if _val(s, "w:pgSz", "orient") == "landscape" else "portrait", "page_width_cm": _cm(_val(s, "w:pgSz", "w")), "page_height_cm": _cm(_val(s, "w:pgSz", "h")),
            **{f"margin_{side}_cm": _cm(_val(s, "w:pgMar", side)) for side in ("top", "bottom", "left", "right")},
        })
    meta["sections"] = sections
    normal = styles.normal()
    meta["default_font_name"] = _val(normal, "w:rPr/w:rFonts", "ascii")
    size = _val(normal, "w:rPr/w:sz")
    meta["default_font_size_pt"] = None if size is None else int(size) / 2
    line, rule = _val(normal, "w:pPr/w:spacing", "line"), _val(normal, "w:pPr/w:spacing", "lineRule")
    meta["default_line_spacing"] = round(int(line) / 240, 2) if line is not None and rule in (None, "auto") else None
    if line is not None and rule not in (None, "auto"):
        meta["default_line_spacing_pt"] = int(line) / 20
    return meta


def parse(data: bytes) -> tuple[list[dict[str, Any]], dict[str, Any]]:
    """Blocks in body order (empty paragraphs are skipped) and metadata."""
    pkg = _Package(data)
    root = pkg.xml("word/document.xml")
    body = None if root is None else root.find(W + "body")
    if body is None:
        raise DocxError("has no body")
    styles, numbering = _Styles(pkg.xml("word/styles.xml")), pkg.xml("word/numbering.xml")
    blocks: list[dict[str, Any]] = []
    paragraphs = tables = 0
    for child in body:
        if child.tag == W + "p" and (text := _text(child).strip()):
            paragraphs += 1
            style_id = _val(child, "w:pPr/w:pStyle")
            name = styles.name(style_id)
            level = _level(child, style_id, name)
            marker = _marker(child, name, numbering) if level is None and numbering is not None else None
            blocks.append({"position": len(blocks) + 1, "index": paragraphs, "kind": "heading" if level else "list_item" if marker else "paragraph", "text": text, "level": level, "marker": marker, "style": name or None})
        elif child.tag == W + "tbl":
            tables += 1
            rows, above = [], {}
            for tr in child.findall(W + "tr"):
                cells, col = [], 0
                for tc in tr.findall(W + "tc"):
                    merge = tc.find(f"{W}tcPr/{W}vMerge")
                    if merge is None or merge.get(W + "val") == "restart":
                        above[col] = "\n".join(_text(p) for p in tc.findall(W + "p")).strip()
                    cells.append(above.get(col, ""))  # one that continues a merge shows the text above
                    col += int(_val(tc, "w:tcPr/w:gridSpan") or 1)
                rows.append(cells)
            blocks.append({"position": len(blocks) + 1, "index": tables, "kind": "table", "text": "", "rows": rows})
    return blocks, _meta(pkg, body, styles)
