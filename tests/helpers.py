"""Documents, specifications and Word files for tests."""

import io
import zipfile

from compliq.plans.detail import check
from compliq.plans.spec import Requirement, config
from compliq.sources.documents import parse_text


def md(text):
    return parse_text(text, "md")


def txt(text):
    return parse_text(text, "txt")


def run_rule(doc, checker, severity="major", **params):
    config(checker, params)
    return check(doc, Requirement("R1", "a rule", checker=checker, parameters=params, severity=severity))


def spec(*rules):
    """rules: (checker, params[, severity])."""
    rows = [{"id": f"R{i}", "description": f"rule {i}", "checker": c, "parameters": p, **({"severity": s[0]} if s else {})} for i, (c, p, *s) in enumerate(rules)]
    return {"version": 1, "name": "test", "requirements": rows}


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
THESIS = [("Title", "A Thesis"), ("Heading1", "Introduction"), (None, "Opening words here."), ("Heading2", "Scope"), ("ListBullet", "one"), ("ListBullet", "two"), ("Heading1", "References"), (None, "Smith 2020."), (None, "Jones 2021.")]


def build_docx(paragraphs=THESIS, landscape=False, margin=1440, font="Arial", size=22, spacing=360, table=(("a", "b"), ("c", "d"))):
    para = lambda s, t: f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:tcPr/><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    tbl = "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in table) + "</w:tbl>" if table else ""
    orient = 'w:orient="landscape"' if landscape else ""
    sect = f'<w:sectPr><w:pgSz w:w="11906" w:h="16838" {orient}/><w:pgMar w:top="{margin}" w:bottom="{margin}" w:left="{margin}" w:right="{margin}"/></w:sectPr>'
    doc = f"<w:document {NS}><w:body>{''.join(para(*p) for p in paragraphs)}<w:p/>{tbl}{sect}</w:body></w:document>"
    named = {"Title": "Title", "Heading1": "heading 1", "Heading2": "heading 2", "ListBullet": "List Bullet"}
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{v}"/></w:style>' for k, v in named.items())
    normal = f'<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:pPr><w:spacing w:line="{spacing}"/></w:pPr><w:rPr><w:rFonts w:ascii="{font}"/><w:sz w:val="{size}"/></w:rPr></w:style>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", doc)
        z.writestr("word/styles.xml", f"<w:styles {NS}>{normal}{styles}</w:styles>")
        z.writestr("word/numbering.xml", f"<w:numbering {NS}/>")
    return out.getvalue()
