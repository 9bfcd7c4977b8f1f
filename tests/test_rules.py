import pytest

from compliq.functions import lexicon
from compliq.plans.detail import describe, word_diff
from compliq.plans.spec import ParameterError, config
from compliq.sources import documents
from compliq.sources.documents import DocumentError, decode, parse_bytes
from tests.helpers import build_docx, md, run_rule, txt


@pytest.mark.parametrize("text,n", [("well-known don't stop", 3), ("Revenue was 1,500 or 3.14 units", 6), ("# Title — **bold** - item", 3)])
def test_words(text, n):
    assert run_rule(md(text), "word_count", exact=n).status == "PASS"
    assert run_rule(txt("a — b"), "word_count", exact=3, count_method="whitespace").status == "PASS"


def test_word_count_scope_and_text():
    doc = md("# Body\n\none two three\n\nfour five six\n\n# References\n\nseven eight")
    assert run_rule(doc, "word_count", exact=10).status == "PASS"
    v = run_rule(doc, "word_count", at_least=11, exclude_sections=["references", "Missing"])
    assert (v.status, v.expected, v.actual, v.hint) == ("FAIL", "at least 11 words", "7 words (short by 4)", "Add content.")
    assert 'Excluded section "missing" was not found' in v.evidence[1]
    assert run_rule(txt(""), "word_count", max=5).status == "PASS" and run_rule(txt(""), "word_count", min=1).status == "FAIL"


def test_literals():
    doc = md("The climate\nchange is climate.\n\n| a | climate change |\n|---|---|\n| x | y |")
    v = run_rule(doc, "forbidden_text", values=["climate change", "climate"])
    assert v.details["by_value"] == {"climate change": 2, "climate": 1} and v.actual == "3 occurrences"
    assert describe(v.locations[2]) == "line 4, table 1, row 1, column 2"
    assert run_rule(md("climate change"), "required_text", values=["climate", "climate change"]).details["missing"] == ["climate"]
    assert run_rule(md("scatter"), "forbidden_text", value="cat", whole_word=True).status == "PASS"
    assert run_rule(md("A a"), "forbidden_text", values=["a"], case_sensitive=True).details["occurrences"] == 1


def test_required_text_within():
    doc = md("# Title\n\nfirst words\n\nmiddle\n\nlast words")
    assert run_rule(doc, "required_text", value="first", within="first_paragraph").status == "PASS"
    assert run_rule(doc, "required_text", value="first", within="last_paragraph").status == "FAIL"
    assert run_rule(md("# Only"), "required_text", value="x", within="first_paragraph").status == "UNVERIFIED"
    assert run_rule(doc, "required_text", values=["middle", "absent"], require="any").actual == 'Found: "middle"'


@pytest.mark.parametrize("name", ["em dash", "em-dashes", "em_dash", "—"])
def test_punctuation(name):
    doc = txt("a — b — c")
    assert run_rule(doc, "forbidden_punctuation", mark=name).status == "FAIL"
    assert run_rule(doc, "forbidden_punctuation", mark=name, max_allowed=2).status == "PASS"
    with pytest.raises(ParameterError):
        config("forbidden_punctuation", {"mark": "word"})


def test_regex_rules_and_timeout():
    doc = md("one\ntwo 2020\n\nthree 2021")
    assert run_rule(doc, "forbidden_regex", pattern=r"\d{4}").actual == "2 matches"
    assert run_rule(doc, "required_regex", patterns=[r"^two", "absent"], flags=["multiline"], require="any").actual == "1 of 2 patterns matched"
    assert run_rule(txt("a" * 60 + "b"), "forbidden_regex", pattern=r"(a|aa)+$").status == "ERROR"
    for bad in ("(", "x" * 1001, "a*", ""):
        with pytest.raises(ParameterError):
            config("forbidden_regex", {"pattern": bad})


def test_occurrences():
    doc = txt("red red blue")
    assert run_rule(doc, "occurrences", text="red", exact=2).status == "PASS"
    assert run_rule(doc, "occurrences", text="red", between=[3, 4]).actual == "2 occurrences (short by 1)"
    assert run_rule(doc, "occurrences", pattern="r.d", max=1).actual == "2 occurrences (over by 1)"


OMNIBUS = "---\nauthor: me\n---\n# Title\n\nTwo line\nparagraph\n\n- one\n- two\n  more\n\n1. first\n\n> quote\n> more\n\n```python\nx = '# no heading'\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nSub\n---\n\n***\nafter\n"


def test_markdown_blocks():
    kinds = [(b["kind"], b["line"]) for b in md(OMNIBUS)["blocks"] if b["kind"] != "table_cell"]
    assert kinds == [("heading", 4), ("paragraph", 6), ("list_item", 9), ("list_item", 10), ("list_item", 13), ("quote", 15), ("code", 18), ("table", 22), ("heading", 26), ("paragraph", 30)]
    assert md(OMNIBUS)["meta"]["front_matter"] == "author: me"
    assert md("a [link](x) **b** `c` ~~d~~ *e* _f_ <!-- g --> ![h](i)")["blocks"][0]["text"] == "a link b c d e f  h"


def test_text_headings():
    doc = txt("INTRODUCTION\n\n2.1 Sub topic\n\nShort line\n\nA full sentence ends here.\n")
    assert [(b["kind"], b["level"], b["candidate"]) for b in doc["blocks"]] == [("heading", 1, False), ("heading", 2, False), ("paragraph", None, True), ("paragraph", None, False)]


@pytest.mark.parametrize("element,n", [("bullets", 2), ("numbered_items", 1), ("list_items", 3), ("headings", 2), ("tables", 1), ("code_blocks", 1), ("paragraphs", 3), ("references", 0)])
def test_elements(element, n):
    assert run_rule(md(OMNIBUS), "element_count", element=element, exact=n).status == "PASS"


def test_references_and_levels():
    doc = md("# A\n\n## B\n\n# References\n\n- one\n- two\n\n## Sub\n\nthree\n\n# After\n\nfour")
    v = run_rule(doc, "element_count", element="references", min=4)
    assert (v.actual, v.confidence) == ("3 references (short by 1)", 0.8)
    assert run_rule(doc, "element_count", element="headings", level=2, exact=2).status == "PASS"


def test_sections():
    doc = md("# 1. Introduction\n\n# Methods\n\n# Discussion:\n")
    assert run_rule(doc, "required_section", headings=["Introduction", ["Methodology", "Methods"]], ordered=True).status == "PASS"
    v = run_rule(doc, "required_section", headings=["Methods", "Introduction"], ordered=True)
    assert v.status == "FAIL" and v.actual == "Order found: Introduction, Methods"
    v = run_rule(doc, "required_section", headings=["Conclusion", "Discussions"])
    assert v.actual == "Missing: Conclusion, Discussions" and '"Discussions" is close to existing heading "Discussion:"' in v.evidence
    v = run_rule(txt("Summary\n\nText goes here."), "required_section", headings=["Summary"])
    assert (v.status, v.confidence) == ("PASS", 0.8)


def test_preservation():
    doc = md('Q1. What are the major risks?\n\nThe "quoted" part\nwraps here.')
    assert run_rule(doc, "preserve_text", text="What are the major risks?").status == "PASS"
    v = run_rule(doc, "preserve_text", text="Q1. What the risks?")
    assert v.status == "FAIL" and v.details["changed"] == 1 and "{+are+}" in v.evidence[2]
    assert run_rule(doc, "preserve_text", text="nothing similar at all").details["missing"] == 1
    assert run_rule(doc, "preserve_text", text="The “quoted” part wraps here.", normalize_quotes=True).status == "PASS"
    assert run_rule(doc, "preserve_text", text="q1. what", case_sensitive=False).status == "PASS"
    assert run_rule(md("one two\n\nthree four"), "preserve_text", text="two three").status == "PASS"
    assert word_diff("a b c", "a x c") == "a [-b-]{+x+} c"


def test_spelling():
    assert lexicon.SPELLING_PAIRS == 137
    doc = txt('The color and "color" of organised centres, organized.')
    v = run_rule(doc, "spelling_variant", variant="british")
    assert v.details["other_variant_words"] == {"color": 1} and v.details["ignored_in_quotes"] == {"color": 1}
    assert run_rule(doc, "spelling_variant", variant="american").details["other_variant_words"] == {"organised": 1, "centres": 1}
    assert run_rule(doc, "spelling_variant", variant="british", allow=["Color"]).confidence == 0.75


def test_docx():
    doc = parse_bytes(build_docx(), "/x/thesis.docx")
    kinds = [(b["kind"], b["level"], b["marker"]) for b in doc["blocks"] if b["kind"] != "table_cell"]
    assert kinds[:6] == [("heading", 1, None), ("heading", 1, None), ("paragraph", None, None), ("heading", 2, None), ("list_item", None, "bullet"), ("list_item", None, "bullet")]
    assert kinds[-1][0] == "table" and [b["text"] for b in doc["blocks"] if b["kind"] == "table_cell"] == ["a", "b", "c", "d"]
    assert run_rule(doc, "docx_format", margin_cm=2.54, orientation="portrait", font_name="arial", font_size_pt=11, line_spacing=1.5).status == "PASS"
    assert run_rule(doc, "docx_format", margins_cm={"top": 2.0}).actual == "section 1 top margin: 2.54 cm (required 2.0 cm)"
    assert run_rule(md("x"), "docx_format", margin_cm=2).status == "UNVERIFIED"
    assert run_rule(doc, "file_type", extensions=["docx"]).status == "PASS" and run_rule(doc, "file_type", extensions=["markdown"]).status == "FAIL"
    for bad in (b"PK", b"not a zip"):
        with pytest.raises(DocumentError):
            parse_bytes(bad, "a.docx")


def test_decoding():
    assert decode(b"\xef\xbb\xbfa\r\nb\rc") == ("a\nb\nc", "utf-8")
    assert decode("é".encode("utf-16"))[1] == "utf-16" and decode(b"caf\xe9") == ("café", "cp1252")
    for bad in (b"a\0b", b"\x81\x8d"):
        with pytest.raises(DocumentError):
            decode(bad)
    with pytest.raises(DocumentError):
        parse_bytes(b"", "a.pdf")


def test_info_is_advisory_and_errors_are_isolated():
    v = run_rule(txt("bad"), "forbidden_text", severity="info", value="bad")
    assert v.status == "WARNING" and v.message.endswith("(advisory: severity is info)")
    v = run_rule(txt("x " * 200), "forbidden_text", value="x")
    assert len(v.locations) == 50 and v.details["locations_total"] == 200


def test_own_extractors(monkeypatch):
    monkeypatch.setattr(documents, "EXTRACTORS", {})
    documents.register(".Log", "log", lambda data: ([{"position": i, "index": i, "kind": "paragraph", "text": t, "line": i} for i, t in enumerate(data.decode().split("|"), 1)], {}))
    doc = parse_bytes(b"a b|c", "/x/y.LOG")
    assert doc["file_type"] == "log" and run_rule(doc, "word_count", exact=3).status == "PASS"
    for bad in ("md", "log", ""):
        with pytest.raises(ValueError):
            documents.register(bad, "x", None)
