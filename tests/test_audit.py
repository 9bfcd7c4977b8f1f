import json
import random
import time

import pytest
from pyspark.sql import functions as F

from compliq import audit
from compliq.plans import detail
from compliq.plans.spec import SpecificationError, load, validate
from compliq.sources import documents
from tests.helpers import build_docx, md, run_rule, spec, txt
from tests.test_rules import OMNIBUS

RULES = [
    ("word_count", {"min": 5, "max": 40}), ("word_count", {"max": 12, "count_method": "whitespace", "exclude_sections": ["References", "nope"], "include_tables": False}),
    ("forbidden_text", {"values": ["climate", "climate change", "Straße"]}), ("forbidden_text", {"value": "cat", "whole_word": True, "exclude_code_blocks": True, "include_headings": False}),
    ("required_text", {"values": ["One", "two", "ONE"]}), ("required_text", {"values": ["alpha", "first"], "require": "any", "within": "first_paragraph"}), ("required_text", {"value": "words", "within": "last_paragraph", "case_sensitive": True}),
    ("forbidden_punctuation", {"marks": ["em dashes", "!", "curly quotes"], "max_allowed": 1}), ("forbidden_regex", {"pattern": r"\d{4}"}), ("required_regex", {"patterns": ["[a-z]+", "zzz"], "require": "any"}),
    ("occurrences", {"text": "one", "between": [1, 2]}), ("occurrences", {"pattern": "o.", "max": 2}), *[("element_count", {"element": e, "exact": 1}) for e in ("bullets", "list_items", "headings", "tables", "code_blocks", "paragraphs", "references")],
    ("element_count", {"element": "headings", "level": 2, "max": 0}), ("required_section", {"headings": ["Introduction", ["Sub", "Scope"]]}), ("required_section", {"headings": ["Sub", "Title"], "ordered": True}),
    ("required_section", {"headings": ["ref"], "exact": False, "require": "any"}), ("required_section", {"headings": ["Title"], "case_sensitive": True}), ("preserve_text", {"texts": ["one two", "Two line paragraph"]}),
    ("preserve_text", {"text": "ONE TWO", "case_sensitive": False, "normalize_quotes": True}), ("spelling_variant", {"variant": "british", "allow": ["center"]}), ("spelling_variant", {"variant": "american"}, "info"),
    ("file_type", {"extensions": ["md", "docx"]}), ("docx_format", {"margin_cm": 2.54, "font_name": "Arial", "line_spacing": 1.5}), ("docx_format", {"orientation": "landscape"}, "info"),
]
TEXTS = {
    "md": [OMNIBUS, "", "   ", "# Title\n\none two cat scatter CAT\n\n## Sub\n\nclimate\nchange — well! “done”\n\n# References\n\n- Smith 2020\n- color and \"colour\" and centre\n\n```\ncat\n```\n", "one\n\ntwo words", "STRASSE straße first\n\nThe organised center; one One"],
    "txt": ["INTRODUCTION\n\nTitle\n\nSub\n\nfirst words. One two\n\nlast words", "Scope\n\nReferences\n\n1. one\n2. two", "# Title\n\nx"],
}


def corpus(spark, tmp_path):
    frames = []
    for kind, texts in TEXTS.items():
        df = spark.createDataFrame([(f"{kind}{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
        frames.append(documents.from_text(df, kind))
    (tmp_path / "a.docx").write_bytes(build_docx())
    (tmp_path / "b.md").write_bytes(b"caf\xe9 one")
    (tmp_path / "c.txt").write_bytes(b"a\0b")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    frames.append(documents.from_files(spark, str(tmp_path)))
    return audit.union(frames)


def test_compiled_rules_agree_with_the_detail_path(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    bad = docs.where("error is not null").collect()
    assert {r.path.rsplit("/", 1)[1]: r.error.split(" (")[0] for r in bad} == {"c.txt": "the file looks binary", "d.pdf": "unsupported file type '.pdf'"}
    fast = {(r.doc_id, r.ord): r for r in audit.audit(docs, spec(*RULES)).collect()}
    slow = {(r.doc_id, r.ord): r for r in audit.audit_in_detail(docs, spec(*RULES)).collect()}
    assert fast.keys() == slow.keys() and len(fast) == len(RULES) * docs.count()
    for k, f in fast.items():
        s, rule = slow[k], RULES[k[1]]
        assert (f.status, f.confidence) == (s.status, s.confidence), (k, rule, f, s)
        if rule[0] not in ("preserve_text", "docx_format") and f.status != "UNVERIFIED":
            assert (f.expected, f.actual) == (s.expected, s.actual), (k, rule)


def test_what_cannot_be_read_never_passes(spark, tmp_path):
    docs = corpus(spark, tmp_path).where("error is not null")
    pattern = ("forbidden_regex", {"pattern": "x"})  # decided in Python, the others by columns
    rules = spec(pattern, ("word_count", {"max": 5}), ("forbidden_text", {"value": "x"}))
    rules["requirements"].append({"id": "M", "description": "d", "verification_type": "manual"})
    rows = audit.audit(docs, rules).collect()
    assert len(rows) == 2 * 4 and {(r.status, r.n, r.confidence) for r in rows} == {("ERROR", 0, 0.0)} and all("unsupported" in r.actual or "binary" in r.actual for r in rows)
    full = audit.audit_in_detail(docs, rules).collect()
    assert len(full) == 2 * 4 and all(r.status == "ERROR" and "could not be read" in r.message for r in full)
    (score,) = {(r.n_error, r.n_pass, r.compliance_score, r.verification_coverage) for r in audit.scores(docs, rules).collect()}
    assert score == (4, 0, None, 0.0)
    assert all(r.word_count is None and "could not be read" in r.notices[0] for r in audit.document_info(docs).collect())
    results = audit.verdicts(docs, load(rules)).select(audit.blocking(F.col("results"), "critical").alias("b")).collect()
    assert all(len(r.b) == 0 for r in results)  # none of them is critical
    assert all(len(r.b) == 4 for r in audit.verdicts(docs, load(rules)).select(audit.blocking(F.col("results"), "any").alias("b")).collect())


GOLDEN = [(["PASS", "FAIL"], ["critical", "minor"], 80.0), (["WARNING"], ["info"], 50.0), (["UNVERIFIED"], ["major"], None), (["PASS"] * 15 + ["FAIL"] * 3 + ["UNVERIFIED"] * 7, ["major"] * 25, 83.3)]


@pytest.mark.parametrize("statuses,severities,score", GOLDEN)
def test_scores(spark, statuses, severities, score):
    weight = {"critical": 8.0, "major": 4.0, "minor": 2.0, "info": 1.0}
    rows = [(i, f"R{i}", None, v, "deterministic", weight[v], s, None, None, 0, 1.0) for i, (s, v) in enumerate(zip(statuses, severities))]
    df = spark.createDataFrame([(rows,)], f"results array<{audit.RESULT}>")
    cols = audit.summary(F.col("results")) | audit.coverage(F.col("results"))
    got = df.select(*[c.alias(k) for k, c in cols.items()], *[F.size(audit.blocking(F.col("results"), f)).alias(f"b_{f}") for f in audit.FAIL_ON]).first()
    entries = [{"requirement": {"severity": v, "verification_type": "deterministic", "effective_weight": weight[v]}, "result": {"status": s}} for s, v in zip(statuses, severities)]
    want = audit.summary_of(entries)
    assert got.compliance_score == want["compliance_score"] == score
    assert got.verification_coverage == want["verification_coverage"] and got.unweighted_compliance == want["unweighted_compliance"]
    cover = audit.coverage_of(entries)
    assert (got.items, got.decided, got.reasons, got.decided_share) == (cover["items"], cover["decided"], cover["reasons"], cover["decided_share"])
    assert [got[f"b_{f}"] for f in audit.FAIL_ON] == [len(audit.blocking_of(entries, f)) for f in audit.FAIL_ON]


def test_policy_thresholds():
    entries = [{"requirement": {"severity": s}, "result": {"status": "FAIL", "s": s}} for s in ("critical", "minor")] + [{"requirement": {"severity": "info"}, "result": {"status": "ERROR"}}]
    assert [len(audit.blocking_of(entries, f)) for f in ("critical", "major", "minor", "any", "none")] == [1, 1, 2, 3, 0]


def test_untested_requirements_are_never_passed(spark, tmp_path):
    s = {"name": "x", "requirements": [{"id": k, "description": "d", "verification_type": k} for k in ("semantic", "manual", "unsupported")]}
    docs = corpus(spark, tmp_path).where("error is null")
    assert {r.status for r in audit.audit(docs, s).collect()} == {"UNVERIFIED"}
    row = audit.scores(docs, s).first()
    assert row.compliance_score is None and row.verification_coverage == 0.0


def test_custom_rules_and_verifiers(spark, tmp_path):
    class Even(detail.CustomRule):
        summary = "An even number of blocks."

        def check(self, doc, config):
            return detail.Verdict("PASS" if len(doc["blocks"]) % 2 == 0 else "FAIL", "counted")

    s = {"name": "x", "requirements": [{"id": "a", "description": "d", "checker": "even"}]}
    out = audit.audit_one(md("a\n\nb"), load(s, registry={"even": Even()}), {"even": Even()})
    assert out["entries"][0]["result"]["status"] == "PASS"
    with pytest.raises(SpecificationError):
        load(s)


def test_validation():
    bad = {"name": "x", "requirements": [
        {"id": "a", "description": "d", "checker": "word_cuont"}, {"id": "a", "description": "d", "checker": "word_count", "parameters": {"maxx": 3}},
        {"id": "b", "description": "d", "verification_type": "deterministic"}, {"id": "c", "description": "d", "checker": "forbidden_regex", "parameters": {"pattern": "("}, "enabled": False},
    ]}
    text = " ".join(i.message for i in validate(bad)[1])
    for part in ("did you mean 'word_count'", "duplicate id 'a'", "did you mean 'max'", "needs a checker", "invalid regular expression"):
        assert part in text
    _, issues = validate({"name": "", "requirements": [{"id": "!", "description": "", "severity": "huge", "weight": 0, "colour": 1}]})
    assert len(issues) == 6
    assert [i.message for i in validate({"name": "x", "requirements": []})[1]] == ["the specification has no requirements"]


def test_report_of_one_document():
    s = spec(("word_count", {"min": 1}), ("forbidden_text", {"value": "x"}, "info"))
    out = audit.audit_one(txt("x y"), s)
    assert out["summary"]["counts"]["WARNING"] == 1 and out["document"]["word_count"] == 2 and json.dumps(out)


PRESERVED = ["a“b” c d\te f", "Straße Änderung ŒUVRE é É ok", "one two three four five", "two three four five six seven", "three four five one two three", "x", "five six", "  spaced   out  words of\nan item ", "no such words in any text"]
PRESERVED += [f"item {i} of many\xa0items here" for i in range(12)] + ["e f one two three", "ο δος straße a b c d e"]


@pytest.mark.parametrize("flags", [{}, {"case_sensitive": False}, {"normalize_quotes": True}, {"normalize_whitespace": False}, {"case_sensitive": False, "normalize_whitespace": False, "normalize_quotes": True}])
def test_many_protected_items_are_counted_as_one_by_one(spark, flags):
    rng, bits = random.Random(5), " one two three four five six seven x item of many items here STRASSE straße änderung œuvre é É ok".split(" ") + PRESERVED + [x.replace(" ", "\n\n") for x in PRESERVED]
    texts = [rng.choice([" ", "\n", "  ", "\xa0", "\n\n"]).join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(60)]
    docs = documents.from_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: (r.status, r.n) for r in audit.audit(docs, spec(("preserve_text", {"texts": PRESERVED} | flags))).collect()}
    assert len({n for _, n in got.values()}) > 8
    for i, t in enumerate(texts):
        bad = [x for x in PRESERVED if run_rule(txt(t), "preserve_text", text=x, **flags).status != "PASS"]
        assert got[str(i)] == ("FAIL" if bad else "PASS", len(bad)), (t, bad)


def test_a_text_is_put_in_normal_form_once_however_many_items_are_protected(spark):
    text, items = "the words of a long text, " * 4000, [f"protected words of the passage number {i} in its own wording" for i in range(200)]
    docs = documents.from_text(spark.createDataFrame([(i, text + items[i]) for i in range(4)], "doc_id long, text string").coalesce(1)).cache()
    docs.count()
    start = time.time()
    assert {r.n for r in audit.audit(docs, spec(("preserve_text", {"texts": items}))).collect()} == {199}
    assert time.time() - start < 15
