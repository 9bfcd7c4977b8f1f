"""Reports: JSON, Markdown, SARIF 2.1.0 and text, of one audit or one folder; and results of a corpus as SARIF rows."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from compliq.functions.text import shorten
from compliq.plans.detail import describe
from compliq.plans.spec import SEVERITIES

FORMATS = ("terminal", "json", "markdown", "sarif")
PLACES_SHOWN, EVIDENCE_SHOWN, SARIF_PLACES, SARIF_EVIDENCE = 10, 12, 20, 5


#: SARIF levels: by status where that decides, else by severity.
BY_STATUS = {"ERROR": "error", "WARNING": "warning"}
BY_SEVERITY = {"critical": "error", "major": "error", "minor": "warning", "info": "note"}


def sarif_level(status: Column, severity: Column) -> Column:
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(BY_STATUS), status), F.try_element_at(table(BY_SEVERITY), severity))


def _level(e: dict) -> str:
    return BY_STATUS.get(e["result"]["status"]) or BY_SEVERITY[e["requirement"]["severity"]]


def render(report: dict[str, Any], fmt: str, verbose: bool = False) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"Unknown format '{fmt}'. Choose from: {', '.join(FORMATS)}")
    if fmt == "json":
        return json.dumps(report, indent=2, ensure_ascii=False) + "\n"
    if fmt == "sarif":
        return json.dumps(sarif(report), indent=2, ensure_ascii=False) + "\n"
    return markdown(report) if fmt == "markdown" else terminal(report, verbose)


def view(e: dict) -> dict[str, Any]:
    """What is shown of one entry."""
    r, q = e["result"], e["requirement"]
    where = list(dict.fromkeys(map(describe, r["locations"])))
    tested = r["checker"] and r["status"] != "UNVERIFIED"
    return {
        "heading": f"{r['status']} {q['id']}", "requirement": q["source_text"] or q["description"], "expected": r["expected"], "found": r["actual"], "where": where[:PLACES_SHOWN],
        "more": max(0, len(where) - PLACES_SHOWN), "evidence": [shorten(x, 300) for x in r["evidence"][:EVIDENCE_SHOWN]], "reason": r["message"] if r["status"] in ("UNVERIFIED", "ERROR", "FAIL") else None,
        "hint": r["hint"], "how": f"checker `{r['checker']}` ({q['verification_type']})" if tested else f"{q['verification_type']} requirement",
    }


def _groups(report: dict, passes: bool) -> list[tuple[str, list[dict]]]:
    """Entries by status, worst severities first, otherwise in the specification's order."""
    out = []
    for s in ("FAIL", "ERROR", "WARNING", "UNVERIFIED", *(("PASS",) if passes else ())):
        if group := sorted((e for e in report["entries"] if e["result"]["status"] == s), key=lambda e: SEVERITIES.index(e["requirement"]["severity"])):
            out.append((s, group))
    return out


def _score(x: float | None) -> str:
    return "not available (nothing was verified)" if x is None else f"{x}%"


def terminal(report: dict, verbose: bool = False) -> str:
    s, c = report["summary"], report["coverage"]
    lines = [f"{report['specification']['name']}: {report['document']['path'] or report['document']['file_type']}", "", "  ".join(f"{k}: {n}" for k, n in s["counts"].items()), f"Compliance: {_score(s['compliance_score'])}   Verification coverage: {_score(s['verification_coverage'])}"]
    lines += [f"Not decided: {k} x {n}" for k, n in c["reasons"].items()] + [f"Note: {n}" for n in [*report["notices"], *c["notes"]]]
    for _, group in _groups(report, verbose):
        for e in group:
            v = view(e)
            lines += ["", f"{v['heading']}  {v['requirement']}"]
            lines += [f"    {k}: {v[k.lower()]}" for k in ("Expected", "Found", "Reason") if v[k.lower()]]
            lines += [f"    At: {w}" for w in v["where"]] + ([f"    ... and {v['more']} more places"] if v["more"] else []) + [f"    {x}" for x in v["evidence"]]
            lines += [f"    Fix: {v['hint']}"] if v["hint"] else []
    return "\n".join(lines) + "\n"


def markdown(report: dict) -> str:
    cell = lambda t: str(t or "").replace("|", "\\|").replace("\n", " ")
    s, c, d = report["summary"], report["coverage"], report["document"]
    lines = [f"# {report['specification']['name']}", "", f"Document: {d['path'] or '(text)'} ({d['file_type']}, {d['word_count']:,} words)  ", f"Generated: {report['generated_at']}", "", "| Status | Count |", "|---|---|"]
    lines += [f"| {k} | {n} |" for k, n in s["counts"].items()]
    lines += ["", f"Compliance: {_score(s['compliance_score'])}. Verification coverage: {_score(s['verification_coverage'])}. Decided: {c['decided']} of {c['items']}.", *(f"\n> {n}" for n in [*report["notices"], *c["notes"]])]
    for status, group in _groups(report, False):
        lines += ["", f"## {status}"]
        for e in group:
            v = view(e)
            lines += ["", f"### {e['requirement']['id']} ({e['requirement']['severity']})", "", v["requirement"], "", "| | |", "|---|---|"]
            lines += [f"| {k} | {cell(v[k.lower()])} |" for k in ("Expected", "Found", "Reason") if v[k.lower()]]
            lines += [f"| Where | {cell('; '.join(v['where']))} |"] if v["where"] else []
            lines += [f"| Checked by | {cell(v['how'])} |", *([f"| Fix | {cell(v['hint'])} |"] if v["hint"] else []), "", *(f"- {x}" for x in v["evidence"])]
    if passes := [e for e in report["entries"] if e["result"]["status"] == "PASS"]:
        lines += ["", "## PASS", "", "| Requirement | Expected | Found |", "|---|---|---|"]
        lines += [f"| {e['requirement']['id']}: {cell(e['requirement']['description'])} | {cell(e['result']['expected'])} | {cell(e['result']['actual'])} |" for e in passes]
    return "\n".join(lines) + "\n"


def sarif(report: dict) -> dict[str, Any]:
    path = report["document"]["path"]
    uri = "document" if not path else Path(path).as_uri() if path.startswith("/") else quote(path, safe="/:@-._~")
    bad = [e for e in report["entries"] if e["result"]["status"] in ("FAIL", "ERROR", "WARNING")]
    rules = {e["requirement"]["id"]: {"id": e["requirement"]["id"], "shortDescription": {"text": e["requirement"]["description"]}, "properties": {"severity": e["requirement"]["severity"], "checker": e["requirement"]["checker"]}} for e in bad}
    index = {k: i for i, k in enumerate(rules)}

    def at(loc: dict | None) -> dict[str, Any]:
        line = loc["line"] if loc and loc["line"] is not None else None
        region = {"startLine": line or 1} | ({"snippet": {"text": loc["excerpt"]}} if line and loc["excerpt"] else {})
        return {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": region}} | ({"logicalLocations": [{"name": describe(loc), "kind": "member"}]} if loc else {})

    results = []
    for e in bad:
        r = e["result"]
        text = "\n".join([r["message"], *r["evidence"][:SARIF_EVIDENCE]])
        results.append({"ruleId": e["requirement"]["id"], "ruleIndex": index[e["requirement"]["id"]], "level": _level(e), "message": {"text": text}, "locations": [at(x) for x in (r["locations"][:SARIF_PLACES] or [None])]})
    run = {
        "tool": {"driver": {"name": "compliq", "version": report["version"], "rules": list(rules.values())}}, "results": results,
        "properties": {"unverified": [e["requirement"]["id"] for e in report["entries"] if e["result"]["status"] == "UNVERIFIED"], "complianceScore": report["summary"]["compliance_score"], "verificationCoverage": report["summary"]["verification_coverage"]},
    }
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}


def render_project(report: Any, fmt: str) -> str:
    """A folder's report as terminal text, Markdown or JSON."""
    if fmt == "json":
        return json.dumps(report.to_dict(), indent=2, ensure_ascii=False) + "\n"
    if fmt not in ("terminal", "markdown"):
        raise ValueError(f"Unknown format '{fmt}'. Choose from: terminal, json, markdown")
    title = {"done": "Done check", "context": "Context lint", "scope": "Scope fence"}[report.kind]
    lines = [("# " if fmt == "markdown" else "") + title, "", "  ".join(f"{k}: {n}" for k, n in report.counts().items() if n), ""]
    for r in report.results:
        lines += [f"{r.status:<10} {r.requirement_id}  {r.message}", *(f"    {x}" for x in r.evidence), *([f"    Fix: {r.hint}"] if r.hint else [])]
    lines += [] if report.results else ["No findings."]
    return "\n".join(lines + [x for n in report.notices for x in ("", f"Note: {n}")]) + "\n"
