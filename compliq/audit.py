"""Audits: a specification over parsed documents, with scores, coverage and policy.

``audit`` evaluates all compiled rules in one projection and the others in one Arrow pass over the same rows; results, scores and coverage
are functions of the document's row, so nothing is shuffled however many documents there are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compliq.plans import detail, native
from compliq.plans.spec import SEVERITIES, STATUSES, Requirement, Specification, load, load_yaml, validate

RESULT = "struct<ord:int,requirement_id:string,checker:string,severity:string,kind:string,weight:double,status:string,expected:string,actual:string,n:bigint,confidence:double>"
FULL = (
    "doc_id string, ord int, requirement_id string, checker string, status string, message string, expected string, actual string, evidence array<string>, "
    "locations array<struct<line:int,paragraph:int,heading:string,table:int,row:int,column:int,excerpt:string>>, confidence double, hint string, details string"
)
_PLACES = pa.list_(pa.struct([(k, pa.int32() if k not in ("heading", "excerpt") else pa.string()) for k in detail.PLACE]))


def _row_doc(names: list[str], batch: pa.RecordBatch, i: int) -> dict[str, Any]:
    row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}
    return row | {"meta": json.loads(row["meta"] or "{}"), "blocks": row["blocks"] or []}


def _check(d: dict[str, Any], r: Requirement, base_dir, registry, verifier) -> detail.Verdict:
    if d.get("error") is not None:
        return detail.Verdict("ERROR", f"The document could not be read: {d['error']}", actual=d["error"], confidence=0.0, checker=r.checker, requirement_id=r.id)
    return detail.check(d, r, base_dir, registry, verifier)


def verdicts(docs: DataFrame, spec: Specification, registry: dict | None = None, verifier: Any = None) -> DataFrame:
    """``docs`` with ``results``: one RESULT per enabled requirement, in the specification's order.

    Where ``docs`` has ``error`` and it is not null, the document could not be read, and every requirement is an ERROR that says so.
    """
    doc = {k: F.col(k) for k in ("blocks", "path", "file_type", "meta")}
    facts, made, rest, columns = native.Facts(), {}, [], docs.columns
    for i, r in enumerate(spec.enabled):
        custom = bool(registry and r.checker in registry) or (verifier is not None and r.verification_type == "semantic")
        v = None if custom else native.compile_rule(r, doc, facts, spec.base_dir)
        if v is None:
            rest.append((i, r))
            v = F.element_at(F.col("_slow"), len(rest)).cast(native.VERDICT)
        made[f"_verdict{i}"] = v
    if rest:
        docs = _slow(docs, rest, spec.base_dir, registry, verifier)
    for step in [s for s in (*facts.steps, made) if s]:
        docs = docs.withColumns(step)
    results = []
    for i, r in enumerate(spec.enabled):
        fixed = {"ord": F.lit(i), "requirement_id": F.lit(r.id), "checker": F.lit(r.checker), "severity": F.lit(r.severity), "kind": F.lit(r.verification_type), "weight": F.lit(float(r.effective_weight))}
        v = F.col(f"_verdict{i}")
        if "error" in columns:
            v = F.when(F.col("error").isNotNull(), unread(F.col("error"))).otherwise(v)
        results.append(F.struct(*[c.alias(k) for k, c in fixed.items()], *[v[k].alias(k) for k in ("status", "expected", "actual", "n", "confidence")]).cast(RESULT))
    return docs.select(*columns, (F.array(*results) if results else F.array().cast(f"array<{RESULT}>")).alias("results"))


def unread(error: Column) -> Column:
    """The verdict on a document that could not be read."""
    return F.struct(F.lit("ERROR").alias("status"), F.lit(None).alias("expected"), error.alias("actual"), F.lit(0).alias("n"), F.lit(0.0).alias("confidence")).cast(native.VERDICT)


def _slow(docs: DataFrame, rest: list[tuple[int, Requirement]], base_dir, registry, verifier) -> DataFrame:
    names = docs.columns
    kind = pa.list_(pa.struct([("status", pa.string()), ("expected", pa.string()), ("actual", pa.string()), ("n", pa.int64()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                d = _row_doc(names, b, i)
                vs = [_check(d, r, base_dir, registry, verifier) for _, r in rest]
                out.append([{"status": v.status, "expected": v.expected, "actual": v.actual, "n": next((x for x in v.details.values() if isinstance(x, int)), 0), "confidence": v.confidence} for v in vs])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*names, "_slow"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, _slow array<{native.VERDICT}>")


def audit(docs: DataFrame, spec: Any, registry: dict | None = None, verifier: Any = None) -> DataFrame:
    """One row per document and enabled requirement: doc_id and the fields of RESULT."""
    spec = load(spec, registry=registry)
    return exploded(verdicts(docs, spec, registry, verifier), "doc_id").select("doc_id", "r.*")


def exploded(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per result, as ``r``. The outer form spares the filter for empty arrays that Catalyst would infer, push below and
    so evaluate all rules twice for; a specification without requirements has no results at all."""
    return docs.select(*keep, F.explode_outer("results").alias("r")).where("r is not null")


def audit_in_detail(docs: DataFrame, spec: Any, registry: dict | None = None, verifier: Any = None) -> DataFrame:
    """As ``audit``, with messages, evidence, places, hints and details; all in Arrow batches."""
    return _detail(docs, load(spec, registry=registry), registry, verifier)


def explain(docs: DataFrame, spec: Any, registry: dict | None = None, verifier: Any = None, statuses: tuple[str, ...] = ("FAIL", "WARNING", "ERROR")) -> DataFrame:
    """``audit_in_detail`` of the results with one of the statuses: compiled rules find them, and only these are explained, in Arrow batches."""
    spec = load(spec, registry=registry)
    found = F.transform(F.filter("results", lambda r: r["status"].isin(*statuses)), lambda r: r["ord"])
    judged = verdicts(docs, spec, registry, verifier).withColumn("_asked", found).drop("results")
    return _detail(judged.where(F.size("_asked") > 0), spec, registry, verifier)


def _detail(docs: DataFrame, spec: Specification, registry, verifier) -> DataFrame:
    """Of all requirements, or of those whose numbers ``_asked`` lists."""
    base_dir, plans = spec.base_dir, list(enumerate(spec.enabled))
    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    asked = F.col("_asked") if "_asked" in docs.columns else F.lit(None).cast("array<int>")
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "file_type", "raw_text", "blocks", "meta", error.alias("error"), asked.alias("_asked"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                d = _row_doc(names, b, i)
                for k, r in plans:
                    if d["_asked"] is not None and k not in d["_asked"]:
                        continue
                    v = asdict(_check(d, r, base_dir, registry, verifier))
                    rows.append(v | {"doc_id": d["doc_id"], "ord": k, "details": json.dumps(v["details"], ensure_ascii=False)})
            kinds = [("doc_id", pa.string()), ("ord", pa.int32()), *((k, pa.string()) for k in ("requirement_id", "checker", "status", "message", "expected", "actual")), ("evidence", pa.list_(pa.string())), ("locations", _PLACES), ("confidence", pa.float64()), ("hint", pa.string()), ("details", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in kinds], names=[k for k, _ in kinds])

    return docs.mapInArrow(run, FULL)


def validate_table(specs: DataFrame, id_col: str = "doc_id", text_col: str = "spec") -> DataFrame:
    """A table of specifications in YAML to one row per issue: doc_id, ord, level, path, message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, issues = load_yaml(text or "")
                rows += [(i, k, x.level, x.path, x.message) for k, x in enumerate(issues or validate(data)[1])]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "ord", "level", "path", "message"])

    return specs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("spec")).mapInArrow(run, "doc_id string, ord int, level string, path string, message string")


# -- scores: functions of the array of results ----------------------------------------------------


def _sum(results: Column, of) -> Column:
    return F.aggregate(results, F.lit(0.0), lambda a, r: a + of(r))


def _n(results: Column, test) -> Column:
    return F.size(F.filter(results, test)).cast("bigint")


def _decided(r: Column) -> Column:
    return r["status"].isin("PASS", "FAIL", "WARNING")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half to even at one decimal; null where nothing was counted."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, 1))


def summary(results: Column, disabled: int = 0) -> dict[str, Column]:
    earned = _sum(results, lambda r: F.when(r["status"] == "PASS", r["weight"]).when(r["status"] == "WARNING", r["weight"] * 0.5).otherwise(0.0))
    possible = _sum(results, lambda r: F.when(_decided(r), r["weight"]).otherwise(0.0))
    size, decided = F.size(results).cast("bigint"), _n(results, _decided)
    passed = _n(results, lambda r: r["status"] == "PASS")
    out = {"total_requirements": size, "disabled_requirements": F.lit(disabled).cast("bigint"), "machine_verifiable": _n(results, lambda r: r["kind"] == "deterministic"), "verified": decided}
    with_status = lambda s: _n(results, lambda r: r["status"] == s)
    failed = lambda s: _n(results, lambda r: r["status"].isin("FAIL", "ERROR") & (r["severity"] == s))
    out |= {f"n_{s.lower()}": with_status(s) for s in STATUSES} | {f"failed_{s}": failed(s) for s in SEVERITIES}
    return out | {"compliance_score": percent(earned, possible), "unweighted_compliance": percent(passed, decided), "verification_coverage": percent(decided, size)}


def reason(r: Column) -> Column:
    """Why a result is undecided; null if it is decided."""
    return F.when(r["status"] == "ERROR", "checker_error").when(r["status"] == "UNVERIFIED", F.when(r["kind"] == "semantic", "semantic_judgement").when(r["kind"] == "manual", "human_judgement").otherwise("no_checker"))


def coverage(results: Column, disabled: int = 0) -> dict[str, Column]:
    reasons = F.array_compact(F.transform(results, reason))
    names = F.array_sort(F.array_distinct(reasons))
    counts = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.size(F.filter(reasons, lambda x: x == k)).cast("bigint"))))
    size, decided = F.size(results).cast("bigint"), _n(results, _decided)
    return {"items": size, "decided": decided, "undecided": size - decided, "decided_share": percent(decided, size), "reasons": counts, "suppressed": F.lit(disabled).cast("bigint")}


FAIL_ON = ("critical", "major", "minor", "any", "none")


def blocking(results: Column, fail_on: str = "any", unverified: bool = False) -> Column:
    """The results that breach the threshold. ERROR blocks, since what was not tested cannot be taken to pass."""
    if fail_on not in FAIL_ON:
        raise ValueError(f"fail_on must be one of {', '.join(FAIL_ON)}")
    worst = [] if fail_on == "none" else SEVERITIES if fail_on == "any" else SEVERITIES[: SEVERITIES.index(fail_on) + 1]
    return F.filter(results, lambda r: (r["status"].isin("FAIL", "ERROR") & r["severity"].isin(*worst, "")) | ((r["status"] == "UNVERIFIED") & F.lit(unverified)))


def scores(docs: DataFrame, spec: Any, registry: dict | None = None) -> DataFrame:
    """One row per document: the fields of its summary."""
    spec = load(spec, registry=registry)
    disabled = len(spec.requirements) - len(spec.enabled)
    return verdicts(docs, spec, registry).select("doc_id", *[c.alias(k) for k, c in summary(F.col("results"), disabled).items()])


def document_info(docs: DataFrame) -> DataFrame:
    """One row per document: words, paragraphs, headings, tables, and notices; of what could not be read only a notice."""
    b = F.col("blocks")
    words = native.total(native.units(b), lambda u: native.word_count(u["text"]))
    counts = {"word_count": words, "paragraphs": F.size(F.filter(b, lambda x: x["para"].isNotNull())), "headings": native.element_counts(b, "headings"), "tables": native.element_counts(b, "tables")}
    failed = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    counts = {k: F.when(failed.isNull(), c) for k, c in counts.items()}
    empty = F.when(failed.isNull() & ~F.coalesce(F.col("raw_text"), F.lit("")).rlike(r"(?U)\S"), "The document contains no text; rules that look for content will fail.")
    legacy = F.when(F.get_json_object("meta", "$.encoding") == "cp1252", "The file is not valid UTF-8; it was read as Windows-1252.")
    return docs.select("doc_id", "path", "file_type", "size_bytes", *[c.cast("bigint").alias(k) for k, c in counts.items()], F.array_compact(F.array(empty, legacy, F.concat(F.lit("The file could not be read: "), failed))).alias("notices"))


# -- one document on the driver -------------------------------------------------------------------


def py_round(x: float) -> float:
    return round(x * 100, 1)


def audit_one(doc: dict, spec: Any, registry: dict | None = None, verifier: Any = None) -> dict[str, Any]:
    """A full report of one parsed document, without Spark."""
    spec = load(spec, registry=registry)
    entries = [{"requirement": asdict(r) | {"effective_weight": r.effective_weight}, "result": asdict(detail.check(doc, r, spec.base_dir, registry, verifier))} for r in spec.enabled]
    disabled = len(spec.requirements) - len(spec.enabled)
    return report(doc, spec, entries, disabled)


def report(doc: dict, spec: Specification, entries: list[dict], disabled: int) -> dict[str, Any]:
    from datetime import UTC, datetime

    from compliq import __version__

    blocks, _ = detail.units(doc)
    notices = [] if (doc["raw_text"] or "").strip() else ["The document contains no text; rules that look for content will fail."]
    notices += ["The file is not valid UTF-8; it was read as Windows-1252."] if doc["meta"].get("encoding") == "cp1252" else []
    notices += [f"{disabled} disabled requirement(s) were skipped."] if disabled else []
    info = {
        "path": doc["path"], "file_type": doc["file_type"], "size_bytes": doc["size_bytes"], "word_count": sum(detail.words(b["text"]) for b in blocks),
        "paragraphs": sum(b["para"] is not None for b in doc["blocks"]), "headings": len(detail.headings(doc)), "tables": sum(b["kind"] == "table" for b in doc["blocks"]),
        "metadata": {k: v for k, v in doc["meta"].items() if k in ("encoding", "title", "author", "line_count")},
    }
    return {
        "schema_version": 1, "version": __version__, "generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "specification": {"name": spec.name, "description": spec.description},
        "document": info, "summary": summary_of(entries, disabled), "coverage": coverage_of(entries, disabled, len(spec.not_extracted)), "notices": notices, "entries": entries,
    }


def summary_of(entries: list[dict], disabled: int = 0) -> dict[str, Any]:
    status = [e["result"]["status"] for e in entries]
    decided = [e for e in entries if e["result"]["status"] in ("PASS", "FAIL", "WARNING")]
    credit = {"PASS": 1.0, "WARNING": 0.5, "FAIL": 0.0}
    possible = sum(e["requirement"]["effective_weight"] for e in decided)
    earned = sum(e["requirement"]["effective_weight"] * credit[e["result"]["status"]] for e in decided)
    machine = sum(e["requirement"]["verification_type"] == "deterministic" for e in entries)
    return {
        "total_requirements": len(entries), "disabled_requirements": disabled, "machine_verifiable": machine, "semantic_or_manual": len(entries) - machine, "counts": {s: status.count(s) for s in STATUSES},
        "verified": len(decided), "failed_by_severity": {s: sum(e["result"]["status"] in ("FAIL", "ERROR") and e["requirement"]["severity"] == s for e in entries) for s in SEVERITIES},
        "compliance_score": py_round(earned / possible) if possible else None, "unweighted_compliance": py_round(status.count("PASS") / len(decided)) if decided else None,
        "verification_coverage": py_round(len(decided) / len(entries)) if entries else None,
    }


def coverage_of(entries: list[dict], disabled: int = 0, not_extracted: int = 0) -> dict[str, Any]:
    kinds = {"semantic": "semantic_judgement", "manual": "human_judgement"}
    why = []
    for e in entries:
        if e["result"]["status"] == "ERROR":
            why.append("checker_error")
        elif e["result"]["status"] == "UNVERIFIED":
            why.append(kinds.get(e["requirement"]["verification_type"], "no_checker"))
    notes = [f"{not_extracted} sentence(s) of the original instructions became no requirement and were not tested (listed under not_extracted in the specification)."] if not_extracted else []
    n = len(entries)
    return {
        "unit": "requirements", "items": n, "decided": n - len(why), "undecided": len(why), "reasons": {k: why.count(k) for k in sorted(set(why))}, "suppressed": disabled, "notes": notes,
        "decided_share": py_round((n - len(why)) / n) if n else None,
    }


def blocking_of(entries: list[dict], fail_on: str = "any", unverified: bool = False) -> list[dict]:
    if fail_on not in FAIL_ON:
        raise ValueError(f"fail_on must be one of {', '.join(FAIL_ON)}")
    worst = [] if fail_on == "none" else SEVERITIES if fail_on == "any" else SEVERITIES[: SEVERITIES.index(fail_on) + 1]
    hit = lambda e: e["result"]["status"] in ("FAIL", "ERROR") and e["requirement"]["severity"] in worst
    return [e for e in entries if hit(e) or (unverified and e["result"]["status"] == "UNVERIFIED")]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
