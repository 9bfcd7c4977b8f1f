"""The library's front door: single documents without Spark, corpora and folders with it."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml

from compliq import audit as _audit
from compliq.extract import Extraction, extract
from compliq.plans import detail, spec
from compliq.plans.spec import Issue, Requirement, Specification
from compliq.sources import documents


def extract_from_text(instructions: str) -> Extraction:
    return extract(instructions)


def specification_from_extraction(found: Extraction, name: str) -> Specification:
    return Specification(name, found.requirements, not_extracted=list(found.skipped))


def validate_data(data: Any, base_dir: str | None = None, registry: dict | None = None) -> list[Issue]:
    return spec.validate(data, base_dir, registry)[1]


def validate_file(path: str, registry: dict | None = None) -> list[Issue]:
    return spec.validate_file(path, registry)[1]


def load_document(path: str) -> dict[str, Any]:
    """Type and size are tested before the content is read; raises DocumentError."""
    documents.file_type_of(path)
    p = Path(path)
    if not p.is_file():
        raise documents.DocumentError(f"{path} does not exist or is not a file")
    if p.stat().st_size > documents.MAX_BYTES:
        raise documents.DocumentError(f"{path} is larger than {documents.MAX_BYTES} bytes")
    return documents.parse_bytes(p.read_bytes(), str(p))


def audit_file(document: str, specification: str, registry: dict | None = None, verifier: Any = None) -> dict[str, Any]:
    return _audit.audit_one(load_document(document), specification, registry, verifier)


def audit_text(content: str, specification: Any, file_type: str = "md", registry: dict | None = None, verifier: Any = None) -> dict[str, Any]:
    kind = documents.TYPES.get(file_type.lower())
    if kind not in ("txt", "md"):
        raise documents.DocumentError(f"text can be read as txt or md, not as '{file_type}'")
    return _audit.audit_one(documents.parse_text(content.replace("\r\n", "\n").replace("\r", "\n"), kind), specification, registry, verifier)


def compare_preserved(content: str, protected: list[str], file_type: str = "md", case_sensitive: bool = True, normalize_whitespace: bool = True, normalize_quotes: bool = False) -> detail.Verdict:
    params = {"texts": protected, "case_sensitive": case_sensitive, "normalize_whitespace": normalize_whitespace, "normalize_quotes": normalize_quotes}
    spec.config("preserve_text", params)
    return detail.check(documents.parse_text(content, documents.TYPES.get(file_type, "md")), Requirement("preserved", "Protected text is unchanged", checker="preserve_text", parameters=params))


def list_rules(registry: dict | None = None) -> list[dict[str, str]]:
    return spec.list_rules(registry)


_TEMPLATE = """\
# A specification: what a document must satisfy. Each requirement names a checker and its parameters, or says why it cannot be tested.
version: 1
name: My requirements
requirements:
  - id: R001
    description: The text has 500 to 2,000 words
    severity: critical
    checker: word_count
    parameters: {min: 500, max: 2000}
  - id: R002
    description: No em dashes
    checker: forbidden_punctuation
    parameters: {marks: [em_dash]}
  - id: R003
    description: Introduction and conclusion are present, in this order
    checker: required_section
    parameters: {headings: [Introduction, [Conclusion, Conclusions]], ordered: true}
  - id: R004
    description: The tone is professional
    severity: minor
    verification_type: semantic
"""


def template() -> str:
    return _TEMPLATE


def dump(s: Specification, header: str = "") -> str:
    """A specification as YAML; defaults are left out."""
    keep = {"category": "other", "severity": "", "verification_type": "", "enabled": True, "parameters": {}}
    rows = [{k: v for k, v in r.items() if v is not None and v != keep.get(k, None)} for r in s.to_dict()["requirements"]]
    data = {"version": s.version, "name": s.name, **({"description": s.description} if s.description else {}), "requirements": rows, **({"not_extracted": s.not_extracted} if s.not_extracted else {})}
    return "".join(f"# {line}\n" for line in header.splitlines()) + yaml.safe_dump(data, sort_keys=False, allow_unicode=True, width=100)
