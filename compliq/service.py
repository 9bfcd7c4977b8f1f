"""A server of the Model Context Protocol over standard input and output: six read-only tools over the same core as the command line.

Messages are JSON-RPC 2.0, one a line. Tools answer with values; what goes wrong inside a tool is a value as well, ``{"ok": false, "error": ...}``, so that
a model can read why and mend its call. Files are read only inside the folders given at the start. Nothing is written.
"""

from __future__ import annotations

import inspect
import json
import logging
import sys
import types
import typing
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path
from typing import Any, TextIO

from compliq import __version__, api
from compliq.plans.spec import ParameterError, SpecificationError, validate
from compliq.sources.documents import DocumentError

#: Revisions of the protocol that this server speaks, the latest first.
PROTOCOLS = ["2025-06-18", "2025-03-26", "2024-11-05"]
INSTRUCTIONS = (
    "Tests whether a document follows its instructions: PASS, FAIL, WARNING, UNVERIFIED or ERROR with evidence. UNVERIFIED means that a requirement could not be tested; "
    "it is never a pass. All tools only read."
)
READ_ONLY = {"readOnlyHint": True, "destructiveHint": False, "idempotentHint": True, "openWorldHint": False}
#: JSON-RPC error codes. Fixed values.
PARSE_ERROR, INVALID_REQUEST, UNKNOWN_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602

log = logging.getLogger(__name__)


class NotAllowed(DocumentError):
    """A path leads out of the folders."""


class Failure(Exception):
    """A JSON-RPC error."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def schema_of(kind: Any) -> dict[str, Any]:
    """The JSON schema of an annotation."""
    if isinstance(kind, types.UnionType):
        return {"anyOf": [schema_of(k) for k in typing.get_args(kind)]}
    if typing.get_origin(kind) is list:
        return {"type": "array", "items": schema_of(typing.get_args(kind)[0])}
    return {"type": {str: "string", bool: "boolean"}.get(kind, "object")}


def fits(value: Any, schema: dict[str, Any]) -> bool:
    if "anyOf" in schema:
        return any(fits(value, s) for s in schema["anyOf"])
    if schema["type"] == "array":
        return isinstance(value, list) and all(fits(v, schema["items"]) for v in value)
    return isinstance(value, {"string": str, "boolean": bool, "object": dict}[schema["type"]])


class Service:
    def __init__(self, roots: list[str]):
        self.roots = [Path(r).resolve() for r in roots or ["."]]
        self.tools: dict[str, Callable[..., dict[str, Any]]] = {f.__name__: f for f in (
            self.extract_requirements, self.validate_specification, self.audit_text, self.audit_file, self.compare_preserved_content, self.list_supported_rules,
        )}

    def path(self, name: str) -> str:
        """Relative names are looked for in each folder; the path, links followed, must lie inside one of them."""
        tries = [(r / name).resolve() for r in self.roots]
        good = [p for p in tries if any(p == r or r in p.parents for r in self.roots)]
        if not good:
            raise NotAllowed(f"{name} is outside the allowed folders")
        return str(next((p for p in good if p.exists()), good[0]))

    # -- tools ------------------------------------------------------------------------------------

    def extract_requirements(self, instructions: str) -> dict[str, Any]:
        """Turns instructions in plain English into candidate requirements. Only what is unambiguous becomes a rule that is tested; the rest is semantic, manual or unsupported. Review them before use."""
        found = api.extract_from_text(instructions)
        spec = api.specification_from_extraction(found, "Extracted requirements")
        said = [{"id": r.id, "source": s, "interpretation": w} for r, s, w in found.items]
        return {"specification": spec.to_dict(), "yaml": api.dump(spec), "interpretations": said, "skipped_sentences": found.skipped}

    def validate_specification(self, specification: dict) -> dict[str, Any]:
        """Checks a specification (a JSON object) without auditing anything."""
        issues = validate(specification)[1]
        valid = not any(i.level == "error" for i in issues)
        return {"ok": valid, "valid": valid, "issues": [asdict(i) for i in issues]}

    def audit_text(self, content: str, specification: dict, file_type: str = "txt") -> dict[str, Any]:
        """Audits a text (txt or md) against a specification."""
        return {"report": api.audit_text(content, specification, file_type)}

    def audit_file(self, file_path: str, specification_path: str) -> dict[str, Any]:
        """Audits a .txt, .md or .docx file against a specification in YAML; both inside the server's folders."""
        return {"report": api.audit_file(self.path(file_path), self.path(specification_path))}

    def compare_preserved_content(self, content: str, protected_text: str | list[str], case_sensitive: bool = True, normalize_whitespace: bool = True, file_type: str = "txt") -> dict[str, Any]:
        """Checks that protected passages appear in the content exactly, and shows how they differ if not."""
        items = [protected_text] if isinstance(protected_text, str) else protected_text
        return {"result": asdict(api.compare_preserved(content, items, file_type, case_sensitive, normalize_whitespace))}

    def list_supported_rules(self) -> dict[str, Any]:
        """Lists the checkers with a summary of their parameters."""
        return {"rules": [{"rule_type": r["checker"], **r} for r in api.list_rules()]}

    # -- calls ------------------------------------------------------------------------------------

    def call(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        """A tool's answer, or why there is none; details of what was not expected go to the log alone."""
        error = lambda code, message, **more: {"ok": False, "error": {"code": code, "message": message, **more}}
        try:
            return {"ok": True, **self.tools[name](**arguments)}
        except SpecificationError as e:
            return error("invalid_specification", "The specification is not valid.", issues=[asdict(i) for i in e.issues])
        except NotAllowed as e:
            return error("path_not_allowed", str(e))
        except (DocumentError, OSError) as e:
            return error("file_error", str(e))
        except ParameterError as e:
            return error("error", str(e))
        except Exception as e:  # noqa: BLE001  a client must not see internals
            log.exception("tool %s", name)
            return error("internal_error", f"Unexpected {type(e).__name__}; see the server's log.")

    def described(self, name: str) -> dict[str, Any]:
        f = self.tools[name]
        kinds, given = typing.get_type_hints(f), inspect.signature(f).parameters
        fields = {k: schema_of(kinds[k]) | ({} if p.default is p.empty else {"default": p.default}) for k, p in given.items()}
        needed = [k for k, p in given.items() if p.default is p.empty]
        return {"name": name, "description": f.__doc__, "inputSchema": {"type": "object", "properties": fields, "required": needed, "additionalProperties": False}, "annotations": READ_ONLY}

    def wrong_arguments(self, name: str, arguments: Any) -> str | None:
        if not isinstance(arguments, dict):
            return "arguments must be an object"
        schema = self.described(name)["inputSchema"]
        problems = [f"'{k}' is missing" for k in schema["required"] if k not in arguments] + [f"'{k}' is not known" for k in arguments if k not in schema["properties"]]
        problems += [f"'{k}' has the wrong type" for k, v in arguments.items() if k in schema["properties"] and not fits(v, schema["properties"][k])]
        return "; ".join(problems) or None

    # -- protocol ---------------------------------------------------------------------------------

    def _initialize(self, params: dict[str, Any]) -> dict[str, Any]:
        asked = params.get("protocolVersion")
        version = asked if asked in PROTOCOLS else PROTOCOLS[0]
        return {"protocolVersion": version, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "compliq", "version": __version__}, "instructions": INSTRUCTIONS}

    def _call_tool(self, params: dict[str, Any]) -> dict[str, Any]:
        name, arguments = params.get("name"), params.get("arguments") or {}
        if name not in self.tools:
            raise Failure(INVALID_PARAMS, f"unknown tool '{name}' (known: {', '.join(self.tools)})")
        if wrong := self.wrong_arguments(name, arguments):
            return {"content": [{"type": "text", "text": f"Invalid arguments: {wrong}"}], "isError": True}
        answer = self.call(name, arguments)
        return {"content": [{"type": "text", "text": json.dumps(answer, ensure_ascii=False)}], "structuredContent": answer, "isError": False}

    def handle(self, message: Any) -> dict[str, Any] | list | None:
        """The answer to a message (or a batch of them); None where none is due."""
        if isinstance(message, list):
            return [a for m in message if (a := self.handle(m))] or None
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            answer = isinstance(message, dict) and ("result" in message or "error" in message)
            return None if answer else _error(None, INVALID_REQUEST, "not a JSON-RPC 2.0 request")
        methods = {
            "initialize": self._initialize, "ping": lambda p: {}, "tools/list": lambda p: {"tools": [self.described(n) for n in self.tools]}, "tools/call": self._call_tool,
        }
        if "id" not in message:
            return None  # a notification
        try:
            if message["method"] not in methods:
                raise Failure(UNKNOWN_METHOD, f"unknown method '{message['method']}'")
            params = message.get("params") or {}
            if not isinstance(params, dict):
                raise Failure(INVALID_PARAMS, "params must be an object")
            return {"jsonrpc": "2.0", "id": message["id"], "result": methods[message["method"]](params)}
        except Failure as e:
            return _error(message["id"], e.code, str(e))


def _error(id_: Any, code: int, message: str) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def serve(roots: list[str], source: TextIO | None = None, sink: TextIO | None = None) -> None:
    """Answers messages line by line until the input ends."""
    service, sink = Service(roots), sink or sys.stdout
    for line in source or sys.stdin:
        if not line.strip():
            continue
        try:
            answer = service.handle(json.loads(line))
        except ValueError:
            answer = _error(None, PARSE_ERROR, "not valid JSON")
        if answer is not None:
            print(json.dumps(answer, ensure_ascii=False), file=sink, flush=True)


__all__ = ["Service", "serve"]
