"""Command line: init, extract, validate, audit, corpus, rules, serve, done, context, scope.

Exit codes: 0 fine, 1 a requirement blocks, 2 a wrong specification, 3 a file cannot be used, 4 an internal error, 5 coverage under the minimum.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from compliq import api, audit, project, reports, service
from compliq.plans.spec import SpecificationError, load_yaml
from compliq.sources.documents import DocumentError, from_files

OK, BLOCKED, BAD_SPEC, BAD_FILE, INTERNAL, LOW_COVERAGE = range(6)


def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("compliq").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def write(text: str, path: str | None, force: bool = False, inputs: tuple[str, ...] = ()) -> None:
    """To a file, or out; an input is never written over, another file only with --force."""
    if path is None:
        sys.stdout.write(text)
        return
    p = Path(path)
    if p.resolve() in {Path(i).resolve() for i in inputs}:
        raise DocumentError(f"{path} is an input and is not written over")
    if p.exists() and not force:
        raise DocumentError(f"{path} exists; use --force to write over it")
    p.write_text(text, encoding="utf-8")


def mapping(path: str) -> Any:
    p = Path(path)
    if not p.is_file():
        raise DocumentError(f"{path} does not exist or is not a file")
    data, issues = load_yaml(p.read_text(encoding="utf-8-sig"))
    if issues or not isinstance(data, dict):
        raise SpecificationError(issues) if issues else DocumentError(f"{path} must hold a mapping")
    return data


def run_init(a) -> int:
    write(api.template(), a.output, a.force)
    return OK


def run_extract(a) -> int:
    if not Path(a.brief).is_file():
        raise DocumentError(f"{a.brief} does not exist or is not a file")
    found = api.extract_from_text(Path(a.brief).read_text(encoding="utf-8-sig"))
    write(api.dump(api.specification_from_extraction(found, a.name)), a.output, a.force, (a.brief,))
    if a.explain:
        for r, source, why in found.items:
            print(f"{r.id}  {source}\n    {r.verification_type}: {why}", file=sys.stderr)
        for s in found.skipped:
            print(f"skipped  {s}", file=sys.stderr)
    return OK


def run_validate(a) -> int:
    issues = api.validate_file(a.spec)
    for i in issues:
        print(f"{i.level}: {i.path}: {i.message}")
    wrong = any(i.level == "error" for i in issues)
    print("invalid" if wrong else "valid")
    return BAD_SPEC if wrong else OK


def run_audit(a) -> int:
    out = api.audit_file(a.document, a.spec)
    write(reports.render(out, a.format, a.verbose), a.output, a.force, (a.document, a.spec))
    if audit.blocking_of(out["entries"], a.fail_on, a.fail_on_unverified):
        return BLOCKED
    low = a.min_coverage is not None and (out["summary"]["verification_coverage"] or 0.0) < a.min_coverage
    return LOW_COVERAGE if low else OK


def run_corpus(a) -> int:
    """Audits all files under a folder; results as Parquet. A file that cannot be read is an ERROR for every requirement."""
    docs, mode = from_files(spark(), a.folder), "overwrite" if a.force else "errorifexists"
    audit.audit(docs, a.spec).write.mode(mode).parquet(a.output)
    return OK


def run_rules(a) -> int:
    for r in api.list_rules():
        print(f"{r['checker']:<22} {r['summary']}")
    return OK


def run_serve(a) -> int:
    service.serve(a.root)
    return OK


def emit_project(report, a) -> int:
    write(reports.render_project(report, a.format), a.output, a.force)
    unverified = getattr(a, "fail_on_unverified", False) and any(r.status == "UNVERIFIED" for r in report.results)
    return BLOCKED if report.failed() or unverified else OK


def run_done_check(a) -> int:
    return emit_project(project.audit_done(spark(), mapping(a.spec), a.root), a)


def run_done_record(a) -> int:
    record = project.record_command(spark(), a.command[1:] if a.command[:1] == ["--"] else a.command, a.root, a.output, a.timeout)
    print(f"exit code {record['exit_code']}, counts {record['counts']}")
    return OK if record["exit_code"] == 0 else BLOCKED


def run_context(a) -> int:
    return emit_project(project.audit_context(spark(), a.root, a.target), a)


def run_scope_snapshot(a) -> int:
    write(json.dumps({"manifest": project.manifest_of(spark(), a.root)}, indent=2, sort_keys=True) + "\n", a.output, a.force)
    return OK


def run_scope_check(a) -> int:
    return emit_project(project.audit_scope(spark(), a.root, project.load_baseline(mapping(a.baseline)), a.allow, a.protect), a)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="compliq", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)

    def command(name: str, f, under=sub, output: bool = True) -> argparse.ArgumentParser:
        c = under.add_parser(name)
        c.set_defaults(run=f)
        if output:
            c.add_argument("--output", "-o")
            c.add_argument("--force", action="store_true")
        return c

    command("init", run_init)
    c = command("extract", run_extract)
    c.add_argument("brief")
    c.add_argument("--name", default="Extracted requirements")
    c.add_argument("--explain", action="store_true")
    command("validate", run_validate, output=False).add_argument("spec")
    c = command("audit", run_audit)
    c.add_argument("document")
    c.add_argument("--spec", "-s", required=True)
    c.add_argument("--format", "-f", choices=reports.FORMATS, default="terminal")
    c.add_argument("--fail-on", choices=audit.FAIL_ON, default="any")
    c.add_argument("--fail-on-unverified", action="store_true")
    c.add_argument("--min-coverage", type=float)
    c.add_argument("--verbose", "-v", action="store_true")
    c = command("corpus", run_corpus)
    c.add_argument("folder")
    c.add_argument("--spec", "-s", required=True)
    command("rules", run_rules, output=False)
    for name in ("mcp", "serve"):
        command(name, run_serve, output=False).add_argument("--root", action="append", default=[])
    done = sub.add_parser("done").add_subparsers(required=True)
    scope = sub.add_parser("scope").add_subparsers(required=True)
    c = command("check", run_done_check, done)
    c.add_argument("spec")
    d = command("record", run_done_record, done)
    d.add_argument("--timeout", type=float, default=600.0)
    d.add_argument("command", nargs=argparse.REMAINDER)
    e = command("context", run_context)
    e.add_argument("--target", default=".")
    s = command("snapshot", run_scope_snapshot, scope)
    k = command("check", run_scope_check, scope)
    k.add_argument("baseline")
    k.add_argument("--allow", action="append", default=[])
    k.add_argument("--protect", action="append", default=[])
    for x in (c, d, e, s, k):
        x.add_argument("--root", default=".")
    for x in (c, e, k):
        x.add_argument("--format", "-f", choices=("terminal", "markdown", "json"), default="terminal")
        x.add_argument("--fail-on-unverified", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except SpecificationError as e:
        for i in e.issues:
            print(f"{i.level}: {i.path}: {i.message}", file=sys.stderr)
        return BAD_SPEC
    except (DocumentError, project.ProjectError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_FILE
    except Exception as e:  # noqa: BLE001  the last line of defence
        print(f"internal error: {type(e).__name__}: {e}", file=sys.stderr)
        return INTERNAL


if __name__ == "__main__":
    sys.exit(main())
