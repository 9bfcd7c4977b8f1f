import io
import json

import pytest

from compliq import api, reports
from compliq.cli import main
from compliq.plans.spec import load, load_yaml, validate
from compliq.service import Service, serve
from tests.helpers import spec


@pytest.fixture
def place(tmp_path):
    (tmp_path / "spec.yml").write_text(api.template())
    (tmp_path / "doc.md").write_text("# Introduction\n\n" + "word " * 600 + "\n\n# Conclusion\n\nend\n")
    (tmp_path / "bad.md").write_text("short — text\n")
    (tmp_path / "brief.txt").write_text("Write at least 10 words. Do not use em dashes. Nice.\n")
    (tmp_path / "wrong.yml").write_text("version: 1\nname: x\nrequirements: [{id: a, description: d, checker: nope}]\n")
    return tmp_path


def run(*args):
    return main([str(a) for a in args])


def test_audit_and_exit_codes(place, capsys):
    assert run("audit", place / "doc.md", "-s", place / "spec.yml") == 0
    assert "PASS: 3" in capsys.readouterr().out
    assert run("audit", place / "bad.md", "-s", place / "spec.yml") == 1
    assert run("audit", place / "bad.md", "-s", place / "spec.yml", "--fail-on", "none") == 0
    assert run("audit", place / "doc.md", "-s", place / "wrong.yml") == 2
    assert run("audit", place / "gone.md", "-s", place / "spec.yml") == 3
    assert run("audit", place / "doc.md", "-s", place / "spec.yml", "--min-coverage", 90) == 5
    assert run("audit", place / "doc.md", "-s", place / "spec.yml", "--fail-on-unverified") == 1
    assert run("validate", place / "wrong.yml") == 2 and run("validate", place / "spec.yml") == 0


def test_overwriting_is_guarded(place):
    out = place / "report.json"
    args = ("audit", place / "doc.md", "-s", place / "spec.yml", "-f", "json", "-o")
    assert run(*args, out) == 0 and run(*args, out) == 3 and run(*args, out, "--force") == 0
    assert run(*args, place / "doc.md", "--force") == 3
    assert json.loads(out.read_text())["summary"]["counts"]["PASS"] == 3


def test_formats(place):
    report = api.audit_file(str(place / "bad.md"), str(place / "spec.yml"))
    text = {f: reports.render(report, f, True) for f in reports.FORMATS}
    assert "## FAIL" in text["markdown"] and "FAIL R001" in text["terminal"]
    run_ = json.loads(text["sarif"])["runs"][0]
    assert [r["ruleId"] for r in run_["results"]] == ["R001", "R002", "R003"] and run_["properties"]["unverified"] == ["R004"]
    assert run_["results"][1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    with pytest.raises(ValueError):
        reports.render(report, "pdf")


def test_extract_to_specification(place, capsys):
    out = place / "made.yml"
    assert run("extract", place / "brief.txt", "-o", out, "--explain") == 0
    assert "word_count" in out.read_text() and "skipped  Nice" in capsys.readouterr().err
    made = load(str(out))
    assert [r.checker for r in made.requirements] == ["word_count", "forbidden_punctuation"] and made.not_extracted == ["Nice"]
    assert api.audit_file(str(place / "doc.md"), str(out))["coverage"]["notes"]


def test_yaml_guards(tmp_path):
    assert load_yaml("a: &x 1\nb: *x")[1] and load_yaml("")[1] and load_yaml("a: [")[1][0].path.startswith("line")
    (tmp_path / "p.txt").write_text("Keep this line\n\nAnd this\n")
    rule = spec(("preserve_text", {"baseline_file": "p.txt"}))
    assert validate(rule, str(tmp_path))[1] == []
    for bad in ("../p.txt", "gone.txt"):
        assert validate(spec(("preserve_text", {"baseline_file": bad})), str(tmp_path))[1]
    assert validate(rule)[1]


def rpc(service, method, id_=1, **params):
    return service.handle({"jsonrpc": "2.0", "id": id_, "method": method, "params": params})


def tool(service, name, **arguments):
    answer = rpc(service, "tools/call", name=name, arguments=arguments)["result"]
    assert answer["isError"] is False and json.loads(answer["content"][0]["text"]) == json.loads(json.dumps(answer["structuredContent"]))
    return answer["structuredContent"]


def test_protocol(place):
    s = Service([str(place)])
    hello = rpc(s, "initialize", protocolVersion="2025-03-26", capabilities={}, clientInfo={"name": "t", "version": "1"})["result"]
    assert hello["protocolVersion"] == "2025-03-26" and "tools" in hello["capabilities"] and hello["serverInfo"]["name"] == "compliq" and "never a pass" in hello["instructions"]
    assert rpc(s, "initialize", protocolVersion="1999-01-01")["result"]["protocolVersion"] == "2025-06-18"
    assert s.handle({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None and rpc(s, "ping")["result"] == {}
    tools = {t["name"]: t for t in rpc(s, "tools/list")["result"]["tools"]}
    assert set(tools) == {"extract_requirements", "validate_specification", "audit_text", "audit_file", "compare_preserved_content", "list_supported_rules"}
    assert all(t["annotations"]["readOnlyHint"] and t["description"] for t in tools.values())
    schema = tools["compare_preserved_content"]["inputSchema"]
    assert schema["required"] == ["content", "protected_text"] and schema["properties"]["protected_text"] == {"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "string"}}]}
    assert schema["properties"]["case_sensitive"] == {"type": "boolean", "default": True}
    for name, arguments in (("audit_text", {"content": "x"}), ("audit_text", {"content": 1, "specification": {}}), ("audit_text", {"content": "x", "specification": {}, "more": 1}), ("compare_preserved_content", {"content": "x", "protected_text": [1]})):
        assert rpc(s, "tools/call", name=name, arguments=arguments)["result"]["isError"] is True
    assert rpc(s, "nope")["error"]["code"] == -32601 and rpc(s, "tools/call", name="nope")["error"]["code"] == -32602
    assert s.handle({"method": "ping"})["error"]["code"] == -32600 and s.handle({"jsonrpc": "2.0", "id": 4, "result": {}}) is None
    assert [a["id"] for a in s.handle([{"jsonrpc": "2.0", "id": 7, "method": "ping"}, {"jsonrpc": "2.0", "method": "x"}])] == [7]
    out = io.StringIO()
    serve([str(place)], io.StringIO('{"jsonrpc": "2.0", "id": 1, "method": "ping"}\n\nnot json\n{"jsonrpc": "2.0", "method": "notifications/x"}\n'), out)
    assert [json.loads(x).get("error", {}).get("code") for x in out.getvalue().splitlines()] == [None, -32700]


def test_tools(place, tmp_path_factory, monkeypatch):
    s = Service([str(place)])
    assert {r["rule_type"] for r in tool(s, "list_supported_rules")["rules"]} >= {"word_count", "preserve_text", "forbidden_regex"}
    assert tool(s, "audit_file", file_path=str(place / "doc.md"), specification_path="spec.yml")["ok"]
    found = tool(s, "extract_requirements", instructions="Do not use em dashes. Hello there you.")
    assert found["specification"]["requirements"][0]["checker"] == "forbidden_punctuation" and found["skipped_sentences"] == ["Hello there you"]
    assert tool(s, "validate_specification", specification={"name": "x", "requirements": []})["valid"] is False
    assert tool(s, "compare_preserved_content", content="a b c", protected_text="a b")["result"]["status"] == "PASS"
    assert tool(s, "compare_preserved_content", content="One.\n\nTwo.", protected_text=["One.", "Three."])["result"]["status"] == "FAIL"
    assert tool(s, "audit_text", content="x", specification={"name": "x"})["error"]["code"] == "invalid_specification"
    outside = tmp_path_factory.mktemp("outside")
    (outside / "doc.md").write_text("hi")
    (place / "link.md").symlink_to(outside / "doc.md")
    for bad in ("/etc/passwd", "../x.md", str(outside / "doc.md"), "link.md"):
        assert tool(s, "audit_file", file_path=bad, specification_path="spec.yml")["error"]["code"] == "path_not_allowed"
    assert tool(s, "audit_file", file_path="gone.md", specification_path="spec.yml")["error"]["code"] == "file_error"

    def broken(*a, **k):
        raise RuntimeError("password=hunter2")

    monkeypatch.setattr(api, "audit_text", broken)
    answer = tool(s, "audit_text", content="x", specification={})
    assert answer["error"]["code"] == "internal_error" and "hunter2" not in json.dumps(answer)


def test_server_over_standard_streams(place):
    import subprocess
    import sys

    said = "".join(json.dumps({"jsonrpc": "2.0", "id": k, "method": m, "params": p}) + "\n" for k, (m, p) in enumerate([("initialize", {"protocolVersion": "2025-06-18"}), ("tools/list", {})]))
    out = subprocess.run([sys.executable, "-m", "compliq", "mcp", "--root", str(place)], input=said, capture_output=True, text=True, timeout=120, check=True).stdout
    first, second = (json.loads(x) for x in out.splitlines())
    assert first["result"]["protocolVersion"] == "2025-06-18" and len(second["result"]["tools"]) == 6


def test_corpus_command(spark, place, tmp_path):
    assert run("corpus", place, "-s", place / "spec.yml", "-o", tmp_path / "out") == 0
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 4 * 5 and {r.doc_id.rsplit(".", 1)[1] for r in rows if r.status == "ERROR"} == {"yml"}


def test_refused_files_are_rows_with_an_error(spark, tmp_path):
    from types import SimpleNamespace

    from compliq import cli
    from compliq.sources import documents
    from tests.helpers import spec

    limit, folder = 25 * 1024 * 1024, tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one two")
    (folder / "b.xyz").write_text("what")
    (folder / "noext").write_text("what")
    (folder / "c.md").write_bytes(b"a " * (limit // 2) + b"a")
    (folder / "d.md").write_bytes(b"a" * 25_000_001)
    name = lambda r: r.doc_id.rsplit("/", 1)[1]
    got = {name(r): (r.error, r.size_bytes) for r in documents.from_files(spark, str(folder)).select("doc_id", "error", "size_bytes").collect()}
    assert got["a.txt"][0] is None and got["d.md"] == (None, 25_000_001) and len(got) == 5
    assert "unsupported file type '.xyz'" in got["b.xyz"][0] and "unsupported" in got["noext"][0]
    assert got["c.md"] == (f"the file is larger than {limit} bytes", limit + 1)
    out = str(tmp_path / "out.parquet")
    assert cli.run_corpus(SimpleNamespace(folder=str(folder), spec=spec(("word_count", {"min": 2})), output=out, force=False)) == cli.OK
    rows = {name(r): r for r in spark.read.parquet(out).collect()}
    assert {k: r.status for k, r in rows.items()} == {"a.txt": "PASS", "d.md": "FAIL", "b.xyz": "ERROR", "noext": "ERROR", "c.md": "ERROR"}
    assert all(rows[k].actual == e for k, (e, _) in got.items() if e)
