import json

import pytest

from auditloom.operators import lines as L
from auditloom.sources import corpus, knowledge, state, tools


def test_read_corpus(spark, tmp_path):
    for name, data in {"a/lib.rs": b"fn x() {}", "node_modules/y.rs": b"no", "img.png": b"no", "bin.rs": b"a\x00b",
                       "late.rs": b"a" * 9000 + b"\x00", "Makefile": b"all:", "bad.md": b"ok \xff"}.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = {r.path: r.content for r in corpus.read_corpus(spark, str(tmp_path / "src"), "demo").collect()}
    assert set(rows) == {"a/lib.rs", "late.rs", "Makefile", "bad.md"}
    assert rows["bad.md"] == "ok �"


def test_manifest_and_tools(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a.rs\t10\trust\nbroken\nb.rs\tx\trust\nc.ts\t3\ttypescript\n")
    assert [tuple(r) for r in corpus.read_manifest_tsv(spark, str(tmp_path / "m.tsv")).orderBy("path").collect()] == [
        ("a.rs", 10, "rust"), ("c.ts", 3, "typescript")]
    message = {"reason": "compiler-message", "message": {"level": "error", "message": "m", "code": None, "spans": [
        {"file_name": "a.rs", "line_start": 4, "line_end": 5}]}}
    (tmp_path / "c.jsonl").write_text("not json\n" + json.dumps(message) + "\n" + json.dumps({"reason": "other"}) + "\n\n")
    row = tools.read_compiler_jsonl(spark, str(tmp_path / "c.jsonl")).collect()
    assert len(row) == 1 and (row[0].severity, row[0].code, row[0].spans[0].line_start) == ("error", "", 4)
    (tmp_path / "a.json").write_text(json.dumps({"vulnerabilities": {"list": [{"advisory": {"id": "R1", "package": "p"}}]}}))
    found = tools.read_advisories(spark, str(tmp_path / "a.json")).collect()
    assert [(r.id, r.package, r.title) for r in found] == [("R1", "p", "")]


def test_rule_directory_drives_a_scan(spark, tmp_path):
    (tmp_path / "one.yml").write_text('id: one\nmessage: >-\n  Two\n  lines.\nseverity: error\nrule:\n  regex: "\\\\bfoo\\\\b"\n')
    (tmp_path / "two.yaml").write_text("message: short\nrule:\n  regex: 'bar+'\n")
    (tmp_path / "none.yml").write_text("id: none\nrule:\n  kind: x\n")
    table = tools.read_rule_dir(spark, str(tmp_path))
    assert {tuple(r) for r in table.collect()} == {("one", "error", "Two lines.", r"\bfoo\b"), ("two", "warning", "short", "bar+")}
    df = spark.createDataFrame([("r", "p", "a foo\nbarr\nfoot")], "repo string, path string, content string")
    hits = L.scan_lines(L.explode_lines(df), tools.rules_from(table)).collect()
    assert {(h.line, h.pattern) for h in hits} == {(1, "one"), (2, "two")}


def test_taxonomy_and_sections(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"classes": {"a": {"domain": 1, "ref": "1.1", "agent": "x"}}}))
    assert [tuple(r) for r in knowledge.read_taxonomy(spark, str(tmp_path / "t.json")).collect()] == [("a", 1, "1.1", "x")]
    text = "intro\n### H1: a\nbody\n---\nrest\n### H2: b\nlast\n---\nend"
    df = spark.createDataFrame([("r", text)], "repo string, text string")
    always = {r.key: r.section for r in knowledge.split_sections(df).collect()}
    assert always == {"H1": "### H1: a\nbody", "H2": "### H2: b\nlast"}
    last = {r.key: r.section for r in knowledge.split_sections(df, stop_at_rule="last").collect()}
    assert last == {"H1": "### H1: a\nbody\n---\nrest", "H2": "### H2: b\nlast"}


def test_state_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.read_state(spark, path, "a int").count() == 0
    state.write_state(spark.range(3), path)
    state.write_state(spark.range(5), path)
    assert state.read_state(spark, path, "id bigint", multi_line=False).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["state"]


def test_state_is_never_missing_and_old_versions_go(spark, tmp_path):
    path = tmp_path / "state"
    path.write_text('{"id": 7}')
    assert state.read_state(spark, str(path), "id bigint").collect() == [(7,)]
    state.write_state(spark.range(2), str(path))
    open_reader = state.read_state(spark, str(path), "id bigint", multi_line=False)
    for n in range(3, 6):
        state.write_state(spark.range(n), str(path))
        if n == 3:
            assert open_reader.count() == 2
        assert state.read_state(spark, str(path), "id bigint", multi_line=False).count() == n
    assert len(list((path / "data").iterdir())) == 2 and [p.name for p in tmp_path.iterdir()] == ["state"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "saved")
    findings = spark.createDataFrame([("r", "high", "valid"), ("r", "low", "pending")], "repo string, severity string, status string")
    assert state.list_snapshots(spark, root).count() == 0
    with pytest.raises(ValueError):
        state.save_snapshot(spark, root, "  ", {})
    first = state.save_snapshot(spark, root, " one ", {"findings": findings}, "target", "done")
    second = state.save_snapshot(spark, root, "n" * 150, {"scope": findings})
    listed = state.list_snapshots(spark, root).collect()
    assert [r.id for r in listed] == [second, first] and len(listed[0].name) == 100 and listed[1].name == "one"
    assert listed[1].findingsCount == {"critical": 0, "high": 1, "medium": 0, "low": 0, "informational": 0}
    assert set(state.load_snapshot(spark, root, first, ["findings", "scope"])) == {"findings"}
    state.delete_snapshot(spark, root, first)
    state.delete_snapshot(spark, root, first)
    assert [r.id for r in state.list_snapshots(spark, root).collect()] == [second]
    with pytest.raises(FileNotFoundError):
        state.load_snapshot(spark, root, first, ["findings"])
    with pytest.raises(ValueError):
        state.load_snapshot(spark, root, "../x", ["findings"])


def test_exports(spark, tmp_path):
    names = "repo string, seq bigint, id string, title string, severity string, file string, line int, bugClass string, agent string, description string, proof string, recommendation string, status string"
    data = [("r", i, f"a-00{i}", f"T{i}", sev, "f", 1, "b", "a", "d", "p", "rec", status) for i, (sev, status) in enumerate(
        [("low", "valid"), ("critical", "valid"), ("high", "pending")])]
    df = spark.createDataFrame(data, names)
    state.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    state.export_report(df, str(tmp_path / "rep"))
    files = sorted((tmp_path / "rep" / "repo=r").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert text.startswith("# Security Audit Report") and "**Findings**: 2" in text
    assert text.index("### a-001: T1") < text.index("### a-000: T0") and "a-002" not in text
    assert state.issue_rows(df).filter("id = 'a-001'").first().title == "[Critical] T1"


def test_json_records_are_parsed_once(spark):
    from auditloom.sources import tools

    rows = spark.createDataFrame([(1, '{"reason":"compiler-message","message":{"level":"error"}}'), (2, "no json"), (3, None),
                                  (4, '{"vulnerabilities":{"list":[{"advisory":{"id":"A"}},{"advisory":{"id":"B"}}]}}')], "n long, value string")
    found = {parse: parse(rows) for parse in (tools.parse_compiler_lines, tools.parse_advisories, tools.parse_matches)}
    for df in found.values():
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    got = {parse.__name__: sorted(r.n for r in df.collect()) for parse, df in found.items()}
    assert got == {"parse_compiler_lines": [1], "parse_advisories": [4, 4], "parse_matches": [1, 2, 4]}
