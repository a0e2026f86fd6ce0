"""Rules, fixes, fixtures, reports."""

import json

import pytest

from treeloom.plans import lint, report
from treeloom.sources.registry import documents_of, read_documents
from treeloom.values import DocumentError, parse_json

S = lint.standard()


def fired(text, form, path="x"):
    out = []
    for d in documents_of(text, form):
        found, problems = lint.lint_value(d, form, path, S)
        assert not problems, problems
        out += [(x["rule_id"], x["line"]) for x in found]
    return out


POD = "kind: Pod\nmetadata: {labels: {app.kubernetes.io/name: a}}\nspec:\n  securityContext: {runAsNonRoot: true}\n  containers:\n  - name: a\n    image: a:1\n    livenessProbe: {}\n    readinessProbe: {}\n    resources: {limits: {cpu: 1, memory: 1}}\n    securityContext: {allowPrivilegeEscalation: false}\n"


def test_clean_documents():
    assert fired(POD, "yaml") == []
    assert fired("FROM a:1\nHEALTHCHECK CMD x\nCOPY a b\n", "dockerfile") == []
    assert fired("---\ntitle: t\ndate: 2024-01-02\n---\n# A\n\ntext [b](http://c)\n\n## B\n", "markdown", "p.md") == []


@pytest.mark.parametrize(("change", "rule"), [
    (("image: a:1", "image: a"), "no-latest-tag"), (("readinessProbe: {}", "x: 1"), "missing-readiness-probe"), (("runAsNonRoot: true", "x: 1"), "run-as-root"), (("cpu: 1, ", ""), "missing-resources-limits"), (("kind: Pod\nmetadata: {labels: {app.kubernetes.io/name: a}}", "kind: DaemonSet\nmetadata: {labels: {x: a}}"), "missing-labels"),
    (("spec:", "spec:\n  hostPID: true"), "host-pid"), (("spec:", "spec:\n  volumes: [{name: v, hostPath: {path: /}}]"), "hostpath-volume"), (("image: a:1", "image: a:1\n    imagePullPolicy: Always"), "image-pull-policy-always"), (("kind: Pod\nmetadata: {", "kind: Pod\napiVersion: extensions/v1beta1\nmetadata: {name: n, "), "deprecated-api"),
])
def test_k8s(change, rule):
    assert fired(POD.replace(*change), "yaml") == [("k8s." + rule, 1)]


def test_other_namespaces():
    assert fired("FROM node AS base\nFROM base\nFROM scratch\nADD a.txt /\nADD https://x/y.tar.gz /\nRUN curl -s x | bash\nRUN curl x || sh y\n", "dockerfile") == [("dockerfile.has-healthcheck", 1), ("dockerfile.no-add-use-copy", 4), ("dockerfile.no-curl-pipe-bash", 6), ("dockerfile.no-latest-base-image", 1)]
    found = [r for r, _ in fired('{"name":"a","version":"1","engines":{"node":"1"},"repository":"x","dependencies":{"x":"*"},"preferGlobal":true,"scripts":{"c":"rm -rf / "}}', "json", "package.json")]
    assert found == ["npm.has-license", "npm.no-deprecated-fields", "npm.no-wildcard-deps", "npm.scripts-no-rm-rf-root"]
    assert fired("kind: Service\nspec: {}\n", "yaml") == [("k8s.missing-labels", 1), ("k8s.service-no-selector", 1)]
    md = dict(fired("---\ntitle: x\ndate: yesterday\n---\n# A\n\n### B\n\n# A\n\n\n\n[here](x) ![](i) http://a.b\n\n```\nx\n```\n\n```yaml\na: [\n```\n\n|a|b|\n|-|-|\n|1|2|3|\n\n## \n", "markdown", "p.md"))
    assert {k.split(".")[1]: v for k, v in md.items()} == {"code-blocks-have-lang": 15, "code-blocks-yaml-valid": 21, "frontmatter-date-format": 1, "heading-order": 7, "image-alt-required": 13, "link-text-not-here": 1, "no-bare-urls": 13, "no-duplicate-headings": 9, "no-empty-headings": 27, "no-multiple-blank-lines": 13, "single-h1": 9, "table-pipes-aligned": 25}
    tf = [r for r, _ in fired('provider "aws" {}\nterraform {}\nvariable "v" {}\noutput "db_password" {\n value = 1\n}\nmodule "m" {\n source = "t/x"\n}\nmodule "n" {\n source = "./x"\n}\nresource "aws_security_group" "s" {\n ingress {\n  cidr_blocks = ["0.0.0.0/0"]\n }\n password = "hunter2"\n}\n', "hcl")]
    assert sorted(r.split(".")[1] for r in tf) == ["module-pin-version", "no-hardcoded-secrets", "no-public-ingress", "output-no-sensitive-without-flag", "provider-pinned", "state-backend-required", "tag-required", "variable-has-description"]
    assert [r for r, _ in fired('{"skill_name":"x","evals":[{"id":1}]}', "json", "a/evals.json")] == ["skills.evals-schema"] * 2
    skill = lambda **x: [r for r, _ in fired("---\ntitle: t\ndate: 2024-01-01\n" + "".join(f"{k}: {v}\n" for k, v in x.items()) + "---\nx", "markdown", "a.md")]
    assert skill(name="Bad Name " + "x" * 64) == ["skills.frontmatter"] * 2 and skill(name="good-name") == [] == skill() and skill(description="a" * 1000, when_to_use="b" * 537) == ["skills.frontmatter"]


@pytest.mark.parametrize("text", ["[a, b]", "x", "null", "{kind: Pod, spec: x}", "{kind: Pod, spec: {containers: x, volumes: 1}}", "{kind: CronJob, spec: 1}", "{on: x, jobs: {a: 1, b: {steps: [1, {uses: 2}]}}}", '{openapi: "3", paths: {a: 1, b: {get: 1, put: {responses: 3}}}}', "{kind: Service, spec: 1}", "{kind: 5}"])
def test_no_rule_raises_on_odd_shapes(text):
    fired(text, "yaml")
    fired(json.dumps(documents_of(text, "yaml")[0]), "json", "package.json")


def test_fixes():
    value, applied, dropped = lint.fix_value(parse_json('{"name":"a","version":"1"}'), "json", "other.json", S)
    assert value == {"name": "a", "version": "1", "license": "UNLICENSED"} and applied == ["npm.has-license"] and not dropped
    assert lint.fix_value(parse_json('{"name":"a","version":"1","private":true}'), "json", "package.json", S)[1] == []
    pod = documents_of(POD.replace("image: a:1", "image: a:1\n    imagePullPolicy: Always"), "yaml")[0]
    fixed, applied, _ = lint.fix_value(pod, "yaml", "x", S)
    assert applied == ["k8s.image-pull-policy-always"] and fixed["spec"]["containers"][0]["imagePullPolicy"] == "IfNotPresent"
    stubborn = lint.read_rules("id: o.r\nseverity: warn\nmatch: {format: json}\ncheck: {jq: '{}', message: m}\nfix: {jq: '.x = 1'}\n")
    assert lint.fix_value({}, "json", "x", stubborn) == ({}, [], ["o.r"])


RULE = """
id: org.no-debug
severity: error
match: {format: [yaml, json], filter: '.kind == "Pod"', glob: 'k8s/**/*.yaml'}
check:
  jq: '.spec.containers[]? | select(.image | test("debug"))'
  message: "{{ .name }} uses {{ .image }} {{ .x }}"
loc: {line: '3'}
"""


def test_pointers_give_lines():
    from treeloom.sources.spans import spans_of

    text = POD.replace("image: a:1", "image: a").replace("spec:\n", "spec:\n  hostPID: true\n").replace("livenessProbe: {}", "x: 1")
    found = lint.lint_value(documents_of(text, "yaml")[0], "yaml", "x", S, spans_of(text, "yaml")[0])[0]
    assert sorted((d["rule_id"], d["line"], d["col"]) for d in found) == [("k8s.host-pid", 4, 12), ("k8s.missing-liveness-probe", 7, 11), ("k8s.no-latest-tag", 8, 12)]


def test_rules_from_folders(tmp_path, spark):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s.json").write_text('{"required": ["x"]}')
    (tmp_path / "sub" / "a.yml").write_text("id: o.schema\nseverity: error\nmatch: {format: json}\ncheck: {schema_file: s.json, prefix: 'p :: q'}\n")
    (tmp_path / "b.yaml").write_text("id: npm.has-engines\nseverity: error\nmatch: {format: json}\ncheck: {jq: '.[0].x | {}', message: m}\n")
    (tmp_path / "a.test.yml").write_text("tests: []")
    rules = lint.resolve([str(tmp_path)], [])
    assert [r.id for r in rules] == ["npm.has-engines", "o.schema"] and [r.severity for r in lint.resolve(["npm.has-engines"], [], str(tmp_path / "nowhere"))] == ["info"]
    assert [(r.id, r.severity) for r in lint.resolve(["npm.has-engines"], [], str(tmp_path))] == [("npm.has-engines", "error"), ("o.schema", "error")]
    rows = lint.lint(read_documents(spark.createDataFrame([("a.json", b"{}"), ("b.json", b'[{"x":1}]')], "path string, content binary")), rules).collect()
    assert sorted((r.path, r.rule_id, r.severity, r.message) for r in rows) == [("a.json", "npm.has-engines", "rule-error", rows[0].message), ("a.json", "o.schema", "error", 'p :: q: /required: "x" is a required property'), ("b.json", "npm.has-engines", "error", "m")]
    (tmp_path / "sub" / "s.json").unlink()
    with pytest.raises(DocumentError, match="schema_file"):
        lint.resolve([str(tmp_path)], [])


def test_own_rules():
    rule = lint.read_rules(RULE)
    d = {"kind": "Pod", "spec": {"containers": [{"name": "a", "image": "debug:1"}]}}
    assert [(x["message"], x["line"]) for x in lint.lint_value(d, "yaml", "k8s/a/b.yaml", rule)[0]] == [("a uses debug:1 <missing>", 3)]
    assert lint.lint_value(d, "yaml", "other.yaml", rule) == ([], []) and lint.lint_value(d, "toml", "k8s/b.yaml", rule) == ([], [])
    assert lint.lint_value({"kind": "Pod", "spec": {"containers": [{"image": 1}]}}, "yaml", "k8s/b.yaml", rule)[1][0][0] == "org.no-debug"
    with pytest.raises(DocumentError, match="unknown field"):
        lint.read_rules(RULE + "typo: 1\n")
    nested = lint.read_rules("id: o.c\nseverity: warn\nmatch: {format: json}\ncheck:\n  composite:\n    extract: '[.a[] | {input: ., line: 5}]'\n    format: yaml\n    rule: {id: i, severity: warn, match: {format: yaml}, check: {jq: 'select(.k == 1) | {}', message: inner}}\n")
    assert [(x["message"], x["line"]) for x in lint.lint_value({"a": ["k: 1", "k: 2", "k: ["]}, "json", "x", nested)[0]] == [("inner", 5), ("o.c: expected the node content, but found '<stream end>'", 5)]
    cases = lint.run_fixture("tests:\n- name: a\n  input: '{kind: Pod, spec: {containers: [{name: a, image: debug}]}}'\n  path: k8s/x.yaml\n  expected: {violations: [{rule: org.no-debug, message_contains: uses}]}\n- name: b\n  input: '{}'\n  expected: {violations: [{rule: org.no-debug}]}\n", rule)
    assert [(n, ok) for n, ok, _ in cases] == [("a", True), ("b", False)]


def test_resolve_and_exit_codes():
    assert {r.id.split(".")[0] for r in lint.resolve(None, ["dockerfile"])} == {"dockerfile"} and len(lint.resolve(["@std/k8s"], [])) == 14 and [r.id for r in lint.resolve(["npm.has-license"], [])] == ["npm.has-license"]
    assert [lint.exit_code(*a) for a in ((["info"],), (["warn"], 0, True), (["error", "warn"],), ([], 1), (["warn"],))] == [0, 1, 4, 3, 0]


def test_globs():
    import re

    ok = lambda g, p: bool(re.search(lint.glob_pattern(g), p))
    assert ok("**/package.json", "package.json") and ok("**/package.json", "a/b/package.json") and ok("a/{b,c}?.[jt]s", "a/b1.js") and not ok("a/*.js", "a/b/c.js") and ok("[!x].y", "a.y")


def test_reports():
    rows = [{"path": "a", "rule_id": "r.x", "severity": "error", "message": "m<\n", "line": 2, "col": 3, "references": []}, {"path": "b", "rule_id": "r.y", "severity": "info", "message": "n", "line": 1, "col": 1, "references": []}]
    s = json.loads(report.sarif(rows))["runs"][0]
    assert [r["ruleIndex"] for r in s["results"]] == [0, 1] and [r["level"] for r in s["results"]] == ["error", "note"]
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(report.junit(rows)).findall(".//testcase")) == 2 and report.tap(rows).splitlines()[:3] == ["TAP version 13", "1..2", "not ok 1 - r.x a:2:3"]
    assert json.loads(report.envelope(rows))["diagnostics"][0]["line"] == 2 and report.console(rows).splitlines()[0].endswith("m<\\u{a}")
    assert [json.loads(x)["rule_id"] for x in report.jsonl(rows).splitlines()] == ["r.x", "r.y"] and documents_of(report.yaml(rows), "yaml")[0] == documents_of(report.toml(rows), "toml")[0] == json.loads(report.envelope(rows))
    assert report.unified_diff("a\nb", "a\nc\n", "f").splitlines()[:3] == ["--- a/f", "+++ b/f", "@@ -1,2 +1,2 @@"] and "No newline" in report.unified_diff("a\nb", "a\nc\n", "f")


def test_native_reports(spark):
    import xml.etree.ElementTree as ET

    d = spark.createDataFrame([("a", 0, 0, 0, "r.x", "error", 'm<&"', 2, 3, []), ("b", 0, 0, 0, "s.y", "info", "n", 1, 1, [])], lint.DIAGNOSTICS)
    assert [json.loads(r.line)["rule_id"] for r in report.json_lines(d).orderBy("n").collect()] == ["r.x", "s.y"]
    cases = [ET.fromstring(r.testcase) for r in report.junit_cases(d).orderBy("n").collect()]
    assert [c.get("name") for c in cases] == ["a:2:3", "b:1:1"] and cases[0][0].get("message") == 'm<&"' and cases[1][0].text == "info: n"
    assert {(r.namespace, r.severity): r.n for r in report.totals(d).collect()} == {(None, None): 2, ("r", None): 1, ("s", None): 1, ("r", "error"): 1, ("s", "info"): 1, (None, "error"): 1, (None, "info"): 1}


def test_lint_plan(spark):
    files = spark.createDataFrame([("d/Dockerfile", b"FROM a\n"), ("x.json", b"{"), ("y.bin", b"\x00"), ("z.json", b"[]"), ("u.yaml", b"\xff\xfea\x00"), (None, None)], "path string, content binary")
    rows = lint.lint(read_documents(files)).collect()
    assert {(r.path, r.rule_id) for r in rows} == {("d/Dockerfile", "dockerfile.has-healthcheck"), ("d/Dockerfile", "dockerfile.no-latest-base-image"), ("x.json", "lint.parse"), ("y.bin", "lint.parse"), (None, "lint.parse")}
    assert {r.severity: r.n for r in lint.summary(lint.lint(read_documents(files.limit(0)))).collect()} == {"error": 0, "warn": 0, "info": 0}


def test_rule_files_and_explanations():
    again = lint.read_rules(lint.rule_file(S))
    assert [(r.id, r.severity, r.formats, r.kind, r.message) for r in again] == [(r.id, r.severity, r.formats, r.kind, r.message) for r in S]
    pod = documents_of(POD.replace("image: a:1", "image: a"), "yaml")[0]
    assert [d["rule_id"] for d in lint.lint_value(pod, "yaml", "x", again)[0]] == ["k8s.no-latest-tag"]
    assert lint.explain("npm.has-license").startswith("npm.has-license [warn] [fix]\n")
    with pytest.raises(DocumentError):
        lint.explain("no.rule")


def test_positions(spark):
    files = spark.createDataFrame([("a.json", b'{"openapi": "3.1.0",\n "info": {"title": 5, "version": "1"},\n "paths": {}}'), ("b.yaml", b"a: 1\n---\nopenapi: 3.1.0\ninfo:\n  title: 5\n  version: x\npaths: {}\n")], "path string, content binary")
    rows = lint.lint(read_documents(files, positions=True), lint.resolve(["jsonschema.openapi-3.1-shape"], [])).collect()
    assert [(r.path, r.doc_idx, r.line, r.col) for r in rows] == [("a.json", 0, 2, 20), ("b.yaml", 1, 5, 10)]
