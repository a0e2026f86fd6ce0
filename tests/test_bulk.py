"""Bulk edits, template guard, positions, streams of files."""

import json

import pytest

from treeloom.operators import bulk
from treeloom.plans import lint
from treeloom.sources.guard import guarded
from treeloom.sources.spans import json_spans, yaml_spans
from treeloom.streaming import lint_stream
from treeloom.values import DocumentError


def test_edit_text():
    e = lambda text, form, **edit: bulk.edit_text(text, form, edit)
    assert e("a: 1\n", "yaml", kind="set", pointer="/b/c", value=[1]) == "a: 1\nb:\n  c:\n  - 1\n"
    assert e("a: 1\n---\nb: 2\n", "yaml", kind="set", pointer="/b", value=3, doc=1) == "a: 1\n---\nb: 3\n" and e("1\n---\n2\n", "yaml", kind="doc-remove", doc=0) == "2\n" and e("1\n", "yaml", kind="doc-insert", doc=1, value=5) == "1\n---\n5\n"
    assert e('{"a":[1,2]}', "json", kind="del", pointer="/a/0") == '{\n  "a": [\n    2\n  ]\n}\n' and e("x=1\n", "dotenv", kind="merge", patch={"x": None, "y": "a b"}) == 'y="a b"\n'
    assert e("---\na: 1\n---\nbody", "frontmatter", kind="jq", program=".a += 1") == "---\na: 2\n---\nbody" and e('{"name":"x"}', "json", kind="patch", ops=[{"op": "add", "path": "/b", "value": 1}]).endswith('"b": 1\n}\n')
    assert e("b: 1\na: 2\n", "yaml", kind="fmt", sort_keys=True) == "a: 2\nb: 1\n"
    for bad in ({"kind": "jq", "program": ".a[]"}, {"kind": "jq", "program": ".a.b.c"}, {"kind": "set", "pointer": "/a", "value": 1, "doc": 7}, {"kind": "none"}):
        with pytest.raises(DocumentError):
            bulk.edit_text("a: [1, 2]\n", "yaml", bad)
    with pytest.raises(DocumentError):
        e("FROM a\n", "dockerfile", kind="fmt")


def test_splices_keep_comments():
    e = lambda text, form, pointer, value: bulk.edit_text(text, form, {"kind": "set", "pointer": pointer, "value": value})
    assert e("# head\na:   1 # one\nb: [x,  'y']  # two\n", "yaml", "/a", "on") == "# head\na:   'on' # one\nb: [x,  'y']  # two\n" and e("b: [x,  'y'] # c\n", "yaml", "/b/1", 5) == "b: [x,  5] # c\n"
    assert e('{"a" : [1,\n 2], "b":3}', "json", "/a/1", {"c": None}) == '{"a" : [1,\n {"c":null}], "b":3}' and e("a: |\n  x\nb: 1\n", "yaml", "/a", "z") == "a: z\nb: 1\n"


def test_guard():
    assert guarded("a: 'x {{ .v }}'\nb: p${{ q }}r\n", "yaml") == [{"a": "x {{ .v }}", "b": "p${{ q }}r"}] and guarded("a: 1", "yaml") == [{"a": 1}]
    for bad in ("a: {{ .v }}\n", "{{ if x }}\na: 1\n{{ end }}\n"):
        with pytest.raises(DocumentError, match="templated"):
            guarded(bad, "yaml")
    assert guarded("a: '${{ a == ''b'' }}'\n", "yaml") == [{"a": "${{ a == 'b' }}"}] and guarded('{"a": "{{ f(\\"y\\") }}"}', "json") == [{"a": '{{ f("y") }}'}] and guarded("# {{ x }}\n\ntext `{{ y }}`\n", "markdown")
    assert guarded("a: {{ .v }}\n", "yaml", raw=True) == [{"a": "{{ .v }}"}]


def test_spans():
    text = '{"a/b": [1, {"c": null}],\n "d": "x"}'
    s = json_spans(text)
    assert {p: text[v[2] : v[3]] for p, v in s.items()} == {"": text, "/a~1b": '[1, {"c": null}]', "/a~1b/0": "1", "/a~1b/1": '{"c": null}', "/a~1b/1/c": "null", "/d": '"x"'} and s["/d"][:2] == (2, 7)
    assert json_spans(" [] ") == {"": (1, 2, 1, 3)} and len(json_spans("[" * 5000 + "]" * 5000)) == 5000
    for bad in ("", "[1", "[1,]", "{1:2}", "1 2"):
        with pytest.raises(DocumentError):
            json_spans(bad)
    assert yaml_spans("a:\n  - 1\n---\nb: 2\n")[1]["/b"][:2] == (4, 4)


def test_bulk(spark, tmp_path):
    files = spark.createDataFrame([("a.yaml", b"a: 1\n"), ("b.yaml", b"a: [\n"), ("c.json", b'{"a": 2}'), ("d.none", b""), ("e.yaml", None)], "path string, content binary")
    out = bulk.edit_files(files, {"kind": "set", "pointer": "/a", "value": 2})
    assert {r.path: r.status for r in out.collect()} == {"a.yaml": "changed", "b.yaml": "failed", "c.json": "unchanged", "d.none": "failed", "e.yaml": "failed"} and {r.status: r.n for r in bulk.counts(out).collect()} == {"changed": 1, "failed": 3, "unchanged": 1}
    assert "+a: 2" in out.where("path = 'a.yaml'").first().diff
    (tmp_path / "a.yaml").write_text("a: 1\n")
    assert bulk.write_files(out, str(tmp_path), backup=True).count() == 5
    assert (tmp_path / "a.yaml").read_text() == "a: 2\n" and (tmp_path / "a.yaml.bak").read_text() == "a: 1\n"
    assert bulk.edit_files(files.limit(0), {"kind": "fmt"}).count() == 0
    assert [r.path for r in bulk.convert_files(files.where("path = 'c.json'"), "toml").collect()] == ["c.toml"]


def test_files_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, text in enumerate(["FROM a:latest\nHEALTHCHECK CMD x\n", "FROM a:1\nHEALTHCHECK CMD x\n"]):
        folder = tmp_path / "in" / str(n)
        folder.mkdir()
        (folder / "Dockerfile").write_text(text)
        lint_stream.watch_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), lint.resolve(["@std/dockerfile"], [])).awaitTermination()
    assert [r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["dockerfile.no-latest-base-image"]


def test_conversion_in_place(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("x: 1\n---\ny: 2\n")
    (tmp_path / "b.json").write_text('{"x":1}')
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("regexp_extract(path, '[^/]*$', 0) AS path", "content")
    out = bulk.convert_files(files, "json")
    assert bulk.write_files(out, str(tmp_path), backup=True, replace=True).count() == 2
    assert json.loads((tmp_path / "a.json").read_text()) == [{"x": 1}, {"y": 2}] and sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "a.yaml.bak", "b.json", "b.json.bak"]


def test_plugin_fixes(spark):
    def lint(document):
        if document.root.get("k", 0) > 50:
            yield "x", "warn", "large", "/k"

    files = spark.createDataFrame([("a.json", b'{"k": 60}'), ("b.json", b'{"k": 5}'), ("c.json", b'{"k": 90, "s": true}')], "path string, content binary")
    fix = lambda document: [] if document.root.get("s") else [{"op": "replace", "path": "/k", "value": 50}]
    out = {r.path: (r.status, r.content) for r in bulk.edit_files(files, {"kind": "plugin", "lint": lint, "fix": fix}).collect()}
    assert {k: v[0] for k, v in out.items()} == {"a.json": "changed", "b.json": "unchanged", "c.json": "unchanged"} and json.loads(out["a.json"][1]) == {"k": 50}
