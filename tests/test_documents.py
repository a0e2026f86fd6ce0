"""Values, pointers, edits, JSONPath, schemas, formats."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom import pointer as P
from treeloom.functions.jsonpath import select
from treeloom.functions.schema import Schema
from treeloom.functions.template import render
from treeloom.sources import registry
from treeloom.sources import text_formats as T
from treeloom.sources.dockerfile import read_dockerfile
from treeloom.sources.hcl import read_hcl, write_hcl
from treeloom.sources.markdown import read_markdown
from treeloom.values import BigFloat, DocumentError, compare_numbers, equal, is_multiple, is_whole, number_from_literal, parse_json, same_data, to_json, type_name

scalars = st.none() | st.booleans() | st.integers(-(10**30), 10**30) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(min_size=1, max_size=4), x, max_size=4), max_leaves=20)


def test_numbers():
    assert [type_name(number_from_literal(x)) for x in ("1", "1.5", "1e400", "-0", "123456789012345678901234567890")] == ["int", "float", "float", "float", "int"]
    assert isinstance(number_from_literal("0.12345678901234567890123"), BigFloat) and number_from_literal("0.1") == 0.1
    assert to_json(parse_json("[1e400,0.12345678901234567890123,9007199254740993]")) == "[1e400,0.12345678901234567890123,9007199254740993]"
    assert is_multiple(0.3, 0.1) and not is_multiple(0.35, 0.1) and not is_multiple(math.nan, 1) and is_whole(number_from_literal("1e400"))
    assert compare_numbers(math.nan, 1) is None and compare_numbers(1, 1.0) == 0 and equal(1, 1.0) and not equal(1, True)
    assert same_data(math.nan, math.nan) and not same_data(0.0, -0.0)


def test_json_refuses():
    for bad in ("{", "[1,]", "NaN", "// c\n1", "'a'", ""):
        with pytest.raises(DocumentError):
            parse_json(bad)
    with pytest.raises(DocumentError):
        to_json(math.inf)


def test_pointers():
    d = {"a": {"b/c": [10, 20]}, "port": 1}
    assert P.get(d, "/a/b~1c/1") == 20 and P.get(d, "") is d and P.exists(d, "/a") and not P.exists(d, "/x")
    assert P.longest_prefix(d, "/a/b~1c/7/x") == "/a/b~1c"
    for bad in ("a", "/", "/a//b", "/a~2"):
        with pytest.raises(DocumentError):
            P.get(d, bad)
    with pytest.raises(DocumentError, match="did you mean port"):
        P.get(d, "/prt")
    assert P.keys([1, 2]) == [0, 1] and P.length("aé") == 2 and P.hint_for_jsonpath("$.a[0]['b c']") == "/a/0/b c"
    assert P.paths(d)[:3] == [("", "object"), ("/a", "object"), ("/a/b~1c", "array")]


def test_edits():
    d = {"a": [1, 2, 3]}
    assert P.set_value(d, "/b/c", 1) == {"a": [1, 2, 3], "b": {"c": 1}} and P.set_value(d, "/a/-", 4)["a"] == [1, 2, 3, 4]
    assert P.delete(d, "/a/0") == {"a": [2, 3]} and P.insert(d, "/a/1", 9)["a"] == [1, 9, 2, 3] and d == {"a": [1, 2, 3]}
    for bad in (lambda: P.delete(d, "/x"), lambda: P.delete(d, ""), lambda: P.set_value(d, "/b", 1, create=False), lambda: P.set_value(d, "/a/7", 1), lambda: P.apply_patch(d, [{"op": "add", "path": "/x/y", "value": 1}])):
        with pytest.raises(DocumentError):
            bad()


def test_patch():
    d = {"a": 1, "b": [1, 2]}
    ops = [{"op": "test", "path": "/a", "value": 1.0}, {"op": "move", "from": "/a", "path": "/c"}, {"op": "copy", "from": "/b/0", "path": "/b/-"}, {"op": "remove", "path": "/b/0"}, {"op": "replace", "path": "/c", "value": [None]}]
    assert P.apply_patch(d, ops) == {"b": [2, 1], "c": [None]}
    with pytest.raises(DocumentError):
        P.apply_patch(d, [{"op": "test", "path": "/a", "value": 2}])
    with pytest.raises(DocumentError):
        P.apply_patch(d, [{"op": "move", "from": "/b", "path": "/b/0"}])
    with pytest.raises(DocumentError):
        P.read_patch([{"op": "add", "path": "/a", "value": 1, "x": 2}], script=True)
    assert P.read_patch_lines("# c\nadd /x [1]\nremove /a\nmove /b /c\n") == [{"op": "add", "path": "/x", "value": [1]}, {"op": "remove", "path": "/a"}, {"op": "move", "path": "/c", "from": "/b"}]


def test_original_pointers():
    value = {"a": [{"n": 0}, {"n": 1}, {"n": 2}], "b": 1}
    ops = [{"op": "remove", "path": "/a/0"}, {"op": "replace", "path": "/a/1/n", "value": 5}, {"op": "add", "path": "/a/0", "value": {"n": 9}}, {"op": "replace", "path": "/a/0/n", "value": 8}, {"op": "test", "path": "/a/1/n", "value": 1}, {"op": "move", "from": "/a/2", "path": "/c"}, {"op": "remove", "path": "/c/n"}, {"op": "add", "path": "/b", "value": 2}, {"op": "copy", "from": "/a/1", "path": "/a/-"}, {"op": "remove", "path": "/a/2/n"}]
    assert P.original_pointers(value, ops) == ["/a/0", "/a/2/n", None, None, "/a/1/n", "/a/2", "/a/2/n", "/b", "/a/1", "/a/1/n"] and P.apply_patch(value, ops)
    with pytest.raises(DocumentError):
        P.original_pointers(value, [{"op": "remove", "path": "/a/7"}])


def test_merge():
    assert P.merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": None, "e": {"f": None, "g": 1}}, "d": [None]}) == {"a": {"c": 2, "e": {"g": 1}}, "d": [None]}
    assert P.merge(1, {"a": None, "b": 2}) == {"b": 2} and P.merge({"a": 1}, 5) == 5


@settings(max_examples=150, deadline=None)
@given(values, values)
def test_diff_then_patch(a, b):
    assert equal(P.apply_patch(a, P.diff(a, b)), b) and P.diff(a, a) == []


def test_diff_order():
    assert [(o["op"], o["path"]) for o in P.diff({"a": 1, "b": 2, "l": [1, 2, 3]}, {"c": 1, "l": [1]})] == [("remove", "/a"), ("remove", "/b"), ("add", "/c"), ("remove", "/l/2"), ("remove", "/l/1")]


@pytest.mark.parametrize(("path", "found"), [("$.a[*].n", [1, 2]), ("$..n", [1, 5, 2]), ("$.a[-1].n", [2]), ("$.a[0:1].n", [1]), ("$.a[?@.n > 1].n", [2]), ("$.a[?@.n==1 || !@.b].n", [1, 2]), ("$.x y", [3]), ("$[?length(@)==3]", ["abc"]), ("$.a[?count(@.*)==2].n", [1]), ("$[?search(@,'b')]", ["abc"]), ("$.a[::-1].n", [2, 1]), ("$.a[?@.n in [1]]", []), ("$.none", [])])
def test_jsonpath(path, found):
    assert [v for _, v in select({"a": [{"n": 1, "b": {"n": 5}}, {"n": 2}], "x y": 3, "s": "abc"}, path)] == found


@pytest.mark.parametrize("path", ["$.a.length()", "$.['x']", "$[?@.a =~ 'x']", "$[", "a", "$[?length(@)]", "$[-0]"])
def test_jsonpath_refuses(path):
    with pytest.raises(DocumentError):
        select({}, path)


@pytest.mark.parametrize(("schema", "good", "bad"), [
    ({"type": "integer"}, 1.0, 1.5), ({"enum": [1, "a"]}, 1.0, 2), ({"multipleOf": 0.1}, 0.3, 0.35), ({"minimum": 1}, 1, math.nan), ({"exclusiveMaximum": 1}, 0, 1), ({"minLength": 2}, "éé", "é"), ({"pattern": "b"}, "abc", "a"),
    ({"uniqueItems": True}, [1, "1"], [1, 1.0]), ({"required": ["a"]}, {"a": None}, {}), ({"additionalProperties": False, "properties": {"a": {}}}, {"a": 1}, {"b": 1}), ({"items": {"type": "string"}, "prefixItems": [{}]}, [1, "a"], [1, 2]), ({"contains": {"const": 1}}, [2, 1], [2]),
    ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, 1, 6), ({"anyOf": [{"const": 1}, {"const": 2}]}, 2, 3), ({"not": {"type": "null"}}, 1, None), ({"if": {"type": "string"}, "then": {"minLength": 1}, "else": {"minimum": 0}}, "a", -1), ({"$defs": {"p": {"minimum": 1}}, "$ref": "#/$defs/p"}, 1, 0),
    ({"unevaluatedProperties": False, "allOf": [{"properties": {"a": {}}}]}, {"a": 1}, {"b": 1}), ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}), ({"dependentRequired": {"a": ["b"]}}, {"b": 1}, {"a": 1}), ({"$anchor": "n", "properties": {"c": {"$ref": "#n"}}, "required": ["v"]}, {"v": 1, "c": {"v": 2}}, {"v": 1, "c": {}}), (False, None, 1),
])
def test_schema(schema, good, bad):
    s = Schema(schema)
    if schema is not False:
        assert s.errors(good) == []
    assert s.errors(bad)


def test_templates():
    assert render("{{ .a.b }} {{ .l.1 }} {{ .x }}!", {"a": {"b": "q"}, "l": [1, 2]}) == "q 2 <missing>!"
    with pytest.raises(DocumentError):
        render("{{ a }}", {})


yaml_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False) | st.text(max_size=8).filter(lambda s: s.isprintable()), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=4).filter(lambda s: s.isprintable()), x, max_size=3), max_leaves=10)


@settings(max_examples=150, deadline=None)
@given(yaml_values)
def test_yaml_round_trip(value):
    assert equal(T.read_yaml_stream(T.write_yaml(value))[0], value)


def test_yaml():
    d = T.read_yaml_stream("a: &x [1, 0x10, 0o7, 1_0, yes, ~]\nb: *x\n<<: {c: 1}\nd: 2001-01-01\n---\n2\n")
    assert d == [{"a": [1, 16, 7, "1_0", "yes", None], "b": [1, 16, 7, "1_0", "yes", None], "<<": {"c": 1}, "d": "2001-01-01"}, 2]
    for bad in ("a: 1\na: 2\n", '1: a\n"1": b\n', "a: [1\n", "a: b: c\n"):
        with pytest.raises(DocumentError):
            T.read_yaml_stream(bad)
    spans: list = []
    T.read_yaml_stream("a:\n  - b: 1\n", spans)
    assert spans[0]["/a/0/b"][:2] == (2, 8)
    assert registry.select_document(d, "1") == 2 and registry.select_document(d, "all") == d


def test_yaml_style():
    assert T.write_yaml({"on": [1e16, 1e-7, -1.5], "<<": {"a": [{"b": 1, "c": [[2]]}]}, "d": "2001-12-14", "e": [], "f": "1:20"}) == "'on':\n- 1.0e+16\n- 1.0e-7\n- -1.5\n<<:\n  a:\n  - b: 1\n    c:\n    - - 2\nd: '2001-12-14'\ne: []\nf: '1:20'\n"
    assert to_json([1e16, 1e-7, 1e300]) == "[1e16,1e-7,1e300]"


def test_small_formats():
    assert T.read_ini("a=1\n[s]\nb: 2\n;c\n") == {"": {"a": "1"}, "s": {"b": "2"}} and T.read_ini(T.write_ini({"s": {"b": "2"}, "t": {}})) == {"s": {"b": "2"}, "t": {}}
    e = {"A": "x\n y", "B": "q$", "C": "", "D": 'a"\\'}
    assert T.read_dotenv(T.write_dotenv(e)) == e and T.read_dotenv("export A=b # c\nB='x # y'\n") == {"A": "b", "B": "x # y"}
    assert T.read_csv('a,b\n1,"x,\ny"\n') == [{"a": "1", "b": "x,\ny"}] and T.write_csv([{"a": "1"}, {"b": 2}]) == "a,b\n1,\n,2\n"
    with pytest.raises(DocumentError):
        T.read_csv("a,b\n1\n")
    assert T.read_jsonl('{"a":1}\r\n\n2\n') == [{"a": 1}, 2] and T.write_jsonl([1, {"a": None}]) == '1\n{"a":null}\n'
    with pytest.raises(DocumentError) as error:
        T.read_jsonl("1\n{\n")
    assert error.value.line == 2
    assert T.read_ignore_list("a \n#c\n\n!b") == ["a", "!b"]
    assert T.split_frontmatter('{"a":\n{"b":1}\n}\n\nbody')[:3] == ("json", {"a": {"b": 1}}, "body") and T.read_frontmatter("no") == {}
    assert T.write_frontmatter({"a": 1}, "yaml", "b\n") == "---\na: 1\n---\nb\n" and T.write_frontmatter(None, "yaml", "x") == "---\n---\nx"
    t = 'title = "x"\nd = 1979-05-27T07:32:00Z\n[s]\nport = 8\n[[p]]\na = 2.5\n'
    assert T.read_toml(T.write_toml(T.read_toml(t))) == T.read_toml(t) == {"title": "x", "d": "1979-05-27T07:32:00Z", "s": {"port": 8}, "p": [{"a": 2.5}]}
    assert T.write_toon({"a": 1, "r": [{"x": 1, "y": "a,b"}, {"x": 2, "y": "c"}], "l": [1, "b"]}) == 'a: 1\nr[2]{x,y}:\n  1,"a,b"\n  2,c\nl[2]: 1,b'


def test_xml():
    x = '<?xml version="1.0"?><!-- c --><p a="1"><v>1 &lt; 2</v><v/><![CDATA[z<]]></p>'
    d = T.read_xml(x)
    assert d["p"][0]["v"] == [{"#text": "1 < 2"}, {}] and d["p"][0]["@attrs"] == {"a": "1"} and d["p"][0]["#cdata"] == ["z<"] and d["#comments"] == [" c "]
    assert T.read_xml(T.write_xml(d)) == d and T.read_xml('<?xml version="1.0" encoding="iso-8859-1"?><a>\xe9</a>'.encode("latin-1"))["a"][0]["#text"] == "é"
    for bad in ("<a>", "<a></b>", "<a/><b/>"):
        with pytest.raises(DocumentError):
            T.read_xml(bad)
    with pytest.raises(DocumentError):
        T.write_xml({"a": [{}, {}]})


def test_dockerfile():
    d = read_dockerfile('# escape=`\nARG V=1\nFROM a:1 AS b\n# c\nRUN echo `\n# in between\n  hi\nENV A=1 B="x y"\nENV OLD some text\nCMD ["sh", "-c"]\nRUN <<E\nfoo\nE\n')
    assert [(x["instruction"], x["line"]) for x in d] == [("ARG", 2), ("FROM", 3), ("RUN", 5), ("ENV", 8), ("ENV", 9), ("CMD", 10), ("RUN", 11)]
    assert d[3]["arguments"] == {"A": "1", "B": "x y"} and d[4]["arguments"] == {"OLD": "some text"} and d[5]["arguments"] == ["sh", "-c"] and d[6]["arguments"] == "<<E\nfoo\nE"
    for bad in ("FROM", "NOPE x", "FROM a\nRUN <<E\nx", "RUN x", "# escape=x\nFROM a"):
        with pytest.raises(DocumentError):
            read_dockerfile(bad)


def test_hcl():
    h = 'terraform {\n  backend "s3" { region = "x" }\n}\nr "a" "b" {\n  i { p = 80 }\n  i { p = 443 }\n  n = var.x + 1 # c\n  l = ["a", var.y, 3.0]\n  t = "${a.b}-x"\n  h = <<EOT\n  hi\nEOT\n}\n'
    d = read_hcl(h)
    assert d["terraform"] == {"backend": {"s3": {"region": "x"}}} and d["r"]["a"]["b"] == {"i": [{"p": 80}, {"p": 443}], "n": "${var.x + 1}", "l": ["a", "${var.y}", 3.0], "t": "${a.b}-x", "h": "  hi\n"}
    assert read_hcl(write_hcl({"resource": {"x": {"y": {"a": [1, True, None], "b": [{"c": "d"}]}}}})) == {"resource": {"x": {"y": {"a": [1, True, None], "b": {"c": "d"}}}}}
    for bad in ("a = 1\na = 2", "x {\n}\nx = 1", 'x "a" {}\nx {}', "a = {b = 1, \"b\" = 2}", "a = "):
        with pytest.raises(DocumentError):
            read_hcl(bad)


def test_markdown():
    d = read_markdown("---\ntitle: x\n---\n# H *a* `c`\n\npara **b** [l](u \"t\") ![](i) ~~s~~ https://a.b/c.\n\n- [x] one\n- two\n\n```yaml\na: 1\n```\n\n    ind\n\n| a | b |\n|---|:-:|\n| 1 | 2 | 3 |\n\n<div>\nx\n\nSet\n===\n")
    kinds = [(c["type"], c["position"]["start"]["line"]) for c in d["children"]]
    assert kinds == [("heading", 4), ("paragraph", 6), ("list", 8), ("code_block", 11), ("code_block", 15), ("table", 17), ("html_block", 21), ("heading", 24)]
    assert d["frontmatter"] == {"kind": "yaml", "value": {"title": "x"}} and [c["type"] for c in d["children"][1]["children"]] == ["text", "strong", "text", "link", "text", "image", "text", "strikethrough", "text", "link", "text"]
    assert d["children"][3]["lang"] == "yaml" and d["children"][4]["fenced"] is False and d["children"][5]["children"][1]["n_source_cells"] == 3 and d["children"][2]["children"][0]["checked"] is True


def test_detect_and_convert():
    assert [registry.detect(x) for x in ("a.JSON", "x/.env.local", "Dockerfile", "a.tf", ".envrc", ".gitignore", ".env.json", "x.md", "pom.xml")] == ["json", "dotenv", "dockerfile", "hcl", None, "ignore-list", "json", "markdown", "xml"]
    assert registry.convert("a,b\n1,2\n", "csv", "json", indent=0) == '[{"a":"1","b":"2"}]\n' and registry.convert('{"b":1,"a":2}', "json", "yaml", sort=True) == "a: 2\nb: 1\n"
    for target in ("dockerfile", "ignore-list", "markdown"):
        with pytest.raises(DocumentError):
            registry.convert("{}", "json", target)
    with pytest.raises(DocumentError):
        registry.convert("[1]", "json", "toml")
    assert registry.format_text("b: 1\na: [1]\n---\n2\n", "yaml", sort=True) == "a:\n- 1\nb: 1\n---\n2\n"


def test_yaml_readers_agree(monkeypatch):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab:- \n[]{},'\"#&*!|>%@`?0.1~\ttrue") for _ in range(rng.randrange(1, 24))) for _ in range(3000)]

    def read(text):
        try:
            return repr(T.read_yaml_stream(text))
        except DocumentError as error:
            return error.message

    fast = list(map(read, texts))
    monkeypatch.setattr(T, "_Fast", None)
    assert fast == list(map(read, texts))
