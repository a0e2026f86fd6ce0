"""Readers and writers of JSON, JSON Lines, YAML, TOML, INI, dotenv, CSV, TSV, front matter, ignore lists and XML."""

from __future__ import annotations

import csv
import datetime
import io
import json
import math
import re
import tomllib
import xml.parsers.expat as expat

import yaml

from treeloom.values import BigFloat, DocumentError, is_number, number_from_literal, number_text, parse_json, to_json, type_name

# JSON Lines


def read_jsonl(text: str) -> list:
    """One record a line; blank lines are skipped, a carriage return before the line's end isn't part of it."""
    out = []
    for n, line in enumerate(text.removeprefix("\ufeff").split("\n"), 1):
        if line.strip():
            try:
                out.append(parse_json(line.rstrip("\r")))
            except DocumentError as error:
                raise DocumentError("parse", error.message, n, error.col) from None
    return out


def write_jsonl(value: object) -> str:
    if not isinstance(value, list):
        raise DocumentError("write", f"JSON Lines are written from an array, not from {type_name(value)}")
    return "".join(to_json(v) + "\n" for v in value)


# YAML: the 1.2 core schema, several documents, exact numbers, no merge keys


class _Loader(yaml.SafeLoader):
    pass


#: The same over the C library, where it is there; it has no say in what is an error, and none in places.
_Fast = type("_Fast", (yaml.CSafeLoader,), {}) if yaml.__with_libyaml__ else None
_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"[-+]?(?:0|[1-9][0-9]*|0[0-9]+)$|0o[0-7]+$|0x[0-9a-fA-F]+$", list("-+0123456789")),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|[-+]?\.(?:inf|Inf|INF)$|\.(?:nan|NaN|NAN)$", list("-+0123456789.")),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)
if _Fast:
    _Fast.yaml_implicit_resolvers = _Loader.yaml_implicit_resolvers


def _scalar(node: yaml.ScalarNode) -> object:
    kind, text = node.tag.rpartition(":")[2], node.value
    if kind == "null":
        return None
    if kind == "bool":
        return text.lower() == "true"
    if kind in ("int", "float") and re.fullmatch(_NUMBERS, text):
        low = text.lower().lstrip("+")
        if low.startswith(("0x", "0o")):
            return int(low, 0)
        if low.endswith(".inf"):
            return -math.inf if low[0] == "-" else math.inf
        if low == ".nan":
            return math.nan
        sign, body = ("-", low[1:]) if low[0] == "-" else ("", low)
        if kind == "int":
            return number_from_literal(sign + (body.lstrip("0") or "0"))
        body = "0" + body if body[0] == "." else body
        found = number_from_literal(sign + re.sub(r"\.(?=$|e)", ".0", body))
        return float(found) if isinstance(found, int) else found
    return text


_NUMBERS = r"[-+]?(?:[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|\.[0-9]+|[0-9]+\.[0-9]*)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)"


def _key_text(node: yaml.Node, value: object) -> str:
    if isinstance(node, yaml.ScalarNode):
        return node.value if value is None or not isinstance(value, str) else value
    return flow_yaml(value)


def _built(node: yaml.Node, at: str, spans: dict | None, depth: int = 0) -> object:
    if depth > 200:
        raise DocumentError("parse", "nested too deeply", node.start_mark.line + 1)
    if spans is not None:
        spans.setdefault(at, (node.start_mark.line + 1, node.start_mark.column + 1, node.start_mark.index, node.end_mark.index))
    if isinstance(node, yaml.ScalarNode):
        return _scalar(node)
    if isinstance(node, yaml.SequenceNode):
        return [_built(x, f"{at}/{i}", spans, depth + 1) for i, x in enumerate(node.value)]
    out: dict = {}
    for k, v in node.value:
        key = _key_text(k, _built(k, "?", None, depth + 1))
        if key in out:
            raise DocumentError("parse", f"duplicate key {key!r}", k.start_mark.line + 1, k.start_mark.column + 1)
        out[key] = _built(v, f"{at}/{key.replace('~', '~0').replace('/', '~1')}", spans, depth + 1)
    return out


def read_yaml_stream(text: str, spans: list | None = None) -> list:
    """All documents of a stream. spans: gets a map from pointer to (line, column, start, end) for each."""
    if spans is None and _Fast and not re.search(r"[\0\t!]|\?[^\s]|[|>][-+0-9]*#", text):
        try:
            loader, out = _Fast(text.removeprefix("\ufeff")), []
            while loader.check_node():
                out.append(_built(loader.get_node(), "", None))
            return out or [None]
        except (yaml.YAMLError, UnicodeError):
            pass  # read again for the message and the place
    loader = _Loader(text.removeprefix("\ufeff"))
    out = []
    try:
        while loader.check_node():
            own: dict | None = None if spans is None else {}
            out.append(_built(loader.get_node(), "", own))
            if spans is not None:
                spans.append(own)
    except yaml.YAMLError as error:
        mark = getattr(error, "problem_mark", None)
        raise DocumentError("parse", str(getattr(error, "problem", None) or error), mark and mark.line + 1, mark and mark.column + 1) from None
    return out or [None]


_PLAIN = re.compile(r"[A-Za-z_./][A-Za-z0-9_./@+-]*(?: [A-Za-z0-9_./@+(-][A-Za-z0-9_./@+()-]*)*\Z")
#: Words that YAML 1.1 readers take for booleans or null.
_WORDS = frozenset("y n yes no on off true false null none nan inf".split())


def _yaml_string(s: str) -> str:
    if s == "<<":
        return s
    if _PLAIN.match(s) and s.lower() not in _WORDS and not s.startswith(("---", "...", ".inf", ".nan")) and not re.fullmatch(_NUMBERS, s) and not re.match(r"\.[0-9]|[0-9]", s):
        return s
    if s.isprintable() and "'" not in s:
        return f"'{s}'"
    return to_json(s)


def _yaml_scalar(v: object) -> str:
    if isinstance(v, str):
        return _yaml_string(v)
    if isinstance(v, float) and math.isfinite(v):
        mantissa, e, exponent = number_text(v).partition("e")
        return mantissa + e + exponent if not e else f"{mantissa if '.' in mantissa else mantissa + '.0'}e{exponent if exponent[0] == '-' else '+' + exponent}"
    return number_text(v) if is_number(v) else to_json(v)


def flow_yaml(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ", ".join(f"{_yaml_string(k)}: {flow_yaml(x)}" for k, x in v.items()) + "}"
    return "[" + ", ".join(map(flow_yaml, v)) + "]" if isinstance(v, list) else _yaml_scalar(v)


def _yaml_lines(v: object, pad: str) -> list[str]:
    out = []
    if isinstance(v, dict) and v:
        for k, x in v.items():
            if isinstance(x, (dict, list)) and x:
                out.append(f"{pad}{_yaml_string(k)}:")
                out += _yaml_lines(x, pad if isinstance(x, list) else pad + "  ")  # sequences stand below their key
            elif isinstance(x, str) and "\n" in x and re.fullmatch(r"[^\x00-\x08\x0b-\x1f]*", x) and not x.startswith((" ", "\n")) and not x.endswith("\n\n"):
                out.append(f"{pad}{_yaml_string(k)}: |{'' if x.endswith(chr(10)) else '-'}")
                out += [f"{pad}  {line}" if line else "" for line in x.removesuffix("\n").split("\n")]
            else:
                out.append(f"{pad}{_yaml_string(k)}: {flow_yaml(x)}")
    elif isinstance(v, list) and v:
        for x in v:
            if isinstance(x, (dict, list)) and x:
                inner = _yaml_lines(x, pad + "  ")
                out += [f"{pad}- {inner[0][len(pad) + 2 :]}", *inner[1:]]
            else:
                out.append(f"{pad}- {flow_yaml(x)}")
    else:
        out.append(pad + flow_yaml(v))
    return out


def write_yaml(value: object) -> str:
    return "\n".join(_yaml_lines(value, "")) + "\n"


def write_yaml_stream(documents: list) -> str:
    return "---\n".join(map(write_yaml, documents))


# TOML


def _from_toml(v: object) -> object:
    if isinstance(v, dict):
        return {k: _from_toml(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_from_toml(x) for x in v]
    if isinstance(v, (datetime.datetime, datetime.date, datetime.time)):
        text = v.isoformat()
        return text.replace("+00:00", "Z")
    return v


def read_toml(text: str) -> object:
    try:
        return _from_toml(tomllib.loads(text.removeprefix("\ufeff").replace("\r\n", "\n"), parse_float=lambda s: _toml_float(s)))
    except tomllib.TOMLDecodeError as error:
        place = re.search(r"line (\d+), column (\d+)", str(error))
        raise DocumentError("parse", str(error), *(map(int, place.groups()) if place else ())) from None


def _toml_float(s: str) -> object:
    low = s.lower().lstrip("+")
    return float(low) if low.lstrip("-") in ("inf", "nan") else number_from_literal(s.lstrip("+").replace("_", ""))


def _toml_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else to_json(k)


def _toml_value(v: object) -> str:
    if v is None:
        raise DocumentError("write", "TOML has no null")
    if isinstance(v, float) and not math.isfinite(v):
        return "nan" if math.isnan(v) else "inf" if v > 0 else "-inf"
    if isinstance(v, BigFloat) or isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
        raise DocumentError("write", f"TOML can't hold {to_json(v)}")
    if isinstance(v, list):
        return "[" + ", ".join(map(_toml_value, v)) + "]"
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items()) + " }" if v else "{}"
    return to_json(v)


def write_toml(value: object) -> str:
    if not isinstance(value, dict):
        raise DocumentError("write", f"the root of TOML is a table, not {type_name(value)}")
    out: list[str] = []

    def table(v: dict, path: list[str]) -> None:
        tables = {k for k, x in v.items() if isinstance(x, dict) or isinstance(x, list) and x and all(isinstance(y, dict) for y in x)}
        out.extend(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items() if k not in tables)
        for k in v:
            if k not in tables:
                continue
            at = [*path, _toml_key(k)]
            for y in v[k] if isinstance(v[k], list) else [v[k]]:
                if out:
                    out.append("")
                out.append(f"[[{'.'.join(at)}]]" if isinstance(v[k], list) else f"[{'.'.join(at)}]")
                table(y, at)

    table(value, [])
    return "\n".join(out) + "\n" if out else ""


# INI


def read_ini(text: str) -> dict:
    """{section: {key: string}}; keys before the first header are in section ""."""
    out: dict = {}
    section = ""
    for n, line in enumerate(text.removeprefix("\ufeff").splitlines(), 1):
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if line.startswith("["):
            if not line.endswith("]"):
                raise DocumentError("parse", "a header ends with ]", n)
            section = line[1:-1].strip()
            out.setdefault(section, {})
            continue
        m = re.match(r"([^=:]*)[=:](.*)", line, re.S)
        if not m:
            raise DocumentError("parse", "a key, = or :, and a value expected", n)
        value = m[2].strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out.setdefault(section, {})[m[1].strip()] = value
    return out


def write_ini(value: object) -> str:
    if not isinstance(value, dict):
        raise DocumentError("write", f"INI is written from sections, not from {type_name(value)}")
    blocks = []
    for name, section in value.items():
        if not isinstance(section, dict):
            raise DocumentError("write", f"section {name!r} is {type_name(section)}")
        lines = [f"[{name}]"] if name else []
        for k, v in section.items():
            if isinstance(v, (dict, list)):
                raise DocumentError("write", f"{name}.{k} is {type_name(v)}")
            text = "" if v is None else v if isinstance(v, str) else to_json(v)
            if "\n" in text:
                raise DocumentError("write", f"{name}.{k} has a line break")
            lines.append(f"{k}={text}")
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) + "\n" if blocks else ""


# dotenv


def read_dotenv(text: str) -> dict:
    """A flat map; export, comments, double quotes with escapes, literal single quotes; nothing is expanded."""
    out: dict = {}
    for n, line in enumerate(text.removeprefix("\ufeff").splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.match(r"(?:export\s+)?([A-Za-z_][A-Za-z0-9_.-]*)\s*=\s*(.*)\Z", line)
        if not m:
            raise DocumentError("parse", "KEY=value expected", n)
        raw = m[2]
        if raw.startswith('"'):
            q = re.match(r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?\Z', raw)
            if not q:
                raise DocumentError("parse", "a double quote without end", n)
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1] if e[1] in '"\\' else e[0]), q[1])
        elif raw.startswith("'"):
            q = re.match(r"'([^']*)'\s*(?:#.*)?\Z", raw)
            if not q:
                raise DocumentError("parse", "a single quote without end", n)
            value = q[1]
        else:
            value = re.split(r"\s#", raw, maxsplit=1)[0].rstrip()
        out[m[1]] = value
    return out


def write_dotenv(value: object, exported: frozenset[str] = frozenset()) -> str:
    if not isinstance(value, dict):
        raise DocumentError("write", f"dotenv is written from a map, not from {type_name(value)}")
    out = []
    for k, v in value.items():
        if isinstance(v, (dict, list)):
            raise DocumentError("write", f"{k} is {type_name(v)}")
        text = "" if v is None else v if isinstance(v, str) else to_json(v)
        if re.search(r"[\s#=$\\\"']", text) or not text.isprintable():
            text = '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
        out.append(f"{'export ' if k in exported else ''}{k}={text}\n")
    return "".join(out)


# CSV and TSV


def read_csv(text: str, delimiter: str = ",") -> list:
    """A row of names, then one map of strings a row; rows of another length are errors."""
    rows = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter=delimiter, strict=True)
    try:
        names = next(rows, None)
        out = []
        for row in rows:
            if not row:
                continue
            if len(row) != len(names):
                raise DocumentError("parse", f"{len(row)} cells where {len(names)} were expected", rows.line_num)
            out.append(dict(zip(names, row, strict=True)))
    except csv.Error as error:
        raise DocumentError("parse", str(error), rows.line_num) from None
    return out


def write_csv(value: object, delimiter: str = ",") -> str:
    """Columns are all keys in the order they are first seen; missing cells are empty."""
    if not isinstance(value, list) or not all(isinstance(r, dict) for r in value):
        raise DocumentError("write", "rows are written from an array of maps")
    names = list(dict.fromkeys(k for r in value for k in r))
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    if names:
        writer.writerow(names)
    for n, r in enumerate(value):
        for k, v in r.items():
            if isinstance(v, (dict, list)):
                raise DocumentError("write", f"row {n}: {k} is {type_name(v)}")
        writer.writerow(["" if r.get(k) is None else r[k] if isinstance(r[k], str) else to_json(r[k]) for k in names])
    return out.getvalue()


# Front matter

_HEADER_LIMIT = 64 << 10


def split_frontmatter(text: str) -> tuple[str | None, object, str, int]:
    """(kind, header value, body, lines before the body); kind None without a header."""
    body = text.removeprefix("\ufeff")
    for kind, mark in (("yaml", "---"), ("toml", "+++")):
        m = re.match(rf"{re.escape(mark)}[ \t]*\r?\n(.*?)^{re.escape(mark)}[ \t]*(?:\r?\n|\Z)", body[:_HEADER_LIMIT], re.S | re.M)
        if m:
            header = read_yaml_stream(m[1])[0] if kind == "yaml" else read_toml(m[1])
            return kind, header, body[m.end() :], m[0].count("\n")
    if body.startswith("{"):
        try:
            end = json.JSONDecoder().raw_decode(body[:_HEADER_LIMIT])[1]
        except ValueError:
            end = 0
        m = re.compile(r"[ \t]*\r?\n[ \t]*(?:\r?\n|\Z)").match(body, end) if end else None
        if m:
            return "json", parse_json(body[:end]), body[m.end() :], body[: m.end()].count("\n")
    return None, {}, text, 0


def read_frontmatter(text: str) -> object:
    return split_frontmatter(text)[1]


def write_frontmatter(value: object, kind: str | None, body: str) -> str:
    if kind is None:
        return body if value in ({}, None) else f"---\n{write_yaml(value)}---\n{body}"
    if kind == "json":
        return f"{to_json(value, 2)}\n\n{body}"
    mark, header = ("---", "" if value is None else write_yaml(value)) if kind == "yaml" else ("+++", write_toml(value))
    return f"{mark}\n{header}{mark}\n{body}"


# Ignore lists


def read_ignore_list(text: str) -> list:
    return [s for line in text.removeprefix("\ufeff").splitlines() if (s := line.rstrip()) and not s.lstrip().startswith("#")]


# XML


def read_xml(data: bytes | str) -> dict:
    """Elements as arrays of maps with @attrs, #text, #comments, #cdata and #pi; the declaration as #xml."""
    raw = data if isinstance(data, bytes) else data.encode("utf-8")
    parser = expat.ParserCreate()
    parser.buffer_text, parser.ordered_attributes = True, True
    root: dict = {}
    stack: list[dict] = [root]
    texts: list[list[str]] = [[]]
    cdata: list[list[str] | None] = [None]

    def start(name: str, attributes: list) -> None:
        node: dict = {}
        if attributes:
            node["@attrs"] = dict(zip(attributes[::2], attributes[1::2], strict=True))
        stack[-1].setdefault(name, []).append(node)
        stack.append(node)
        texts.append([])

    def end(name: str) -> None:
        text = "".join(texts.pop())
        node = stack.pop()
        if text.strip(" \t\r\n"):
            node["#text"] = text if not set(node) - {"@attrs"} else text.strip(" \t\r\n")

    def characters(text: str) -> None:
        if cdata[0] is not None:
            cdata[0].append(text)
        else:
            texts[-1].append(text)

    def cdata_end() -> None:
        stack[-1].setdefault("#cdata", []).append("".join(cdata[0] or []))
        cdata[0] = None

    def declaration(version: str, encoding: str | None, standalone: int) -> None:
        root["#xml"] = {"version": version} | ({"encoding": encoding} if encoding else {}) | ({"standalone": "yes" if standalone else "no"} if standalone >= 0 else {})

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.CommentHandler = lambda text: stack[-1].setdefault("#comments", []).append(text)
    parser.ProcessingInstructionHandler = lambda target, body: stack[-1].setdefault("#pi", []).append(f"{target} {body}".strip())
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: cdata.__setitem__(0, []), cdata_end
    parser.XmlDeclHandler = declaration
    try:
        parser.Parse(raw, True)
    except (expat.ExpatError, ValueError, LookupError) as error:
        raise DocumentError("parse", str(error), getattr(error, "lineno", None), getattr(error, "offset", None)) from None
    return root


def _xml_escaped(s: str, attribute: bool = False) -> str:
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", s):
        raise DocumentError("write", "XML can't hold this control character")
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;").replace("\x85", "&#133;").replace("\u2028", "&#8232;")
    if attribute:
        return s.replace('"', "&quot;").replace("\t", "&#9;").replace("\n", "&#10;")
    return "".join(f"&#{ord(c)};" for c in s) if s and not s.strip(" \t\n") else s


_XML_NAME = re.compile(r"[:A-Za-z_\u00c0-\U000effff][-:.\w\u00b7\u00c0-\U000effff]*\Z")


def _xml_element(name: str, node: object, pad: str) -> list[str]:
    if not _XML_NAME.match(name):
        raise DocumentError("write", f"{name!r} is no name of an element")
    node = {} if node is None else {"#text": node if isinstance(node, str) else to_json(node)} if not isinstance(node, dict) else node
    attributes = "".join(f' {k}="{_xml_escaped(v if isinstance(v, str) else to_json(v), True)}"' for k, v in (node.get("@attrs") or {}).items())
    inner: list[str] = []
    for text in node.get("#pi", []):
        inner.append(f"{pad}  <?{text}?>")
    for text in node.get("#comments", []):
        if "--" in text or text.endswith("-"):
            raise DocumentError("write", "-- can't stand in a comment")
        inner.append(f"{pad}  <!--{text}-->")
    cdata = []
    for text in node.get("#cdata", []):
        if "]]>" in text:
            raise DocumentError("write", "]]> can't stand in a CDATA section")
        cdata.append(f"<![CDATA[{text}]]>")
    for k, v in node.items():
        if k[:1] not in "@#":
            for x in v if isinstance(v, list) else [v]:
                inner += _xml_element(k, x, pad + "  ")
    text = _xml_escaped(node["#text"] if isinstance(node["#text"], str) else to_json(node["#text"])) if "#text" in node else ""
    if not inner:
        body = text + "".join(cdata)
        return [f"{pad}<{name}{attributes}>{body}</{name}>" if body else f"{pad}<{name}{attributes}/>"]
    return [f"{pad}<{name}{attributes}>", *([f"{pad}  {text}"] if text else []), *(f"{pad}  {c}" for c in cdata), *inner, f"{pad}</{name}>"]


def write_xml(value: object) -> str:
    if not isinstance(value, dict):
        raise DocumentError("write", f"XML is written from a map, not from {type_name(value)}")
    roots = [(k, x) for k, v in value.items() if k[:1] not in "@#" for x in (v if isinstance(v, list) else [v])]
    if len(roots) != 1:
        raise DocumentError("write", f"XML has one root, not {len(roots)}")
    out = []
    if "#xml" in value:
        d = value["#xml"]
        out.append("<?xml" + "".join(f' {k}="{d[k]}"' for k in ("version", "encoding", "standalone") if k in d) + "?>")
    out += [f"<?{p}?>" for p in value.get("#pi", [])] + [f"<!--{c}-->" for c in value.get("#comments", [])]
    return "\n".join([*out, *_xml_element(*roots[0], "")]) + "\n"


# TOON, output only


def _toon_scalar(v: object, delimiter: str = ",") -> str:
    if not isinstance(v, str):
        return to_json(v, finite=False)
    plain = v and v == v.strip() and not re.search(r'[:"\\\[\]{}\n\r\t]', v) and delimiter not in v and not v.startswith("-") and v not in ("true", "false", "null") and not re.fullmatch(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|0\d+", v)
    return v if plain else to_json(v)


def _toon_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z_][\w.]*", k) else to_json(k)


def write_toon(value: object) -> str:
    """Indented keys; arrays of scalars in one line, arrays of like maps as rows under a header."""
    scalar = lambda v: not isinstance(v, (dict, list))

    def array(head: str, v: list, pad: str) -> list[str]:
        if all(map(scalar, v)):
            return [f"{pad}{head}[{len(v)}]:" + (" " + ",".join(map(_toon_scalar, v)) if v else "")]
        first = v[0]
        if isinstance(first, dict) and first and all(isinstance(x, dict) and x.keys() == first.keys() and all(map(scalar, x.values())) for x in v):
            names = ",".join(map(_toon_key, first))
            return [f"{pad}{head}[{len(v)}]{{{names}}}:", *(f"{pad}  " + ",".join(_toon_scalar(x[k]) for k in first) for x in v)]
        out = [f"{pad}{head}[{len(v)}]:"]
        for x in v:
            if scalar(x):
                out.append(f"{pad}  - {_toon_scalar(x)}")
            elif isinstance(x, list):
                inner = array("", x, pad + "    ")
                out += [f"{pad}  - {inner[0].lstrip()}", *inner[1:]]
            else:
                inner = fields(x, pad + "    ")
                out += [f"{pad}  - {inner[0].lstrip()}", *inner[1:]] if inner else [f"{pad}  -"]
        return out

    def fields(v: dict, pad: str) -> list[str]:
        out = []
        for k, x in v.items():
            if isinstance(x, dict):
                out += [f"{pad}{_toon_key(k)}:", *fields(x, pad + "  ")]
            elif isinstance(x, list):
                out += array(_toon_key(k), x, pad)
            else:
                out.append(f"{pad}{_toon_key(k)}: {_toon_scalar(x)}")
        return out

    lines = fields(value, "") if isinstance(value, dict) else array("", value, "") if isinstance(value, list) else [_toon_scalar(value)]
    return "\n".join(lines)
