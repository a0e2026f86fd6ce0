"""HCL: blocks as nested maps with labels as keys, repeated blocks as arrays, expressions as ${...} texts."""

from __future__ import annotations

import re

from treeloom.values import DocumentError, is_number, number_from_literal, number_text, to_json, type_name

_SKIP = re.compile(r"(?:[ \t\r]+|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_SKIP_LINES = re.compile(r"(?:[ \t\r\n]+|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[A-Za-z_][\w-]*")
_NUMBER = re.compile(r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_HEREDOC = re.compile(r"<<(-?)([A-Za-z_]\w*)\n")


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, what: str, at: int | None = None):
        at = self.at if at is None else at
        raise DocumentError("parse", what, self.text.count("\n", 0, at) + 1, at - self.text.rfind("\n", 0, at))

    def skip(self, lines: bool = False) -> None:
        self.at = (_SKIP_LINES if lines else _SKIP).match(self.text, self.at).end()

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, s: str) -> bool:
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def body(self, closed: bool) -> dict:
        out: dict = {}
        kinds: dict[str, object] = {}  # "attribute", or the number of labels
        while True:
            self.skip(True)
            if not self.peek():
                if closed:
                    self.fail("a block without end")
                return out
            if closed and self.take("}"):
                return out
            start = self.at
            m = _NAME.match(self.text, self.at)
            if not m and self.peek() != '"':
                self.fail("a name expected")
            name = m[0] if m else self.plain_string()
            self.at = m.end() if m else self.at
            self.skip()
            if self.peek() == "=" and not self.text.startswith("==", self.at):
                self.at += 1
                if name in kinds:
                    self.fail(f"{name} stands twice", start)
                kinds[name] = "attribute"
                out[name] = self.expression()
                self.skip()
                if self.peek() not in ("\n", "") and not (closed and self.peek() == "}"):
                    self.fail("a line's end expected")
                continue
            labels = []
            while self.peek() and self.peek() != "{":
                if self.peek() == '"':
                    labels.append(self.plain_string())
                elif m := _NAME.match(self.text, self.at):
                    labels.append(m[0])
                    self.at = m.end()
                else:
                    self.fail("a label or { expected")
                self.skip()
            if not self.take("{"):
                self.fail("{ expected")
            if kinds.setdefault(name, len(labels)) != len(labels):
                self.fail(f"{name} is an attribute too, or has another number of labels", start)
            inner = self.body(True)
            here, keys = out, [name, *labels]
            for k in keys[:-1]:
                here = here.setdefault(k, {})
            last = keys[-1]
            if last not in here:
                here[last] = inner
            elif isinstance(here[last], list):
                here[last].append(inner)
            else:
                here[last] = [here[last], inner]

    def plain_string(self) -> str:
        found = self.quoted()
        return found

    def quoted(self) -> str:
        """A quoted template; interpolations stay as they are written."""
        start = self.at
        self.at += 1
        out = []
        while True:
            c = self.peek()
            if not c or c == "\n":
                self.fail("a string without end", start)
            if c == '"':
                self.at += 1
                return "".join(out)
            if c == "\\":
                e = self.text[self.at + 1 : self.at + 2]
                if e in "uU" and e:
                    n = 4 if e == "u" else 8
                    out.append(chr(int(self.text[self.at + 2 : self.at + 2 + n], 16)))
                    self.at += 2 + n
                else:
                    out.append({"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}.get(e, "\\" + e))
                    self.at += 2
            elif self.text.startswith(("$${", "%%{"), self.at):
                out.append(self.text[self.at : self.at + 3])
                self.at += 3
            elif self.text.startswith(("${", "%{"), self.at):
                out.append(self.interpolation())
            else:
                out.append(c)
                self.at += 1

    def interpolation(self) -> str:
        start, depth = self.at, 0
        while self.at < len(self.text):
            c = self.peek()
            if c == '"':
                self.quoted()
                continue
            depth += (c == "{") - (c == "}")
            self.at += 1
            if not depth and c == "}":
                return self.text[start : self.at]
        self.fail("an interpolation without end", start)

    def expression(self) -> object:
        self.skip()
        start = self.at
        found = self.literal()
        if found is not _OTHER:
            end = self.at
            self.skip()
            if self.peek() in ("\n", "", ",", "}", "]", ":") or self.text.startswith("//", self.at):
                return found
            self.at = end
        self.at = start
        return "${" + self.raw() + "}"

    def literal(self) -> object:
        c = self.peek()
        if c == '"':
            return self.quoted()
        m = _HEREDOC.match(self.text, self.at)
        if m:
            lines, at = [], m.end()
            while True:
                end = self.text.find("\n", at)
                line = self.text[at : end if end >= 0 else len(self.text)]
                if line.strip() == m[2]:
                    self.at = at + len(line)
                    break
                if end < 0:
                    self.fail("a heredoc without end")
                lines.append(line)
                at = end + 1
            if m[1]:
                indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
                lines = [x[indent:] for x in lines]
            return "".join(x + "\n" for x in lines)
        if c == "-" and (m := _NUMBER.match(self.text, self.at + 1)) or (m := _NUMBER.match(self.text, self.at)):
            self.at = m.end()
            found = number_from_literal(("-" if c == "-" else "") + m[0])
            return float(found) if isinstance(found, int) and not m[0].isdigit() else found
        if c == "[":
            self.at += 1
            out = []
            while True:
                self.skip(True)
                if self.take("]"):
                    return out
                if re.match(r"for\b", self.text[self.at : self.at + 4]):
                    return _OTHER
                out.append(self.expression())
                self.skip(True)
                if not self.take(","):
                    self.skip(True)
                    if not self.take("]"):
                        return _OTHER
                    return out
        if c == "{":
            self.at += 1
            found: dict = {}
            while True:
                self.skip(True)
                if self.take("}"):
                    return found
                if re.match(r"for\b", self.text[self.at : self.at + 4]):
                    return _OTHER
                start = self.at
                if self.peek() == '"':
                    key = self.quoted()
                elif m := re.compile(r"[A-Za-z_][\w-]*|\d+").match(self.text, self.at):
                    key, self.at = m[0], m.end()
                elif self.peek() == "(":
                    key = "${" + self.raw(stop="=:") + "}"
                else:
                    return _OTHER
                self.skip()
                if not (self.take("=") or self.take(":")):
                    return _OTHER
                if key in found:
                    self.fail(f"key {key} stands twice", start)
                found[key] = self.expression()
                self.skip()
                self.take(",")
        for word, value in (("true", True), ("false", False), ("null", None)):
            if re.match(rf"{word}(?![\w.\[(-])", self.text[self.at :][:10]):
                self.at += len(word)
                return value
        return _OTHER

    def raw(self, stop: str = "") -> str:
        """An expression as it is written."""
        start, depth = self.at, 0
        while self.at < len(self.text):
            c = self.peek()
            if c == '"':
                self.quoted()
                continue
            if c in "([{":
                depth += 1
            elif c in ")]}":
                if not depth:
                    break
                depth -= 1
            elif not depth and (c == "\n" or c == "," or c in stop and c or c == "#"):
                break
            self.at += 1
        found = self.text[start : self.at].strip()
        return found or self.fail("an expression expected")


_OTHER = object()


def read_hcl(text: str) -> dict:
    return _Reader(text.removeprefix("\ufeff").replace("\r\n", "\n")).body(False)


def _expression(v: object, pad: str) -> str:
    if isinstance(v, str):
        if v.startswith("${") and v.endswith("}") and v.count("${") == 1:
            return v[2:-1]
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    if isinstance(v, list):
        return "[" + ", ".join(_expression(x, pad) for x in v) + "]"
    if isinstance(v, dict):
        return "{\n" + "".join(f"{pad}  {k if _NAME.fullmatch(k) else to_json(k)} = {_expression(x, pad + '  ')}\n" for k, x in v.items()) + pad + "}"
    return number_text(v) if is_number(v) else to_json(v)


#: Block types that Terraform writes with as many labels.
_LABELS = {"resource": 2, "data": 2, "variable": 1, "output": 1, "provider": 1, "module": 1, "terraform": 0, "locals": 0, "backend": 1, "provisioner": 1, "dynamic": 1, "check": 1}


def write_hcl(value: object) -> str:
    """Maps under the names of known block types as blocks, all else as attributes."""
    if not isinstance(value, dict):
        raise DocumentError("write", f"the root of HCL is a body, not {type_name(value)}")
    out: list[str] = []

    def block(head: str, body: object, pad: str) -> None:
        for one in body if isinstance(body, list) else [body]:
            if not isinstance(one, dict):
                raise DocumentError("write", f"block {head} is {type_name(one)}")
            out.append(f"{pad}{head} {{")
            fields(one, pad + "  ")
            out.append(f"{pad}}}")

    def labelled(head: str, v: object, n: int, pad: str) -> None:
        if not n:
            block(head, v, pad)
            return
        if not isinstance(v, dict):
            raise DocumentError("write", f"block {head} needs labels")
        for k, x in v.items():
            labelled(f"{head} {to_json(k)}", x, n - 1, pad)

    def fields(v: dict, pad: str) -> None:
        for k, x in v.items():
            if k in _LABELS and isinstance(x, (dict, list)) and x:
                labelled(k, x, _LABELS[k], pad)
            elif isinstance(x, list) and x and all(isinstance(y, dict) for y in x) and _NAME.fullmatch(k):
                block(k, x, pad)
            else:
                out.append(f"{pad}{k} = {_expression(x, pad)}")

    fields(value, "")
    return "\n".join(out) + "\n" if out else ""
