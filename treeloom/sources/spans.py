"""Where each node of a JSON or YAML text stands: pointer to (line, column, start, end)."""

from __future__ import annotations

import json
import re
from bisect import bisect_right

from treeloom.pointer import escape
from treeloom.sources.text_formats import read_yaml_stream
from treeloom.values import DocumentError

_BLANK = re.compile(r"[ \t\r\n]*")
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null')


class Lines:
    """Line and column of places in a text, by binary search."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, place: int) -> tuple[int, int]:
        line = bisect_right(self.starts, place)
        return line, place - self.starts[line - 1] + 1


def json_spans(text: str) -> dict[str, tuple[int, int, int, int]]:
    """One pass without recursion; the text must be valid JSON."""
    lines, out, at = Lines(text), {}, 1 if text.startswith("﻿") else 0
    stack: list[list] = []  # [pointer, start, next index or None]
    pointer = ""

    def skip() -> str:
        nonlocal at
        at = _BLANK.match(text, at).end()
        return text[at : at + 1]

    def key() -> str:
        nonlocal at
        skip()
        m = _SCALAR.match(text, at)
        if not m or m[0][0] != '"':
            raise DocumentError("parse", "a key expected", *lines.at(at))
        at = m.end()
        if skip() != ":":
            raise DocumentError("parse", ": expected", *lines.at(at))
        at += 1
        return json.loads(m[0])

    while True:
        c = skip()
        start = at
        if c and c in "{[":
            at += 1
            if skip() == ("}" if c == "{" else "]"):
                at += 1
                out[pointer] = (*lines.at(start), start, at)
            else:
                stack.append([pointer, start, None if c == "{" else 0])
                out[pointer] = (0, 0, start, 0)
                pointer = f"{pointer}/{escape(key()) if c == '{' else 0}"
                continue
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise DocumentError("parse", "a value expected", *lines.at(at))
            at = m.end()
            out[pointer] = (*lines.at(start), start, at)
        while stack:
            c = skip()
            above, start, index = stack[-1]
            if c == ",":
                at += 1
                if index is None:
                    pointer = f"{above}/{escape(key())}"
                else:
                    stack[-1][2] = index + 1
                    pointer = f"{above}/{index + 1}"
                break
            if c != ("}" if index is None else "]"):
                raise DocumentError("parse", ", or an end expected", *lines.at(at))
            at += 1
            stack.pop()
            out[above] = (*lines.at(start), start, at)
        else:
            if skip():
                raise DocumentError("parse", "text after the document", *lines.at(at))
            return out


def yaml_spans(text: str) -> list[dict[str, tuple[int, int, int, int]]]:
    """For each document of a stream."""
    out: list = []
    read_yaml_stream(text, out)
    return out


def spans_of(text: str, form: str) -> list[dict] | None:
    return [json_spans(text)] if form == "json" else yaml_spans(text) if form == "yaml" else None
