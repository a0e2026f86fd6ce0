"""Dockerfiles as an array of {instruction, arguments, line}."""

from __future__ import annotations

import json
import re

from treeloom.values import DocumentError

#: Instructions of the Dockerfile reference.
KEYWORDS = frozenset("ADD ARG CMD COPY ENTRYPOINT ENV EXPOSE FROM HEALTHCHECK LABEL MAINTAINER ONBUILD RUN SHELL STOPSIGNAL USER VOLUME WORKDIR".split())
_EXEC = frozenset("ADD CMD COPY ENTRYPOINT RUN SHELL VOLUME".split())
_DIRECTIVE = re.compile(r"#\s*([A-Za-z][\w.-]*)\s*=\s*(.*?)\s*$")


def _pairs(text: str, escape: str) -> list[tuple[str, str | None]]:
    """name=value words, with quotes and escapes removed."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        word, cut, quoted = [], None, ""
        while at < len(text) and (quoted or not text[at].isspace()):
            c = text[at]
            if c == escape and quoted != "'" and at + 1 < len(text):
                if quoted and text[at + 1] not in ('"', escape, "$"):
                    word.append(c)
                word.append(text[at + 1])
                at += 2
                continue
            if c in "'\"" and (not quoted or quoted == c):
                quoted = "" if quoted else c
            elif c == "=" and cut is None and not quoted:
                cut = len(word)
                word.append(c)
            else:
                word.append(c)
            at += 1
        whole = "".join(word)
        out.append((whole, None) if cut is None else (whole[:cut], whole[cut + 1 :]))
    return out


def _arguments(name: str, text: str, escape: str, line: int) -> object:
    if name in _EXEC and text.startswith("["):
        try:
            found = json.loads(text)
        except ValueError:
            return text
        return found if isinstance(found, list) and all(isinstance(x, str) for x in found) else text
    if name in ("ENV", "LABEL"):
        pairs = _pairs(text, escape)
        if pairs[0][1] is None:  # the old form: NAME rest of the line
            key, _, rest = text.partition(" ")
            if not rest.strip():
                raise DocumentError("parse", f"{name} needs a name and a value", line)
            return {key: rest.strip()}
        if any(v is None for _, v in pairs):
            raise DocumentError("parse", f"{name} takes name=value pairs", line)
        return dict(pairs)
    if name == "ARG":
        return dict(_pairs(text, escape))
    return text


def read_dockerfile(text: str) -> list:
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
    escape, at, out = "\\", 0, []
    seen: set[str] = set()
    while at < len(lines) and (m := _DIRECTIVE.match(lines[at].strip())):
        key = m[1].lower()
        if key not in ("syntax", "escape", "check"):
            break
        if key in seen:
            raise DocumentError("parse", f"directive {key} stands twice", at + 1)
        seen.add(key)
        if key == "escape":
            if m[2] not in ("\\", "`"):
                raise DocumentError("parse", f"escape can't be {m[2]!r}", at + 1)
            escape = m[2]
        at += 1
    continued = re.compile(rf"{re.escape(escape)}[ \t]*$")
    while at < len(lines):
        stripped = lines[at].strip()
        if not stripped or stripped.startswith("#"):
            at += 1
            continue
        start, parts = at, []
        while at < len(lines):
            now = lines[at]
            at += 1
            if parts and (not now.strip() or now.lstrip().startswith("#")):
                if at >= len(lines):
                    break
                continue
            more = bool(continued.search(now))
            parts.append(continued.sub("", now) if more else now)
            if not more:
                break
        word, _, rest = "".join(parts).strip().partition(" ")
        if "\t" in word:
            word, _, rest = "".join(parts).strip().partition("\t")
        name, rest = word.upper(), rest.strip()
        if name not in KEYWORDS:
            raise DocumentError("parse", f"unknown instruction {word}", start + 1)
        if not rest:
            raise DocumentError("parse", f"{name} needs an argument", start + 1)
        if name in ("RUN", "COPY", "ADD"):
            body = [rest]
            for m in re.finditer(r"<<-?\s*(['\"]?)([A-Za-z_]\w*)\1", rest):
                while True:
                    if at >= len(lines):
                        raise DocumentError("parse", f"heredoc {m[2]} has no end", start + 1)
                    body.append(lines[at])
                    at += 1
                    if (body[-1].lstrip("\t") if m[0].startswith("<<-") else body[-1]) == m[2]:
                        break
            rest = "\n".join(body)
        out.append({"instruction": name, "arguments": _arguments(name, rest, escape, start + 1), "line": start + 1})
    if not any(x["instruction"] == "FROM" for x in out) and out:
        first = out[0]
        if any(x["instruction"] != "ARG" for x in out):
            raise DocumentError("parse", "a build begins with FROM", first["line"])
    return out
