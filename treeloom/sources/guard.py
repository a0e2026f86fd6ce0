"""Template syntax in files: {{ ... }} and ${{ ... }} are refused where they would change how the file reads."""

from __future__ import annotations

import re

from treeloom.sources.registry import documents_of
from treeloom.values import DocumentError, equal

_SLOT = re.compile(r"\$?\{\{.*?\}\}", re.S)


def slots(text: str) -> list[tuple[int, str]]:
    """(line, text) of each slot."""
    return [(text.count("\n", 0, m.start()) + 1, m[0]) for m in _SLOT.finditer(text)]


def _names(value: object, found: dict[str, str]) -> object:
    """value with marks replaced by what they stand for."""
    if isinstance(value, str):
        return re.sub("|".join(map(re.escape, found)), lambda m: found[m[0]], value)
    if isinstance(value, list):
        return [_names(v, found) for v in value]
    return {_names(k, found): _names(v, found) for k, v in value.items()} if isinstance(value, dict) else value


def _alike(read: object, marked: object, marks: re.Pattern) -> bool:
    """Whether two readings hold the same, a mark standing for any text; positions don't count."""
    if isinstance(marked, str):
        return isinstance(read, str) and re.fullmatch(".*".join(map(re.escape, marks.split(marked))), read, re.S) is not None
    if isinstance(marked, list):
        return isinstance(read, list) and len(read) == len(marked) and all(_alike(a, b, marks) for a, b in zip(read, marked, strict=True))
    if isinstance(marked, dict):
        return isinstance(read, dict) and len(read) == len(marked) and all(_alike(a, b, marks) and (b == "position" or _alike(read[a], marked[b], marks)) for a, b in zip(read, marked, strict=True))
    return equal(read, marked)


def guarded(text: str, form: str, raw: bool = False) -> list:
    """The documents of a text whose slots stand in strings.

    The text is read as it is, and with a word in place of each slot. Where both hold the same, the
    slots don't matter to the reading. Otherwise the file is refused, unless raw: then each slot is
    a string as written.
    """
    if not _SLOT.search(text):
        return documents_of(text, form)
    known: dict[str, str] = {}

    def put(m: re.Match) -> str:
        n, name = len(known), ""
        while n or not name:  # letters only, so that no format reads it as markup
            n, digit = divmod(n, 26)
            name += chr(97 + digit)
        mark = f"xslotq{name}qx"
        known[mark] = m[0]
        return mark

    refused = DocumentError("parse", f"templated file: {slots(text)[0][1]} changes how it reads", slots(text)[0][0])
    try:
        marked = documents_of(_SLOT.sub(put, text), form)
        if raw:
            return _names(marked, known)
        read = documents_of(text, form)
    except DocumentError:
        raise refused from None
    if not _alike(read, marked, re.compile("|".join(sorted(known, key=len, reverse=True)))):
        raise refused
    return read
