"""Message templates: {{ .a.b }} and {{ .items.0 }}, <missing> where nothing is."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.values import DocumentError, is_number, to_json

_SLOT = re.compile(r"\{\{\s*(\.[^{}]*?)\s*\}\}")


def parts_of(template: str) -> list[str | list[str]]:
    """Texts, and lists of segments for slots."""
    out: list[str | list[str]] = []
    end = 0
    for m in _SLOT.finditer(template):
        out += [template[end : m.start()], [p for p in m[1].split(".") if p]]
        end = m.end()
    if "{{" in re.sub(_SLOT, "", template):
        raise DocumentError("parse", f"bad slot in {template!r}")
    return [*out, template[end:]]


def render(template: str, value: object) -> str:
    out = []
    for part in parts_of(template):
        if isinstance(part, str):
            out.append(part)
            continue
        now: object = value
        for key in part:
            if isinstance(now, dict) and key in now:
                now = now[key]
            elif isinstance(now, list) and key.isdigit() and int(key) < len(now):
                now = now[int(key)]
            else:
                now = "<missing>"
                break
        out.append(now if isinstance(now, str) else to_json(now, finite=False) if now is not None and not is_number(now) else "null" if now is None else to_json(now, finite=False))
    return "".join(out)


def column(template: str) -> Column:
    """The template over columns and struct fields of a DataFrame."""
    parts = []
    for part in parts_of(template):
        if isinstance(part, str):
            parts.append(F.lit(part))
        else:
            found = F.col(part[0])
            for key in part[1:]:
                found = F.get(found, int(key)) if key.isdigit() else found[key]
            parts.append(F.coalesce(found.cast("string"), F.lit("<missing>")))
    return F.concat(*parts)
