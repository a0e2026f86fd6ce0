"""Document values: null, booleans, exact numbers, strings, arrays and ordered objects.

Python carries them as None, bool, int, float, BigFloat, str, list and dict. Integers are exact at
any length; a decimal literal that a double can't hold stays a BigFloat with its text.
"""

from __future__ import annotations

import json
import math
import re
import sys
from decimal import Decimal, InvalidOperation, localcontext
from functools import total_ordering

sys.set_int_max_str_digits(0)


class DocumentError(Exception):
    """kind: parse, path, type, usage, validation, patch, write, runtime."""

    def __init__(self, kind: str, message: str, line: int | None = None, col: int | None = None) -> None:
        super().__init__(message)
        self.kind, self.message, self.line, self.col = kind, message, line, col

    def __reduce__(self):
        return type(self), (self.kind, self.message, self.line, self.col)


#: Process exit codes by kind of error.
EXIT_CODES = {"ok": 0, "generic": 1, "path": 2, "usage": 2, "type": 2, "parse": 3, "validation": 4, "io": 5, "runtime": 6, "patch": 6, "write": 7}


@total_ordering
class BigFloat:
    """A decimal literal beyond what a double holds."""

    __slots__ = ("literal",)

    def __init__(self, literal: str) -> None:
        self.literal = literal

    def decimal(self) -> Decimal:
        return Decimal(self.literal)

    def __float__(self) -> float:
        return float(self.literal)

    def __eq__(self, other: object) -> bool:
        return is_number(other) and same_number(self, other)

    def __lt__(self, other: object) -> bool:
        return compare_numbers(self, other) == -1

    def __hash__(self) -> int:
        return hash(self.decimal())

    def __repr__(self) -> str:
        return self.literal


def number_from_literal(text: str) -> int | float | BigFloat:
    """Integers exactly; decimals as a double when nothing is lost, else as they are spelt."""
    body = text.lstrip("+-")
    if body.isdigit():
        return -0.0 if text.startswith("-") and not body.strip("0") else int(text)
    value = float(text)
    exact = Decimal(text)
    digits = len(exact.normalize().as_tuple().digits) if exact else 1
    lost = math.isinf(value) or (value == 0) != (exact == 0) or digits > 17 and Decimal(repr(value)) != exact
    return BigFloat(text) if lost else value


def is_number(x: object) -> bool:
    return isinstance(x, (int, float, BigFloat)) and not isinstance(x, bool)


def _exact(x: int | float | BigFloat) -> Decimal | None:
    if isinstance(x, BigFloat):
        return x.decimal()
    return None if isinstance(x, float) and not math.isfinite(x) else Decimal(x)


def compare_numbers(a: object, b: object) -> int | None:
    """-1, 0, 1 by exact value; None when either is NaN."""
    if any(isinstance(x, float) and math.isnan(x) for x in (a, b)):
        return None
    if all(isinstance(x, (int, float)) for x in (a, b)):
        return (a > b) - (a < b)
    x, y = _exact(a), _exact(b)
    if x is None or y is None:
        x, y = float(a), float(b)
    return (x > y) - (x < y)


def same_number(a: object, b: object) -> bool:
    return compare_numbers(a, b) == 0


def is_whole(x: object) -> bool:
    exact = _exact(x)
    return exact is not None and exact == exact.to_integral_value()


def is_multiple(x: object, of: object) -> bool:
    """By exact decimal value: 0.3 is a multiple of 0.1. Doubles count as their shortest spelling."""
    spelt = lambda v: Decimal(repr(v)) if isinstance(v, float) else _exact(v)
    if any(isinstance(v, float) and not math.isfinite(v) for v in (x, of)):
        return False
    a, b = spelt(x), spelt(of)
    if not b:
        return False
    with localcontext() as context:
        context.prec = max(60, abs(a.adjusted() - b.adjusted()) + len(a.as_tuple().digits) + len(b.as_tuple().digits) + 10)
        try:
            return a % b == 0
        except InvalidOperation:
            return False


def equal(a: object, b: object) -> bool:
    """Equality of values: numbers by exact value (NaN equals nothing), objects without regard to order."""
    if is_number(a) and is_number(b):
        return same_number(a, b)
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return a is b
    if isinstance(a, str) or isinstance(b, str):
        return isinstance(a, str) and isinstance(b, str) and a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return False


def same_data(a: object, b: object) -> bool:
    """Like equal, but NaN is NaN, and -0.0 isn't 0.0."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or a == b and math.copysign(1, a) == math.copysign(1, b)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_data, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same_data(v, b[k]) for k, v in a.items())
    return equal(a, b)


def type_name(x: object) -> str:
    """null bool int float string array object."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "bool"
    if isinstance(x, int):
        return "int"
    if isinstance(x, (float, BigFloat)):
        return "float"
    return "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def jq_type(x: object) -> str:
    return {"bool": "boolean", "int": "number", "float": "number"}.get(type_name(x), type_name(x))


def number_text(x: int | float | BigFloat) -> str:
    """Shortest text that reads back the same; whole doubles keep `.0`."""
    if isinstance(x, BigFloat):
        return x.literal
    if isinstance(x, int):
        return str(x)
    if math.isnan(x):
        return ".nan"
    if math.isinf(x):
        return ".inf" if x > 0 else "-.inf"
    return re.sub(r"e(-?)\+?0*(\d)", r"e\1\2", repr(x))


# JSON


def parse_json(text: str) -> object:
    """Exact numbers, source key order; a duplicate key's last value at its first place; no comments."""
    if text.startswith("﻿"):
        text = text[1:]
    try:
        return json.loads(text, parse_float=number_from_literal, parse_int=number_from_literal, parse_constant=_no_constant)
    except json.JSONDecodeError as error:
        raise DocumentError("parse", error.msg, error.lineno, error.colno) from None
    except RecursionError:
        raise DocumentError("parse", "nested too deeply") from None


def _no_constant(name: str) -> None:
    raise DocumentError("parse", f"{name} is not JSON")


def sorted_keys(x: object) -> object:
    """Keys in byte order at every depth."""
    if isinstance(x, dict):
        return {k: sorted_keys(x[k]) for k in sorted(x, key=lambda k: k.encode("utf-8", "surrogatepass"))}
    return [sorted_keys(v) for v in x] if isinstance(x, list) else x


def to_json(x: object, indent: int | None = None, finite: bool = True, _pad: str = "") -> str:
    """Compact, or with an indent; refuses NaN and infinities unless finite is False (then null)."""
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if is_number(x):
        if isinstance(x, float) and not math.isfinite(x):
            if finite:
                raise DocumentError("write", f"JSON has no {number_text(x)}")
            return "null"
        return number_text(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    inner = _pad + " " * (indent or 0)
    if isinstance(x, list):
        parts, a, b = [to_json(v, indent, finite, inner) for v in x], "[", "]"
    else:
        parts, a, b = [f"{json.dumps(k, ensure_ascii=False)}:{' ' if indent else ''}{to_json(v, indent, finite, inner)}" for k, v in x.items()], "{", "}"
    if not parts or not indent:
        return a + ",".join(parts) + b
    return f"{a}\n" + ",\n".join(inner + p for p in parts) + f"\n{_pad}{b}"
