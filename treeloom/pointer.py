"""JSON Pointer: parsing, navigation, suggestions and edits of one document."""

from __future__ import annotations

import re

from treeloom.values import DocumentError, equal, is_number, same_number, to_json, type_name

#: Above this an index is refused, as in the query language.
MOST_INDEX = 536870911


def parse(pointer: str) -> list[str]:
    """Segments; "" is the root. A pointer starts with / and has no empty segment."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise DocumentError("path", f"a pointer starts with /: {pointer!r}")
    parts = pointer[1:].split("/")
    if any(p == "" for p in parts):
        raise DocumentError("type", f"empty segment in {pointer!r}")
    if any(re.search(r"~(?![01])", p) for p in parts):
        raise DocumentError("path", f"bad escape in {pointer!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in parts]


def escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def render(parts: list[str | int]) -> str:
    return "".join("/" + escape(str(p)) for p in parts)


def index_of(part: str) -> int | None:
    """A canonical array index."""
    return int(part) if re.fullmatch(r"0|[1-9][0-9]*", part) and int(part) <= MOST_INDEX else None


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestions(missing: str, keys: list[str]) -> list[str]:
    """At most three keys within two edits, nearest first, then by name."""
    near = sorted((d, k) for k in keys if (d := _distance(missing, k)) <= 2)
    return [k for _, k in near[:3]]


def step(value: object, part: str, path: list[str]) -> object:
    if isinstance(value, dict):
        if part in value:
            return value[part]
        near = suggestions(part, list(value))
        hint = f"; did you mean {', '.join(near)}?" if near else ""
        raise DocumentError("path", f"no {render([*path, part])}; found up to {render(path) or 'the root'}{hint}")
    if isinstance(value, list):
        i = index_of(part)
        if i is not None and i < len(value):
            return value[i]
        raise DocumentError("path", f"no {render([*path, part])}: the array has {len(value)} items")
    raise DocumentError("path", f"{render(path) or 'the root'} is {type_name(value)}, without {part!r}")


def get(value: object, pointer: str) -> object:
    parts = parse(pointer)
    for n, part in enumerate(parts):
        value = step(value, part, parts[:n])
    return value


def exists(value: object, pointer: str) -> bool:
    try:
        get(value, pointer)
    except DocumentError as error:
        if error.kind == "type":
            raise
        return False
    return True


def longest_prefix(value: object, pointer: str) -> str:
    """The deepest part of the pointer that is there."""
    parts = parse(pointer)
    for n, part in enumerate(parts):
        try:
            value = step(value, part, parts[:n])
        except DocumentError:
            return render(parts[:n])
    return pointer


def keys(value: object) -> list:
    if isinstance(value, dict):
        return list(value)
    if isinstance(value, list):
        return list(range(len(value)))
    raise DocumentError("type", f"{type_name(value)} has no keys")


def values(value: object) -> list:
    if isinstance(value, dict):
        return list(value.values())
    if isinstance(value, list):
        return list(value)
    raise DocumentError("type", f"{type_name(value)} has no values")


def length(value: object) -> int:
    if isinstance(value, (dict, list, str)):
        return len(value)
    raise DocumentError("type", f"{type_name(value)} has no length")


def paths(value: object, at: str = "") -> list[tuple[str, str]]:
    """(pointer, type), the root first, in pre-order."""
    out = [(at, type_name(value))]
    if isinstance(value, dict):
        for k, v in value.items():
            out += paths(v, f"{at}/{escape(k)}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += paths(v, f"{at}/{i}")
    return out


def hint_for_jsonpath(text: str) -> str | None:
    """A pointer that says what a simple JSONPath such as $.a[0]['b'] means."""
    if not text.startswith("$"):
        return None
    found, end = [], 1
    for m in re.finditer(r"\.([A-Za-z_][\w-]*)|\[(\d+)\]|\['([^']*)'\]|\[\"([^\"]*)\"\]", text):
        if m.start() != end:
            return None
        found.append(next(g for g in m.groups() if g is not None))
        end = m.end()
    return render(found) if end == len(text) else None


# Edits return a new document and share what they leave alone.


def _changed(value: object, parts: list[str], n: int, act) -> object:
    """act(container, last part) on a copy of the parent of the place."""
    if n == len(parts) - 1:
        copy = dict(value) if isinstance(value, dict) else list(value) if isinstance(value, list) else value
        return act(copy, parts[n])
    below = step(value, parts[n], parts[:n])
    copy = dict(value) if isinstance(value, dict) else list(value)
    copy[parts[n] if isinstance(value, dict) else int(parts[n])] = _changed(below, parts, n + 1, act)
    return copy


def set_value(value: object, pointer: str, new: object, create: bool = True) -> object:
    """Replace or add; missing objects on the way are made unless create is False; /- appends."""
    parts = parse(pointer)
    if not parts:
        return new

    def put(here: object, n: int) -> object:
        if n == len(parts):
            return new
        part = parts[n]
        if isinstance(here, dict):
            if part not in here and not create:
                raise DocumentError("path", f"no {render(parts[: n + 1])}")
            return {**here, part: put(here[part] if part in here else {} if n + 1 < len(parts) else None, n + 1)}
        if isinstance(here, list):
            i = len(here) if part == "-" else index_of(part)
            if i is None or i > len(here) or i == len(here) and (part != "-" or n + 1 < len(parts) and not create):
                raise DocumentError("path", f"no {render(parts[: n + 1])}: the array has {len(here)} items")
            return here[:i] + [put(here[i] if i < len(here) else {} if n + 1 < len(parts) else None, n + 1)] + here[i + 1 :]
        raise DocumentError("type", f"{render(parts[:n]) or 'the root'} is {type_name(here)}")

    return put(value, 0)


def delete(value: object, pointer: str) -> object:
    parts = parse(pointer)
    if not parts:
        raise DocumentError("usage", "the root can't be deleted")
    get(value, pointer)

    def drop(container: object, part: str) -> object:
        del container[part if isinstance(container, dict) else int(part)]
        return container

    return _changed(value, parts, 0, drop)


def insert(value: object, pointer: str, new: object) -> object:
    """As `add` of a patch: into arrays at an index or -, into objects by key; the parent must be there."""
    parts = parse(pointer)
    if not parts:
        return new

    def put(container: object, part: str) -> object:
        if isinstance(container, dict):
            container[part] = new
        elif isinstance(container, list):
            i = len(container) if part == "-" else index_of(part)
            if i is None or i > len(container):
                raise DocumentError("path", f"no place {part} in an array of {len(container)} items")
            container.insert(i, new)
        else:
            raise DocumentError("type", f"{render(parts[:-1]) or 'the root'} is {type_name(container)}")
        return container

    return _changed(value, parts, 0, put)


#: Members that each operation needs.
OPERATIONS = {"add": ("path", "value"), "remove": ("path",), "replace": ("path", "value"), "move": ("from", "path"), "copy": ("from", "path"), "test": ("path", "value")}


def read_patch(ops: object, script: bool = False) -> list[dict]:
    """A checked patch. script: only add, replace and remove, without further members."""
    if not isinstance(ops, list):
        raise DocumentError("patch", "a patch is an array")
    for op in ops:
        name = op.get("op") if isinstance(op, dict) else None
        if name not in OPERATIONS or script and name not in ("add", "replace", "remove"):
            raise DocumentError("patch", f"unknown operation {to_json(op)}")
        for member in OPERATIONS[name]:
            if member not in op:
                raise DocumentError("patch", f"{name} needs {member}")
            if member != "value" and not isinstance(op[member], str):
                raise DocumentError("patch", f"{member} is a pointer")
        if script and set(op) - {"op", *OPERATIONS[name]}:
            raise DocumentError("patch", f"unknown member in {to_json(op)}")
    return ops


def read_patch_lines(text: str) -> list[dict]:
    """One operation a line: `op pointer [JSON or from-pointer]`; blank lines and # comments are skipped."""
    from treeloom.values import parse_json

    ops = []
    for n, line in enumerate(text.splitlines(), 1):
        parts = line.strip().split(None, 2)
        if not parts or parts[0].startswith("#"):
            continue
        if len(parts) < 2:
            raise DocumentError("patch", f"line {n}: an operation and a pointer are needed", n)
        op: dict = {"op": parts[0], "path": parts[1]}
        if parts[0] in ("move", "copy"):
            op["from"], op["path"] = parts[1], parts[2] if len(parts) > 2 else ""
        elif len(parts) > 2:
            op["value"] = parse_json(parts[2])
        ops.append(op)
    return read_patch(ops)


def apply_patch(value: object, ops: list[dict]) -> object:
    """All operations in order, or DocumentError and no change."""
    for op in read_patch(ops):
        name, path = op["op"], op["path"]
        if name == "add":
            value = insert(value, path, op["value"])
        elif name == "remove":
            value = delete(value, path)
        elif name == "replace":
            get(value, path)
            value = set_value(value, path, op["value"], create=False) if path else op["value"]
        elif name == "test":
            found = get(value, path)
            if not equal(found, op["value"]):
                raise DocumentError("patch", f"test of {path or 'the root'} failed: {to_json(found, finite=False)}")
        else:
            moved = get(value, op["from"])
            if name == "move":
                if path == op["from"]:
                    continue
                if path.startswith(op["from"] + "/"):
                    raise DocumentError("patch", "a value can't move into itself")
                value = delete(value, op["from"])
            value = insert(value, path, moved)
    return value


class _Place:
    """Where a value stood in the document at first; None for one that a patch brought."""

    __slots__ = ("at", "inner")

    def __init__(self, value: object, at: str | None) -> None:
        below = lambda k: None if at is None else f"{at}/{escape(k) if isinstance(k, str) else k}"
        self.at = at
        self.inner: dict | list | None = {k: _Place(v, below(k)) for k, v in value.items()} if isinstance(value, dict) else [_Place(v, below(i)) for i, v in enumerate(value)] if isinstance(value, list) else None

    def copy(self) -> _Place:
        out = _Place(None, self.at)
        out.inner = {k: v.copy() for k, v in self.inner.items()} if isinstance(self.inner, dict) else [v.copy() for v in self.inner] if isinstance(self.inner, list) else None
        return out


def original_pointers(value: object, ops: list[dict]) -> list[str | None]:
    """For each operation of a patch the pointer that its target has in value, before the patch; None for a target that the patch itself makes.

    Insertions and removals before it shift an item's index, and moves take it elsewhere: the patch is
    run over a tree of places, where each node knows its first pointer. For move and copy the target
    is what is moved or copied. Operations that don't apply raise, as in `apply_patch`.
    """
    root, out = _Place(value, ""), []

    def holder(pointer: str) -> tuple[_Place, str]:
        parts = parse(pointer)
        here = root
        for part in parts[:-1]:
            here = step(here, part, pointer)
        return here, parts[-1]

    def step(here: _Place, part: str, pointer: str) -> _Place:
        i = index_of(part) if isinstance(here.inner, list) else part if isinstance(here.inner, dict) and part in here.inner else None
        if i is None or isinstance(here.inner, list) and i >= len(here.inner):
            raise DocumentError("path", f"no {pointer}")
        return here.inner[i]

    def take(pointer: str) -> _Place:
        here, part = holder(pointer)
        found = step(here, part, pointer)
        del here.inner[part if isinstance(here.inner, dict) else int(part)]
        return found

    def put(pointer: str, place: _Place) -> None:
        here, part = holder(pointer)
        if isinstance(here.inner, dict):
            here.inner[part] = place
        elif isinstance(here.inner, list) and (part == "-" or (index_of(part) or 0) <= len(here.inner) and index_of(part) is not None):
            here.inner.insert(len(here.inner) if part == "-" else int(part), place)
        else:
            raise DocumentError("path", f"no {pointer}")

    def at(pointer: str) -> _Place:
        here = root
        for part in parse(pointer):
            here = step(here, part, pointer)
        return here

    for op in read_patch(ops):
        name, path = op["op"], op["path"]
        if name in ("move", "copy"):
            place = at(op["from"])
            out.append(place.at)
            if name == "move" and path == op["from"]:
                continue
            place = take(op["from"]) if name == "move" else place.copy()
        elif name == "add":
            place = _Place(op["value"], None)
            try:
                found = at(path)
                out.append(found.at if path == "" or isinstance(holder(path)[0].inner, dict) else None)
            except DocumentError:
                out.append(None)
        else:
            place = at(path)
            out.append(place.at)
            if name == "test":
                continue
            if name == "remove":
                take(path)
                continue
            new = _Place(op["value"], None)
            place.inner = new.inner
            continue
        if path:
            put(path, place)
        else:
            root = place
    return out


def rebased(ops: list[dict], under: str) -> list[dict]:
    """The operations for the document that holds this one at `under`."""
    return [{k: under + v if k in ("path", "from") else v for k, v in op.items()} for op in ops]


def without_nulls(value: object) -> object:
    return {k: without_nulls(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else value


def merge(target: object, patch: object) -> object:
    """Merge patch: null removes, objects merge, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    if not isinstance(target, dict):
        return without_nulls(patch)
    out = dict(target)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge(out[k], v)
        else:
            out[k] = without_nulls(v)
    return out


def diff(a: object, b: object, at: str = "") -> list[dict]:
    """Fewest add, remove and replace: removals in a's order, additions in b's, then what both have; arrays by index."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = [{"op": "remove", "path": f"{at}/{escape(k)}"} for k in a if k not in b]
        out += [{"op": "add", "path": f"{at}/{escape(k)}", "value": v} for k, v in b.items() if k not in a]
        for k, v in a.items():
            if k in b:
                out += diff(v, b[k], f"{at}/{escape(k)}")
        return out
    if isinstance(a, list) and isinstance(b, list):
        out = []
        for i in range(min(len(a), len(b))):
            out += diff(a[i], b[i], f"{at}/{i}")
        out += [{"op": "remove", "path": f"{at}/{i}"} for i in range(len(a) - 1, len(b) - 1, -1)]
        return out + [{"op": "add", "path": f"{at}/{i}", "value": b[i]} for i in range(len(a), len(b))]
    same = same_number(a, b) if is_number(a) and is_number(b) else equal(a, b)
    return [] if same else [{"op": "replace", "path": at, "value": b}]


def inline_value(text: str) -> object:
    """What a value on a command line means: JSON where it reads as such, else the text itself."""
    from treeloom.values import parse_json

    try:
        return parse_json(text)
    except DocumentError:
        return text
