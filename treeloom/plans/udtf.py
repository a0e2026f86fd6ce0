"""Plugins: table functions that read a document and yield diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.functions import udtf

from treeloom.functions import jq
from treeloom.pointer import apply_patch, get, read_patch
from treeloom.values import DocumentError, parse_json

COLUMNS = "rule_id string, severity string, message string, pointer string"


class Document:
    """What a plugin may ask of a document."""

    def __init__(self, text: str | None, form: str = "json", root: object = None) -> None:
        self.root, self.form = root if text is None else parse_json(text), form

    def get_at(self, pointer: str) -> object:
        return get(self.root, pointer)

    def iterate(self) -> Iterator[object]:
        yield from self.root.values() if isinstance(self.root, dict) else self.root if isinstance(self.root, list) else ()

    def eval(self, program: str) -> list:
        return jq.compile_program(program).run(self.root)


def plugin(lint: Callable[[Document], Iterator[tuple[str, str, str, str]]]):
    """A table function from lint(document), which yields (rule_id, severity, message, pointer)."""

    class Plugin:
        def eval(self, text: str) -> Iterator[tuple[str, str, str, str]]:
            if text is None:
                return
            try:
                yield from lint(Document(text))
            except (DocumentError, jq.JqError) as error:
                yield "plugin.error", "error", str(error), ""

    return udtf(Plugin, returnType=COLUMNS)


def fixed_value(value: object, lint: Callable, fix: Callable[[Document], list[dict]], form: str = "json") -> object:
    """value after a plugin's fix, a patch, which counts only if the plugin then finds nothing more."""
    document = Document(None, form, value)
    try:
        if not list(lint(document)):
            return value
        new = apply_patch(value, read_patch(fix(document)))
        return value if list(lint(Document(None, form, new))) else new
    except jq.JqError as error:
        raise DocumentError("runtime", str(error)) from None


def _large_k(document: Document) -> Iterator[tuple[str, str, str, str]]:
    k = document.root.get("k") if isinstance(document.root, dict) else None
    if isinstance(k, int) and k > 50:
        yield "events.large-k", "warn", f"k is {k}", "/k"


EventLint = plugin(_large_k)
