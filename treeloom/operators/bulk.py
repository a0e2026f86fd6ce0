"""Edits over many files: each file is read, changed, written anew in its format, and reported."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom import pointer as P
from treeloom.functions import jq
from treeloom.plans import lint, report, udtf
from treeloom.sources import registry
from treeloom.sources import text_formats as T
from treeloom.sources.guard import guarded
from treeloom.sources.spans import spans_of
from treeloom.values import DocumentError, same_data, sorted_keys, to_json

RESULTS = "path string, status string, content string, diff string, error string"


def _edited(value: object, edit: dict, form: str, path: str) -> object:
    kind = edit["kind"]
    if kind == "set":
        return P.set_value(value, edit["pointer"], edit["value"], edit.get("create", True))
    if kind == "del":
        return P.delete(value, edit["pointer"])
    if kind == "insert":
        return P.insert(value, edit["pointer"], edit["value"])
    if kind == "patch":
        return P.apply_patch(value, edit["ops"])
    if kind == "merge":
        return P.merge(value, edit["patch"])
    if kind == "jq":
        try:
            outputs = jq.compile_program(edit["program"]).run(value)
        except jq.JqError as error:
            raise DocumentError("runtime", str(error)) from None
        if len(outputs) != 1:
            raise DocumentError("runtime", f"a transformation gives one value, not {len(outputs)}")
        return outputs[0]
    if kind == "fix":
        return lint.fix_value(value, form, path, lint.resolve(edit.get("rules"), [form]))[0]
    if kind == "plugin":
        return udtf.fixed_value(value, edit["lint"], edit["fix"], form)
    if kind == "fmt":
        return sorted_keys(value) if edit.get("sort_keys") else value
    raise DocumentError("usage", f"unknown edit {kind}")


def spliced(text: str, form: str, edit: dict) -> str | None:
    """A value that is there replaced where it stands, so that comments and layout stay; None where that doesn't read back as it should."""
    if edit["kind"] != "set" or form not in ("json", "yaml") or str(edit.get("doc", "0")) != "0" or "to" in edit or "{{" in text:
        return None
    try:
        span = (spans_of(text, form) or [{}])[0].get(P.render(P.parse(edit["pointer"])))
        expected = registry.documents_of(text, form)
        if span is None or isinstance(edit["value"], (dict, list)) and form == "yaml":
            return None
        new = text[: span[2]] + (to_json(edit["value"]) if form == "json" else T.flow_yaml(edit["value"])) + text[span[3] :]
        expected[0] = P.set_value(expected[0], edit["pointer"], edit["value"])
        return new if all(map(same_data, registry.documents_of(new, form), expected)) and len(registry.documents_of(new, form)) == len(expected) else None
    except DocumentError:
        return None


def edit_text(text: str, form: str, edit: dict, path: str = "") -> str:
    """A file's new text. `doc` picks a document of a stream: a number (0 is the default) or all; fmt and fix take all.

    stream edits: kind `doc-replace`, `doc-insert`, `doc-remove` with `doc` and `value`.
    """
    if form == "frontmatter":
        kind, value, body, _ = T.split_frontmatter(text)
        return T.write_frontmatter(_edited(value, edit, form, path), kind, body)
    if (new := spliced(text, form, edit)) is not None:
        return new
    documents = guarded(text, form)
    which = str(edit.get("doc", "all" if edit["kind"] in ("fmt", "fix") else "0"))
    if edit["kind"].startswith("doc-"):
        n = int(which)
        if n > len(documents) - (edit["kind"] != "doc-insert"):
            raise DocumentError("usage", f"no document {n}")
        documents[n : n + (edit["kind"] != "doc-insert")] = [] if edit["kind"] == "doc-remove" else [edit["value"]]
    elif which == "all":
        documents = [_edited(d, edit, form, path) for d in documents]
    else:
        registry.select_document(documents, which)
        documents[int(which)] = _edited(documents[int(which)], edit, form, path)
    target = edit.get("to", form)
    if target not in registry.WRITERS:
        raise DocumentError("write", f"{target} can't be written")
    if target == "yaml":
        return T.write_yaml_stream(documents)
    return registry.WRITERS[target](documents if which == "all" and len(documents) > 1 else documents[0])


def edit_files(files: DataFrame, edit: dict, form: str | None = None) -> DataFrame:
    """RESULTS of files(path, content): status changed, unchanged or failed; a failed file has no content.

    Files are edited in tasks, one by one, and nothing is shuffled; a file that says the same after
    as before keeps its text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULTS.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = form or registry.detect(path or "")
                try:
                    if own is None:
                        raise DocumentError("usage", "unknown format")
                    text = (content or b"").decode("utf-8")
                    new = edit_text(text, own, edit, path or "")
                    if edit["kind"] != "fmt" and own == edit.get("to", own) and own in registry.READERS and own not in ("frontmatter", "csv", "tsv") and new != text and registry.documents_of(new, own) == registry.documents_of(text, own):
                        new = text
                    rows.append((path, "changed" if new != text else "unchanged", new, report.unified_diff(text, new, path or ""), None))
                except (DocumentError, UnicodeDecodeError) as error:
                    rows.append((path, "failed", None, None, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

    return files.select(F.col(files.columns[0]).cast("string"), F.col(files.columns[1]).cast("binary")).mapInArrow(run, RESULTS)


def convert_files(files: DataFrame, target: str, form: str | None = None) -> DataFrame:
    """RESULTS with the target's extension in place of the file's own, and `source`, the file's own path."""
    out = edit_files(files, {"kind": "fmt", "to": target}, form).withColumn("source", F.col("path"))
    return out.withColumn("path", F.regexp_replace("path", r"\.[^./]*$", "." + registry.EXTENSIONS.get(target, (target,))[0]))


def counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def write_atomically(path: str, text: str, backup: bool = False) -> None:
    """Beside the file, then renamed over it, so a reader sees the old or the new one."""
    if backup and os.path.exists(path):
        os.replace(path, path + ".bak")
    with open(f"{path}.tmp-{uuid.uuid4().hex}", "w", encoding="utf-8", newline="") as out:
        out.write(text)
    os.replace(out.name, path)


def write_files(results: DataFrame, root: str, backup: bool = False, replace: bool = False) -> DataFrame:
    """Write what changed below root, a folder that all tasks reach; (path, status) of each file.

    replace: a converted file takes the place of its source, which goes once the new one is whole; with
    backup it stays as .bak. A task that runs again finds the new file there and writes the same.
    """
    source = F.col("source") if replace and "source" in results.columns else F.lit(None).cast("string").alias("source")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, status, text, old in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if status == "changed":
                    full = os.path.join(root, path)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    write_atomically(full, text, backup)
                    if old is not None and old != path and os.path.exists(gone := os.path.join(root, old)):
                        if backup:
                            os.replace(gone, gone + ".bak")
                        else:
                            os.remove(gone)
            yield batch.select(["path", "status"])

    return results.select("path", "status", "content", source).mapInArrow(run, "path string, status string")
