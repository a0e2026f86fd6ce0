"""Linting documents: gates, checks, places, fixes, fixtures and exit codes; over one document or a DataFrame.

A rule's gates go from cheap to dear: format, glob, filter; the first two are column predicates of
the DataFrame plan, so that files no rule is for never reach Python.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import jq
from treeloom.functions.schema import Schema
from treeloom.functions.template import render
from treeloom.plans.rules import PRELUDE, RULES
from treeloom.pointer import apply_patch, read_patch
from treeloom.sources.registry import detect, documents_of
from treeloom.sources.text_formats import read_yaml_stream, write_yaml
from treeloom.values import DocumentError, equal, parse_json, to_json

SEVERITIES = ("error", "warn", "info")
RULE_ERROR = "rule-error"
MOST_DEPTH = 4
_FIELDS = {"id", "severity", "description", "match", "check", "loc", "fix", "references"}


def glob_pattern(glob: str) -> str:
    """A glob with *, ?, [], {} and ** as an anchored regular expression."""
    out, at, braces = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
            continue
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        if c == "[" and "]" in glob[at + 1 :]:
            end = glob.index("]", at + 2 if glob[at + 1 : at + 2] in "!]" else at + 1)
            body = glob[at + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]")
            at = end + 1
            continue
        if c == "{":
            braces += 1
            out.append("(?:")
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
        elif c == "," and braces:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        at += 1
    return "^" + "".join(out) + "$"


class Rule:
    """One compiled rule. A rule of data (see rules.py) or of a YAML file (`read_rules`); workers keep the rules they compiled."""

    def __init__(self, spec: dict) -> None:
        self.spec = spec
        self.id, self.severity, self.formats, self.kind = spec["id"], spec["severity"], spec["formats"], spec["kind"]
        self.message, self.glob = spec["message"], re.compile(glob_pattern(spec["glob"])) if spec.get("glob") else None
        self.references = spec.get("references", [])
        compiled = lambda name: jq.compile_program(PRELUDE + spec[name]) if spec.get(name) else None
        self.filter, self.line, self.pointer, self.file = compiled("filter"), compiled("line"), compiled("pointer"), compiled("file")
        self.fix_jq, self.fix_ops = compiled("fix_jq"), compiled("fix_ops")
        self.check = jq.compile_program(PRELUDE + spec["check"]) if self.kind == "jq" else None
        if self.kind == "schema" and "schema_file" in spec["check"]:
            raise DocumentError("parse", "a schema_file is read by read_rules, which knows where the rule's file is")
        self.schema = Schema(spec["check"]) if self.kind == "schema" else None
        self.extract = jq.compile_program(PRELUDE + spec["check"]["extract"]) if self.kind == "composite" else None
        inner = spec["check"].get("rule") if self.kind == "composite" else None
        self.inner = Rule(inner) if inner else None

    def __reduce__(self):
        return _compiled, (to_json(self.spec),)

    def applies(self, value: object, form: str, path: str) -> bool:
        if form not in self.formats or self.glob and not self.glob.search(path):
            return False
        return self.filter is None or jq.truthy(next(self.filter.stream(value), None))

    def violations(self, value: object, depth: int = 0) -> list[dict]:
        """{message, line, col, pointer, file} of each."""
        if self.kind == "jq":
            return [self._placed(v, value) for v in self.check.run(value)]
        if self.kind == "schema":
            return [{"message": ": ".join(x for x in (self.message, where, text) if x), "pointer": at} for at, where, text in self.schema.errors(value)]
        found = next(self.extract.stream(value), None)
        if not isinstance(found, list):
            return [{"message": "extract gave no array", "id": f"{self.id}.composite-extract-not-array"}]
        if depth >= MOST_DEPTH:
            return [{"message": "nested too deeply", "id": f"{self.id}.composite-too-deep"}]
        out = []
        for item in found:
            text = item.get("input") if isinstance(item, dict) else item
            line = item.get("line") or 1 if isinstance(item, dict) else 1
            if not isinstance(text, str):
                out.append({"message": "an item has no text", "id": f"{self.id}.composite-error"})
                continue
            try:
                documents = documents_of(text, self.spec["check"]["format"])
            except DocumentError as error:
                out.append({"message": f"{self.message}: {error.message}", "line": line + (error.line or 1) - 1, "col": error.col or 1})
                continue
            if self.inner:
                for d in documents:
                    out += [{**v, "line": line + (v.get("line") or 1) - 1} for v in self.inner.violations(d, depth + 1)]
        return out

    def _placed(self, v: object, value: object) -> dict:
        out: dict = {"message": render(self.message, v)}
        for name in ("pointer", "line", "file"):
            program = getattr(self, name)
            if program is not None:
                try:
                    found = next(program.stream(v), None)
                except jq.JqError:
                    continue
                if name == "line" and isinstance(found, int) and found > 0 or name != "line" and isinstance(found, str) and (found or name == "pointer"):
                    out[name] = found
        return out


@lru_cache(1024)
def _compiled(spec: str) -> Rule:
    return Rule(parse_json(spec))


def read_rules(text: str, folder: str = ".") -> list[Rule]:
    """Rules of a YAML file, one or a list; all mistakes are told at once.

    A schema_file is found from `folder`, where the rules' file is, and becomes part of the rule, so
    that tasks need no file.
    """
    loaded = read_yaml_stream(text)[0]
    rules, wrong = [], []
    for n, raw in enumerate(loaded if isinstance(loaded, list) else [loaded]):
        try:
            if not isinstance(raw, dict):
                raise DocumentError("parse", "a rule is a map")
            if extra := set(raw) - _FIELDS:
                raise DocumentError("parse", f"unknown field {', '.join(sorted(extra))}")
            for name in ("id", "severity", "match", "check"):
                if name not in raw:
                    raise DocumentError("parse", f"{name} is missing")
            if raw["severity"] not in SEVERITIES:
                raise DocumentError("parse", f"severity {raw['severity']!r}")
            rules.append(Rule(_spec(raw, folder)))
        except DocumentError as error:
            wrong.append(f"rule {raw.get('id', n) if isinstance(raw, dict) else n}: {error.message}")
    if wrong:
        raise DocumentError("parse", "; ".join(wrong))
    return rules


def _spec(raw: dict, folder: str = ".") -> dict:
    match, check, loc, fix = raw["match"], raw["check"], raw.get("loc") or {}, raw.get("fix") or {}
    for part, known in ((match, {"format", "filter", "glob"}), (check, {"jq", "message", "schema", "schema_file", "prefix", "composite"}), (loc, {"pointer", "line", "file"}), (fix, {"ops", "jq"})):
        if extra := set(part) - known:
            raise DocumentError("parse", f"unknown field {', '.join(sorted(extra))}")
    kinds = [k for k in ("jq", "schema", "schema_file", "composite") if k in check]
    if len(kinds) != 1:
        raise DocumentError("parse", "exactly one kind of check")
    formats = match["format"] if isinstance(match["format"], list) else [match["format"]]
    spec = {"id": raw["id"], "severity": raw["severity"], "formats": formats, "filter": match.get("filter"), "glob": match.get("glob"), "message": check.get("message") or check.get("prefix") or raw["id"], "references": raw.get("references", []), "fix_ops": fix.get("ops"), "fix_jq": fix.get("jq"), **{k: loc.get(k) for k in ("pointer", "line", "file")}}
    body = check[kinds[0]]
    if kinds[0] == "jq":
        return {**spec, "kind": "jq", "check": body}
    if kinds[0] == "composite":
        inner = body.get("rule")
        return {**spec, "kind": "composite", "check": {"extract": body["extract"], "format": body["format"], "rule": _spec(inner, folder) if inner else None}}
    return {**spec, "kind": "schema", "check": body if kinds[0] == "schema" else _schema_file(os.path.join(folder, body))}


def _schema_file(path: str) -> object:
    try:
        with open(path, encoding="utf-8") as file:
            return documents_of(file.read(), detect(path) or "json")[0]
    except (OSError, UnicodeDecodeError) as error:
        raise DocumentError("parse", f"schema_file {path}: {error}") from None


def rule_files(path: str) -> list[Rule]:
    """Rules of a file, or of all .yml and .yaml files below a folder but for fixtures (*.test.yml), in the order of their paths."""
    if os.path.isdir(path):
        found = sorted(os.path.join(at, name) for at, _, names in os.walk(path) for name in names if re.search(r"(?<!\.test)\.ya?ml$", name))
    elif os.path.isfile(path):
        found = [path]
    else:
        raise DocumentError("runtime", f"no rules at {path}")
    out: dict[str, Rule] = {}
    for name in found:
        with open(name, encoding="utf-8") as file:
            text = file.read()
        try:
            out |= {r.id: r for r in read_rules(text, os.path.dirname(name))}
        except DocumentError as error:
            raise DocumentError("parse", f"{name}: {error.message}") from None
    return list(out.values())


def rule_file(rules: Iterable[Rule]) -> str:
    """Rules as a YAML file that `read_rules` reads again, to be changed locally."""
    out = []
    for r in rules:
        s = r.spec
        some = lambda **parts: {k: v for k, v in parts.items() if v}
        check = {"jq": s["check"]} if r.kind == "jq" else {"composite": some(**s["check"])} if r.kind == "composite" else {"schema": s["check"]}
        out.append({"id": r.id, "severity": r.severity, "match": some(format=r.formats, filter=s.get("filter"), glob=s.get("glob")), "check": {**check, "message": r.message}} | some(loc=some(line=s.get("line"), pointer=s.get("pointer"), file=s.get("file")), fix=some(ops=s.get("fix_ops"), jq=s.get("fix_jq")), references=r.references))
    return write_yaml(out)


def explain(id_: str) -> str:
    """What a standard rule checks."""
    (r,) = resolve([id_], [])
    fixable = " [fix]" if r.fix_jq or r.fix_ops else ""
    return f"{r.id} [{r.severity}]{fixable}\n{r.message}\nformats: {', '.join(r.formats)}\n" + "".join(f"see {x}\n" for x in r.references)


@lru_cache(1)
def standard() -> tuple[Rule, ...]:
    return tuple(map(Rule, RULES))


def resolve(names: list[str] | None, formats: Iterable[str], local: str | None = None) -> list[Rule]:
    """@std/<namespace>, a rule's id, a file or folder of rules, or None for every namespace with a rule for one of the formats.

    local: a folder whose rules come on top; one with the id of another takes its place.
    """
    out = {r.id: r for r in _resolved(names, formats)} | ({r.id: r for r in rule_files(local)} if local and os.path.isdir(local) else {})
    return list(out.values())


def _resolved(names: list[str] | None, formats: Iterable[str]) -> list[Rule]:
    if names is None:
        wanted = set(formats)
        spaces = {r.id.split(".")[0] for r in standard() if wanted & set(r.formats)}
        return [r for r in standard() if r.id.split(".")[0] in spaces]
    out = []
    for name in names:
        if name.startswith((".", "/")) or re.search(r"\.ya?ml$", name):
            out += rule_files(name)
            continue
        short = name.removeprefix("@std/")
        found = [r for r in standard() if name == "@std" or r.id == short.replace("/", ".") or r.id.split(".")[0] == short]
        if not found:
            raise DocumentError("runtime", f"unknown rules {name}")
        out += found
    return out


def lint_value(value: object, form: str, path: str, rules: Iterable[Rule], spans: dict | None = None) -> tuple[list[dict], list[tuple[str, str]]]:
    """(diagnostics, errors of rules). spans: pointer to (line, column)."""
    out, problems = [], []
    for rule in rules:
        try:
            if not rule.applies(value, form, path):
                continue
            for v in rule.violations(value):
                line, col = v.get("line"), v.get("col", 1)
                if spans and "pointer" in v and v["pointer"] in spans:
                    line, col = spans[v["pointer"]][:2]
                out.append({"path": v.get("file") or path, "rule_id": v.get("id", rule.id), "severity": rule.severity, "message": v["message"], "line": line or 1, "col": col, "references": rule.references})
        except (jq.JqError, DocumentError) as error:
            problems.append((rule.id, str(error)))
    return out, problems


def exit_code(severities: Iterable[str], parse_errors: int = 0, strict: bool = False) -> int:
    found = set(severities)
    return 3 if parse_errors else 4 if "error" in found else 1 if strict and "warn" in found else 0


# Fixes


def fix_value(value: object, form: str, path: str, rules: Iterable[Rule]) -> tuple[object, list[str], list[str]]:
    """(value after the fixes, rules that changed it, rules whose fix left violations and was dropped)."""
    applied, dropped = [], []
    for rule in rules:
        if not (rule.fix_ops or rule.fix_jq) or rule.kind != "jq":
            continue
        try:
            if not rule.applies(value, form, path) or not rule.violations(value):
                continue
            if rule.fix_ops:
                outputs = rule.fix_ops.run(value)
                if len(outputs) != 1 or not isinstance(outputs[0], list):
                    raise DocumentError("runtime", f"{rule.id}: fix.ops gives one array")
                if not outputs[0]:
                    continue
                new = apply_patch(value, read_patch(outputs[0], script=True))
            else:
                outputs = rule.fix_jq.run(value)
                if len(outputs) != 1:
                    raise DocumentError("runtime", f"{rule.id}: fix.jq gives one value")
                new = outputs[0]
            if rule.violations(new):
                dropped.append(rule.id)
            elif not equal(new, value):
                value = new
                applied.append(rule.id)
        except (jq.JqError, DocumentError):
            dropped.append(rule.id)
    return value, applied, dropped


# Fixtures


def run_fixture(text: str, rules: list[Rule], form: str | None = None) -> list[tuple[str, bool, str]]:
    """(name, passed, what differs) of each case of a fixture file; the order of violations doesn't matter."""
    out = []
    for case in read_yaml_stream(text)[0]["tests"]:
        own = case.get("format") or form or (rules[0].formats[0] if rules else "yaml")
        path = case.get("path") or {"json": "package.json", "markdown": "SKILL.md"}.get(own, f"input.{own}")
        found, problems = [], []
        for d in documents_of(case["input"], own):
            a, b = lint_value(d, own, path, rules)
            found, problems = found + a, problems + b
        left, missing = list(found), []
        for e in case["expected"]["violations"]:
            hit = next((d for d in left if d["rule_id"] == e["rule"] and e.get("message_contains", "") in d["message"] and e.get("message_equals", d["message"]) == d["message"] and e.get("line", d["line"]) == d["line"]), None)
            if hit is None:
                missing.append(e)
            else:
                left.remove(hit)
        what = "; ".join([f"missing {to_json(e)}" for e in missing] + [f"unexpected {d['rule_id']}: {d['message']}" for d in left] + [f"{r}: {m}" for r, m in problems])
        out.append((case["name"], not what, what))
    return out


# DataFrames

DIAGNOSTICS = "path string, doc_idx int, rule_ord int, violation_ord int, rule_id string, severity string, message string, line int, col int, references array<string>"


def gate(rules: Iterable[Rule], path: Column, form: Column) -> Column:
    """Whether any rule's format and glob let a document in."""
    out = F.lit(False)
    for formats, glob in {(tuple(r.formats), r.spec.get("glob")) for r in rules}:
        own = form.isin(*formats)
        out = out | (own & path.rlike(glob_pattern(glob)) if glob else own)
    return out


def lint(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """DIAGNOSTICS of documents (path, format, doc_idx, json, error ...), as `read_documents` gives them.

    Documents that couldn't be read become lint.parse errors. Where a rule itself fails, there is a row
    of severity RULE_ERROR with what went wrong, which counts in no summary and no exit code; the
    other rules go on. With a column spans, findings with a pointer get its line and column. Nothing is
    shuffled; the rows carry the numbers that put them in order: path, document, rule, violation.
    """
    rules = list(standard() if rules is None else rules)
    wanted = documents.where(F.col("json").isNull() | gate(rules, F.col("path"), F.col("format")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIAGNOSTICS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for path, form, idx, text, line, col, error, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    rows.append((path, idx, -1, 0, "lint.parse", "error", error, line or 1, col or 1, []))
                    continue
                value, where = parse_json(text), parse_json(spans) if spans else None
                for n, rule in enumerate(rules):
                    found, problems = lint_value(value, form, path or "", [rule], where)
                    rows += [(path, idx, n, -1, id_, RULE_ERROR, what, 1, 1, []) for id_, what in problems]
                    rows += [(d["path"], idx, n, k, d["rule_id"], d["severity"], d["message"], d["line"], d["col"], d["references"]) for k, d in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    spans = F.col("spans") if "spans" in documents.columns else F.lit(None).cast("string").alias("spans")
    return wanted.select("path", "format", "doc_idx", "json", "error_line", "error_col", "error", spans).mapInArrow(run, DIAGNOSTICS)


def summary(diagnostics: DataFrame) -> DataFrame:
    """(severity, n) of all three severities."""
    spark = diagnostics.sparkSession
    known = spark.createDataFrame([(s, n) for n, s in enumerate(SEVERITIES)], "severity string, rank int")
    return known.join(diagnostics.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def catalogue(spark) -> DataFrame:
    """(id, namespace, severity, kind, formats, has_fix) of the standard rules."""
    return spark.createDataFrame([(r.id, r.id.split(".")[0], r.severity, r.kind, r.formats, bool(r.fix_ops or r.fix_jq)) for r in standard()], "id string, namespace string, severity string, kind string, formats array<string>, has_fix boolean")


def match_fixtures(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(rule_id, message, side): expected violations that are missing, and unexpected ones, as often as they are.

    Both sides are counted before they meet, so a violation that fills a table is one row from each task.
    """
    keys = ["rule_id", "message"]
    a, b = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((expected, "wanted"), (actual, "found")))
    off = F.coalesce("wanted", F.lit(0)) - F.coalesce("found", F.lit(0))
    both = a.join(b, keys, "full_outer").select(*keys, off.alias("off")).where("off <> 0")
    return both.select(*keys, F.when(F.col("off") > 0, "missing").otherwise("unexpected").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("off")))).select(*keys, "side")
