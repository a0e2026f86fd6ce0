"""Diagnostics as JSON, JSONL, YAML, TOML, SARIF 2.1.0, JUnit XML, TAP 13 and console text; unified diffs."""

from __future__ import annotations

import difflib
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.sources.text_formats import flow_yaml, write_toml, write_yaml
from treeloom.values import to_json

ORDER = ["path", "doc_idx", "rule_ord", "violation_ord"]
#: SARIF's names for severities.
LEVELS = {"error": "error", "warn": "warning", "info": "note"}


def envelope(rows: list[dict]) -> str:
    return to_json({"diagnostics": list(map(_plain, rows))}, 2) + "\n"


def _plain(d: dict) -> dict:
    return {k: d[k] for k in ("path", "line", "col", "message", "severity", "rule_id", "references")}


def jsonl(rows: list[dict]) -> str:
    """One finding a line."""
    return "".join(to_json(_plain(d)) + "\n" for d in rows)


def yaml(rows: list[dict]) -> str:
    return write_yaml({"diagnostics": list(map(_plain, rows))})


def toml(rows: list[dict]) -> str:
    return write_toml({"diagnostics": list(map(_plain, rows))})


def sarif(rows: list[dict], tool: str = "treeloom", version: str = "0.1.0") -> str:
    ids = list(dict.fromkeys(d["rule_id"] for d in rows))
    results = [
        {"ruleId": d["rule_id"], "ruleIndex": ids.index(d["rule_id"]), "level": LEVELS[d["severity"]], "message": {"text": d["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": d["path"]}, "region": {"startLine": d["line"], "startColumn": d["col"]}}}]}
        for d in rows
    ]
    catalogue = [{"id": i, "defaultConfiguration": {"level": LEVELS[next(d["severity"] for d in rows if d["rule_id"] == i)]}} for i in ids]
    return to_json({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": catalogue}}, "results": results}]}, 2) + "\n"


def junit(rows: list[dict]) -> str:
    bad = sum(d["severity"] == "error" for d in rows)
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<testsuites tests="{len(rows)}" failures="{bad}">', f'  <testsuite name="lint" tests="{len(rows)}" failures="{bad}">']
    for d in rows:
        place = f"{d['path']}:{d['line']}:{d['col']}"
        out.append(f"    <testcase classname={quoteattr(d['rule_id'])} name={quoteattr(place)}>")
        tag = "failure" if d["severity"] == "error" else "system-out"
        out.append(f"      <failure type={quoteattr(d['severity'])} message={quoteattr(d['message'])}/>" if tag == "failure" else f"      <system-out>{escape(d['severity'])}: {escape(d['message'])}</system-out>")
        out.append("    </testcase>")
    return "\n".join([*out, "  </testsuite>", "</testsuites>"]) + "\n"


def tap(rows: list[dict]) -> str:
    out = ["TAP version 13", f"1..{len(rows)}"]
    for n, d in enumerate(rows, 1):
        state = "not ok" if d["severity"] == "error" else "ok"
        out += [f"{state} {n} - {d['rule_id']} {d['path']}:{d['line']}:{d['col']}", "  ---", f"  message: {to_json(d['message'])}", f"  severity: {d['severity']}", "  ..."]
    return "\n".join(out) + "\n"


def console(rows: list[dict]) -> str:
    shown = lambda s: "".join(c if c.isprintable() else f"\\u{{{ord(c):x}}}" for c in s)
    return "".join(f"{shown(d['path'])}:{d['line']}:{d['col']}: {d['severity']}[{d['rule_id']}]: {shown(d['message'])}\n" for d in rows)


def console_value(value: object) -> str:
    return "".join(c if c.isprintable() or c == "\n" else f"\\u{{{ord(c):x}}}" for c in (value if isinstance(value, str) else flow_yaml(value)))


def unified_diff(a: str, b: str, path: str) -> str:
    out = []
    for line in difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), f"a/{path}", f"b/{path}"):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


def _number(rows: DataFrame) -> DataFrame:
    """rows with n, 1, 2, ... in the contract's order: prefix sums over range partitions, no single task."""
    from treeloom.operators.frames import numbered

    return numbered(rows, ORDER, "n")


def tap_lines(diagnostics: DataFrame) -> DataFrame:
    """(n, line) of a TAP report, natively."""
    place = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"))
    state = F.when(F.col("severity") == "error", "not ok ").otherwise("ok ")
    return _number(diagnostics).select("n", F.concat(state, F.col("n").cast("string"), F.lit(" - "), "rule_id", F.lit(" "), place).alias("line"))


def sarif_results(diagnostics: DataFrame) -> DataFrame:
    """(n, result as JSON) natively; ruleIndex by the rule's first place."""
    rows = _number(diagnostics)
    from treeloom.operators.frames import numbered

    first = rows.groupBy("rule_id").agg(F.min("n").alias("first"))
    first = numbered(first, ["first"], "k").select("rule_id", (F.col("k") - 1).cast("int").alias("rule_index"))
    level: Column = F.coalesce(*(F.when(F.col("severity") == s, F.lit(v)) for s, v in LEVELS.items()))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))
    body = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return rows.join(first, "rule_id").select("n", F.to_json(body).alias("result"))


def json_lines(diagnostics: DataFrame) -> DataFrame:
    """(n, line): the findings as JSON Lines, natively."""
    fields = ("path", "line", "col", "message", "severity", "rule_id", "references")
    return _number(diagnostics).select("n", F.to_json(F.struct(*fields)).alias("line"))


def junit_cases(diagnostics: DataFrame) -> DataFrame:
    """(n, testcase): the elements of a JUnit suite, natively."""
    def escaped(c: Column) -> Column:
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(entity))
        return c

    place = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"))
    open_ = F.concat(F.lit('<testcase classname="'), escaped(F.col("rule_id")), F.lit('" name="'), escaped(place), F.lit('">'))
    failure = F.concat(F.lit('<failure type="error" message="'), escaped(F.col("message")), F.lit('"/>'))
    other = F.concat(F.lit("<system-out>"), F.col("severity"), F.lit(": "), escaped(F.col("message")), F.lit("</system-out>"))
    return _number(diagnostics).select("n", F.concat(open_, F.when(F.col("severity") == "error", failure).otherwise(other), F.lit("</testcase>")).alias("testcase"))


def totals(diagnostics: DataFrame) -> DataFrame:
    """(namespace, severity, n, n_files, n_files_near): findings by rule cube; a null stands for all. n_files_near is estimated from sketches, which merge before the shuffle."""
    space = F.split_part("rule_id", F.lit("."), F.lit(1)).alias("namespace")
    return diagnostics.cube(space, "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"), F.approx_count_distinct("path", 0.02).alias("n_files_near"))
