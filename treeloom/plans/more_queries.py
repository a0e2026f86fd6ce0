"""Further queries of the catalogue: edits, formats, paths and errors over documents made from nation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import jq_columns
from treeloom.operators import bulk, frames
from treeloom.plans import lint
from treeloom.pointer import inline_value, read_patch_lines, rebased
from treeloom.sources import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


def _filled(pattern: str) -> Column:
    """pattern with <k>, <r> and <name> in place of nation's key, region and name."""
    out = F.lit(pattern)
    for mark, column in (("<k>", F.col("n_nationkey").cast("string")), ("<r>", F.col("n_regionkey").cast("string")), ("<name>", F.col("n_name"))):
        out = F.replace(out, F.lit(mark), column)
    return out


def _docs(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    return _nation(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("doc_id"), _filled(pattern).alias("json"))


def _files(spark: SparkSession, sf_dir: str, pattern: str, extension: str) -> DataFrame:
    return _nation(spark, sf_dir).select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit(f"/x.{extension}")).alias("path"), _filled(pattern).cast("binary").alias("content"))


def _edited(spark: SparkSession, sf_dir: str, pattern: str, extension: str, edit: dict) -> DataFrame:
    out = bulk.edit_files(_files(spark, sf_dir, pattern, extension), edit)
    return out.select(_key(), "status", F.replace("content", F.lit("\n"), F.lit("|")).alias("content"))


def _key() -> Column:
    return F.regexp_extract("path", r"^n/(\d+)/", 1).cast("long").alias("k")


_TREE = '{"a":[{"n":<k>,"name":"<name>"},{"n":<r>}],"x y":<r>}'
_PATHS = {
    "slice": "$.a[0:1].n", "steps": "$.a[::-1].n", "length": "$.a[?length(@.name) > 6].n", "count": "$.a[?count(@.*) == 2].n", "search": "$.a[?search(@.name, 'AN')].n",
    "match": "$.a[?match(@.name, '[A-M].*')].n", "value": "$.a[?value(@..name) == \"FRANCE\"].n", "number": "$.a[?@.n == 3.0].n", "blank": "$.x y", "in": "$.a[?@.n in [1]].n", "below": "$..n",
}


@_query("""
WITH t AS (SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r, n_name FROM nation)
SELECT 'slice' AS path, k AS doc_id, k::VARCHAR AS value, 0 AS n FROM t
UNION ALL SELECT 'steps', k, unnest([r, k])::VARCHAR, unnest([0, 1]) FROM t
UNION ALL SELECT 'length', k, k::VARCHAR, 0 FROM t WHERE length(n_name) > 6
UNION ALL SELECT 'count', k, k::VARCHAR, 0 FROM t
UNION ALL SELECT 'search', k, k::VARCHAR, 0 FROM t WHERE contains(n_name, 'AN')
UNION ALL SELECT 'match', k, k::VARCHAR, 0 FROM t WHERE n_name < 'N'
UNION ALL SELECT 'value', k, k::VARCHAR, 0 FROM t WHERE n_name = 'FRANCE'
UNION ALL SELECT 'number', k, x::VARCHAR, (row_number() OVER (PARTITION BY k ORDER BY place) - 1)::INT FROM (SELECT k, unnest([k, r]) AS x, unnest([0, 1]) AS place FROM t) WHERE x = 3
UNION ALL SELECT 'blank', k, r::VARCHAR, 0 FROM t
UNION ALL SELECT 'below', k, unnest([k, r])::VARCHAR, unnest([0, 1]) FROM t""")
def jsonpath_forms(spark, sf_dir):
    """Slices, functions, exact numbers and blanks of JSONPath; `in` is no operator and matches nothing."""
    d = _docs(spark, sf_dir, _TREE)
    out = None
    for name, path in _PATHS.items():
        found = frames.select(d, path).select(F.lit(name).alias("path"), "doc_id", "value", "n")
        out = found if out is None else out.unionByName(found)
    return out


@_query("SELECT n_nationkey::BIGINT AS doc_id, 2 AS n_numbers, CASE WHEN n_nationkey > 3 THEN 1 ELSE 0 END AS n_large FROM nation")
def jq_recurse(spark, sf_dir):
    out = jq_columns.query(_docs(spark, sf_dir, '{"a":[{"n":<k>}],"b":{"c":{"d":3}}}'), "[.. | numbers] | length, (map(select(. > 3)) | length)", "json")
    return out.select("doc_id", F.col("outputs")[0].cast("int").alias("n_numbers"), F.col("outputs")[1].cast("int").alias("n_large"))


@_query("""
SELECT n_nationkey::BIGINT AS doc_id, CASE n_regionkey % 3 WHEN 0 THEN 'Cannot index number with "b"' WHEN 1 THEN 'string ("x") and number (' || n_nationkey || ') cannot be added' END AS error, CASE n_regionkey % 3 WHEN 2 THEN 'null' END AS output FROM nation""")
def jq_errors(spark, sf_dir):
    """What programs say that fail, and an index beyond any array."""
    d = _docs(spark, sf_dir, '{"n":<k>,"r":<r>,"a":[1]}')
    out = jq_columns.query(d, 'if .r % 3 == 0 then .n.b.c elif .r % 3 == 1 then "x" + .n else .a[4294967296] end', "json")
    return out.select("doc_id", "error", F.col("outputs")[0].alias("output"))


@_query("SELECT n_nationkey::BIGINT AS k, 'changed' AS status, '{|  \"n\": ' || (n_nationkey + 1) || ',|  \"t\": \"' || lower(n_name) || '\"|}|' AS content FROM nation")
def bulk_jq(spark, sf_dir):
    return _edited(spark, sf_dir, '{"n":<k>,"t":"<name>"}', "json", {"kind": "jq", "program": ".n += 1 | .t |= ascii_downcase"})


@_query("SELECT n_nationkey::BIGINT AS k, 'changed' AS status, '{\"n\":' || n_nationkey || ',\"v\":{\"a\":[true]}}' AS content FROM nation")
def bulk_inline_value(spark, sf_dir):
    """A value from a command line is JSON where it reads as such."""
    return _edited(spark, sf_dir, '{"n":<k>,"v":0}', "json", {"kind": "set", "pointer": "/v", "value": inline_value('{"a":[true]}')})


@_query("SELECT n_nationkey::BIGINT AS doc_id, '{\"a\":[1,9,' || n_nationkey || ']}' AS json, NULL::VARCHAR AS error FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT n_nationkey, '{\"a\":' || n_nationkey || '}', 'the parent is a number' FROM nation WHERE n_regionkey = 0")
def insert_items(spark, sf_dir):
    d = _nation(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("doc_id"), F.when(F.col("n_regionkey") == 0, _filled('{"a":<k>}')).otherwise(_filled('{"a":[1,<k>]}')).alias("json"))
    out = frames.insert(d, "/a/1", 9)
    return out.select("doc_id", "json", F.when(F.col("error").isNotNull(), "the parent is a number").alias("error"))


@_query("SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_regionkey = 2 THEN '{\"b\":2,\"c\":1}' ELSE '{\"a\":1,\"b\":' || n_regionkey || '}' END AS json, n_regionkey <> 2 AS aborted FROM nation")
def patch_test_aborts(spark, sf_dir):
    """A patch from lines, whose test lets all of it through or nothing."""
    out = frames.patch(_docs(spark, sf_dir, '{"a":1,"b":<r>}'), read_patch_lines("# moved only where b is 2\nmove /a /c\ntest /b 2\n"))
    return out.select("doc_id", "json", F.col("error").isNotNull().alias("aborted"))


@_query("SELECT n_nationkey::BIGINT AS doc_id, '{\"spec\":{\"n\":' || (n_regionkey + 0) || ',\"m\":5}}' AS json FROM nation")
def edit_script_under(spark, sf_dir):
    """A script for a part, moved below the pointer of the whole that holds it."""
    script = rebased([{"op": "add", "path": "/m", "value": 5}, {"op": "remove", "path": "/gone"}], "/spec")
    return frames.patch(_docs(spark, sf_dir, '{"spec":{"n":<r>,"gone":1}}'), script).select("doc_id", "json")


@_query("SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey = 0 THEN 'unchanged' ELSE 'changed' END AS status, CASE WHEN n_regionkey = 0 THEN '{\"name\":\"a\",\"version\":\"1\",\"private\":true}' ELSE '{|  \"name\": \"' || n_name || '\",|  \"version\": \"1\",|  \"license\": \"UNLICENSED\"|}|' END AS content FROM nation")
def fix_license(spark, sf_dir):
    text = F.when(F.col("n_regionkey") == 0, F.lit('{"name":"a","version":"1","private":true}')).otherwise(_filled('{"name":"<name>","version":"1"}'))
    files = _nation(spark, sf_dir).select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit("/package.json")).alias("path"), text.cast("binary").alias("content"))
    out = bulk.edit_files(files, {"kind": "fix", "rules": ["npm.has-license"]})
    return out.select(_key(), "status", F.replace("content", F.lit("\n"), F.lit("|")).alias("content"))


@_query("SELECT n_nationkey::BIGINT AS k, 'changed' AS status, 'a: ' || n_nationkey || '|---|new: ' || n_regionkey * 0 || '|---|b: 2|' AS content FROM nation")
def stream_insert(spark, sf_dir):
    return _edited(spark, sf_dir, "a: <k>\n---\nb: 2\n", "yaml", {"kind": "doc-insert", "doc": 1, "value": {"new": 0}})


@_query("SELECT n_nationkey::BIGINT AS k, 'changed' AS status, 'a: ' || n_nationkey || '|' AS content FROM nation")
def stream_remove(spark, sf_dir):
    return _edited(spark, sf_dir, "a: <k>\n---\nb: 2\n", "yaml", {"kind": "doc-remove", "doc": 1})


@_query("SELECT n_nationkey::BIGINT AS k, 'changed' AS status, '---|title: x|count: ' || 7 || '|---|# ' || n_name || '|' AS content FROM nation")
def frontmatter_set(spark, sf_dir):
    """The front matter alone is written; the body stays."""
    out = bulk.edit_files(_files(spark, sf_dir, "---\ntitle: x\n---\n# <name>\n", "md"), {"kind": "set", "pointer": "/count", "value": 7}, "frontmatter")
    return out.select(_key(), "status", F.replace("content", F.lit("\n"), F.lit("|")).alias("content"))


@_query("SELECT n_nationkey::BIGINT AS k, 'failed' AS status, NULL::VARCHAR AS content FROM nation")
def read_only_formats(spark, sf_dir):
    """Dockerfiles are read, never written."""
    return _edited(spark, sf_dir, "FROM a:<k>\n", "dockerfile", {"kind": "set", "pointer": "/0/line", "value": 2})


@_query("SELECT n_nationkey::BIGINT AS k, '{\"n\":12345678901234567890123' || n_nationkey || ',\"x\":[1],\"y\":[1],\"h\":16,\"s\":\"1_000\"}' AS json FROM nation")
def yaml_exact(spark, sf_dir):
    """Numbers of any length, anchors, hexadecimal numbers; what only looks like a number is text."""
    out = registry.read_documents(_files(spark, sf_dir, "n: 12345678901234567890123<k>\nx: &a [1]\ny: *a\nh: 0x10\ns: 1_000\n", "yaml"))
    return out.select(_key(), "json")


@_query("SELECT n_nationkey::BIGINT AS k, unnest([0, 1]) AS doc_idx, unnest([1, 4]) AS line FROM nation")
def yaml_stream_positions(spark, sf_dir):
    out = registry.read_documents(_files(spark, sf_dir, "# <name>\na: 1\n---\nb: <k>\n", "yaml"), positions=True)
    line = F.get_json_object("spans", "$['/a'][0]"), F.get_json_object("spans", "$['/b'][0]")
    return out.select(_key(), "doc_idx", F.when(F.col("doc_idx") == 0, line[0].cast("int") - 1).otherwise(line[1].cast("int")).alias("line"))


@_query("SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey = 1 THEN 'unchanged' ELSE 'changed' END AS status, 'a:|  c: 2|  d: ' || n_nationkey || '|b: 1|' AS content FROM nation")
def fmt_sorted(spark, sf_dir):
    text = F.when(F.col("n_regionkey") == 1, _filled("a:\n  c: 2\n  d: <k>\nb: 1\n")).otherwise(_filled("b:   1\na: {d: <k>, c: 2}\n"))
    files = _nation(spark, sf_dir).select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit("/x.yaml")).alias("path"), text.cast("binary").alias("content"))
    out = bulk.edit_files(files, {"kind": "fmt", "sort_keys": True})
    return out.select(_key(), "status", F.replace("content", F.lit("\n"), F.lit("|")).alias("content"))


@_query("SELECT n_nationkey::BIGINT AS k, 'changed' AS status, 'rows[2]{id,name}:|  ' || n_nationkey || ',' || n_name || '|  2,Y' AS content FROM nation")
def toon_tables(spark, sf_dir):
    return _edited(spark, sf_dir, '{"rows":[{"id":<k>,"name":"<name>"},{"id":2,"name":"Y"}]}', "json", {"kind": "fmt", "to": "toon"})


@_query("SELECT n_nationkey::BIGINT AS k, '--- a/n/' || n_nationkey || '/x.yaml|+++ b/n/' || n_nationkey || '/x.yaml|@@ -1,2 +1,2 @@|-a: ' || n_nationkey || '|+a: 100| b: ' || n_regionkey || '|' AS diff FROM nation")
def unified_diffs(spark, sf_dir):
    out = bulk.edit_files(_files(spark, sf_dir, "a: <k>\nb: <r>\n", "yaml"), {"kind": "set", "pointer": "/a", "value": 100})
    return out.select(_key(), F.replace("diff", F.lit("\n"), F.lit("|")).alias("diff"))


_RULES = """
- id: own.small
  severity: warn
  match: {format: [json, yaml], glob: 'n/**', filter: '.r != 0'}
  check: {jq: 'select(.n < 10) | {n: .n, f: .f, p: "/n"}', message: 'n is {{ .n }}'}
  loc: {pointer: .p, file: .f}
- id: own.fails
  severity: error
  match: {format: json}
  check: {jq: '.n.b.c', message: never}
"""


@_query("""
SELECT 'F' || n_nationkey AS path, 'own.small' AS rule_id, 'warn' AS severity, 'n is ' || n_nationkey AS message, 2 AS line FROM nation WHERE n_nationkey < 10 AND n_regionkey <> 0
UNION ALL SELECT 'n/' || n_nationkey || '/x.json', 'own.fails', 'rule-error', 'Cannot index number with "b"', 1 FROM nation""")
def own_rules(spark, sf_dir):
    """Rules of a file: globs, filters, places in another file, and a rule that fails."""
    files = registry.read_documents(_files(spark, sf_dir, '{"r":<r>,\n"n":<k>,"f":"F<k>"}', "json"), positions=True)
    return lint.lint(files, lint.read_rules(_RULES)).select("path", "rule_id", "severity", "message", "line")


@_query("SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey < 2 THEN 'changed' ELSE 'unchanged' END AS status FROM nation")
def plugin_fix(spark, sf_dir):
    """A plugin's patch counts where the plugin finds nothing afterwards."""

    def check(document):
        if document.root["r"] < 3:
            yield "own.r", "warn", "r is small", "/r"

    edit = {"kind": "plugin", "lint": check, "fix": lambda document: [{"op": "replace", "path": "/r", "value": document.root["r"] * 0 + (3 if document.root["r"] < 2 else 2)}]}
    return bulk.edit_files(_files(spark, sf_dir, '{"r":<r>}', "json"), edit).select(_key(), "status")
