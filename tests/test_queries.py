"""Every query of the catalogue against its SQL on the smallest tables, and plans."""

import os
import sys

import duckdb
import pandas as pd
import pytest

from tests.conftest import SMALL
from treeloom.functions import jq_columns
from treeloom.operators import frames
from treeloom.plans import catalogue, lint

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    shown = lambda v: repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else "None" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SMALL).toPandas()
    expected = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_times_and_roots_round_as_in_sql(spark, tmp_path):
    times = ["2024-01-01 23:59:59.499999", "2024-01-01 23:59:59.5", "2024-02-28 23:59:59.999999", "1969-12-31 23:59:59.4", "1969-12-31 23:59:59.5", "9999-12-31 23:59:59.7", "0044-03-15 (BC) 12:00:00", None]
    values = [-0.0, -1.5, 2.5e-13, 1e-13, -0.01, 9.2e18, 0.3 * 1e15, None]
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, value DOUBLE)")
    c.executemany("INSERT INTO events VALUES (?, ?::TIMESTAMP, ?)", list(zip(range(len(times)), times, values)))
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = sorted(map(tuple, catalogue.QUERIES["jq_math_time"](spark, str(tmp_path)).collect()))
    assert len(found) == len(times) and found == sorted(c.execute(catalogue.ORACLES["jq_math_time"]).fetchall())


PROGRAMS = ["map(.a)", "map(select(.a > 1))", ".[0].b", ".[-1].a", ".[5].a", "[.[].a] | add", "map(.b // \"z\")", "any(.a > 2)", "all(.a > 0)", "sort_by(-.a) | map(.b)", "unique_by(.b) | map(.a)", "group_by(.b) | map(length)", "min_by(.a).b", "max_by(.a).b", "length", "map(if .a > 1 then \"x\" else .b end)", ".[1:][0].a", "map(.a * 2 + 1)", "map(.b // \"z\" | ascii_upcase)", "[limit(2; .[].a)]", "first.a", "map(has(\"a\"))", "reduce .[] as $x (0; . + $x.a)", ". as $all | map(.a + ($all | length))", "map(\"\\(.b)-\\(.a)\")", "[.[] | .a, .a]", "map(.b < \"c\")", "map(select(.b != null) | .b | test(\"^[ab]\"))", "[range(3)]", "map([.a, 1] | max)", "def d(x): x * 2; map(d(.a))", "map(.a | tostring) | join(\"/\")", "map(.a / 2 | floor)", "map({k: .a}) | map(.k)", "map(.b | explode?) | length", "map(.a % 2 == 0)", "map(.b | . == null)", "map(.a) - [1]", "flatten | length", "map(.b | length)"]


@pytest.mark.parametrize("program", PROGRAMS)
def test_columns_say_what_the_evaluator_says(spark, program):
    from treeloom.functions.jq import Program
    from treeloom.values import to_json

    data = [[(1, "a"), (3, "b"), (2, "a")], [(5, None)], [(2, "c"), (2, "b")]]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, l array<struct<a:bigint,b:string>>")
    try:
        out = jq_columns.compile_column(program, df["l"], df.schema["l"].dataType)
    except jq_columns.Unsupported:
        pytest.skip("left to the evaluator")

    def plain(x):
        return {k: plain(v) for k, v in x.asDict().items()} if hasattr(x, "asDict") else [plain(v) for v in x] if isinstance(x, list) else int(x) if isinstance(x, float) and x == int(x) else x

    for i, found in df.select("i", out.column.alias("x")).collect():
        expected = Program(program).run([{"a": a, "b": b} for a, b in data[i]])
        got = [plain(v) for v in found] if out.many else [plain(found)]
        assert [to_json(v) for v in got] == [to_json(v) for v in expected], program


def test_unsupported_programs_run_in_the_evaluator(spark):
    docs = spark.createDataFrame([(1, '{"a":[1,{"b":2}]}'), (2, "[]"), (3, "{"), (4, None)], "id int, json string")
    out = {r.id: (r.outputs, r.error) for r in jq_columns.query(docs, "[.. | numbers], .a").collect()}
    assert out[1] == (["[1,2]", '[1,{"b":2}]'], None) and out[2][0] is None and "Cannot index" in out[2][1] and out[3][0] is None and out[4] == (["[]", "null"], None)


def test_plans_push_down_and_shuffle_once(spark):
    plan = catalogue.QUERIES["jq_map_select"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_discount:double>" in plan and "Python" not in plan and "Arrow" not in plan
    plan = catalogue.QUERIES["pointer_get"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    gated = lint.lint(catalogue._manifests(spark, SMALL, "json", catalogue.F.lit("{}"), "other.json"), lint.resolve(["npm.has-license"], []))
    assert gated.count() == 0


def test_nodes_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, '{"a/b":[null,1e400,"\\u00e9"],"":{}}'), (2, "3"), (3, None)], "doc_id long, json string")
    n = frames.nodes(docs)
    assert [(r.doc_id, r.pointer, r.type) for r in n.orderBy("doc_id", "ord").collect()] == [(1, "", "object"), (1, "/a~1b", "array"), (1, "/a~1b/0", "null"), (1, "/a~1b/1", "float"), (1, "/a~1b/2", "string"), (1, "/", "object"), (2, "", "int")]
    assert {r.doc_id: r.json for r in frames.rebuild(n).collect()} == {1: '{"a/b":[null,1e400,"é"],"":{}}', 2: "3"}
    assert [(r.op, r.path, r.value) for r in frames.diff(frames.nodes(spark.createDataFrame([(1, '{"a":{"x":1},"b":[1,2],"c":1}')], "doc_id long, json string")), frames.nodes(spark.createDataFrame([(1, '{"a":3,"b":[1],"c":1.0,"d":"q"}')], "doc_id long, json string"))).orderBy("path").collect()] == [("replace", "/a", "3"), ("remove", "/b/1", None), ("add", "/d", '"q"')]


def test_contract(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
