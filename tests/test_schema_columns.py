"""Schemas as columns say what the checker says."""

import random

import pytest

from treeloom.functions import schema_columns
from treeloom.values import to_json

SCHEMAS = [
    {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["integer", "null"], "minimum": 2, "exclusiveMaximum": 5}, "b": {"type": "string", "minLength": 1, "maxLength": 2, "pattern": "^[a-c]+$"}}},
    {"properties": {"a": {"enum": [1, "x", None, True, 2.5]}, "o": {"type": "object", "required": ["k"], "additionalProperties": False, "maxProperties": 1, "properties": {"k": {"const": "x"}}}, "l": {"type": "array", "minItems": 1, "maxItems": 2}}, "minProperties": 2},
    {"type": ["string", "boolean"]}, {"type": "number", "maximum": 3, "exclusiveMinimum": 1}, {}, {"properties": {"a b": {"type": "integer"}, "c/d": {"type": "number"}}},
]


def value(rng, depth=0):
    x = rng.choice([None, True, False, 0, 1, 2, 2.5, 3.0, 5, -1, "", "x", "ab", "abc", 10**30, 1e300, {}, []])
    if depth < 2 and rng.random() < 0.6:
        x = {k: value(rng, depth + 1) for k in rng.sample(["a", "b", "o", "l", "k", "a b", "c/d"], rng.randrange(6))} if rng.random() < 0.8 else [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return x


@pytest.mark.parametrize("schema", SCHEMAS)
def test_columns_and_checker_agree(spark, schema):
    rng = random.Random(1)
    texts = [to_json(value(rng)) for _ in range(500)] + ["{", '{"a":1,"a":"x","b":"c"}', '{"a":2.00000000000000000001,"b":"a"}', None, " [1] "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, json string")
    out = schema_columns.errors(d, schema)
    assert "variant" in out._jdf.queryExecution().optimizedPlan().toString().lower() or schema == {}
    found, expected = (sorted((r.doc_id, str(r.pointer), r.keyword) for r in x.collect()) for x in (out, schema_columns._checked(d.where("json is not null"), schema)))
    assert found == expected


def test_what_does_not_compile_is_checked(spark):
    d = spark.createDataFrame([(1, "[1,1]"), (2, "[1]")], "doc_id long, json string")
    assert [tuple(r) for r in schema_columns.errors(d, {"uniqueItems": True}).collect()] == [(1, "", "/uniqueItems")]
