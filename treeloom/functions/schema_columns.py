"""Schemas as columns: what of a schema built-in functions can check over VARIANT, document by document, without Python.

Compiled are type, enum and const of scalars, the bounds of numbers, lengths, patterns, required,
properties, additionalProperties: false, and the sizes of objects and arrays. A schema with other
keywords isn't compiled (`Unsupported`); `functions.schema.Schema` checks it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.schema import Schema
from treeloom.pointer import escape
from treeloom.values import DocumentError, is_number, parse_json, to_json

ERRORS = "doc_id long, pointer string, keyword string"
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}
_TYPES = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
#: Numbers that a double, or VARIANT, may not hold as they are written; Python checks their documents.
_LONG_NUMBER = r"[0-9][0-9.]{14,}|[0-9][eE][-+]?[0-9]"


class Unsupported(Exception):
    pass


def _errors(schema: object, v: Column, there: Column, at: str, where: str) -> Iterator[Column]:
    """For each keyword a struct (pointer, keyword), or null where v, if it is there, is as it should be."""
    if schema is True or schema == {}:
        return
    if not isinstance(schema, dict):
        raise Unsupported("false")
    known = _NOTES | {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties", "minProperties", "maxProperties", "minItems", "maxItems"}
    if extra := set(schema) - known:
        raise Unsupported(", ".join(sorted(extra)))
    shape = F.schema_of_variant(v)
    is_ = {name: shape.startswith(prefix) for name, prefix in _TYPES.items()}
    number = F.when(shape.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, "$", "double"))
    text = F.when(is_["string"], F.try_variant_get(v, "$", "string"))
    is_ |= {"number": number.isNotNull(), "integer": number.isNotNull() & (number == F.floor(number))}

    def bad(keyword: str, wrong: Column) -> Column:
        return F.when(there & F.coalesce(wrong, F.lit(False)), F.struct(F.lit(at).alias("pointer"), F.lit(f"{where}/{keyword}").alias("keyword")))

    def equal(x: object) -> Column:
        if x is None:
            return is_["null"]
        if isinstance(x, bool):
            return F.coalesce(F.when(is_["boolean"], F.try_variant_get(v, "$", "boolean")) == x, F.lit(False))
        if isinstance(x, str):
            return F.coalesce(text == x, F.lit(False))
        if is_number(x) and not re.search(_LONG_NUMBER, to_json(x)):
            return F.coalesce(number == float(x), F.lit(False))
        raise Unsupported("enum of containers")

    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        good = F.lit(False)
        for k in kinds:
            good = good | is_[k]
        yield bad("type", ~good)
    if "enum" in schema:
        good = F.lit(False)
        for x in schema["enum"]:
            good = good | equal(x)
        yield bad("enum", ~good)
    if "const" in schema:
        yield bad("const", ~equal(schema["const"]))
    for keyword, wrong in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x)):
        if keyword in schema:
            if re.search(_LONG_NUMBER, to_json(schema[keyword])):
                raise Unsupported("long numbers")
            yield bad(keyword, wrong(float(schema[keyword])))
    if "minLength" in schema:
        yield bad("minLength", F.length(text) < schema["minLength"])
    if "maxLength" in schema:
        yield bad("maxLength", F.length(text) > schema["maxLength"])
    if "pattern" in schema:
        if not re.fullmatch(r"(?:[\w\s^$.,:;/@#%&=~<>!|()*+?{}\[\]-]|\\[dswDSW.+*?^$()\[\]{}|/\\-])*", schema["pattern"], re.A) or re.search(r"\(\?|&&|\[[^\]]*\[|\\[wdsWDS]", schema["pattern"]):
            raise Unsupported("pattern")  # what may mean something else in Java
        yield bad("pattern", ~text.rlike(schema["pattern"]))
    object_, names = there & is_["object"], F.json_object_keys(F.when(there & is_["object"], v.cast("string")))
    for k in schema.get("required", []):
        yield F.when(object_ & ~F.coalesce(F.array_contains(names, k), F.lit(False)), F.struct(F.lit(at).alias("pointer"), F.lit(f"{where}/required").alias("keyword")))
    if "minProperties" in schema:
        yield bad("minProperties", is_["object"] & (F.size(names) < schema["minProperties"]))
    if "maxProperties" in schema:
        yield bad("maxProperties", is_["object"] & (F.size(names) > schema["maxProperties"]))
    known = schema.get("properties", {})
    if "additionalProperties" in schema and schema["additionalProperties"] is not True:
        if schema["additionalProperties"] is not False:
            raise Unsupported("additionalProperties")
        yield bad("additionalProperties", is_["object"] & (F.size(F.array_except(names, F.array(*map(F.lit, known)).cast("array<string>"))) > 0))
    size = F.when(is_["array"], F.size(F.try_variant_get(v, "$", "array<variant>")))
    if "minItems" in schema:
        yield bad("minItems", size < schema["minItems"])
    if "maxItems" in schema:
        yield bad("maxItems", size > schema["maxItems"])
    for k, inner in known.items():
        if re.search(r"['\"\\\]\[]", k):
            raise Unsupported("names with quotes")
        found = F.try_variant_get(v, f"$['{k}']", "variant")
        yield from _errors(inner, found, object_ & F.coalesce(F.array_contains(names, k), F.lit(False)), f"{at}/{escape(k)}", f"{where}/properties/{escape(k)}")


def compiled(schema: object, v: Column) -> Column:
    """An array of (pointer, keyword) of what in the VARIANT v breaks the schema."""
    parts = list(_errors(schema, v, F.lit(True), "", ""))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<struct<pointer:string,keyword:string>>")


def errors(docs: DataFrame, schema: dict) -> DataFrame:
    """ERRORS of docs(doc_id, json): one row for each keyword that a document breaks.

    A text that is no JSON gives the keyword "parse" and no pointer, a null nothing. Columns check what
    they can; Python checks documents with numbers that need exact arithmetic, and texts that VARIANT
    refuses, such as those with repeated keys; and all documents where the schema doesn't compile.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("json").cast("string").alias("json")).where("json is not null")
    v = F.try_parse_json("json")
    try:
        found = F.explode(compiled(schema, F.col("v"))).alias("x")
    except Unsupported:
        return _checked(docs, schema)
    plain = ~F.col("json").rlike(_LONG_NUMBER) & v.isNotNull()
    native = docs.where(plain).select("doc_id", v.alias("v")).select("doc_id", found).select("doc_id", "x.pointer", "x.keyword")
    return native.distinct().unionByName(_checked(docs.where(~plain), schema)) if _repeats(schema) else native.unionByName(_checked(docs.where(~plain), schema))


def _repeats(schema: dict) -> bool:
    """Whether several missing names, which are one row each time, may be told by the same row."""
    return len(schema.get("required", [])) > 1 or any(isinstance(x, dict) and _repeats(x) for x in schema.get("properties", {}).values())


def _checked(docs: DataFrame, schema: dict) -> DataFrame:
    text = to_json(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Schema(parse_json(text))

        def rows_of(value: str) -> list[tuple]:
            try:
                return list(dict.fromkeys((at, where) for at, where, _ in own.errors(parse_json(value))))
            except DocumentError:
                return [(None, "parse")]

        for batch in batches:
            rows = [(d, *x) for d, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in rows_of(value)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "pointer", "keyword"])

    return docs.mapInArrow(run, ERRORS)
