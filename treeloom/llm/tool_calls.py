"""Chat formatting: linking tool calls to their results (operator 3).

Messages hold calls, `<tool_call>{"id", "name", "arguments", "after"}</tool_call>`, and results,
`<tool_result id="...">text</tool_result>`. A message with neither is part of an implied exchange:
a user's message calls `reply` with its text, under the id of its turn and after the exchange two
turns earlier, and an assistant's message is the result for the turn before it.

Calls and results meet in a hash join on (conversation, id), salted for ids with many results. The
place of a call in topological order is its depth below calls it comes `after`, found by pointer
doubling in as many joins as the logarithm of the longest chain, each salted for calls that many
others come after; then its turn, place and id. `position` counts the calls of a conversation in
this order, from prefix sums over range partitions. Arguments are validated against the schema of the
tool's name (`errors_of`, the usual keywords). Each row becomes one canonical JSON text: sorted keys,
no spaces, shortest numbers, UTF-8; whole numbers of any length as they are, lone surrogates escaped.
No step gathers a conversation, so one that holds a third of all rows is no single task's work.

Nothing of a message is lost. Rows by status:
* calls: "linked" with the first result of their id in the same or a later turn; "unanswered"; "cycle",
  in or after a circle, depth null; "invalid", arguments that break the schema or an unknown tool;
  "duplicate", of repeated ids in a conversation all but the first (least turn, place, content);
  "malformed", bad JSON, or nested deeper than MOST_NESTED;
* results of their own: "orphan" without a call, "early" before the call's turn, "repeated" after the first;
* "text" beside calls and results; "message" of other roles or without turn, without calls and results.

Edge cases: `after` an id that no call has is ignored. Null text is empty; null conv_id is a
conversation of its own; a null turn comes after all others. Repeated rows repeat their calls and
results. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import hot_counts, ranked, rows_of, salted_join, written

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_RESULT = re.compile(r"<tool_result\s+id=\"([^\"]*)\"\s*>(.*?)</tool_result>", re.S)
SCHEMAS = {"reply": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
MOST_NESTED = 100
_LATE = 1 << 62
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """Sorted keys, no spaces, whole floats as integers, non-finite numbers as null."""

    def plain(x: object) -> object:
        if isinstance(x, float):
            return None if x != x or x in (float("inf"), float("-inf")) else int(x) if x == int(x) and abs(x) < 1 << 53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return whole_text(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def whole_text(text: str) -> str:
    """text with lone surrogates, which UTF-8 doesn't have, as escapes."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def parsed(text: str) -> object:
    """JSON with whole numbers of any length; ValueError for what is nested too deeply."""
    sys.set_int_max_str_digits(0)
    value = json.loads(text)
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > MOST_NESTED:
            raise ValueError("nested too deeply")
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
    return value


def errors_of(value: object, schema: dict, at: str = "") -> list[str]:
    """What in value breaks the schema, as "pointer: keyword"."""
    out = []
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not any(number and (k == "number" or isinstance(value, int) or value.is_integer()) if k in ("number", "integer") else isinstance(value, _TYPES[k]) for k in kinds):
            return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if isinstance(value, dict):
        out += [f"{at}/{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in schema.get("properties", {}):
                out += errors_of(v, schema["properties"][k], f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}/{k}: additionalProperties")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{at}: items")
        for i, v in enumerate(value if "items" in schema else []):
            out += errors_of(v, schema["items"], f"{at}/{i}")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: range")
    return out


def parts_of(turn: int | None, role: str | None, text: str | None) -> list[tuple]:
    """(kind, id, place, name, arguments or content, after) of a message."""
    text = text or ""
    out: list[tuple] = []
    for place, m in enumerate(_CALL.finditer(text)):
        try:
            call = parsed(m[1])
            out.append(("call", whole_text(str(call["id"])), place, whole_text(str(call["name"])), canonical(call.get("arguments", {})), whole_text(str(call["after"])) if call.get("after") is not None else None))
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            out.append(("malformed", f"?{turn}.{place}", place, None, m[1], None))
    out += [("result", m[1], place, None, m[2], None) for place, m in enumerate(_RESULT.finditer(text))]
    if out:
        edges = sorted(m.span() for tag in (_CALL, _RESULT) for m in tag.finditer(text))
        beside, at = [], 0
        for start, end in [*edges, (len(text), len(text))]:
            beside.append(text[at:start].strip() if start > at else "")
            at = max(at, end)
        return out + [("text", f"#{turn}.{place}", place, None, x, None) for place, x in enumerate(beside) if x]
    if role == "user" and turn is not None:
        return [("call", f"turn {turn}", 0, "reply", canonical({"text": text, "turn": turn}), f"turn {turn - 2}")]
    if role == "assistant" and turn is not None:
        return [("result", f"turn {turn - 1}", 0, None, text, None)]
    return [("message", f"#{turn}", 0, None, text, None)]


_PARTS = "conv_id long, turn long, role string, kind string, id string, place long, name string, body string, after string"


def depths(calls: DataFrame) -> DataFrame:
    """(key, depth) of calls(key, parent), unique keys; depth null in and after circles."""
    known = calls.select(F.col("key").alias("parent"), F.lit(True).alias("there"))
    many = hot_counts(calls.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")), "parent")
    now = salted_join(calls, known, "parent", many, F.col("key"), "left")
    now = written(now.select("key", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")), "depths")
    total, left, reach = now.count(), now.where("up is not null").count(), 1
    while left and reach <= total:
        waiting, done = now.where("up is not null"), now.where("up is null")
        hot = hot_counts(waiting.groupBy("up").agg(F.count("*").alias("n")), "up")
        step = salted_join(waiting, now.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more")), "up", hot, F.col("key"))
        now = written(step.select("key", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")).unionByName(done), "depths")
        reach *= 2
        left = now.where("up is not null").count()
    return now.select("key", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def linked_calls(messages: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """(conv_id, turn, id, depth, position, status, n_errors, message) for each call, each result without a call of its own, and all other text."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PARTS.split(", ")]
        kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in _PARTS.split(", ")]
        for part in rows_of(batches):
            rows = [(conv, turn, role, *p) for conv, turn, role, text in zip(part["conv_id"], part["turn"], part["role"], part["text"], strict=True) for p in parts_of(turn, role, text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(parse, _PARTS)
    own = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = written(rows.withColumn("key", F.concat_ws(" ", own, "id")).withColumn("parent", F.when(F.col("after").isNotNull(), F.concat_ws(" ", own, "after"))).withColumn("row", F.monotonically_increasing_id()), "parts")
    time = F.coalesce("turn", F.lit(_LATE))
    # Of each id the first call; it takes the first result that isn't earlier.
    first = F.min(F.struct(time.alias("time"), "place", "name", "body", "parent", "row"))
    calls = written(rows.where("kind = 'call'").groupBy("key").agg(first.alias("c")).select("key", "c.parent", F.col("c.time").alias("called"), F.col("c.row").alias("call")), "calls")
    results = rows.where("kind = 'result'")
    many = written(hot_counts(results.groupBy("key").agg(F.count("*").alias("n")), "key"), "many")
    results = salted_join(results, calls.select("key", "called"), "key", many, F.col("row"), "left").withColumn("fits", F.col("called").isNotNull() & (time >= F.col("called")))
    results = written(results, "results")
    taken = results.where("fits").groupBy("key").agg(F.min(F.struct(time.alias("time"), "place", "body", "row")).alias("r"))
    links = written(calls.hint("shuffle_hash").join(taken, "key", "left").join(depths(calls.select("key", "parent")), "key", "left").select("call", "depth", F.col("r.row").alias("result_row"), F.col("r.body").alias("result")), "links")
    firsts = rows.join(links.withColumnRenamed("call", "row"), "row").withColumn("status", F.when(F.col("depth").isNull(), "cycle").when(F.col("result_row").isNotNull(), "linked").otherwise("unanswered"))
    firsts = written(firsts.select("row", "conv_id", "turn", "place", "role", "kind", "id", "name", "body", "depth", "result", "status"), "firsts")
    ordered = written(ranked(firsts.where("depth is not null").select("row", "conv_id", "depth", time.alias("time"), "place", "id"), ["conv_id", "depth", "time", "place", "id", "row"], "rank"), "ordered")
    began = ordered.groupBy("conv_id").agg(F.min("rank").alias("began"), F.count("*").alias("n")).select(own.alias("conv"), "began", "n")
    places = salted_join(ordered.withColumn("conv", own), began.select("conv", "began"), "conv", written(hot_counts(began, "conv"), "hot"), F.col("row")).select("row", (F.col("rank") - F.col("began")).alias("position"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rest = rows.where("kind <> 'result'").join(firsts.select("row"), "row", "left_anti").withColumn("status", F.when(F.col("kind") == "call", "duplicate").otherwise(F.col("kind")))
    over = results.join(links.where("result_row is not null").select(F.col("result_row").alias("row")), "row", "left_anti")
    over = over.withColumn("status", F.when(F.col("called").isNull(), "orphan").when(F.col("fits"), "repeated").otherwise("early"))
    plain = ["conv_id", "turn", "role", "kind", "id", "name", "body", "status"]
    out = firsts.join(places, "row", "left").select(*plain, "depth", "position", "result")
    for more in (rest, over):
        out = out.unionByName(more.select(*plain, none("long", "depth"), none("long", "position"), none("string", "result")))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            errors, messages_, statuses = [], [], []
            for n in range(len(part["id"])):
                status, body, found = part["status"][n], part["body"][n], []
                record: dict = {"id": part["id"][n]}
                if part["kind"][n] == "call":
                    arguments = parsed(body)
                    found = errors_of(arguments, schemas[part["name"][n]]) if part["name"][n] in schemas else [": unknown tool"]
                    record |= {"name": part["name"][n], "arguments": arguments}
                    status = "invalid" if found and status in ("linked", "unanswered") else status
                else:
                    record["text"] = body
                if part["kind"][n] in ("text", "message"):
                    record["role"] = part["role"][n]
                if part["result"][n] is not None:
                    record["result"] = part["result"][n]
                if found:
                    record["errors"] = found
                record["status"] = status
                errors.append(len(found))
                statuses.append(status)
                messages_.append(canonical(record))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in ((part["conv_id"], pa.int64()), (part["turn"], pa.int64()), (part["id"], pa.string()), (part["depth"], pa.int64()), (part["position"], pa.int64()), (statuses, pa.string()), (errors, pa.int64()), (messages_, pa.string()))], names=["conv_id", "turn", "id", "depth", "position", "status", "n_errors", "message"])

    return out.mapInArrow(finish, "conv_id long, turn long, id string, depth long, position long, status string, n_errors long, message string")
