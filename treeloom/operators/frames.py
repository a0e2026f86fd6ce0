"""Document operators as DataFrame plans over the table of nodes, one row for each node of each document.

nodes: doc_id, pointer, parent, key, idx, ord (pre-order), depth, type, str, num_literal, num, bool, n_children.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom import pointer as P
from treeloom.functions import jsonpath
from treeloom.values import DocumentError, is_number, number_text, parse_json, sorted_keys, to_json, type_name

LONG_NAME = 40
NODES = "doc_id long, pointer string, parent string, key string, idx int, ord int, depth int, type string, str string, num_literal string, num double, bool boolean, n_children int"


def as_double(v: object) -> float:
    """A number as the nearest double; infinite beyond their range."""
    try:
        return float(v)
    except OverflowError:
        return float("inf") if v > 0 else float("-inf")


def _rows(doc_id: int, value: object, wanted: Callable[[str, str | None, str | None], bool] | None = None) -> list[tuple]:
    out: list[tuple] = []
    todo = [("", None, None, None, 0, value)]
    n = 0
    while todo:
        at, parent, key, idx, depth, v = todo.pop()
        items = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
        if wanted is None or wanted(at, parent, key):
            number = is_number(v)
            out.append((doc_id, at, parent, key, idx, n, depth, type_name(v), v if isinstance(v, str) else None, number_text(v) if number else None, as_double(v) if number else None, v if isinstance(v, bool) else None, len(items) if isinstance(v, (dict, list)) else None))
        n += 1
        for k, x in reversed(items):
            todo.append((f"{at}/{P.escape(k) if isinstance(k, str) else k}", at, k if isinstance(k, str) else None, k if isinstance(k, int) else None, depth + 1, x))
    return out


def nodes(docs: DataFrame, pointers: Iterable[str] = (), parents: Iterable[str] = (), keys: Iterable[str] = ()) -> DataFrame:
    """The nodes of docs(doc_id, json), in tasks, document by document.

    With pointers, parents or keys only the nodes at one of the pointers, right below one of the
    parents, or of one of the keys are built; the others are walked over. A text that is no JSON
    gives one row of type "error", with no pointer and what is wrong in str; a null none.
    """
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in NODES.split(", ")]
    at, below = (frozenset(P.render(P.parse(x)) for x in part) for part in (pointers, parents))
    named = frozenset(keys)
    wanted = (lambda p, parent, key: p in at or parent in below or key in named) if at or below or named else None

    def rows_of(d: int, text: str) -> list[tuple]:
        try:
            return _rows(d, parse_json(text), wanted)
        except DocumentError as error:
            return [(d, None, None, None, None, 0, 0, "error", error.message, None, None, None, None)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_ in range(0, batch.num_rows, 256):
                part = batch.slice(at_, 256)
                rows = [r for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text is not None for r in rows_of(d, text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("json").cast("string")).mapInArrow(run, NODES)


def errors(table: DataFrame) -> DataFrame:
    """(doc_id, error) of documents that are no JSON."""
    return table.where("type = 'error'").select("doc_id", F.col("str").alias("error"))


def rebuild(table: DataFrame, root: str | None = None) -> DataFrame:
    """docs(doc_id, json) from nodes, members in the order of ord. A document is one task's work.

    root: a column of pointers; then (doc_id, root, json) of the subtree that each names, whose
    nodes have it in that column.
    """
    groups = ["doc_id", *([root] if root else [])]
    kept = table.where("pointer is not null").groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("ord", "pointer", "parent", "key", "type", "str", "num_literal", "bool"))).alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(len(groups)).to_pylist():
                built: dict[str, object] = {}
                top = None
                for n, r in enumerate(rows):
                    kind = r["type"]
                    v = {} if kind == "object" else [] if kind == "array" else r["str"] if kind == "string" else r["bool"] if kind == "bool" else parse_json(r["num_literal"]) if kind in ("int", "float") else None
                    built[r["pointer"]] = v
                    if n == 0:
                        top = v
                    elif isinstance(built[r["parent"]], dict):
                        built[r["parent"]][r["key"]] = v
                    else:
                        built[r["parent"]].append(v)
                out.append(to_json(top))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(groups)], pa.array(out, pa.string())], names=[*groups, "json"])

    return kept.mapInArrow(run, "doc_id long, " + (f"{root} string, " if root else "") + "json string")


def above(pointer: Column, own: bool = True) -> Column:
    """The pointers of a node's ancestors, from the root, and its own."""
    steps = F.split(pointer, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps) - (0 if own else 1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def subtrees(table: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root, json) of the subtrees at roots(doc_id, root), none of which lies in another."""
    spread = table.where("pointer is not null").join(roots.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("root", F.explode(above(F.col("pointer"))))
    return rebuild(spread.join(roots.select("doc_id", "root"), ["doc_id", "root"], "left_semi"), "root")


def text_of(prefix: str = "") -> Column:
    """A scalar node as JSON text; null for containers."""
    c = lambda n: F.col(prefix + n)
    quoted = F.regexp_replace(F.to_json(F.array(c("str"))), r"(?s)^\[|\]$", "")
    return F.when(c("type") == "string", quoted).when(c("type").isin("int", "float"), c("num_literal")).when(c("type") == "bool", c("bool").cast("string")).when(c("type") == "null", "null")


# Reading


def get(table: DataFrame, pointer: str) -> DataFrame:
    """(doc_id, type, value) of documents that have the pointer; value is JSON, a subtree's too.

    `nodes` may have been told to build only nodes at or below the pointer's scalars; a container's value
    needs all nodes below it.
    """
    at = P.render(P.parse(pointer))
    return _with_subtrees(table, table.where(F.col("pointer") == at)).select("doc_id", "type", "value")


def _with_subtrees(table: DataFrame, found: DataFrame) -> DataFrame:
    """found, nodes none of which lies in another, with their value as JSON."""
    whole = subtrees(table, found.where("type in ('object', 'array') and n_children > 0").select("doc_id", F.col("pointer").alias("root")))
    scalar = F.when(F.col("n_children") == 0, F.when(F.col("type") == "object", "{}").otherwise("[]")).otherwise(text_of())
    return found.join(whole.withColumnRenamed("root", "pointer"), ["doc_id", "pointer"], "left").withColumn("value", F.coalesce("json", scalar)).drop("json")


def get_scalar(table: DataFrame, pointer: str) -> DataFrame:
    """(doc_id, type, value) as `get`, where no container stands at the pointer: a filter, without a shuffle; containers give null."""
    return table.where(F.col("pointer") == P.render(P.parse(pointer))).select("doc_id", "type", text_of().alias("value"))


def values(table: DataFrame, pointer: str) -> DataFrame:
    """(doc_id, ord, key, idx, type, value) of the members below a pointer, subtrees as JSON."""
    return _with_subtrees(table, table.where(F.col("parent") == P.render(P.parse(pointer)))).select("doc_id", "ord", "key", "idx", "type", "value")


def exists(docs: DataFrame, table: DataFrame, pointer: str) -> DataFrame:
    """(doc_id, found) for each document."""
    there = table.where(F.col("pointer") == P.render(P.parse(pointer))).select("doc_id", F.lit(True).alias("there"))
    return docs.select("doc_id").join(there, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("found"))


def children(table: DataFrame, pointer: str) -> DataFrame:
    """(doc_id, ord, key, idx, type, value) of the members below a pointer."""
    return table.where(F.col("parent") == P.render(P.parse(pointer))).select("doc_id", "ord", "key", "idx", "type", text_of().alias("value"))


def lengths(table: DataFrame, pointer: str) -> DataFrame:
    """(doc_id, type, len): items, members or characters; null for what has no length."""
    return table.where(F.col("pointer") == P.render(P.parse(pointer))).select("doc_id", "type", F.coalesce("n_children", F.when(F.col("type") == "string", F.length("str"))).cast("long").alias("len"))


def paths(table: DataFrame) -> DataFrame:
    return table.where("pointer is not null").select("doc_id", "ord", "pointer", "type")


def suggestions(known: DataFrame, missing: DataFrame, most: int = 3) -> DataFrame:
    """(missing, rank, key, distance): at most three keys within two edits, by distance and name.

    known(key) is a document's keys. Names within two edits have a form in common that each becomes by
    leaving out at most two characters, so they meet in a join on these forms, whose number grows with
    the square of a name's length; names of more than LONG_NAME characters meet those of near length.
    """
    def shorter(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1, F.length(c))))

    def forms(c: Column) -> tuple[Column, Column]:
        once = F.when(F.length(c) > 0, shorter(c)).otherwise(F.array().cast("array<string>"))
        twice = F.flatten(F.transform(F.filter(once, lambda x: F.length(x) > 0), shorter))
        every = F.array_distinct(F.concat(F.array(c), once, twice))
        long = F.transform(F.sequence(F.length(c) - 2, F.length(c) + 2), lambda n: F.concat(F.lit("\0"), n.cast("string")))
        return F.when(F.length(c) <= LONG_NAME + 2, every).otherwise(F.array().cast("array<string>")), F.when(F.length(c) > LONG_NAME, long).otherwise(F.array().cast("array<string>"))

    short, long = forms(F.col("missing"))
    spread = missing.select("missing", F.explode(F.concat(short, long)).alias("form"))
    short, long = forms(F.col("key"))
    own = F.when(F.length("key") > LONG_NAME - 2, F.array(F.concat(F.lit("\0"), F.length("key").cast("string")))).otherwise(F.array().cast("array<string>"))
    forms_of = known.select("key", F.explode(F.concat(short, own)).alias("form"))
    near = spread.join(forms_of, "form").select("missing", "key").distinct().withColumn("distance", F.levenshtein("missing", "key")).where("distance <= 2")
    order = Window.partitionBy("missing").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("missing", "rank", "key", "distance")


def longest_prefix(table: DataFrame, pointer: str) -> DataFrame:
    """(doc_id, prefix): the deepest part of the pointer that each document has."""
    parts = P.parse(pointer)
    known = [P.render(parts[:n]) for n in range(len(parts) + 1)]
    return table.where(F.col("pointer").isin(known)).groupBy("doc_id").agg(F.max_by("pointer", "depth").alias("prefix"))


def select(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, pointer, value) of a JSONPath's matches, in document order."""
    jsonpath.compile_path(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, n, P.render(list(p)), to_json(v, finite=False)) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text is not None for n, (p, v) in enumerate(jsonpath.select(parse_json(text), path))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n", "pointer", "value"])

    return docs.select(F.col("doc_id").cast("long"), F.col("json").cast("string")).mapInArrow(run, "doc_id long, n int, pointer string, value string")


def descendants(table: DataFrame, key: str) -> DataFrame:
    """$..key as a plan over nodes."""
    return table.where(F.col("key") == key).select("doc_id", "ord", "pointer", "type", text_of().alias("value"))


# Changing


def _per_document(docs: DataFrame, change) -> DataFrame:
    """docs(doc_id, json, error): change(value) of each document; documents that refuse stay as they were."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for text in batch.column(1).to_pylist():
                error = None
                try:
                    text = to_json(change(parse_json(text)))
                except DocumentError as e:
                    error = e.message
                out.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "json", "error"])

    return docs.select(F.col("doc_id").cast("long"), F.col("json").cast("string")).mapInArrow(run, "doc_id long, json string, error string")


def set_value(docs: DataFrame, pointer: str, value: object, create: bool = True) -> DataFrame:
    return _per_document(docs, lambda v: P.set_value(v, pointer, value, create))


def delete(docs: DataFrame, pointer: str) -> DataFrame:
    return _per_document(docs, lambda v: P.delete(v, pointer))


def insert(docs: DataFrame, pointer: str, value: object) -> DataFrame:
    return _per_document(docs, lambda v: P.insert(v, pointer, value))


def patch(docs: DataFrame, ops: list[dict]) -> DataFrame:
    P.read_patch(ops)
    return _per_document(docs, lambda v: P.apply_patch(v, ops))


def merge(docs: DataFrame, patch_: object) -> DataFrame:
    return _per_document(docs, lambda v: P.merge(v, patch_))


def sort_keys(docs: DataFrame) -> DataFrame:
    return _per_document(docs, sorted_keys)


def delete_item(table: DataFrame, array: str, at: int) -> DataFrame:
    """Nodes after an array's item went: an anti-join of its subtree, and new numbers for the items behind it."""
    gone = P.render([*P.parse(array), at])
    kept = table.where(~((F.col("pointer") == gone) | F.col("pointer").startswith(gone + "/")))
    below = F.col("pointer").startswith(array + "/")
    number = F.regexp_extract(F.substring(F.col("pointer"), len(array) + 2, 1 << 20), r"^(\d+)", 1).cast("int")
    moved = below & (number > at)
    shift = lambda c: F.concat(F.lit(array + "/"), (number - 1).cast("string"), F.regexp_replace(F.substring(F.col(c), len(array) + 2, 1 << 20), r"^\d+", ""))
    return (
        kept.withColumn("_moved", moved).withColumn("idx", F.when(F.col("_moved") & (F.col("parent") == array), F.col("idx") - 1).otherwise(F.col("idx")))
        .withColumn("_parent", F.when(F.col("_moved") & (F.col("parent") != array), shift("parent")).otherwise(F.col("parent")))
        .withColumn("pointer", F.when(F.col("_moved"), shift("pointer")).otherwise(F.col("pointer")))
        .withColumn("n_children", F.when((F.col("pointer") == array) & F.exists(F.array(F.lit(at)), lambda a: a < F.col("n_children")), F.col("n_children") - 1).otherwise(F.col("n_children")))
        .drop("parent", "_moved").withColumnRenamed("_parent", "parent")
    )


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, op, path, value, ord): the fewest changes from nodes a to nodes b.

    A full outer join on (doc_id, pointer); of changed pointers only the topmost stay, by an
    anti-join against their changed ancestors. value is JSON, of b's whole subtree for containers.
    In the order of ord a document's changes can be applied one after another: removals come first,
    the last ones of a before those before them, then what b has, in its order.
    """
    keys = ["doc_id", "pointer"]
    a, b = (x.where("pointer is not null") for x in (a, b))
    x = a.select(*keys, F.col("type").alias("ta"), text_of().alias("va"), F.col("num").alias("na"), F.col("ord").alias("oa"))
    y = b.select(*keys, F.col("type").alias("tb"), text_of().alias("vb"), F.col("num").alias("nb"), F.col("ord").alias("ob"), "n_children")
    kind = lambda c: F.when(F.col(c).isin("int", "float"), "number").otherwise(F.col(c))
    number = (kind("ta") == "number") & (kind("tb") == "number")
    same = (kind("ta") == kind("tb")) & F.when(number, (F.col("va") == F.col("vb")) | (F.col("na") == F.col("nb"))).otherwise(F.col("va").eqNullSafe(F.col("vb")))
    both = x.join(y, keys, "full_outer")
    changed = both.where(F.col("ta").isNull() | F.col("tb").isNull() | ~same)
    changed = changed.select(*keys, F.when(F.col("ta").isNull(), "add").when(F.col("tb").isNull(), "remove").otherwise("replace").alias("op"), F.col("tb").alias("type"), F.col("vb").alias("scalar"), "n_children", F.when(F.col("tb").isNull(), -F.col("oa")).otherwise(F.col("ob")).alias("ord"))
    up = changed.where("pointer <> ''").select("doc_id", F.col("pointer").alias("below"), F.explode(above(F.col("pointer"), own=False)).alias("pointer"))
    under = up.join(changed.select(*keys), keys, "left_semi").select("doc_id", F.col("below").alias("pointer")).distinct()
    top = changed.join(under, keys, "left_anti")
    whole = subtrees(b, top.where("n_children > 0").select("doc_id", F.col("pointer").alias("root"))).withColumnRenamed("root", "pointer")
    empty = F.when(F.col("type") == "object", "{}").when(F.col("type") == "array", "[]")
    return top.join(whole, keys, "left").select("doc_id", "op", F.col("pointer").alias("path"), F.coalesce("json", "scalar", empty).alias("value"), "ord")


def merge_trees(target: DataFrame, patch_: DataFrame) -> DataFrame:
    """The nodes (without depth, num and n_children; ord long) of target after merge patches, by doc_id; `rebuild` makes documents of them.

    Outside arrays a patch's nulls delete, its scalars and arrays replace, its objects merge with
    objects and replace all else. So target keeps the nodes that have none of the patch's cuts at or
    above them, and gets the patch's other nodes; two anti-joins and a union. A replaced member
    keeps its place, new ones come last. A document without patch stays; a patch without document
    makes one.
    """
    columns = ["doc_id", "pointer", "parent", "key", "idx", "type", "str", "num_literal", "bool"]
    t, p = (x.where("pointer is not null") for x in (target, patch_))
    arrays = p.where("type = 'array'").select("doc_id", F.col("pointer").alias("up"))
    inside = p.where("depth > 0").select("doc_id", "pointer", F.explode(above(F.col("pointer"), own=False)).alias("up")).join(arrays, ["doc_id", "up"], "left_semi").select("doc_id", "pointer").distinct()
    plain = p.join(inside, ["doc_id", "pointer"], "left_anti")
    old = t.select("doc_id", "pointer", F.col("type").alias("old"), F.col("ord").alias("place"))
    met = plain.join(old, ["doc_id", "pointer"], "left")
    cuts = met.where("type <> 'object' or old is not null and old <> 'object'").select("doc_id", F.col("pointer").alias("up"), "place")
    gone = t.select("doc_id", "pointer", F.explode(above(F.col("pointer"))).alias("up")).join(cuts.select("doc_id", "up"), ["doc_id", "up"], "left_semi").select("doc_id", "pointer").distinct()
    stays = t.join(gone, ["doc_id", "pointer"], "left_anti").select(*columns, F.shiftleft(F.col("ord").cast("long"), 31).alias("ord"))
    # New nodes stand where the old member was, else behind all.
    new = plain.where("type <> 'null' or pointer = ''").unionByName(p.join(inside, ["doc_id", "pointer"], "left_semi"))
    new = new.join(old.where("old = 'object'").select("doc_id", "pointer").join(gone, ["doc_id", "pointer"], "left_anti").withColumn("both", F.lit(True)), ["doc_id", "pointer"], "left").where("not (type = 'object' and coalesce(both, false))").drop("both")
    places = cuts.where("place is not null")
    new = new.withColumn("up", F.explode(above(F.col("pointer")))).join(places, ["doc_id", "up"], "left").groupBy(*columns, F.col("ord").alias("own")).agg(F.min("place").alias("place"))
    last = F.lit((1 << 31) - 1).cast("long")
    return stays.unionByName(new.select(*columns, (F.shiftleft(F.coalesce(F.col("place").cast("long"), last), 31) + F.col("own") + 1).alias("ord")))


def merge_nodes(target: DataFrame, patch_: DataFrame) -> DataFrame:
    """(doc_id, key, value) of the members of objects after a merge patch; value is JSON for scalars, null for containers."""
    return merge_trees(target, patch_).where("parent = ''").select("doc_id", "key", text_of().alias("value"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with 1, 2, 3 ... in the order of columns: a range partitioning and prefix sums of its counts."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    counts = {r[0]: r[1] for r in dealt.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()}
    before, table = 0, []
    for part in sorted(counts):
        table.append((part, before))
        before += counts[part]
    bases = rows.sparkSession.createDataFrame(table, "_part long, _base long")
    out = dealt.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(bases), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_base", "_at")


def bulk_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(status, n): changed, unchanged and failed documents of a bulk edit."""
    both = before.select("doc_id", F.xxhash64("json").alias("h0")).join(after.select("doc_id", F.xxhash64("json").alias("h1"), "error"), "doc_id")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
