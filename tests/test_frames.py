"""Node plans over random documents, against the operations on single values."""

import random

from treeloom import pointer as P
from treeloom.operators import frames
from treeloom.values import parse_json, same_data, to_json


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 4:
        return rng.choice([None, True, 1, 2.5, "x", "", "a/b~"])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: value(rng, depth + 1) for k in rng.sample(["a", "b", "c", "d/e", "~", "0"], rng.randrange(5))}


def pairs(n, seed):
    rng = random.Random(seed)
    return [(i, value(rng), value(rng)) for i in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, to_json(v)) for i, v in rows], "doc_id long, json string")


def test_differences_lead_from_one_to_the_other(spark):
    rows = pairs(300, 1) + [(300, [1, 2, 3, 4], [1]), (301, {"a": [1]}, {"a": [1, {"b": []}, 3]}), (302, 5, 5)]
    out = {i: [] for i, _, _ in rows}
    for r in frames.diff(frames.nodes(docs(spark, [(i, a) for i, a, _ in rows])), frames.nodes(docs(spark, [(i, b) for i, _, b in rows]))).orderBy("doc_id", "ord").collect():
        out[r.doc_id].append({"op": r.op, "path": r.path} | ({"value": parse_json(r.value)} if r.op != "remove" else {}))
    for i, a, b in rows:
        assert same_data(P.apply_patch(a, out[i]), b), (a, b, out[i])
    assert out[302] == []


def test_merge_of_nested_documents(spark):
    rows = [*pairs(300, 2), (300, {"a": 1}, {}), (301, [1], {"a": None}), (302, {"a": {"b": 1}, "c": 2}, {"a": {"b": None, "d": {"e": None}}})]
    t = docs(spark, [(i, a) for i, a, _ in rows] + [(400, {"k": 1})])
    p = docs(spark, [(i, b) for i, _, b in rows] + [(401, {"k": {"n": None, "m": [None]}})])
    out = {r.doc_id: r.json for r in frames.rebuild(frames.merge_trees(frames.nodes(t), frames.nodes(p))).collect()}
    assert {i: out[i] for i, _, _ in rows} == {i: to_json(P.merge(a, b)) for i, a, b in rows}
    assert (out[400], out[401]) == ('{"k":1}', '{"k":{"m":[null]}}')


def test_values_are_whole(spark):
    rows = [(i, a) for i, a, _ in pairs(200, 3)] + [(200, {"a": {"b": [1, {}]}})]
    n = frames.nodes(docs(spark, rows))
    assert {r.doc_id: r.value for r in frames.get(n, "").collect()} == {i: to_json(v) for i, v in rows}
    found = {(r.doc_id, r.key if r.key is not None else r.idx): r.value for r in frames.values(n, "/a").collect()}
    assert found == {(i, k): to_json(x) for i, v in rows if isinstance(v, dict) and isinstance(v.get("a"), (dict, list)) for k, x in (v["a"].items() if isinstance(v["a"], dict) else enumerate(v["a"]))}


def test_nodes_that_are_asked_for(spark):
    d = docs(spark, [(i, a) for i, a, _ in pairs(100, 4)])
    whole = {tuple(r) for r in frames.nodes(d).collect()}
    assert {tuple(r) for r in frames.nodes(d, pointers=["/a", ""], parents=["/b"], keys=["c"]).collect()} == {r for r in whole if r[1] in ("/a", "") or r[2] == "/b" or r[3] == "c"}


def test_malformed_documents(spark):
    d = spark.createDataFrame([(1, "{"), (2, None), (3, "[1" + "0" * 400 + "]")], "doc_id long, json string")
    n = frames.nodes(d)
    assert [r.doc_id for r in frames.errors(n).collect()] == [1] and [(r.doc_id, r.pointer) for r in frames.paths(n).orderBy("pointer").collect()] == [(3, ""), (3, "/0")]
    assert [r.num for r in n.where("pointer = '/0'").collect()] == [float("inf")] and [r.doc_id for r in frames.rebuild(n).collect()] == [3]


def test_suggestions(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 6, 38, 39, 40, 41, 42, 43, 60])))
    keys = {word() for _ in range(60)}
    keys |= {k[:i] + k[i + 1 :] + rng.choice(["", "a"]) for k in list(keys) for i in range(0, len(k), 9)}
    asked = rng.sample(sorted(keys), 40) + ["abab", ""]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    d = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    found = {(r.missing, r["rank"]): (r.distance, r.key) for r in frames.suggestions(d(sorted(keys), "key"), d(sorted(set(asked)), "missing")).collect()}
    near = {m: sorted((distance(m, k), k) for k in keys if distance(m, k) <= 2)[:3] for m in set(asked)}
    expected = {(m, n): x for m, own in near.items() for n, x in enumerate(own, 1)}
    assert found == expected
