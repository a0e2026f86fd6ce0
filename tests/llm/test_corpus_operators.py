"""Operators over whole tables: tool calls, deduplication, joins, mixing, wrappers, language model, pipeline."""

import html
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from treeloom.llm import common, html_wrappers, mixing, ngram_join, pseudo_likelihood, stream_dedup, tool_calls

# Helpers


def hashes(text):
    return common.word_hashes(pa.array([text], pa.string()))[0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_join(spark):
    left = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(3000)], "k string, i int")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = common.hot_counts(right, "k", slots=10, least=5)
    assert [r.k for r in hot.collect()] == ["h"] and common.salted_join(left, right, "k", hot, F.col("i")).count() == 3000


# Tool calls


def test_tool_calls(spark):
    m = [
        (1, 0, "system", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", '<tool_call>{"id":"a","name":"reply","arguments":{"text":"x","turn":1.0}}</tool_call> <tool_call>{"id":"b","name":"reply","arguments":{"text":""},"after":"a"}</tool_call><tool_call>{bad}</tool_call>'),
        (1, 3, "tool", '<tool_result id="a">ok é</tool_result><tool_result id="z">?</tool_result>'), (1, 4, "assistant", '<tool_call>{"id":"a","name":"nope","after":"a"}</tool_call>'),
        (2, 0, "assistant", "".join(f'<tool_call>{{"id":"{a}","name":"t","after":"{b}"}}</tool_call>' for a, b in ("xy", "yx", "wy"))), (None, None, None, None), (3, 0, "user", None),
    ] + [(9, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(40)]
    d = spark.createDataFrame(m, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash"))
    out = {(r.conv_id, r.id, r.status): r for r in tool_calls.linked_calls(d).collect()}
    assert {k[1:] for k in out if k[0] == 1} == {("#0", "message"), ("turn 1", "unanswered"), ("?2.2", "malformed"), ("a", "linked"), ("a", "duplicate"), ("b", "invalid"), ("z", "orphan")}
    assert (out[1, "a", "duplicate"].turn, out[1, "a", "duplicate"].message) == (4, '{"arguments":{},"errors":[": unknown tool"],"id":"a","name":"nope","status":"duplicate"}') and out[None, "#None", "message"].message == '{"id":"#None","role":null,"status":"message","text":""}'
    assert out[1, "a", "linked"].message == '{"arguments":{"text":"x","turn":1},"id":"a","name":"reply","result":"ok é","status":"linked"}' and out[1, "b", "invalid"].depth == 1 and out[1, "b", "invalid"].n_errors == 2
    assert {k[1:] for k in out if k[0] == 2} == {("x", "cycle"), ("y", "cycle"), ("w", "cycle")} and out[3, "turn 0", "invalid"].n_errors == 1
    assert [out[9, f"turn {t}", "linked"].depth for t in range(0, 40, 2)] == list(range(20))
    assert tool_calls.linked_calls(d.limit(0)).count() == 0


def test_canonical_json():
    assert tool_calls.canonical({"b": [1.0, 0.5, float("nan")], "a": {"é": None}}) == '{"a":{"é":null},"b":[1,0.5,null]}'
    assert tool_calls.errors_of({"a": 1, "c": [1]}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "string"}, "c": {"items": {"minimum": 2}}}}) == ["/b: required", "/a: type", "/c/0: range"]


def test_messages_keep_all():
    parts = lambda text: [p[:2] + p[4:5] for p in tool_calls.parts_of(1, "assistant", text)]
    assert parts('a <tool_call>{"id":1,"name":"n"}</tool_call> b <tool_result id="x">c</tool_result>') == [("call", "1", "{}"), ("result", "x", "c"), ("text", "#1.0", "a"), ("text", "#1.1", "b")]
    whole = "9" * 5000
    assert parts('<tool_call>{"id":"\\ud800","name":"n","arguments":[%s,"\\udfff"]}</tool_call>' % whole) == [("call", "\\ud800", f'[{whole},"\\udfff"]')]
    assert tool_calls.errors_of(int(whole[:4000]), {"type": "integer"}) == [] and parts("<tool_call>%s</tool_call>" % ("[" * 500 + "]" * 500))[0][0] == "malformed"
    assert tool_calls.parts_of(None, "user", "x") == [("message", "#None", 0, None, "x", None)] and parts("<tool_call>[]</tool_call>")[0][0] == "malformed"


def brute_calls(messages):
    late = 1 << 62
    parts = [(conv, turn, role, *p) for conv, turn, role, text in messages for p in tool_calls.parts_of(turn, role, text)]
    time = lambda p: late if p[1] is None else p[1]
    calls, results, out = defaultdict(list), defaultdict(list), []
    for p in parts:
        if p[3] == "call":
            calls[p[0], p[4]].append(p)
        elif p[3] == "result":
            results[p[0], p[4]].append(p)
        else:
            out.append((p[0], p[1], p[4], None, None, p[3], {"id": p[4], "text": p[7]} | ({"role": p[2]} if p[3] != "malformed" else {})))
    first = {k: min(v, key=lambda p: (time(p), p[5], p[6], p[7], p[8] is not None, p[8] or "")) for k, v in calls.items()}

    def depth(k, seen=()):
        if k in seen:
            return None
        up = (k[0], first[k][8])
        if first[k][8] is None or up not in first:
            return 0
        above = depth(up, (*seen, k))
        return None if above is None else above + 1

    places = defaultdict(list)
    for k, p in first.items():
        if (d := depth(k)) is not None:
            places[k[0]].append((d, time(p), p[5], k[1]))
    for k, v in calls.items():
        for n, p in enumerate(sorted(v, key=lambda p: p is not first[k])):
            found = [e for e in [tool_calls.errors_of(tool_calls.parsed(p[7]), tool_calls.SCHEMAS[p[6]]) if p[6] in tool_calls.SCHEMAS else [": unknown tool"]] if e]
            record = {"id": p[4], "name": p[6], "arguments": tool_calls.parsed(p[7])} | ({"errors": found[0]} if found else {})
            d, at, status = None, None, "duplicate"
            if n == 0:
                d = depth(k)
                at = None if d is None else sorted(places[k[0]]).index((d, time(p), p[5], k[1]))
                fits = sorted([r for r in results[k] if time(r) >= time(p)], key=lambda r: (time(r), r[5], r[7]))
                if fits:
                    record["result"] = fits[0][7]
                status = "cycle" if d is None else "invalid" if found else "linked" if fits else "unanswered"
                for r in results[k]:
                    if not fits or r is not fits[0]:
                        out.append((r[0], r[1], r[4], None, None, "repeated" if r in fits else "early", {"id": r[4], "text": r[7]}))
            out.append((p[0], p[1], p[4], d, at, status, record))
    out += [(r[0], r[1], r[4], None, None, "orphan", {"id": r[4], "text": r[7]}) for k, v in results.items() if k not in calls for r in v]
    return Counter((*o[:6], len(o[6].get("errors", [])), tool_calls.canonical(o[6] | {"status": o[5]})) for o in out)


def test_explicit_calls_brute(spark):
    rng = random.Random(3)
    made = []
    for conv in [1, 2, 3, None]:
        for turn in [*range(25), None]:
            text = ""
            for _ in range(rng.randrange(4)):
                i = rng.choice("abcdefghijklmnop")
                after = f',"after":"{rng.choice("abcdefghijklmnopqr")}"' if rng.random() < 0.7 else ""
                arguments = rng.choice(['{"text":"x","turn":1}', "{}", '{"text":"","turn":-1}'])
                text += rng.choice([f'<tool_call>{{"id":"{i}","name":"{rng.choice(["reply", "other"])}","arguments":{arguments}{after}}}</tool_call>', f'<tool_result id="{i}">r{rng.randrange(9)}</tool_result>', " words ", "<tool_call>{</tool_call>"])
            made.append((conv, turn, rng.choice(["user", "assistant", "tool", "system", None]), text or rng.choice(["", "plain", None])))
    made += [made[5]]
    d = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, tool_calls.linked_calls(d).collect())) == brute_calls(made)


def test_tool_calls_brute(spark):
    c = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    have = {(r.conv_id, r.turn): r for r in c}
    found = {(r.conv_id, r.turn): r for r in tool_calls.linked_calls(spark.read.parquet(f"{SMALL}/conversations.parquet")).collect() if r.status not in ("orphan", "message")}
    users = {k for k, r in have.items() if r.role == "user"}
    assert set(found) == users
    for conv, turn in users:
        answer = have.get((conv, turn + 1))
        depth, t = 0, turn
        while (conv, t - 2) in users:
            depth, t = depth + 1, t - 2
        assert (found[conv, turn].status, found[conv, turn].depth) == ("linked" if answer is not None and answer.role == "assistant" else "unanswered", depth)


# Exact deduplication


def brute_groups(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    return by


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1), lambda t: F.lit("one")])
def test_exact_copies(spark, digest):
    rows = [(1, None), (2, "a  b"), (3, ""), (4, "a b"), (5, "a\nb"), (6, "u"), (7, "A b"), (8, " "), (9, "\x85")] + [(100 + i, f"t{i % 7}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("row", F.lit(1))
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in stream_dedup.marked(d, digest).collect()}
    assert found == {x: (min(ids), len(ids), x == min(ids)) for ids in brute_groups(rows).values() for x in ids}


def test_copies_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(2, "a", "x"), (2, "a", "y"), (None, "u", "p"), (None, "u", "q"), (5, "u", None), (None, "n", "r")], "doc_id long, text string, row string")
    assert sorted((r.keep_id if r.keep_id is not None else -1, r.group_size) for r in stream_dedup.marked(d).collect() if r.kept) == [(-1, 1), (2, 2), (5, 3)]
    assert sorted((str(r.doc_id), r.text) for r in stream_dedup.deduplicated(d).collect()) == [("2", "a"), ("5", "u"), ("None", "n")]
    assert stream_dedup.marked(d.limit(0)).count() == 0 == stream_dedup.deduplicated(d.limit(0)).count()


def test_the_stream_goes_on(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", stream_dedup.ROCKSDB)
    schema = "row long, doc_id long, digest string, locator string"
    for n, rows in enumerate([[(0, 5, "d", "f#1"), (1, 7, "e", "f#1")], [(0, 3, "d", "f#2")]]):
        session.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{n}")
        stream_dedup.watch(session.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    assert sorted(map(tuple, stream_dedup.state_of(spark, f"file://{tmp_path}/out").select("digest", "id", "locator", "n").collect())) == [("d", 3, "f#2", 2), ("e", 7, "f#1", 1)]


# N-gram Jaccard join


def brute_links(docs):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root, lists, both = {d: d for d in sets}, defaultdict(list), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for g in s:
            lists[g].append(d)
    for ids in lists.values():
        both.update(itertools.combinations(sorted(ids), 2))
    for (a, b), k in both.items():
        if 100 * k >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_divide_skip():
    rng = random.Random(5)
    for _ in range(1500):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(rng.randrange(1, 12))]
        need, counts = rng.randrange(1, 8), Counter(x for one in lists for x in one)
        assert sorted(ngram_join.divide_skip(lists, need)) == sorted((k, v) for k, v in counts.items() if v >= need)


@pytest.mark.parametrize("tiny", [False, True])
def test_near_copies(spark, tiny, monkeypatch):
    if tiny:  # many cells are large, many blocks, few postings at a time
        for name, value in (("PIVOT_CELL", 8), ("PIVOTS", 2), ("LEAST_BLOCK", 3000), ("MOST_BLOCK", 4000), ("BLOCK_POSTINGS", 2000)):
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.randrange(1, 120)) for _ in range(30)]
    passage = rng.choices(words, k=60)
    docs = []
    for i in range(500):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + max(1, len(w) // 15))):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [rng.choice(words).upper()] * rng.randrange(2) or w[k : k + 1]
        docs.append((i, rng.choice(" \n").join(w + passage * (rng.random() < 0.15))))
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "few words"), (5004, "Few Words")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == brute_links(docs)


def test_near_copies_of_the_table(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(d).collect()} == brute_links([tuple(r) for r in d.collect()])


def test_near_copies_odd(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "zz"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string").withColumn("tag", F.lit("clash")).withColumn("n", F.lit(0))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.joined(d).collect()) == [("3", 2, "3"), ("3", 2, "3"), ("4", 2, "3"), ("None", 1, "None"), ("None", 2, "3")]
    assert sorted(str(r.doc_id) for r in ngram_join.without_near_duplicates(d.where("doc_id is not null")).collect()) == ["3", "3"]
    assert ngram_join.joined(d.limit(0)).count() == 0 == ngram_join.without_near_duplicates(d.limit(0)).count()


# Mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (goal - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        new = {s for s in rest if 2 * sizes[s] <= weight[s] * level}
        if not new:
            return {s: min(2.0 * sizes[s], weight[s] * level) if s not in full else 2.0 * sizes[s] for s in order}
        full |= new


@pytest.mark.parametrize("small", [True, False])
def test_mixing(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)), rng.choice(["b", "a", "é", None, "big", "big"])) for i in range(600)] + [(1000, None, "a"), (1001, "", "empty"), (1, "again", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("clash"))
    out = mixing.mixed(d).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.05 * targets[s] + 40
    assert sorted(map(str, mixing.mixed(d).collect())) == sorted(map(str, out))
    mix = mixing.mixture(d)
    assert mix.columns == d.columns and mix.count() == sum(r.copies for r in out) and mixing.mixture(d.limit(0)).count() == 0 == mixing.mixed(d.limit(0)).count()


# HTML


def test_wrappers(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in pages.join(html_wrappers.extracted(pages).select("page_id", "text", "n_chars"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(("page", "text"), [
    ('<html><body><div id="header"><h1>Site</h1></div><div class="menu"><a href=x>a</a></div><div class="content"><h2>Title &amp; x</h2><p>One <b>two</b>&nbsp;three<p>four<ul><li>x<li>y</ul><form><label>Name</label></form><div class="cookie-notice">c</div><section id=comments><p>hi</p></section><aside>s</aside></div><script>if(a<b)</script><footer>f', "Title & x\n\nOne two three\n\nfour\n\nx\n\ny"),
    ('<article><header><h1>T</h1></header><p>a < b & c &lt;p&gt;</p>tail<div class="article-comments">no</div></article>', "T\n\na < b & c <p>\n\ntail"), ("", ""), ("plain", "plain"), ("<main><p>x<!-- <p>y -->z<p hidden>h</main>", "xz"), ("<p>a<br>b", "a b"), ('<body><ul><li><a href=x>m</a><li><a href=y>n</a></ul><div><p>see <a href=z>this</a> text here, long enough</p></div>', "see this text here, long enough"),
])
def test_pages(page, text):
    assert html_wrappers.extract(page, html_wrappers.content_paths(html_wrappers.page_wrapper(page), 1)) == text


def test_alignment():
    a, b = html_wrappers.page_wrapper("<ul><li>x<li>y</ul><p>same"), html_wrappers.page_wrapper("<ul><li>z</ul><h2>q</h2><p>same")
    assert html_wrappers.expression(html_wrappers.merged(a, b)) == "<ul>(<li>#TEXT</li>)+</ul>(<h2>#SAME</h2>)?<p>#SAME</p>"


def test_alignment_of_long_lists():
    rng = random.Random(5)
    kinds = [["e", f"div.k{i}", [], False, False] for i in range(600)]
    a, b = ([x for x in kinds if rng.random() < 0.7] for _ in range(2))
    pairs = html_wrappers._pairs(a, b)
    assert all(a[i][1] == b[j][1] for i, j in pairs) and pairs == sorted(pairs) and {a[i][1] for i, _ in pairs} == {x[1] for x in a} & {x[1] for x in b}
    a, b = ([["e", rng.choice("xyz"), [], False, False] for _ in range(300)] for _ in range(2))
    pairs = html_wrappers._pairs(a, b)
    assert all(a[i][1] == b[j][1] for i, j in pairs) and all(p < q and r < t for (p, r), (q, t) in itertools.pairwise(pairs)) and len(pairs) > 50
    wide = "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}><p>t{i}</p></div>" for i in range(5000))
    both = html_wrappers.merged(html_wrappers.page_wrapper(wide), html_wrappers.page_wrapper(wide[3000:]))
    assert html_wrappers.extract(wide, html_wrappers.content_paths(both, 2)).count("t") == 5000
    assert html_wrappers.extract("<b>" * 30_000 + "x" + "</i>" * 30_000, html_wrappers.content_paths(html_wrappers.page_wrapper("<b>" * 30_000 + "x"), 1)) == "x"


def _page(i, extra=""):
    return f'<div class="top"><a href=/>Home</a></div><article><h1>Same title</h1><p>text {i}</p><div class="share-links">{"<a href=x>Share</a>" * 2} it</div><div>Follow us</div>{extra}<p class="related work">of {i}</p><p id="share-price">at {i}</p><ul><li><a href=a>source {i}</a><li><a href=b>another {i}</a></ul></article><div id="comments"><p>nice {i}</p></div>'


@pytest.mark.parametrize("small", [True, False])
def test_slots_decide(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(html_wrappers, "MOST_WRAPPERS", 0)
    rest = lambda i: [f"of {i}", f"at {i}", f"source {i}", f"another {i}"]
    rows = [(i, f"http://many.b/{i}", _page(i)) for i in range(40)] + [(100 + i, f"http://few.b/{i}", _page(i)) for i in range(2)] + [(200 + i, f"http://copies.b/{i}", _page(7)) for i in range(12)]
    rows += [(300, "\u00a0http://odd.b/1", "<p>x"), (301, "http://ODD.b", "<p>y"), (302, "http://eight.b", "<p>again</p>" * 8), (303, "http://long.b/1", "<article><p>a</p></article>"), (304, "http://long.b/2", "<div class=post><p>old</div>")]
    rows += [(400 + i, f"http://plain.b/{i}", f"<div><p>word {i}</p></div><div><span>{'Always the same words. ' * 20}</span></div>") for i in range(7)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {i: ["Same title", f"text {i}", *rest(i)] for i in range(40)} | {100 + i: ["Same title", f"text {i}", "Follow us", *rest(i)] for i in range(2)} | {200 + i: ["Same title", "text 7", "Follow us", *rest(7)] for i in range(12)}
    expected |= {300: ["x"], 301: ["y"], 302: ["again"] * 8, 303: ["a"], 304: ["old"]} | {400 + i: [f"word {i}"] for i in range(7)}
    for n in (1, 5):  # whatever the order and partitions of the rows
        out = html_wrappers.extracted(d.orderBy(F.rand(n)).repartition(n)).collect()
        assert {r.page_id: r.text.split("\n\n") for r in out} == expected and len(out) == len(rows)


@pytest.mark.parametrize("small", [True, False])
def test_pages_odd(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(html_wrappers, "MOST_WRAPPERS", 0)
    d = spark.createDataFrame([(1, "http://a.b/x", "<article>t</article>"), (2, None, None), (2, "http://A.b:80/", "<article>é&#233;</article>"), (None, "", "<p>q")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_wrappers.extracted(d).collect()) == [("1", "t", 1), ("2", "", 0), ("2", "éé", 2), ("None", "q", 1)]
    assert html_wrappers.extracted(d.limit(0)).count() == 0


# Language model


def test_gradients():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in pseudo_likelihood.start().items()}
    ids = rng.integers(0, pseudo_likelihood.VOCABULARY, 40)
    around = pseudo_likelihood.contexts(ids)
    g = pseudo_likelihood.gradients(net, around, ids)
    mean = lambda: pseudo_likelihood.forward(net, around, ids)[0].mean()
    for name, shape in pseudo_likelihood.SHAPES.items():
        at = tuple(int(rng.integers(0, s)) for s in shape)
        at = (int(around[3, 1]), at[1]) if name == "embed" else (int(ids[5]) // pseudo_likelihood.CLASSES, *at[1:]) if name.startswith("word") else at
        old, step = net[name][at], 1e-4
        net[name][at] = old + step
        up = mean()
        net[name][at] = old - step
        down = mean()
        net[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], abs=2e-3)


def test_scores_are_probabilities():
    net = pseudo_likelihood.start()
    around = np.array([[3, 7, 900, 1024]] * pseudo_likelihood.VOCABULARY)
    assert np.exp(pseudo_likelihood.forward(net, around, np.arange(pseudo_likelihood.VOCABULARY))[0]).sum() == pytest.approx(1, abs=1e-3)


def test_language_model(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["red green blue", "one two three", "north south west"]) for _ in range(120))
    d = spark.createDataFrame([(i, text()) for i in range(3000)] + [(900, None), (901, ""), (902, "red")], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    words = pseudo_likelihood.frequent(d)
    network = pseudo_likelihood.trained(d, words)
    held_out = [text() for _ in range(10)]
    mixed_up = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held_out]
    means = {r.doc_id: r.mean for r in pseudo_likelihood.scores(spark.createDataFrame([(i, t) for i, t in enumerate(held_out + mixed_up)], "doc_id long, text string"), words, network).collect()}
    assert max(means[i] for i in range(10, 20)) < min(means[i] for i in range(10)) and np.mean([means[i] for i in range(10)]) > -np.log(9)
    out = {r.doc_id: r for r in pseudo_likelihood.scored(d).collect()}
    assert (out[900].n_words, out[900].log_likelihood, out[900].mean) == (0, 0.0, None) and out[902].n_words == 1 and pseudo_likelihood.scored(d.limit(0)).count() == 0
    net, ids = pseudo_likelihood.unpacked(network), pseudo_likelihood.numbered(hashes(held_out[0]), words)
    assert means[0] == pytest.approx(pseudo_likelihood.forward(net, pseudo_likelihood.contexts(ids), ids)[0].mean(), abs=1e-3)


def test_rare_words_have_their_own_probability(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "BLOCK", 500)
    rng = random.Random(9)
    frequent = [f"f{i}" for i in range(pseudo_likelihood.OWN)] * 9
    rare = {f"r{i}": 1 + i % 5 for i in range(300)}
    rng.shuffle(frequent)
    texts = [" ".join(frequent[at : at + 100]) for at in range(0, len(frequent), 100)] + [w for w, n in rare.items() for _ in range(n)] + [None]
    rows = [(None if i == 7 else i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    words = pseudo_likelihood.frequent(d)
    net = pseudo_likelihood.start()
    out = pseudo_likelihood.scores(d, words, pseudo_likelihood.packed(net)).collect()
    assert len(out) == len(texts) and sum(r.n_words for r in out) == len(frequent) + sum(rare.values()) and sum(r.doc_id is None for r in out) == 1
    found = {r.doc_id: r.log_likelihood for r in out}
    number = {w: int(pseudo_likelihood.numbered(hashes(w), words)[0]) for w in rare}
    assert min(number.values()) >= pseudo_likelihood.OWN
    together = Counter()
    for w, n in rare.items():
        together[number[w]] += n
    of_word = {}
    for i, t in rows:
        if t in rare:
            ids = np.array([number[t]])
            of_number = pseudo_likelihood.forward(net, pseudo_likelihood.contexts(ids), ids)[0][0]
            assert found[i] == pytest.approx(of_number + np.log(rare[t] / together[number[t]]), abs=2e-3)
            of_word[t] = np.exp(found[i] - of_number)
    for k, n in together.items():
        assert sum(p for w, p in of_word.items() if number[w] == k) == pytest.approx(1, abs=0.02)


def test_scores_brute(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "BLOCK", 300)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(pseudo_likelihood.OWN + 300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(40)) + rng.choices(vocabulary[:30], k=20)) for _ in range(60)] + ["Once only\tÉ once", None, "", vocabulary[0]]
    texts += [texts[3].upper(), texts[3]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pseudo_likelihood.scored(d).collect()}
    frequent = pseudo_likelihood.frequent(d)
    net = {k: v.astype(float) for k, v in pseudo_likelihood.unpacked(pseudo_likelihood.trained(d, frequent)).items()}
    words = [re.findall(r"[^ \t]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) for t in texts]
    counts = Counter(w for t in words for w in t)
    number = {w: int(pseudo_likelihood.numbered(hashes(w), frequent)[0]) for w in counts}
    ranks = sorted(counts.values(), reverse=True)
    assert all(counts[w] >= ranks[min(pseudo_likelihood.OWN, len(ranks)) - 1] for w in counts if number[w] < pseudo_likelihood.OWN)
    together = Counter()
    for w, n in counts.items():
        together[number[w]] += n
    softmax = lambda x, k: x[k] - np.log(np.exp(x).sum())
    for i, t in enumerate(words):
        ids = [pseudo_likelihood.BORDER] * 2 + [number[w] for w in t] + [pseudo_likelihood.BORDER] * 2
        total = 0.0
        for k, w in enumerate(t):
            hidden = np.tanh(net["bias"] + sum(net["embed"][ids[k + 2 + p]] * net["scale"][j] for j, p in enumerate(pseudo_likelihood.PLACES)))
            c, own = divmod(number[w], pseudo_likelihood.CLASSES)
            total += softmax(hidden @ net["class"] + net["class_bias"], c) + softmax(hidden @ net["word"][c] + net["word_bias"][c], own) + np.log(counts[w] / together[number[w]] if number[w] >= pseudo_likelihood.OWN else 1)
        assert out[i].log_likelihood == pytest.approx(total, abs=0.01) and out[i].n_words == len(t) and out[i].mean == (pytest.approx(total / len(t), abs=0.01) if t else None)
        assert out[i].n_unseen == sum(counts[w] == n and n for w, n in Counter(t).items())


def test_every_word_is_trained_on(spark):
    texts = ["a b c d e f g h i j k", "l", "", "m n o", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    words = pseudo_likelihood.frequent(d)
    start = pseudo_likelihood.start()
    ids = [pseudo_likelihood.numbered(hashes(t), words) for t in texts]
    memory = {name: np.full(shape, 1e-6, np.float32) for name, shape in pseudo_likelihood.SHAPES.items()}
    pseudo_likelihood.step(start, memory, np.concatenate([pseudo_likelihood.contexts(x) for x in ids if len(x)]), np.concatenate(ids))
    assert pseudo_likelihood.trained(d, words) == pytest.approx(pseudo_likelihood.packed(start), abs=1e-5)


def test_near_copies_without_ids_or_with_one_id(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, "lone one two three four five"), (None, "another six seven eight nine ten"), (7, text), (7, text + " 1"), (None, text.upper()), (8, None), (None, "  "), (None, "P Q R S T U"), (None, "p q r s t u")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), str(r.text).lower()) for r in ngram_join.without_near_duplicates(d).collect())
    assert [k for k in kept if text not in k[1]] == sorted([("None", "lone one two three four five"), ("None", "another six seven eight nine ten"), ("8", "none"), ("None", "  "), ("None", "p q r s t u")])
    assert [k[0] for k in kept if text in k[1]] == ["7"]


@pytest.mark.parametrize("small", [True, False])
def test_two_templates_on_a_host(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(html_wrappers, "MOST_WRAPPERS", 0)
    d = spark.createDataFrame([(1, "http://a.b/1", "<article><p>new</article><p>tail"), (2, "http://a.b/2", '<div class="post"><p>old one</div>'), (3, None, "<article>x</article>"), (4, None, "<p>q"), (5, "http://a.b/3", "<article></article><p>beside")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_wrappers.extracted(d).collect()} == {1: "new", 2: "old one", 3: "x", 4: "q", 5: "beside"}
