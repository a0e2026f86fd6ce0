"""HTML extraction by inferred wrappers: union-free regular expressions (operator 7).

A page's tags become a tree of elements and text slots. Within a page, and between the pages of a
host, token streams are aligned again and again: an element or text that one side lacks becomes
optional, neighbours of equal shape become one repeated group, texts that differ become slots.
There are no alternatives, so the wrapper of a host is one expression that covers all its pages.
Each slot of a wrapper keeps what its pages have there: how many pages, a bit field of their
hashes (so that copies of a page count once), characters, characters in links, and the least and
largest hash of the texts, equal while the text is the same everywhere.

The wrapper then decides by slots, in this order:
1. Never text: below menus, headers, footers, asides, forms, scripts and the like, hidden elements,
   and containers whose class or id consists of words for adverts, comments, consent or navigation.
2. Template: the same text on at least LEAST_PAGES unlike pages and half of the pages of the host,
   but for headings.
3. A container whose class or id says that it is about sharing, related pages and the like goes where
   the wrapper agrees: most of its characters are links or its text is a template, or it is not in
   an article. Words on paragraphs, headings, items and inline elements count for nothing.
4. Outside article and main also repeated groups, other than paragraphs, most of which are links.
A page gives the slots below its article or main; if it has no text there, the others in the body.
All that decides are sums, minima and unions over pages, which no order of rows changes.

Scale: each task folds its own pages into one wrapper for each host it meets, so that a host with
a third of all pages is one small row from each task; wrappers merge in two steps, over salts and
then by host. Alignment is quadratic for short lists of siblings, else by anchors; of more than
MOST_SIBLINGS those of one kind become one group, so a wrapper grows with the distinct paths of a
host, not with its pages. Elements deeper than MOST_DEPTH count as their ancestor there, unless rule 1
drops them. Decisions return to the pages by broadcast if they are at most MOST_WRAPPERS and
MOST_BYTES, else by a join salted for frequent hosts.

Edge cases: null or empty html gives an empty text. A page without url belongs to the host "".
Truncated pages and unclosed tags are read as browsers do, roughly: a block ends an open
paragraph, an end tag closes what is open inside. Repeated page_ids each give their row. Very long
pages are read whole. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import hot_counts, rows_of, salted_join, written

MOST_WRAPPERS, MOST_BYTES = 4096, 8 << 20
MOST_SIBLINGS, MOST_DEPTH = 256, 100
LEAST_PAGES = 3
SALTS = 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = ("script", "style", "textarea", "title", "noscript", "xmp", "iframe")
_RAW_END = {name: re.compile(f"</{name}[^>]*>", re.I) for name in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul title".split())
#: What a start tag ends when it is open inside the nearest of the second.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("html body article section main div td th table ul ol li aside nav header footer form blockquote button".split())
_DROPPED = frozenset("head title nav footer aside form script style noscript template button select textarea iframe svg menu dialog object canvas audio video xmp input label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id that say what a container is for, whatever it holds; and those that need the wrapper's consent.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertisements adsense adsbygoogle sponsor sponsored sponsors".split())
_SURE = _ADVERTS | frozenset("comment comments commentlist disqus respond replies cookie cookies consent gdpr nav navbar navigation sidenav menu breadcrumb breadcrumbs sidebar footer pagination pager popup modal overlay newsletter subscribe subscription skip masthead topbar notice notices notification notifications alert alerts promo promos promoted promotion".split())
_LIKELY = frozenset("banner signup login share sharing social related recommended widget widgets toolbar rail".split())
#: Words beside them that change nothing.
_NEUTRAL = frozenset("area article bar block body bottom box button buttons container content entry form global header inner item items js left link links list main message outer page panel post primary right row secondary section site text top view wrap wrapper".split())
_CONTAINERS = frozenset("div section aside ul ol dl table details article nav header footer figure center fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = _HEADINGS | frozenset("p blockquote pre".split())
_OUTER_MARKS = frozenset("header head masthead".split())
_PARTS = re.compile(r"[^a-z]+")


def _key(name: str, attributes: str) -> str:
    """An element's name with what of its attributes says which part of a page it is."""
    if not attributes.strip():
        return name
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    tokens = {"-".join(x for x in _PARTS.split(re.sub("(?<=[a-z])(?=[A-Z])", "-", w).lower()) if x) for a in ("class", "id") for w in found.get(a, "").split()} - {""}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    role = found.get("role", "").lower()
    return name + (f"@{role}" if role else "") + (f".{'.'.join(sorted(tokens))}" if tokens else "") + ("!" if hidden else "")


def _element(key: str) -> str:
    return key.rstrip("!").partition(".")[0].partition("@")[0]


def _says(tokens: list[str], words: frozenset[str]) -> bool:
    """Whether a class or id consists of such words, beside neutral ones."""
    return any(any(w in words for w in parts) and all(w in words or w in _NEUTRAL for w in parts) for parts in (t.split("-") for t in tokens))


@lru_cache(65536)
def _part(key: str) -> tuple[bool, bool, bool, bool]:
    """(dropped anywhere, dropped unless inside the main part, begins the main part, dropped where the wrapper agrees)."""
    head, _, marks = key.rstrip("!").partition(".")
    name, _, role = head.partition("@")
    tokens = marks.split(".") if marks else []
    container = name in _CONTAINERS
    dropped = key.endswith("!") or name in _DROPPED or role in _ROLES or container and _says(tokens, _SURE) or bool(tokens) and all(w in _ADVERTS for t in tokens for w in t.split("-"))
    main = name in ("article", "main") or role in ("main", "article")
    return dropped, name == "header" or container and not main and _says(tokens, _OUTER_MARKS), main and not dropped, container and not dropped and _says(tokens, _LIKELY)


def events(page: str) -> Iterator[tuple[tuple[str, ...], str, str]]:
    """(path of keys, "text" or "block", text) in page order; "block" where a block begins or ends."""
    stack: list[tuple[str, tuple[str, ...]]] = []  # names, paths
    opened: dict[str, int] = {}
    path: tuple[str, ...] = ()
    at, n = 0, len(page)

    def closed(count: int) -> tuple[str, ...]:
        for name, _ in stack[len(stack) - count :]:
            opened[name] -= 1
        del stack[len(stack) - count :]
        return stack[-1][1] if stack else ()

    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            yield path, "text", page[at:]
            break
        if found.start() > at:
            yield path, "text", page[at : found.start()]
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:  # an end tag
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None) if opened.get(name) else None
            if depth is not None and (name in _BLOCKS or name in ("td", "th") or not any(x in _SCOPE or x in _BLOCKS for x, _ in stack[depth + 1 :])):
                path = closed(len(stack) - depth)
                if name in _BLOCKS:
                    yield path, "block", ""
            elif name == "br":
                yield path, "text", " "
            elif name in ("td", "th"):
                yield path, "text", " "
            continue
        attributes = found[3] if found[2] else found[6]
        if name in _BLOCKS:  # ends an open paragraph
            for d in range(len(stack) - 1, -1, -1) if opened.get("p") else ():
                if stack[d][0] == "p":
                    path = closed(len(stack) - d)
                    break
                if stack[d][0] in _SCOPE:
                    break
            if name[0] == "h" and len(name) == 2 and name[1].isdigit() and stack and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                path = closed(1)
        if name in _ENDS and any(map(opened.get, _ENDS[name][0])):
            inner, outer = _ENDS[name]
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in inner:
                    path = closed(len(stack) - d)
                elif stack[d][0] in outer:
                    break
        if name in _BLOCKS:
            yield path, "block", ""
        if name in ("td", "th", "br"):
            yield path, "text", " "
        if name in _VOID:
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        if attributes.rstrip().endswith("/") and name not in _BLOCKS:
            continue
        key = _key(name, attributes)
        if len(path) < MOST_DEPTH or len(path) < 2 * MOST_DEPTH and _part(key)[0]:
            path = path + (key,)
        stack.append((name, path))
        opened[name] = opened.get(name, 0) + 1


# A wrapper is a list of nodes: ["e", key, children, optional, repeated] or
# ["#", pages, bits of their hashes, chars, link chars, least and largest hash of the texts, optional].


def page_wrapper(page: str) -> list:
    """The expression of one page."""
    root: list = []
    open_nodes: list[tuple[str, list]] = []
    bit = 1 << xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) % 64
    for path, kind, text in events(page):
        shared = 0
        while shared < min(len(path), len(open_nodes)) and open_nodes[shared][0] == path[shared] and kind == "text":
            shared += 1
        if kind == "block":
            shared = min(len(path), len(open_nodes))
        del open_nodes[shared:]
        for key in path[shared:]:
            node = ["e", key, [], False, False]
            (open_nodes[-1][1] if open_nodes else root).append(node)
            open_nodes.append((key, node[2]))
        if kind == "text" and (text := " ".join(entities.unescape(text).split())):
            linked = len(text) if any(k == "a" or k.startswith(("a.", "a@")) for k in path) else 0
            own = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
            (open_nodes[-1][1] if open_nodes else root).append(["#", 1, bit, len(text), linked, own, own, False])
    return collapsed(root)


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] == "#" or a[1] == b[1])


def _kind(node: list) -> str:
    return node[1] if node[0] == "e" else "#"


def _joined(a: list, b: list, again: bool = False) -> list:
    """One node that covers both; again: both are of the same pages."""
    if a[0] == "#":
        return ["#", max(a[1], b[1]) if again else a[1] + b[1], a[2] | b[2], a[3] + b[3], a[4] + b[4], min(a[5], b[5]), max(a[6], b[6]), a[7] or b[7]]
    return ["e", a[1], merged(a[2], b[2], again), a[3] or b[3], again or a[4] or b[4]]


def collapsed(nodes: list) -> list:
    """Repeated groups: neighbours, and sequences of up to four nodes that recur at once, become one."""
    out: list = []
    for node in nodes:
        if node[0] == "e":
            node = ["e", node[1], collapsed(node[2]), node[3], node[4]]
        out.append(node)
        width = 1
        while width <= min(4, len(out) // 2):
            first, second = out[-2 * width : -width], out[-width:]
            if all(map(_same, first, second)):
                del out[-2 * width :]
                out += [_joined(a, b, True) for a, b in zip(first, second, strict=True)]
                width = 1
                if len(out) < 2:
                    break
                continue
            width += 1
    if len(out) > MOST_SIBLINGS:
        groups: dict[str, list] = {}
        for node in out:
            old = groups.get(_kind(node))
            groups[_kind(node)] = node if old is None else _joined(old, node, True)
        out = list(groups.values())
        for node in out:
            node[7 if node[0] == "#" else 3] = True
    return out


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of nodes that stay in an alignment of two lists: a longest common subsequence, of long lists one through unique nodes."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and _same(a[start], b[start]):
        start += 1
    while end < min(len(a), len(b)) - start and _same(a[-1 - end], b[-1 - end]):
        end += 1
    outer = [(i, i) for i in range(start)], [(len(a) - i, len(b) - i) for i in range(end, 0, -1)]
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    inner: list[tuple[int, int]] = []
    if len(a) * len(b) <= 1 << 14:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if _same(a[i], b[j]):
                inner.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for j, node in enumerate(b):
            places.setdefault(_kind(node), []).append(j)
        seen = Counter(map(_kind, a))
        # Kinds that occur once on both sides: the longest ascending run of their places.
        once = [(i, places[_kind(x)][0]) for i, x in enumerate(a) if seen[_kind(x)] == 1 and len(places.get(_kind(x), ())) == 1]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(once):
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
            ends[k : k + 1] = [n]
            back.append(ends[k - 1] if k else -1)
        anchors: list[tuple[int, int]] = []
        n = ends[-1] if ends else -1
        while n >= 0:
            anchors.append(once[n])
            n = back[n]
        last_i = last_j = -1
        for i, j in [*reversed(anchors), (len(a), len(b))]:  # between anchors: each node's next place
            at = last_j + 1
            for k in range(last_i + 1, i):
                own = places.get(_kind(a[k]), [])
                found = bisect_left(own, at)
                if found < len(own) and own[found] < j:
                    inner.append((k, own[found]))
                    at = own[found] + 1
            if i < len(a):
                inner.append((i, j))
            last_i, last_j = i, j
    return [*outer[0], *((start + i, start + j) for i, j in inner), *outer[1]]


def merged(a: list, b: list, again: bool = False) -> list:
    """Align two expressions: what pairs stays, the rest becomes optional."""
    if len(a) == len(b) and all(map(_same, a, b)):
        return [_joined(x, y, again) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for x, y in [*_pairs(a, b), (len(a), len(b))]:
        for node in [*a[i:x], *b[j:y]]:
            node = list(node)
            node[7 if node[0] == "#" else 3] = True
            out.append(node)
        if x < len(a):
            out.append(_joined(a[x], b[y], again))
        i, j = x + 1, y + 1
    return collapsed(out)


def expression(nodes: list) -> str:
    """The wrapper as a regular expression over tokens, for people to read."""

    def one(node: list) -> str:
        if node[0] == "#":
            return ("#TEXT" if node[5] != node[6] else "#SAME") + "?" * node[7]
        body = f"<{node[1]}>{''.join(map(one, node[2]))}</{node[1].split('.')[0].split('@')[0]}>"
        mark = "*" if node[3] and node[4] else "+" if node[4] else "?" if node[3] else ""
        return f"({body}){mark}" if mark else body

    return "".join(map(one, nodes))


Paths = tuple[frozenset[tuple[str, ...]], frozenset[tuple[str, ...]]]


class _Slots:
    """What all slots of one block have together; inline elements count with the block that holds them."""

    def __init__(self) -> None:
        self.paths: set[tuple[str, ...]] = set()
        self.pages = self.bits = self.chars = self.links = 0
        self.same = True
        self.repeated = False

    def template(self, pages: int) -> bool:
        """The same text on enough unlike pages; a text that a page repeats isn't the page's frame."""
        return self.same and self.bits.bit_count() >= LEAST_PAGES and 2 * self.pages >= pages


def content_paths(wrapper: list, pages: int) -> Paths:
    """Paths of the slots that hold main text: (below article or main, elsewhere, for pages without text in the first)."""
    blocks: dict[tuple[str, ...], _Slots] = {}
    texts: dict[tuple[str, ...], list] = {}
    likely: dict[tuple[str, ...], list[int]] = {}  # links and characters of containers that may go

    def walk(nodes: list, path: tuple[str, ...], repeated: bool) -> None:
        for node in nodes:
            if node[0] == "e":
                walk(node[2], path + (node[1],), repeated or node[4])
                continue
            depth = next((n for n in range(len(path), 0, -1) if _element(path[n - 1]) in _BLOCKS), 0)
            own = blocks.setdefault(path[:depth], _Slots())
            own.paths.add(path)
            own.pages, own.bits = max(own.pages, node[1]), own.bits | node[2]
            own.chars, own.links, own.repeated = own.chars + node[3], own.links + node[4], own.repeated or repeated
            old = texts.setdefault(path, [node[5], node[6]])
            old[0], old[1] = min(old[0], node[5]), max(old[1], node[6])
            own.same &= old[0] == old[1]
            for n, key in enumerate(path):
                if _part(key)[3]:
                    sums = likely.setdefault(path[: n + 1], [0, 0])
                    sums[0], sums[1] = sums[0] + node[4], sums[1] + node[3]

    walk(wrapper, (), False)
    main: set[tuple[str, ...]] = set()
    kept: set[tuple[str, ...]] = set()
    for block, slots in blocks.items():
        if _element(block[-1]) not in _HEADINGS if block else True:
            if slots.template(pages):
                continue
        for path in slots.paths:
            inside = dropped = doubtful = False
            for n, key in enumerate(path):
                always, outside, begins, maybe = _part(key)
                if always or outside and not inside:
                    dropped = True
                    break
                inside |= begins
                if maybe:
                    links, chars = likely[path[: n + 1]]
                    dropped |= inside and 2 * links > chars
                    doubtful |= not inside
            if dropped:
                continue
            if inside:
                main.add(path)
            elif not doubtful and not (slots.repeated and 2 * slots.links > slots.chars and (not block or _element(block[-1]) not in _PARAGRAPHS)):
                kept.add(path)
    return frozenset(main), frozenset(kept)


def extract(page: str | None, paths: Paths) -> str:
    main, kept = paths
    return _text_at(page, main) or _text_at(page, kept)


def _text_at(page: str | None, paths: frozenset[tuple[str, ...]]) -> str:
    blocks: list[str] = []
    now: list[str] = []
    for path, kind, text in events(page or ""):
        if kind == "block":
            if now:
                blocks.append("".join(now))
                now = []
        elif path in paths:
            now.append(text)
        elif text == " " and now:
            now.append(text)
    blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(entities.unescape(b).split()) for b in blocks) if b)


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON, n pages) from pages(url, html)."""
    schema = "host string, wrapper string, n long"

    def infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": list(found), "wrapper": [json.dumps(w) for w, _ in found.values()], "n": [n for _, n in found.values()]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("n", pa.int64())]))

        for part in rows_of(batches):
            for url, page in zip(part["url"], part["html"], strict=True):
                host = host_of(url)
                own = page_wrapper(page or "")
                old = found.get(host)
                found[host] = [own, 1] if old is None else [merged(old[0], own), old[1] + 1]
            if len(found) > 20_000:
                yield rows()
                found.clear()
        if found:
            yield rows()

    def meet(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wrapper: list | None = None
        n = 0
        for rows in tables:
            n += int(rows["n"].sum())
            for text in rows["wrapper"]:
                own = json.loads(text)
                wrapper = own if wrapper is None else merged(wrapper, own)
        yield pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper)], "n": [n]})

    parts = pages.select("url", "html").mapInArrow(infer, schema)
    first = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "salt").applyInPandas(meet, schema)
    return first.groupBy("host").applyInPandas(meet, schema)


@lru_cache(4096)
def _paths(wrapper: str) -> Paths:
    main, kept = json.loads(wrapper)
    return frozenset(map(tuple, main)), frozenset(map(tuple, kept))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [json.dumps([sorted(p) for p in content_paths(json.loads(w), n)]) for w, n in zip(batch.column("wrapper").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), batch.column("n")], names=["host", "paths", "n"])

    found = written(wrappers(pages).mapInArrow(decide, "host string, paths string, n long"), "wrappers")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("paths") + 32), F.lit(0))).first()
    schema = "page_id long, url string, text string, n_chars long"

    def run_with(known: dict[str, str] | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in rows_of(batches):
                of = part["paths"] if known is None else [known.value.get(host_of(u), "[[], []]") for u in part["url"]]
                texts = [extract(page, _paths(p)) for page, p in zip(part["html"], of, strict=True)]
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(part["page_id"], pa.int64()), "url": pa.array(part["url"], pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

        return run

    if n <= MOST_WRAPPERS and size <= MOST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r.host: r.paths for r in found.collect()})
        return pages.mapInArrow(run_with(known), schema)

    def with_hosts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(host_of, batch.column(1).to_pylist()), pa.string())], names=[*batch.schema.names, "host"])

    hosted = pages.mapInArrow(with_hosts, "page_id long, url string, html string, host string")
    joined = salted_join(hosted, found.select("host", "paths"), "host", written(hot_counts(found, "host"), "hot"), F.col("page_id"))
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run_with(None), schema)
