"""N-gram Jaccard join: T-occurrence search with DivideSkip (operator 5).

A document is the set of its distinct 5-word shingles (64-bit hashes). Two link when
100 * |both| >= 75 * |either|. Every step is exact; none caps partners or candidates.

1. signatures: (doc_id, n, tag) of each document, tag being a digest of its whole set. Documents
   with equal tags are one class and go on as one.
2. survivors: each class posts the (25 + 15) % of its shingles with the least hashes. Partners
   share at least 15 % of ceil(0.75 n) of these, so a class with fewer that any other class posts
   has no partner. Postings travel as numpy blobs by bucket of the hash; a shingle that is
   frequent within a task's block is settled there and posted twice only, so that a shingle in a
   third of all documents is a few numbers from each block.
3. sets: only survivors' whole sets are fetched, and those go on of whose shingles at least
   ceil(0.75 n) are in another survivor's set; so sharing a passage or line alone ends here.
4. cells: survivors that share one of their rarest 25 % + 1 shingles, as partners must, get into
   one connected cell, by stars sent to distributed connected components.
5. links within cells: cells of more than PIVOT_CELL classes first compare all with PIVOTS pivots,
   in shares of bounded bytes; what is linked so becomes one known component. Cells that are one component
   are finished. For others, classes outside the largest component search all of the cell, in
   blocks of bounded bytes; small cells are packed together. The search is `Finder`.
6. components of all links, brought back to documents by tag, salted where a class is large.

Finder: inverted lists by shingle over components of what was added; DivideSkip puts the longest
lists aside, heap-merges the short ones (jumping over what can't reach the required overlap) and
binary-probes the long ones; for each component that reaches the overlap, the same search runs
among its members until one link is found, as one is enough to join.

Hashes of 64 bits and tags of 128 bits are taken as equal only for equal contents: the chance that
a result differs by this is below pairs * 2^-64.

Edge cases: null or empty texts, and texts of white space, have n_shingles 0 and link with nothing,
each being its own component. With fewer than five words the whole sequence is one shingle. Null
doc_ids take part; their component_id is the least doc_id reachable, null if there is none. Rows
that repeat are copies. Very long texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import components, free_memory, hot_counts, only, partitions, salted_join, slices, word_hashes, written

WIDTH = 5
PIVOTS, PIVOT_CELL = 64, 64
BLOCK_POSTINGS = 1 << 20
LEAST_BLOCK, MOST_BLOCK = 64 << 10, 2 << 20
SLICE = 4 << 20
_NONE = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    x, before = word_hashes(texts)
    h = x[: max(0, len(x) - WIDTH + 1)].copy()
    for k in range(1, WIDTH):
        h *= _BASE
        h += x[k : len(x) - WIDTH + 1 + k] if len(h) else 0
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
        if b - a >= WIDTH:
            yield np.unique(h[a : b - WIDTH + 1])
        else:  # the whole sequence is one
            words = texts[i].as_py().encode("utf-8", "surrogatepass").lower().split() if b > a else []
            yield np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string())))


def tag_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def least_overlap(n: int) -> int:
    """ceil(0.75 n): what any partner of a set of n shares with it."""
    return (3 * n + 3) // 4


def _extra(n: int) -> int:
    return (15 * n + 99) // 100


def linked(both: int, a: int, b: int) -> bool:
    return 100 * both >= 75 * (a + b - both)


def divide_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(id, number of lists that hold it) of all ids in at least `need` of the sorted lists."""
    lists = sorted((x for x in lists if x), key=len)
    if need < 1:
        raise ValueError("need must be positive")
    if len(lists) < need:
        return []
    longest = len(lists[-1])
    n_long = min(need - 1, int(need / (0.01 * max(longest, 2).bit_length() + 1)), sum(len(x) > 8 for x in lists))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    need_short = need - n_long
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= need_short:
        first = heap[0][0]
        popped = []
        while heap and heap[0][0] == first:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need_short:
            count = len(popped)
            for rest, x in enumerate(long):
                if count + len(long) - rest < need:
                    break
                at = bisect_left(x, first)
                count += at < len(x) and x[at] == first
            if count >= need:
                out.append((first, count))
            goal = first + 1
        else:
            while heap and len(popped) < need_short - 1:
                popped.append(heapq.heappop(heap))
            goal = max(heap[0][0], first + 1) if heap else first + 1
        for _, k, at in popped:
            at = bisect_left(short[k], goal, at)
            if at < len(short[k]):
                heapq.heappush(heap, (short[k][at], k, at))
    return out


class Finder:
    """Links of sets to components of the sets added before; tokens are small numbers."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}
        self.members: list[list[int]] = []
        self.holds: list[set[int]] = []
        self.inner: list[dict[int, list[int]] | None] = []
        self.sets: list[tuple[np.ndarray, int]] = []
        self.root: list[int] = []

    def find(self, c: int) -> int:
        while self.root[c] != c:
            self.root[c] = c = self.root[self.root[c]]
        return c

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)

    def component(self) -> int:
        c = len(self.root)
        self.root.append(c)
        self.members.append([])
        self.holds.append(set())
        self.inner.append(None)
        return c

    def add(self, tokens: np.ndarray, n: int, c: int) -> int:
        """Add a set (tokens that may match, n in all) to component c."""
        at = len(self.sets)
        self.sets.append((tokens, n))
        self.members[c].append(at)
        holds = self.holds[c]
        for t in tokens.tolist():
            if t not in holds:
                holds.add(t)
                x = self.lists.setdefault(t, [])
                if not x or x[-1] < c:
                    x.append(c)
                else:
                    x.insert(bisect_left(x, c), c)
        if self.inner[c] is not None:
            for t in tokens.tolist():
                self.inner[c].setdefault(t, []).append(at)
        return at

    def _linked(self, tokens: np.ndarray, n: int, at: int) -> bool:
        other, m = self.sets[at]
        if 4 * min(n, m) < 3 * max(n, m):
            return False
        return linked(len(np.intersect1d(tokens, other, assume_unique=True)), n, m)

    def links(self, tokens: np.ndarray, n: int, own: int | None = None) -> list[tuple[int, int]]:
        """(component, a linked member) of each component that holds one, those joined with `own` left out."""
        need = least_overlap(n)
        if len(tokens) < need:
            return []
        out: list[tuple[int, int]] = []
        done = set() if own is None else {self.find(own)}
        keys = tokens.tolist()
        held = [x for t in keys if (x := self.lists.get(t))]
        for c, _ in divide_skip(held, need):
            if self.find(c) in done:
                continue
            members = self.members[c]
            hit = next((m for m in dict.fromkeys([members[0], *members[-2:]]) if self._linked(tokens, n, m)), None)
            if hit is None and len(members) > 3:
                inner = self.inner[c]
                if inner is None:
                    inner = self.inner[c] = {}
                    for m in members:
                        for t in self.sets[m][0].tolist():
                            inner.setdefault(t, []).append(m)
                held = [x for t in keys if (x := inner.get(t))]
                hit = next((m for m, both in divide_skip(held, need) if linked(both, n, self.sets[m][1])), None)
            if hit is not None:
                out.append((c, hit))
                done.add(self.find(c))
        return out


def _signatures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        for part in slices(batches, SLICE):
            found = [(len(s), tag_of(s)) for s in shingle_sets(part.column("text"))]
            n, tags = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "tag": pa.array(tags, pa.binary()), "text_key": part.column("text_key")})

    return docs.select("doc_id", "text", _text_key("text").alias("text_key")).mapInArrow(run, "doc_id long, n long, tag binary, text_key long")


def _text_key(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _short(tag: bytes) -> int:
    return int.from_bytes(tag[:8], "little", signed=True)


def _buckets(low: np.ndarray, n: int) -> np.ndarray:
    return ((low & np.uint64(0xFFFFFF)) % np.uint64(n)).astype(np.int64)


def _blobs(bucket: np.ndarray, n_buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: the columns' values there, as bytes."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    rows = [b for b in range(n_buckets) if edges[b] < edges[b + 1]]
    named = {f"c{i}": pa.array([c[order[edges[b] : edges[b + 1]]].tobytes() for b in rows], pa.binary()) for i, c in enumerate(columns)}
    return pa.RecordBatch.from_pydict({"bucket": pa.array(rows, pa.int64()), **named})


def _flat(column: pd.Series, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column]) if len(column) else np.empty(0, kind)


def _first_posts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(tag, the (25 + 15) % of shingles with the least hashes) of texts."""
    for part in slices(batches, SLICE):
        for s in shingle_sets(part.column("text")):
            if n := len(s):
                yield _short(tag_of(s)), s[: n - least_overlap(n) + _extra(n)]


def _shared_counts(rows: DataFrame, posts: Callable, n_buckets: int) -> DataFrame:
    """(tag64, n_shared): how many of a class's posted shingles another class posts too."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        seen: dict[int, int] = {}
        tokens: list[np.ndarray] = []
        held = 0

        def block() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(tokens)
            tags = np.repeat(np.fromiter(seen, np.int64, len(seen)), [len(t) for t in tokens])
            order = np.argsort(flat, kind="stable")
            flat, tags = flat[order], tags[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            sizes = np.diff(np.append(first, len(flat)))
            place = np.arange(len(flat)) - np.repeat(first, sizes)
            many = np.repeat(sizes >= 8, sizes)
            settled = many & (place >= 2)  # known to be shared; two postings tell the other blocks
            posted = ~settled
            low = flat[posted]
            yield _blobs(_buckets(low, n_buckets), n_buckets, ((low >> np.uint64(12)) & np.uint64(0xFFFFFFFF)).astype("<u4"), tags[posted].astype("<i8"))
            if settled.any():
                own, n = np.unique(tags[settled], return_counts=True)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1 - int(own[0]) % n_buckets], pa.int64()), "c0": pa.array([n.astype("<u4").tobytes()], pa.binary()), "c1": pa.array([own.astype("<i8").tobytes()], pa.binary())})

        for tag, some in posts(batches):
            if tag in seen:
                continue
            seen[tag] = len(some)
            tokens.append(some)
            held += len(some)
            if held >= BLOCK_POSTINGS:
                yield from block()
                seen, tokens, held = {}, [], 0
        if held:
            yield from block()

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            tags, n = _flat(rows["c1"], "<i8"), _flat(rows["c0"], "<u4")
        else:
            tokens, tags = _flat(rows["c0"], "<u4"), _flat(rows["c1"], "<i8")
            order = np.lexsort((tags, tokens))
            tokens, tags = tokens[order], tags[order]
            fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (tags[1:] != tags[:-1])])
            tokens, tags = tokens[fresh], tags[fresh]
            same = tokens[1:] == tokens[:-1]
            hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            tags, n = tags[hit], np.ones(int(hit.sum()), np.int64)
        own, at = np.unique(tags, return_inverse=True)
        sums = np.bincount(at, n, len(own)).astype(np.int64) if len(own) else np.empty(0, np.int64)
        home = (own.astype(np.uint64) >> np.uint64(20)) % np.uint64(n_buckets)
        return _blobs(home.astype(np.int64), n_buckets, own.astype("<i8"), sums.astype("<i8")).to_pandas()

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        own, at = np.unique(_flat(rows["c0"], "<i8"), return_inverse=True)
        return pd.DataFrame({"tag64": own, "n_shared": np.bincount(at, _flat(rows["c1"], "<i8"), len(own)).astype(np.int64)})

    blobs = "bucket long, c0 binary, c1 binary"
    return rows.mapInArrow(post, blobs).groupBy("bucket").applyInPandas(meet, blobs).groupBy("bucket").applyInPandas(total, "tag64 long, n_shared long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tag64, n, tokens) of the classes in wanted(doc_id, text_key, tag64)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        for part in slices(batches, SLICE):
            sets = [(tag, s) for s, tag in zip(shingle_sets(part.column("text")), part.column("tag64").to_pylist(), strict=True) if _short(tag_of(s)) == tag]
            yield pa.RecordBatch.from_pydict({"tag64": pa.array([t for t, _ in sets], pa.int64()), "n": pa.array([len(s) for _, s in sets], pa.int64()), "tokens": pa.array([s.tobytes() for _, s in sets], pa.binary())})

    return docs.withColumn("text_key", _text_key("text")).join(wanted, ["doc_id", "text_key"]).select("text", "tag64").mapInArrow(run, "tag64 long, n long, tokens binary")


def _rare(sets: DataFrame, n_buckets: int) -> DataFrame:
    """(tag64, prefix) of the sets of which enough is shared: their shared shingles among the rarest 25 % + 1.

    Shingles are ordered by the number of sets that hold them, then by hash. Blocks of sets count
    their own shingles first and get back one number for each distinct one.
    """
    total = sets.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0]
    n_blocks = int(max(partitions(sets.sparkSession), total // MOST_BLOCK))
    blocks = sets.select(F.pmod(F.xxhash64("tag64"), F.lit(n_blocks)).alias("block"), "tag64", "n", "tokens")

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flat, n = np.unique(_flat(rows["tokens"], "<u8"), return_counts=True)
        return _blobs(_buckets(flat, n_buckets), n_buckets, flat.astype("<u8"), n.astype("<u4")).to_pandas().assign(block=int(key[0]))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        flat, n = _flat(rows["c0"], "<u8"), _flat(rows["c1"], "<u4").astype(np.int64)
        own, at = np.unique(flat, return_inverse=True)
        sums = np.bincount(at, n, len(own)).astype(np.int64)[at]
        out, start = [], 0
        for block, raw in zip(rows["block"], rows["c0"], strict=True):
            end = start + len(raw) // 8
            many = sums[start:end] > 1
            out.append((block, flat[start:end][many].tobytes(), sums[start:end][many].astype("<u8").tobytes()))
            start = end
        return pd.DataFrame(out, columns=["block", "c0", "c1"])

    def choose(sets_: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        tokens, counts = _flat(found["c0"], "<u8"), _flat(found["c1"], "<u8")
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]
        out = []
        for tag, n, raw in zip(sets_["tag64"], sets_["n"], sets_["tokens"], strict=True):
            own = np.frombuffer(raw, "<u8")
            at = np.searchsorted(tokens, own)
            shared = np.flatnonzero((at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == own)) if len(tokens) else np.empty(0, np.int64)
            quota = n - least_overlap(n) + 1 - (n - len(shared))
            if quota > 0:
                rare = np.lexsort((own[shared], counts[at[shared]]))[:quota]
                out.append((tag, own[shared][rare].tobytes()))
        return pd.DataFrame(out, columns=["tag64", "prefix"])

    counts = blocks.select("block", "tokens").groupBy("block").applyInPandas(count, "block long, bucket long, c0 binary, c1 binary")
    back = counts.groupBy("bucket").applyInPandas(meet, "block long, c0 binary, c1 binary")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(choose, "tag64 long, prefix binary")


def _stars(prefixes: DataFrame, n_buckets: int) -> DataFrame:
    """Edges (a, b) that connect all classes with a common shingle in their prefixes."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        tags: list[int] = []

        def block() -> Iterator[pa.RecordBatch]:
            flat, own = np.concatenate(tokens), np.repeat(np.array(tags, np.int64), [len(t) for t in tokens])
            order = np.lexsort((own, flat))
            flat, own = flat[order], own[order]
            first = np.concatenate([[True], flat[1:] != flat[:-1]])
            least = own[np.flatnonzero(first)]
            edges = np.unique(np.stack([own, least[np.cumsum(first) - 1]], 1)[~first], axis=0)
            yield _blobs(_buckets(flat[first], n_buckets), n_buckets, flat[first].astype("<u8"), least.astype("<i8"))
            if len(edges):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1 - int(edges[0, 0]) % n_buckets], pa.int64()), "c0": pa.array([edges[:, 0].astype("<i8").tobytes()], pa.binary()), "c1": pa.array([edges[:, 1].astype("<i8").tobytes()], pa.binary())})

        held = 0
        for batch in batches:
            for tag, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens.append(np.frombuffer(raw.as_buffer(), "<u8"))
                tags.append(tag)
                held += len(tokens[-1])
                if held >= BLOCK_POSTINGS:
                    yield from block()
                    tokens, tags, held = [], [], 0
        if held:
            yield from block()

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            edges = np.stack([_flat(rows["c0"], "<i8"), _flat(rows["c1"], "<i8")], 1)
        else:
            flat, own = _flat(rows["c0"], "<u8"), _flat(rows["c1"], "<i8")
            order = np.lexsort((own, flat))
            flat, own = flat[order], own[order]
            first = np.concatenate([[True], flat[1:] != flat[:-1]])
            edges = np.stack([own, own[np.flatnonzero(first)][np.cumsum(first) - 1]], 1)[~first]
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return prefixes.select("tag64", "prefix").mapInArrow(post, "bucket long, c0 binary, c1 binary").groupBy("bucket").applyInPandas(meet, "a long, b long")


def _block_bytes(sets: DataFrame) -> int:
    """How many bytes of sets a task gets at a time."""
    total = sets.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0]
    return max(LEAST_BLOCK, min(MOST_BLOCK, total // (4 * partitions(sets.sparkSession))))


def _compare(key: tuple, members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """For each member a link to each component of pivots that holds one, and links that join the pivots."""
    finder, links, own_tags = Finder(), [], []
    if not len(pivots) or not len(members):
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")
    known = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in pivots["tokens"]]))

    def found(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, int, list[tuple[int, int]]]]:
        for tag, n, raw in zip(rows["tag64"].tolist(), rows["n"].tolist(), rows["tokens"], strict=True):
            tokens = np.frombuffer(raw, "<u8")
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            ids = np.sort(at[known[at] == tokens])
            yield tag, ids, n, finder.links(ids, n)

    for tag, ids, n, others in found(pivots.sort_values(["n", "tag64"])):
        links += [(tag, own_tags[m]) for _, m in others]
        c = finder.find(others[0][0]) if others else finder.component()
        for x, _ in others:
            finder.union(c, x)
        finder.add(ids, n, finder.find(c))
        own_tags.append(tag)
    for tag, _, _, others in found(members):
        links += [(tag, own_tags[m]) for _, m in others if own_tags[m] != tag]
    del finder
    free_memory()
    return _as_stars(links)


def _as_stars(links: list[tuple[int, int]]) -> pd.DataFrame:
    """Edges (a, b) that connect what the links connect, each with the least tag of its component, so that few rounds join them all."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return pd.DataFrame([(x, find(x)) for x in list(root) if find(x) != x], columns=["a", "b"]).astype("int64")


def _pivot_links(sets: DataFrame, cells: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of large cells and the cell's pivots, PIVOTS classes by hash."""
    rows = written(cells.join(sets.select("tag64", F.octet_length("tokens").alias("bytes")), "tag64"), "members")
    block = _block_bytes(sets)
    big = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") > PIVOT_CELL)
    big = written(big.withColumn("shares", F.ceil(F.col("bytes") / block).cast("int")), "large")
    if big.isEmpty():
        return sets.sparkSession.createDataFrame([], "a long, b long")
    inside = salted_join(rows.select("tag64", "cell"), big.select("cell", "shares"), "cell", written(hot_counts(big, "cell"), "hot"), F.col("tag64"))
    inside = inside.withColumn("h", F.xxhash64("tag64"))
    # The least few of each of 1024 shares, then the least of these: no task sees a whole cell.
    few = inside.groupBy("cell", F.pmod("h", F.lit(16 * PIVOTS)).alias("k")).agg(F.min(F.struct("h", "tag64")).alias("p"), F.first("shares").alias("shares"))
    few = few.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("p")), 1, PIVOTS).alias("p"), F.first("shares").alias("shares")).select("cell", "shares", F.explode("p.tag64").alias("tag64"))
    few = written(few.join(sets, "tag64").select("cell", "shares", "tag64", "n", "tokens"), "pivots").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    members = inside.withColumn("share", F.pmod(F.xxhash64(F.lit(3), "tag64"), F.col("shares")).cast("int")).join(sets, "tag64")
    a, b = (x.select("cell", "share", "tag64", "n", "tokens").groupBy("cell", "share") for x in (members, few))
    return a.cogroup(b).applyInPandas(_compare, "a long, b long")


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within a packet. role: 0 is searched and searches, 1 is only searched, 2 only searches."""
    sets = [np.frombuffer(x, "<u8") for x in rows["tokens"]]
    flat, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    inverse, edges = inverse.reshape(-1), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    tags, sizes, labels, roles = (rows[c].tolist() for c in ("tag64", "n", "label", "role"))
    finder, known, links, own_tags = Finder(), {}, [], []
    for k in sorted(range(len(rows)), key=lambda k: (roles[k] != 1, sizes[k], tags[k])):
        ids = inverse[edges[k] : edges[k + 1]]
        ids = np.sort(ids[counts[ids] > 1])
        c = known.get(labels[k])
        if roles[k] != 1:
            if len(ids) < least_overlap(sizes[k]):
                continue
            found = [(x, m) for x, m in finder.links(ids, sizes[k], c) if own_tags[m] != tags[k]]
            links += [(tags[k], own_tags[m]) for _, m in found]
            if c is None and found:
                c = known[labels[k]] = finder.find(found[0][0])
            for x, _ in found:
                finder.union(c, x)
        if roles[k] != 2:
            if c is None:
                c = known[labels[k]] = finder.component()
            finder.add(ids, sizes[k], c)
            own_tags.append(tags[k])
    del finder
    free_memory()
    return _as_stars(links)


def _cell_links(sets: DataFrame, cells: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) that join what known(node, component) leaves apart within cells(tag64, cell)."""
    label = F.coalesce("component", "tag64")
    rows = sets.select("tag64", F.octet_length("tokens").alias("bytes")).join(cells, "tag64").join(known.withColumnRenamed("node", "tag64"), "tag64", "left").select("tag64", "cell", label.alias("label"), "bytes")
    rows = written(rows, "members")
    labels = written(rows.groupBy("cell", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "labels")
    state = labels.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("n_labels"), F.max(F.struct("bytes", "label")).alias("top"))
    state = written(state.where("n_labels > 1"), "open")
    block = _block_bytes(sets)
    packs = max(1, -(-(state.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // block))
    hot = written(hot_counts(state, "cell"), "hot")
    state = state.select("cell", F.ceil(F.col("bytes") / block).cast("int").alias("index_blocks"), F.ceil((F.col("bytes") - F.col("top.bytes")) / block).cast("int").alias("query_blocks"), F.col("top.label").alias("top"))
    rows = salted_join(rows, state, "cell", hot, F.col("tag64"))
    one = rows.where("index_blocks = 1").select("tag64", "label", F.lit(0).alias("role"), F.lit(0).cast("long").alias("cell"), F.pmod(F.xxhash64("cell"), F.lit(packs)).cast("int").alias("i"), F.lit(0).alias("q"))
    many = rows.where("index_blocks > 1").withColumn("h", F.xxhash64(F.lit(7), "tag64"))
    i, q = F.pmod("h", F.col("index_blocks")).cast("int"), F.pmod(F.xxhash64(F.lit(9), "tag64"), F.col("query_blocks")).cast("int")
    index = many.select("tag64", "label", F.lit(1).alias("role"), "cell", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("q"))
    query = many.where("label <> top").select("tag64", "label", F.lit(2).alias("role"), "cell", q.alias("q"), F.explode(F.sequence(F.lit(0), F.col("index_blocks") - 1)).alias("i"))
    plan = one.unionByName(index).unionByName(query)
    return plan.join(sets, "tag64").select("cell", "i", "q", "tag64", "n", "label", "role", "tokens").groupBy("cell", "i", "q").applyInPandas(_search, "a long, b long")


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of docs(doc_id, text).

    class_id is the least doc_id with the same set. A small packet's search runs in one task;
    none holds more than about two blocks of MOST_BLOCK bytes, or a single set beyond that.
    """
    rows, named, least = _components_of(docs)
    named = written(salted_join(named.select("component", "tag", "class_id", "n"), least.select("component", "component_id"), "component", written(hot_counts(least, "component"), "hot"), F.col("tag")), "named")
    out = salted_join(rows.where("n > 0"), named.select("tag", "class_id", "component_id"), "tag", written(hot_counts(named, "tag"), "hot"), F.col("doc_id"))
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    out = out.select("doc_id", "n", "component_id", "class_id").unionByName(empty)
    real = lambda c: F.when(F.col(c) < _NONE, F.col(c)).alias(c)
    return out.select(real("doc_id"), F.col("n").alias("n_shingles"), real("component_id"), real("class_id"))


def _components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of all rows, classes with their component, components with their first row); _NONE for null ids."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(_signatures(docs), "signatures")
    first = F.min(F.struct("doc_id", "text_key"))
    classes = rows.where("n > 0").groupBy("tag").agg(first["doc_id"].alias("doc_id"), first["text_key"].alias("text_key"), F.min("n").alias("n_shingles"), F.count("*").alias("n"))
    classes = written(classes.withColumn("tag64", _tag64("tag")), "classes")
    postings = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] * 0.4
    n_buckets = int(max(64, partitions(spark), postings // 1_000_000))
    counts = _shared_counts(docs.select("text"), _first_posts, n_buckets)
    need = F.floor((15 * F.floor((3 * F.col("n_shingles") + 3) / 4) + 99) / 100)
    wanted = written(classes.join(counts, "tag64").where(F.col("n_shared") >= need).select("doc_id", "text_key", "tag64"), "wanted")
    sets = written(_sets(docs, wanted).dropDuplicates(["tag64"]), "sets")
    prefixes = written(_rare(sets, n_buckets), "prefixes")
    cells = written(components(_stars(prefixes, n_buckets), "cells").select(F.col("node").alias("tag64"), F.col("component").alias("cell")), "cells")
    first = written(_pivot_links(sets, cells), "links")
    known = components(first, "known")
    links = written(_cell_links(sets, cells, known), "links")
    final = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "final")
    named = classes.select(F.col("tag64").alias("node"), F.col("doc_id").alias("class_id"), "text_key", "tag", "n").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "named")
    first = F.min(F.struct("class_id", "text_key"))
    least = named.groupBy("component").agg(first["class_id"].alias("component_id"), first["text_key"].alias("text_key"), F.count("*").alias("n"))
    return rows, named, written(least, "least")


def _tag64(column: str) -> Column:
    """The first eight bytes of the tag, little-endian, as in _short."""
    parts = F.reverse(F.hex(F.substring(column, 1, 8)))  # digits in reverse: each byte's digits swapped
    swapped = F.regexp_replace(parts, "(.)(.)", "$2$1")
    return F.conv(swapped, 16, -10).cast("long")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each component the row with the least doc_id, nulls last, with all its columns.

    Where several texts of a component have that doc_id, one of them stays; rows that repeat all stay.
    """
    rows, _, least = _components_of(docs)
    stays = least.select(F.col("component_id").alias("_id"), F.col("text_key").alias("_key")).unionByName(rows.where("n = 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("_id"), _text_key("text").alias("_key"))
    return rows.join(stays, ["_id", "_key"], "left_semi").select("_row.*")
