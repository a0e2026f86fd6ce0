"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting and runs on one machine it is below /tmp/checkpoints.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for other stores."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def temporary(spark: SparkSession, path: str) -> None:
    """Let the driver's JVM delete what is at path when it ends; until then results may still be read from it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. paths: gets the folder, for `discard`."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    temporary(spark, path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: bytes.split() cuts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most_bytes, so that long texts don't pile up."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def rows_of(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[dict[str, list]]:
    """Python columns of the batches, in slices of about most_bytes."""
    for part in slices(batches, most_bytes):
        yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def gather_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for each i, one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


_caches: dict[str, Callable[[], None]] = {}
_busy = ""


def holds_cache(name: str, clear: Callable[[], None]) -> None:
    """Tell how to empty what the tasks of an operator keep in their worker process."""
    _caches[name] = clear


def only(name: str) -> None:
    """A task of this operator begins: workers outlive tasks, so empty what other operators left there."""
    global _busy
    if _busy != name:
        for other, clear in _caches.items():
            if other != name:
                clear()
        free_memory()
        _busy = name


def free_memory() -> None:
    """Return what was freed to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a column of strings, where each text begins and the last ends); null is empty. Nothing is copied."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    edges = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[edges[0] : edges[-1]], edges - edges[0]


#: Whether a byte is ASCII white space.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_words(flat: np.ndarray, edges: np.ndarray, cuts: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts as binary, number of words before each text and in all). cuts: places where a word begins anyway."""
    inside = ~BLANK[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges[:-1][edges[:-1] < len(flat)]] = True
    begins &= inside
    if cuts is not None:
        begins[cuts] = True
    kept = flat[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(kept))
    return as_binary(kept, offsets), np.searchsorted(np.flatnonzero(begins), edges)


def as_binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, A-Z in lower case; number of words before each text and in all).

    Arrow numbers the words, so that each distinct one of the column is hashed once.
    """
    flat, edges = text_bytes(texts)
    words, before = split_words(LOWER[flat], edges)
    numbered = words.dictionary_encode()
    own = numbered.dictionary.to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))[numbered.indices.to_numpy()], before


class RunCache:
    """Number sequences of keys that recur, each learned once; bounded.

    When it holds more than `most` keys or `most_bytes` of them it keeps the quarter used most, of
    half that size at most, and forgets the rest, which are learned again when they come again:
    results never depend on what it holds.
    """

    def __init__(self, most: int, most_bytes: int = 96 << 20) -> None:
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}
        self.starts, self.counts, self.uses = (np.zeros(1024, np.int64) for _ in range(3))
        self.flat, self.used, self.bytes = np.zeros(1 << 14, np.uint32), 0, 0

    def _shrink(self) -> None:
        n = len(self.known)
        most = np.argsort(-self.uses[:n], kind="stable")[: max(1, min(n // 2, self.most // 4))]
        sizes = np.fromiter(map(len, self.known), np.int64, n) + 4 * self.counts[:n]
        keep = np.zeros(n, bool)
        keep[most[np.cumsum(sizes[most]) <= self.most_bytes // 2]] = True
        at = np.flatnonzero(keep)
        flat = gather_runs(self.flat, self.starts[at], self.counts[at])
        self.known = {k: i for i, k in enumerate(k for k, x in zip(self.known, keep.tolist(), strict=True) if x)}
        counts = self.counts[at]
        for name, x in (("counts", counts), ("starts", np.cumsum(counts) - counts), ("uses", self.uses[at] // 2)):
            setattr(self, name, np.concatenate([x, np.zeros(1024, np.int64)]))
        self.flat, self.used, self.bytes = np.concatenate([flat, np.zeros(1 << 14, np.uint32)]), len(flat), int(sizes[at].sum())

    def _add(self, keys: list, counts: np.ndarray, flat: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))
        while len(self.starts) < first + len(keys):
            self.starts, self.counts, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.uses))
        if len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), 2 * len(flat)), np.uint32)])
        self.starts[first : first + len(keys)] = self.used + np.cumsum(counts) - counts
        self.counts[first : first + len(keys)] = counts
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.bytes += sum(map(len, keys)) + 4 * len(flat)

    def places(self, keys: list, learn: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where the runs of the keys are known, now. learn(keys): (counts, flat)."""
        if len(self.known) > self.most or self.bytes > self.most_bytes:
            self._shrink()
        at = list(map(self.known.get, keys))
        if None in at:
            new = list(dict.fromkeys(k for k, i in zip(keys, at, strict=True) if i is None))
            self._add(new, *learn(new))
            at = list(map(self.known.__getitem__, keys))
        return np.array(at, np.int64)

    def at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the runs at these places one after another, where each begins and the last ends)."""
        self.uses[: len(self.known)] += np.bincount(at, minlength=len(self.known))
        return gather_runs(self.flat, self.starts[at], self.counts[at]), np.concatenate([[0], np.cumsum(self.counts[at])])

    def runs(self, groups: list[list], learn: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(the runs of all keys one after another, length of each group's runs)."""
        flat, ends = self.at(self.places(list(chain.from_iterable(groups)), learn))
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, groups), np.int64, len(groups)))])
        return flat, np.diff(ends[edges])


def hot_counts(counts: DataFrame, key: str, n: str = "n", slots: int = 4096, least: int = 64) -> DataFrame:
    """Keys whose count is over max(least, total / slots), with the number of salts for each.

    At most `slots` keys can hold more than total / slots rows, so the result is small enough
    to broadcast whatever the input's size.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(least, -(-total // slots))
    return counts.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """Join on `key`, which is unique in `right` and may be very frequent in `left`.

    hot: as from hot_counts, of left's keys. Rows of a hot key on the left are dealt over its
    salts by `spread`; its one row on the right is repeated once for each salt.
    """
    hot = F.broadcast(hot.withColumnRenamed("salts", "_salts"))
    a = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))).drop("_salts")
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), two longs: rows (node, component), component the least id.

    Large-star and small-star alternate until nothing changes. Each round groups by node, but
    sends on only the least neighbour, found by partial aggregation, so a node with very many
    neighbours is no single task's work. Nodes without edges don't appear.
    """
    spark = edges.sparkSession
    before: list[str] = []
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, before)
    sums = _edge_sums(now)
    for _ in range(rounds):
        # A round's tables have about as many rows as there are edges; few edges take few tasks and files.
        parts = max(8, sums[0] // 100_000)
        fit = lambda df, parts=parts: df.coalesce(parts) if parts < partitions(spark) else df
        own: list[str] = []
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        least = written(fit(least), name, before)
        hot = hot_counts(least, "a")
        least = least.select("a", "m")
        large = salted_join(both, least, "a", hot, F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(fit(large.where("a <> b").distinct()), name, before)
        least = written(fit(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))), name, before)
        small = salted_join(large, least.select("a", "m"), "a", hot_counts(least, "a"), F.col("b"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = written(fit(small.where("a <> b").distinct()), name, own)
        old, sums = sums, _edge_sums(new)
        discard(spark, before)
        now, before = new, own
        if old == sums:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"no end after {rounds} rounds")


def _edge_sums(edges: DataFrame) -> tuple:
    """(number of edges, sum of their hashes): equal for equal tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def ranked(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with `name`, 0, 1, 2 ... in the order of columns: prefix sums over range partitions, whose counts alone reach the driver."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    before, table = 0, []
    for number, n in sorted(map(tuple, dealt.groupBy(part.alias("p")).count().collect())):
        table.append((number, before))
        before += n
    bases = rows.sparkSession.createDataFrame(table, "_part long, _base long")
    return dealt.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_base", "_id")
