"""Token-ID output: flat unsigned integer files with 64-bit document offsets (operator 1).

Layout of a folder, one set of files for each partition, partitions in ascending doc_id order:
    part-00000.ids   all ids, little-endian, uint16 where the vocabulary allows it, else uint32
    part-00000.off   n_docs + 1 int64 offsets into the ids, the first 0
    part-00000.docs  n_docs int64 doc_ids
    index.parquet/   one row for each partition: part, n_docs, n_tokens, doc_base, token_base
Bases are prefix sums over the partitions' counts, the only numbers that the driver gathers.

Encoding: the tokenizer drops white space and never joins across it, so a text's ids are those of
its words one after another. Words are cut and numbered in Arrow's bytes; each worker keeps the ids
of words it has met (of MOST_WORDS at most those used most) and gives only new words to the library.
That this equals encoding whole texts is checked for each tokenizer file when it is loaded
(`splits_at_spaces`); for one that doesn't qualify, whole texts are encoded.

Files are written under a name of the attempt and renamed when whole, so a task that runs again
after a lost executor writes the same bytes to the same place.

Edge cases: a null or empty text is one end id. Null doc_ids come first, stored as the least long.
Rows with equal doc_id stand in order of a hash of their texts, so that they too are dealt over
partitions. An empty table gives no files and no rows. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import BLANK, LOWER, RunCache, gather_runs, holds_cache, local_path, only, partitions, shared_folder, slices, split_words, text_bytes

MOST_WORDS = 800_000
NULL_ID = -(1 << 63)


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer file's ids of a text are those of its ASCII-space separated words.

    True for a pre-tokenizer that first removes everything its pattern doesn't match, where the
    pattern matches no white space, without dropout, post-processor or added tokens with spaces.
    """
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", r"\s")
    parts = pattern.replace(r"[^\s\p{L}\p{N}]", "")
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return bool(
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"\s" not in parts and " " not in parts and "." not in parts and r"\S" not in parts
        and set(kinds) <= {"NFC", "Replace", "Lowercase"} and not spec.get("post_processor") and not spec["model"].get("dropout") and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"]) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


class WordEncoder:
    """Ids of texts, from ids of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_spaces(path)
        self.lower = "Lowercase" in json.dumps(json.load(open(path, encoding="utf-8")).get("normalizer"))
        #: A special token, which the library cuts out before anything else, to separate words in one call.
        self.mark = next(((t["content"], t["id"]) for t in json.load(open(path, encoding="utf-8"))["added_tokens"] if t["special"] and not t["normalized"]), None)
        self.cache = RunCache(MOST_WORDS)
        self.ends, self.tails = None, False
        end = self.tokenizer.model.end_of_word_suffix if self.by_word else None
        if end:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
            self.tails = self.lower

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids), from few calls of the library.

        Words of letters alone are one pre-token each, whose last id ends a word: they are encoded
        in one text. Others are separated by a special token.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark is None or any(self.mark[0] in t for t in texts):
            return self._each(texts)
        letters = [k for k, t in enumerate(texts) if t.isalpha()] if self.ends is not None else []
        rest = [k for k, t in enumerate(texts) if not t.isalpha()] if self.ends is not None else list(range(len(texts)))
        counts, starts, flats, used = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        for group, plain in ((letters, True), (rest, False)):
            for at in range(0, len(group), 1024):
                own = group[at : at + 1024]
                joint = " " if plain else self.mark[0]
                ids = np.array(self.tokenizer.encode(joint.join([*(texts[k] for k in own), ""]), add_special_tokens=False).ids, np.uint32)
                last = np.flatnonzero(self.ends[ids] if plain else ids == self.mark[1])
                if len(last) != len(own):  # a letter that the library's tables don't know
                    n, ids = self._each([texts[k] for k in own])
                else:
                    n = np.diff(last, prepend=-1) - (not plain)
                    ids = ids if plain else np.delete(ids, last)
                counts[own], starts[own] = n, used + np.cumsum(n) - n
                used += len(ids)
                flats.append(ids)
        return counts, gather_runs(np.concatenate([np.empty(0, np.uint32), *flats]), starts, counts)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [f.ids for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return counts, np.fromiter((x for one in ids for x in one), np.uint32, int(counts.sum()))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, from Arrow strings.

        Words are cut from the column's bytes and numbered by Arrow, so that Python sees each
        distinct word of a column once. A-Z become lower case where the tokenizer does that anyway
        and no special token can arise from it. A comma or full stop that ends a word after a-z is a
        word of its own: it is a pre-token of its own, as letters and marks never share one.
        """
        if not self.by_word:
            ids = [f.ids for f in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for one in ids for x in one), np.uint32, int(counts.sum())), counts
        flat, edges = text_bytes(texts)
        cuts = None
        if self.lower and not ((flat[:-1] == 60) & (flat[1:] == 124)).any():  # <|
            flat = LOWER[flat]
            if self.tails:
                last = np.ones(len(flat), bool)
                last[:-1] = BLANK[flat[1:]]
                last[edges[1:-1][edges[1:-1] > 0] - 1] = True
                last &= (flat == 44) | (flat == 46)
                last[1:] &= (flat[:-1] >= 97) & (flat[:-1] <= 122)
                last[edges[:-1][edges[:-1] < len(flat)]] = False
                cuts = np.flatnonzero(last)
        words, before = split_words(flat, edges, cuts)
        numbered = words.dictionary_encode()
        at = self.cache.places(numbered.dictionary.to_pylist(), self._encode)
        ids, ends = self.cache.at(at[numbered.indices.to_numpy()])
        return ids, np.diff(ends[before])


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


holds_cache("token_files", encoder.cache_clear)


class _Folder:
    """Files of a folder that is local or in a store that pyarrow reaches."""

    def __init__(self, uri: str) -> None:
        self.local = local_path(uri)
        if self.local is None:
            self.fs, self.base = pafs.FileSystem.from_uri(uri)

    def write(self, name: str, attempt: str, parts: Iterable[bytes]) -> None:
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/.{name}.{attempt}", "wb") as out:
                out.writelines(parts)
            os.replace(f"{self.local}/.{name}.{attempt}", f"{self.local}/{name}")
        else:
            self.fs.create_dir(self.base, recursive=True)
            with self.fs.open_output_stream(f"{self.base}/.{name}.{attempt}") as out:
                for x in parts:
                    out.write(x)
            self.fs.move(f"{self.base}/.{name}.{attempt}", f"{self.base}/{name}")

    def read(self, name: str, kind: np.dtype) -> np.ndarray | _Ranges:
        """What gives the numbers of a slice: the mapped file, or for a store one that reads the slice's bytes."""
        if self.local is not None:
            path = f"{self.local}/{name}"
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
        return _Ranges(self.fs.open_input_file(f"{self.base}/{name}"), kind)


class _Ranges:
    def __init__(self, file: pa.NativeFile, kind: np.dtype) -> None:
        self.file, self.kind = file, kind

    def __len__(self) -> int:
        return self.file.size() // self.kind.itemsize

    def __getitem__(self, at: slice) -> np.ndarray:
        return np.frombuffer(self.file.read_at((at.stop - at.start) * self.kind.itemsize, at.start * self.kind.itemsize), self.kind)


INDEX = "part long, n_docs long, n_tokens long, doc_base long, token_base long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str, vocabulary: int = 1 << 32, n_parts: int | None = None) -> DataFrame:
    """Encode docs(doc_id, text) into `folder` in ascending doc_id order; the index, which is also written there.

    The range partitioning is fixed by writing its bounds into the plan: the counts come from the
    same job that writes the files.
    """
    spark = docs.sparkSession
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("token_files")
        context = TaskContext.get()
        part, attempt = context.partitionId(), str(context.taskAttemptId())
        words, target = encoder(tokenizer), _Folder(folder)
        doc_ids: list[int] = []
        counts: list[np.ndarray] = []

        def chunks() -> Iterator[bytes]:
            for rows in slices(batches):
                doc_ids.extend(NULL_ID if x is None else x for x in rows.column(0).to_pylist())
                ids, n = words.encode_column(rows.column(1))
                if end_id is not None:
                    n = n + 1
                    own = np.ones(int(n.sum()), bool)
                    own[np.cumsum(n) - 1] = False
                    ended = np.full(len(own), end_id, kind)
                    ended[own] = ids
                    ids = ended
                counts.append(n)
                yield ids.astype(kind, copy=False).tobytes()

        name = f"part-{part:05d}"
        target.write(f"{name}.ids", attempt, chunks())
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]))])
        if not doc_ids:
            return
        target.write(f"{name}.off", attempt, [offsets.astype("<i8").tobytes()])
        target.write(f"{name}.docs", attempt, [np.array(doc_ids, "<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(doc_ids)], "n_tokens": [int(offsets[-1])]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n_parts or partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    found = sorted(dealt.mapInArrow(run, "part long, n_docs long, n_tokens long").collect())
    docs_before = tokens_before = 0
    index = []
    for part, n_docs, n_tokens in found:
        index.append((part, n_docs, n_tokens, docs_before, tokens_before))
        docs_before, tokens_before = docs_before + n_docs, tokens_before + n_tokens
    spark.createDataFrame(index, INDEX).coalesce(1).write.parquet(f"{folder}/index.parquet")
    return spark.read.schema(INDEX).parquet(f"{folder}/index.parquet")


def read_token_files(spark: SparkSession, folder: str, columns: str, row: Callable[[int, int, np.ndarray], tuple], vocabulary: int = 1 << 32) -> DataFrame:
    """row(doc_id, start, ids as uint32) for each document, from the memory-mapped files."""
    kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index.parquet")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Folder(folder)
        for batch in batches:
            for part in batch.to_pylist():
                name = f"part-{part['part']:05d}"
                ids, offsets, doc_ids = source.read(f"{name}.ids", kind), source.read(f"{name}.off", np.dtype("<i8")), source.read(f"{name}.docs", np.dtype("<i8"))
                for at in range(0, len(doc_ids), 1024):
                    end = min(at + 1024, len(doc_ids))
                    edges = offsets[at : end + 1].tolist()
                    own = ids[edges[0] : edges[-1]].astype("<u4")
                    found = [row(d, part["token_base"] + a, own[a - edges[0] : b - edges[0]]) for d, a, b in zip(doc_ids[at:end].tolist(), edges, edges[1:], strict=False)]
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found, strict=True)), strict=True)))

    names = [c.split()[0] for c in columns.split(", ")]
    n = max(1, index.count())
    return index.repartition(n, "part").mapInArrow(run, columns)


def token_rows(spark: SparkSession, folder: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    return read_token_files(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda d, start, ids: (None if d == NULL_ID else d, start, len(ids), zlib.crc32(ids.tobytes())), vocabulary)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int = 1 << 32, folder: str | None = None) -> DataFrame:
    """Write the files to a shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    write_token_files(docs, tokenizer, end_id, folder, vocabulary)
    return token_rows(spark, folder, vocabulary)
