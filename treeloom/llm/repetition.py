"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths (operator 10).

For each text, words get dense numbers, and windows of 5, 10 and 20 words get 64-bit rolling
hashes in numpy; longer windows come from shorter ones by one multiplication. Windows whose hash
occurs twice are repeated; for the 5-word windows, whose count is part of the result, windows of
equal hash are compared word by word, so that a collision changes nothing.

A row depends on its own text alone: no shuffle, and a lost executor costs only its tasks.

Edge cases: a null or empty text has no words, counts of 0, base_failed true, kept false. Texts of
any length are read whole. Repeated rows each get their own result. An empty table gives an empty
result. Further columns of the input are left out of `quality_rules` and kept by `keep_clean`,
except that a column of the input may be called like one of the results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import only, rows_of, words_of

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_chars_5 long, dup_chars_10 long, dup_chars_20 long, dup_line_chars long, line_chars long"
)


@dataclass(frozen=True)
class Limits:
    """A text fails when characters in later copies of n-word windows, or of lines, or symbols exceed these shares of its characters."""

    least_words: int = 10
    repeat_percent: int = 20
    dup_5: float = 0.30
    dup_10: float = 0.25
    dup_20: float = 0.20
    dup_lines: float = 0.30
    symbols: float = 0.10


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads small numbers over 64 bits."""
    x = (x + np.uint64(1)) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULTIPLIER), n, 1 << 64))


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n numbers."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    have, width = {1: _mixed(ids.astype(np.uint64))}, 1
    while width * 2 <= n:
        half = have[width]
        have[width * 2] = half[:-width] * _power(width) + half[width:]
        width *= 2
    out, done = have[width], width
    for step in sorted((w for w in have if w & (n - width)), reverse=True):
        tail = have[step][done:]
        out = out[: len(tail)] * _power(step) + tail
        done += step
    return out


def _groups(hashes: np.ndarray, ids: np.ndarray, n: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(windows that occur at least twice, those of them after their first occurrence)."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    if exact and same.any():
        at = np.flatnonzero(same)
        left, right = order[at], order[at + 1]
        if not all((ids[left + k] == ids[right + k]).all() for k in range(n)):  # a collision: number the windows exactly
            rows = np.lib.stride_tricks.sliding_window_view(ids, n)
            hashes = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            same = ordered[1:] == ordered[:-1]
    later = np.zeros(len(hashes), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def _covered(windows: np.ndarray, n: int, length: int) -> np.ndarray:
    """Positions that lie in one of the marked windows."""
    change = np.zeros(length + 1, np.int64)
    at = np.flatnonzero(windows)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change[:-1]) > 0


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    """The columns of SCHEMA after doc_id."""
    words = words_of(text)
    if not words:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return 0, 0, sum(raw.count(s.encode()) for s in _SYMBOLS), 0, 0, True, False, 0, 0, 0, 0, 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in numbers), np.int64, len(numbers))[ids]
    chars = int(lengths.sum())
    symbols = sum(text.count(s) for s in _SYMBOLS)
    repeated, dup = 0, {5: 0, 10: 0, 20: 0}
    for n in dup:
        if len(ids) < n:
            break
        twice, later = _groups(window_hashes(ids, n), ids, n, n == 5)
        if n == 5:
            repeated = int(_covered(twice, n, len(ids)).sum())
        if not later.any():
            break
        dup[n] = int(lengths[_covered(later, n, len(ids))].sum())
    seen: set[str] = set()
    n_dup_lines = dup_line_chars = line_chars = 0
    for line in text.split("\n"):
        if size := len(line.strip(_BLANKS)):
            line_chars += size
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += size
            seen.add(line)
    failed = len(words) < limits.least_words or 100 * repeated > limits.repeat_percent * len(words)
    kept = not failed and all(dup[n] <= most * chars for n, most in ((5, limits.dup_5), (10, limits.dup_10), (20, limits.dup_20))) and dup_line_chars <= limits.dup_lines * max(line_chars, 1) and symbols <= limits.symbols * chars
    return len(words), chars, symbols, n_dup_lines, repeated, failed, kept, dup[5], dup[10], dup[20], dup_line_chars, line_chars


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row of SCHEMA for each row of docs(doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            found = [measure(t, limits) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), *(pa.array(c, pa.bool_() if i in (5, 6) else pa.int64()) for i, c in enumerate(zip(*found, strict=True)))], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


ARROW = pa.schema([(part.split()[0], {"long": pa.int64(), "boolean": pa.bool_()}[part.split()[1]]) for part in SCHEMA.split(", ")])


def keep_clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Read once, in one pass, without a join."""
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("repetition")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            kept = [measure(t.as_py(), limits)[6] for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)
