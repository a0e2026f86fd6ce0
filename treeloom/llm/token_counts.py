"""Edit-aware token counts: segment trees over pre-tokens (operator 9).

A text's pre-tokens lie in blocks, and a segment tree over the blocks sums their characters and
tokens. An edit finds its place by descending the tree, cuts the text anew from two pre-tokens
before it until a cut falls on one that was there before, at or behind the edit's end (cutting
looks ahead only, so all later cuts stay), encodes only these pre-tokens and updates the sums on
their path. Blocks take up to four times their first size before the tree gets more of them. The
count afterwards is the root's.

A row depends on its own text alone: no shuffle, and one tree at a time is in memory. Counts of
pre-tokens are kept, at most MOST_KNOWN, then begun anew.

Edge cases: null or empty texts count 0, and edits insert into them. Edits beyond the end are moved
to the end. Very long texts are read whole, also as one pre-token. Repeated rows each get their own
result. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import holds_cache, only, rows_of

BLOCK = 64
MOST_KNOWN = 800_000


class Counter:
    """Pre-tokens of a text, and the number of tokens of each."""

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_file, "rb") if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.compiled = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def __call__(self, pre_token: str) -> int:
        n = self.known.get(pre_token)
        if n is None:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            n = self.known[pre_token] = len(self.encoding.encode_ordinary(pre_token))
        return n


@lru_cache(2)
def counter(ranks_file: str, pattern: str) -> Counter:
    return Counter(ranks_file, pattern)


holds_cache("token_counts", counter.cache_clear)


class CountedText:
    def __init__(self, text: str, count: Counter) -> None:
        self.count, self.n_encoded = count, 0
        parts = count.compiled.findall(text)
        self.blocks = [parts[i : i + BLOCK] for i in range(0, len(parts), BLOCK)] or [[]]
        self.sums = [self._sum(b) for b in self.blocks]
        self._build()

    def _sum(self, block: list[str]) -> tuple[int, int]:
        return sum(map(len, block)), sum(map(self.count, block))

    def _build(self) -> None:
        """chars and tokens: heap-ordered trees, leaves from `width` on."""
        self.width = 1
        while self.width < len(self.blocks):
            self.width *= 2
        pad = [0] * (self.width - len(self.blocks))
        self.chars = [0] * self.width + [c for c, _ in self.sums] + pad
        self.tokens = [0] * self.width + [t for _, t in self.sums] + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _block_at(self, place: int) -> tuple[int, int]:
        """(block that holds the character at place, or the last one; characters before it)."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if place >= before + self.chars[i]:
                before += self.chars[i]
                i += 1
        block = min(i - self.width, len(self.blocks) - 1)
        if i - self.width > block:
            before -= self.sums[block][0] if self.chars[self.width + block] else 0
        return block, before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) by new."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, before = self._block_at(start)
        while before > start:
            first -= 1
            before -= self.sums[first][0]
        # Two pre-tokens of context: they may have looked at what is edited now.
        place, kept = before, 0
        for p in self.blocks[first]:
            if place + len(p) >= start:
                break
            place += len(p)
            kept += 1
        back = 2
        while back and (kept or first):
            if not kept:
                first -= 1
                before -= self.sums[first][0]
                kept = len(self.blocks[first])
                if not kept:
                    continue
            kept -= 1
            place -= len(self.blocks[first][kept])
            back -= 1
        head = self.blocks[first][:kept]
        # Old pre-tokens from there on, taken until a new cut meets an old one behind the edit.
        last, at = first, kept
        old_place = place
        pieces: list[str] = []
        cuts: set[int] = set()
        shift = len(new) - (end - start)

        def take(until: int) -> None:
            nonlocal last, at, old_place
            while old_place < until or not pieces:
                if at >= len(self.blocks[last]):
                    if last + 1 >= len(self.blocks):
                        return
                    last, at = last + 1, 0
                    continue
                p = self.blocks[last][at]
                pieces.append(p)
                old_place += len(p)
                at += 1
                if old_place >= end:
                    cuts.add(old_place + shift)

        reach = 256
        while True:
            take(end + reach)
            old = "".join(pieces)
            window = old[: start - place] + new + old[end - place :]
            whole = last == len(self.blocks) - 1 and at >= len(self.blocks[last])
            fresh, now, met = [], place, None
            for m in self.count.compiled.finditer(window):
                # A cut whose lookahead may have left the window isn't certain yet.
                if not whole and place + m.end() >= place + len(window) - 1:
                    break
                now = place + m.end()
                fresh.append(m[0])
                if now >= start + len(new) and now in cuts:
                    met = now
                    break
            if met is not None or whole:
                break
            reach *= 4
        if met is None:
            rest_last, rest_at = len(self.blocks) - 1, len(self.blocks[-1])
        else:  # the old pre-token that ends where the new cut is
            goal, rest_last, rest_at, spot = met - shift, first, kept, place
            while spot < goal:
                if rest_at >= len(self.blocks[rest_last]):
                    rest_last, rest_at = rest_last + 1, 0
                    continue
                spot += len(self.blocks[rest_last][rest_at])
                rest_at += 1
        self.n_encoded += len(fresh)
        tail = self.blocks[rest_last][rest_at:]
        parts = head + fresh + tail
        n = rest_last - first + 1
        if len(parts) <= 4 * BLOCK * n:  # the same blocks hold them, maybe some of them nothing
            size = -(-len(parts) // n)
            for i in range(n):
                block = parts[i * size : (i + 1) * size]
                self.blocks[first + i], self.sums[first + i] = block, self._sum(block)
                self._update(first + i)
        else:  # full: more blocks, which is rare, as each then takes many more
            new_blocks = [parts[i : i + BLOCK] for i in range(0, len(parts), BLOCK)]
            self.blocks[first : rest_last + 1] = new_blocks
            self.sums[first : rest_last + 1] = [self._sum(b) for b in new_blocks]
            self._build()

    def _update(self, block: int) -> None:
        i = self.width + block
        self.chars[i], self.tokens[i] = self.sums[block]
        i //= 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2


def edits_of(doc_id: int | None, n_chars: int, n: int) -> list[tuple[int, int, str]]:
    """n edits seeded by doc_id: each replaces up to 20 characters by a few others, by nothing, or only inserts."""
    out = []
    for k in range(n):
        h = hashlib.blake2b(f"{doc_id}:{k}".encode(), digest_size=16).digest()
        start = int.from_bytes(h[:8], "little") % (n_chars + 1)
        size = h[8] % 21 if h[9] % 3 else 0
        new = ("", " edited text", "x", " 12,\n", "é")[h[10] % 5]
        out.append((start, min(n_chars, start + size), new))
        n_chars += len(new) - (out[-1][1] - start)
    return out


def counted(docs: DataFrame, ranks_file: str, pattern: str, edits: int = 8) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_chars_after, n_encoded): counts before and after the document's edits."""
    schema = "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_encoded long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("token_counts")
        count = counter(ranks_file, pattern)
        for part in rows_of(batches):
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                tree = CountedText(text or "", count)
                before = tree.n_tokens
                for edit in edits_of(doc_id, tree.n_chars, edits):
                    tree.edit(*edit)
                rows.append((doc_id, before, tree.n_tokens, tree.n_chars, tree.n_encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
