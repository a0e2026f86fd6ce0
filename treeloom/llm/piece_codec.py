"""SentencePiece encoding and decoding for models of the BPE type (operator 2).

The library merges, again and again, the adjacent pair whose joined piece has the best score, the
leftmost on ties. The same segmentation is found here left to right, without merging:

* an Aho-Corasick automaton gives all pieces that begin at each place of a stretch of text;
* at each place the longest piece that may follow the last one is taken, then shorter ones;
* two pieces may be neighbours if merging their joined characters anew gives just these two
  (kept in a bounded table). For merges by any fixed order of score, then place, a sequence whose
  neighbours all pass is the only one that merging can give;
* where no piece fits, the last piece is taken back, and a bit field of failed places keeps the
  search from coming there again, so that each place fails at most once.

Characters without a piece stand alone and become their bytes' pieces (or the unknown id).
No piece has a space after another character, or a character that isn't a piece itself, so a text
can be cut before runs of spaces and around such characters (`Codec` computes this from the model
and cuts nowhere else); the ids of a stretch don't depend on the rest. Each worker keeps those of
stretches it has met, of MOST_STRETCHES and bounded bytes at most those used most.

A row depends on its own text alone: no shuffle.

Edge cases: a null or empty text encodes to begin and end only, decoded "". Very long texts are
read whole, also without any space. Repeated rows each get their own result. An empty table gives
an empty result. Further columns are ignored. Only models with the identity normaliser, with a
dummy prefix and without user-defined pieces are taken; others raise ValueError.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import RunCache, as_binary, gather_runs, holds_cache, only, slices, text_bytes

SPACE = "▁"
MOST_STRETCHES = 600_000
MOST_PAIRS = 300_000


class Codec:
    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(map(sp.is_unused, range(n))) or sp.encode("ﬁ  a ", out_type=str)[:2] != [SPACE, "ﬁ"] and "ﬁ" not in "".join(sp.encode("ﬁ", out_type=str)) or sp.decode(sp.encode("  a  b ")) != "  a  b ":
            raise ValueError("this kind of model isn't supported")
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.loose = {c for c in "\n\t\r" if c not in inside}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces that hold a space after another character aren't supported")
        self.lone = np.zeros(256, bool)
        self.lone[[ord(c) for c in self.loose]] = True
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        #: The next shorter piece, or lone character, that begins a piece.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.ids), p[0]) for p in self.ids if len(p) > 1}
        #: What each id adds to a decoded text.
        self.spelt = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.is_byte = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(n)])
        self.spelt_length = np.fromiter(map(len, self.spelt), np.int64, n)
        self.spelt_start = np.cumsum(self.spelt_length) - self.spelt_length
        self.spelt_flat = np.frombuffer(b"".join(self.spelt), np.uint8)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache = RunCache(MOST_STRETCHES)

    def merged(self, text: str) -> list[str]:
        """Merging as the library does it; for short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging left + right anew gives left and right. For the first piece left is ""."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def segment(self, text: str) -> list[str]:
        """Pieces of a stretch, by backtracking."""
        n = len(text)
        if text in self.ids and self.fits("", text):
            return [text]
        longest = [1] * n  # a character without a piece stands alone
        for end, length in self.automaton.iter(text):
            longest[end + 1 - length] = length  # ends ascend, so the longest comes last
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        pairs, fits, shorter = self.pairs, self.fits, self.shorter
        at, piece = 0, text[: longest[0]]
        while at < n:
            last = out[-1] if out else ""
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = pairs.get((last, piece))
                    if fits(last, piece) if ok is None else ok:
                        break
                piece = shorter.get(piece, "")
            else:  # nothing fits here: take the last piece back and try shorter ones in its place
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(last)
                piece = shorter.get(out.pop(), "")
                continue
            out.append(piece)
            at = end
            if at < n:
                piece = text[at : at + longest[at]]
        return out

    def ids_of(self, stretch: str) -> list[int]:
        out: list[int] = []
        for p in self.segment(stretch):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8")]
            elif not (out and out[-1] == self.unk):
                out.append(self.unk)
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts without begin and end, number of ids of each)."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `encode_batch`, from Arrow strings.

        A stretch begins at a text's first character, before a run of spaces, and on both sides of a
        loose character. Stretches are cut from the column's bytes, a space before each text that
        isn't empty, and numbered by Arrow, so that Python sees each distinct one of a column once.
        """
        flat, edges = text_bytes(texts)
        if (flat == SPACE.encode()[0]).any() and SPACE.encode() in flat.tobytes():  # as good as a space
            flat, edges = text_bytes(pc.replace_substring(texts, SPACE, " "))
        full = np.diff(edges) > 0
        flat = np.insert(flat, edges[:-1][full], 32)
        edges = edges + np.concatenate([[0], np.cumsum(full)])
        begins = np.zeros(len(flat) + 1, bool)
        space, lone = flat == 32, self.lone[flat]
        begins[:-1] = space | lone
        begins[1:-1] &= ~(space[1:] & space[:-1])
        begins[1:] |= lone
        begins[edges] = True
        starts = np.flatnonzero(begins)
        numbered = as_binary(flat, starts).dictionary_encode()
        at = self.cache.places(numbered.dictionary.to_pylist(), self._learn)
        ids, ends = self.cache.at(at[numbered.indices.to_numpy()])
        return ids, np.diff(ends[np.searchsorted(starts, edges)])

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.ids_of(x.decode("utf-8", "replace").replace(" ", SPACE)) for x in new]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return counts, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))

    def encode(self, text: str | None) -> list[int]:
        return [self.bos, *self.encode_batch([text])[0].tolist(), self.eos]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids): pieces' characters, the first space dropped, bytes joined to characters."""
        ids = np.asarray(ids, np.int64)
        inner = ids[(ids != self.bos) & (ids != self.eos)]
        odd = self.is_byte[inner]
        if len(ids) != len(inner) + 2 * (len(ids) > 1 and ids[0] == self.bos and ids[-1] == self.eos) or odd.any() and not self._bytes_whole(inner, odd):
            return self.library.decode(ids.tolist())
        raw = gather_runs(self.spelt_flat, self.spelt_start[inner], self.spelt_length[inner]).tobytes()
        return (raw[1:] if raw[:1] == b" " and not odd[0] else raw).decode("utf-8")

    def _bytes_whole(self, ids: np.ndarray, odd: np.ndarray) -> bool:
        """Whether each run of byte pieces is valid UTF-8 by itself."""
        if self.unk in ids[odd]:
            return False
        edges = np.flatnonzero(np.diff(np.concatenate([[False], odd, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            run = b"".join(self.spelt[i] for i in ids[a:b])
            if run != b"\n":
                try:
                    run.decode("utf-8")
                except UnicodeDecodeError:
                    return False
        return True


@lru_cache(2)
def codec(model: str) -> Codec:
    return Codec(model)


holds_cache("piece_codec", codec.cache_clear)


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs(doc_id, text); ids with begin and end."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("piece_codec")
        c = codec(model)
        for part in slices(batches):
            flat, counts = c.encode_column(part.column(1))
            ends = np.cumsum(counts)
            found = []
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                ids = np.empty(n + 2, "<u4")
                ids[0], ids[1:-1], ids[-1] = c.bos, flat[end - n : end], c.eos
                found.append((n + 2, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """docs with `ids` (array of int, begin and end included) and `decoded_sha256`, of the text that the ids decode to, in place of columns of these names."""
    kept = docs.drop(*(c for c in docs.columns if c.lower() in ("ids", "decoded_sha256")))
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())])
    at = next(i for i, name in enumerate(kept.columns) if name.lower() == "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("piece_codec")
        c = codec(model)
        for part in slices(batches):
            flat, counts = c.encode_column(part.column(at))
            offsets = np.concatenate([[0], np.cumsum(counts + 2)]).astype(np.int32)
            own = np.ones(offsets[-1], bool)
            own[offsets[:-1]] = own[offsets[1:] - 1] = False
            ids = np.empty(len(own), np.int32)
            ids[own], ids[offsets[:-1]], ids[offsets[1:] - 1] = flat, c.bos, c.eos
            decoded = [hashlib.sha256(c.decode(ids[a:b]).encode("utf-8")).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(decoded, pa.string())], names=[*part.schema.names, "ids", "decoded_sha256"])

    return kept.mapInArrow(run, schema)
