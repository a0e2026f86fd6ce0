"""Language-model scoring by masked pseudo-likelihood (operator 8).

Words get one of CLASSES * CLASSES numbers: the most frequent ones of the corpus, counted over all
documents, their own by rank, all others by hash into the last class. A window network sees the
two words on either side of a masked one: embeddings scaled by place are summed, pass a tanh, and
predict the word by a softmax over classes times one within its class, in numpy. A word that shares
its number has, times that, its share of all occurrences of the number's words; the probabilities of
all words of the corpus sum to 1. As context, words that share a number look alike.

Training: each task walks its own documents once, predicting every word of all of them, from the
same start, in batches that double from LEAST_BATCH to MOST_BATCH words; the tasks' networks are
averaged, weighted by the words they saw, chunk by chunk and over salts. So the network depends on
which documents share a task. Scoring: a document's score is the sum over all its words of
log p(word | both sides). `n_unseen` counts its words that no other document has: a text that stands
in the corpus once has some, as a rule, and one of which there is a copy has none.

Documents are cut into words once: written as blocks of places among a block's distinct 64-bit
hashes. Counts of all words, which grow with the corpus, meet by bucket and return to the blocks;
buckets grow in number with the words. The network and the frequent words that each task gets have
a fixed size (NETWORK_BYTES), whatever the corpus.

Edge cases: a null or empty text has no words, score 0 and mean null. The first and last words see
a border mark. Very long texts are read whole, scored in slices. Repeated rows count each time, and
each gets its result. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import only, partitions, rows_of, slices, word_hashes, written

CLASSES, WIDTH = 32, 8
PLACES = (-2, -1, 1, 2)
VOCABULARY = CLASSES * CLASSES
OWN = VOCABULARY - CLASSES
BORDER = VOCABULARY
RATE, LEAST_BATCH, MOST_BATCH = 0.1, 512, 4096
BLOCK, SLICE = 1 << 19, 1 << 12
SALTS, CHUNKS = 32, 8
SHAPES = {"embed": (VOCABULARY + 1, WIDTH), "scale": (len(PLACES), WIDTH), "bias": (WIDTH,), "class": (WIDTH, CLASSES), "class_bias": (CLASSES,), "word": (CLASSES, WIDTH, CLASSES), "word_bias": (CLASSES, CLASSES)}
_BLOCKS = "block long, n_own long, doc_ids binary, nulls binary, lengths binary, tokens binary, own binary"
NETWORK_BYTES = 4 * sum(int(np.prod(s)) for s in SHAPES.values())


def numbered(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Class numbers; vocabulary: hashes of frequent words, most frequent first."""
    order = np.argsort(vocabulary)
    ordered = vocabulary[order]
    rest = OWN + (hashes % np.uint64(CLASSES)).astype(np.int64)
    if not len(vocabulary):
        return rest
    at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    return np.where(ordered[at] == hashes, order[at], rest)


def start(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {name: np.zeros(shape, np.float32) for name, shape in SHAPES.items()}
    for name in ("embed", "class", "word"):
        net[name] = rng.normal(0, 0.3, SHAPES[name]).astype(np.float32)
    net["scale"] += 0.5
    return net


def contexts(ids: np.ndarray) -> np.ndarray:
    """Numbers at PLACES around each word."""
    padded = np.concatenate([[BORDER, BORDER], ids, [BORDER, BORDER]])
    return np.stack([padded[2 + p : 2 + p + len(ids)] for p in PLACES], 1)


def forward(net: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray) -> tuple:
    """log p of each word, with what the backward pass needs; that is in order of the numbers."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    edges = np.searchsorted(ids, np.arange(0, VOCABULARY + 1, CLASSES))
    placed = net["embed"] * net["scale"][:, None]
    seen = placed[0][around[:, 0]]
    for k in range(1, len(PLACES)):
        seen += placed[k][around[:, k]]
    hidden = np.tanh(seen[order] + net["bias"])
    x = np.empty((2, len(ids), CLASSES), hidden.dtype)  # over classes, within the class
    np.matmul(hidden, net["class"], out=x[0])
    x[0] += net["class_bias"]
    for c in range(CLASSES):
        if edges[c] < edges[c + 1]:
            np.matmul(hidden[edges[c] : edges[c + 1]], net["word"][c], out=x[1, edges[c] : edges[c + 1]])
    x[1] += net["word_bias"][ids // CLASSES]
    if not net.get("small"):  # else no logit can overflow
        x -= x.max(-1, keepdims=True)
    n = np.arange(len(ids))
    picked = x[0, n, ids // CLASSES] + x[1, n, ids % CLASSES]
    np.exp(x, out=x)
    sums = x.sum(-1, keepdims=True)
    log_p = np.empty(len(ids), hidden.dtype)
    log_p[order] = picked - np.log(sums).sum(0)[:, 0]
    return log_p, hidden, x, sums, order, edges


def gradients(net: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log-likelihood."""
    _, hidden, x, sums, order, edges = forward(net, around, ids)
    around, ids = around[order], ids[order]
    n = np.arange(len(ids))
    x /= -sums
    x[0, n, ids // CLASSES] += 1
    x[1, n, ids % CLASSES] += 1
    out = {name: np.zeros(shape, np.float32) for name, shape in SHAPES.items()}
    out["class"], out["class_bias"] = hidden.T @ x[0], x[0].sum(0)
    up, across, back = np.empty_like(hidden), hidden.T, net["word"].transpose(0, 2, 1)
    for c in range(CLASSES):
        if edges[c] < edges[c + 1]:
            at = slice(edges[c], edges[c + 1])
            here = x[1, at]
            np.matmul(across[:, at], here, out=out["word"][c], casting="same_kind")
            np.matmul(here, back[c], out=up[at])
    there = np.flatnonzero(np.diff(edges))
    out["word_bias"][there] = np.add.reduceat(x[1], edges[there])
    up += x[0] @ net["class"].T
    up *= 1 - hidden * hidden
    out["bias"] = up.sum(0)
    placed = np.zeros((len(PLACES), VOCABULARY + 1, WIDTH), np.float32)
    for k in range(len(PLACES)):
        by = np.argsort(around[:, k].astype(np.uint16), kind="stable")
        own = around[by, k]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        placed[k, own[first]] = np.add.reduceat(up[by], first)
    out["scale"], out["embed"] = np.einsum("pvd,vd->pd", placed, net["embed"]), np.einsum("pvd,pd->vd", placed, net["scale"])
    return {name: g / len(ids) for name, g in out.items()}


def step(net: dict[str, np.ndarray], memory: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray) -> None:
    """One Adagrad step uphill."""
    bounded(net)
    for name, g in gradients(net, around, ids).items():
        memory[name] += g * g
        net[name] += RATE * g / (np.sqrt(memory[name]) + 1e-6)


def bounded(net: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """net, with a note whether its logits, whose hidden values lie between -1 and 1, stay below 60."""
    net["small"] = max(np.abs(net[w]).sum(-2).max() + np.abs(net[b]).max() for w, b in (("class", "class_bias"), ("word", "word_bias"))) < 60
    return net


def packed(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[name].ravel() for name in SHAPES]).astype("<f4")


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name], at = flat[at : at + size].reshape(shape).astype(np.float32), at + size
    return out


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks of about BLOCK words of docs(doc_id, text): each word's place among the block's distinct hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pseudo_likelihood")
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        size, block = 0, TaskContext.get().partitionId() << 33

        def rows() -> pa.RecordBatch:
            own, tokens = np.unique(np.concatenate(held), return_inverse=True)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "n_own": pa.array([len(own)], pa.int64()), "doc_ids": pa.array([np.array([x or 0 for x in ids], "<i8").tobytes()], pa.binary()), "nulls": pa.array([np.array([x is None for x in ids], bool).tobytes()], pa.binary()),
                "lengths": pa.array([np.array([len(x) for x in held], "<i8").tobytes()], pa.binary()), "tokens": pa.array([tokens.reshape(-1).astype("<u4").tobytes()], pa.binary()), "own": pa.array([own.astype("<u8").tobytes()], pa.binary()),
            })

        for part in slices(batches):
            hashes, before = word_hashes(part.column(1))
            for doc_id, a, b in zip(part.column(0).to_pylist(), before[:-1].tolist(), before[1:].tolist(), strict=True):
                held.append(hashes[a:b])
                ids.append(doc_id)
                size += len(held[-1])
                if size >= BLOCK or len(held) >= BLOCK:
                    yield rows()
                    held, ids, size, block = [], [], 0, block + 1
        if held:
            yield rows()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(docs.mapInArrow(run, _BLOCKS), "blocks")


def _by_bucket(own: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of hashes by bucket, where each bucket begins in it)."""
    bucket = (own % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def counted(blocks: DataFrame) -> tuple[np.ndarray, DataFrame, int]:
    """Counts of all words over all blocks.

    (hashes of the OWN most frequent words, most frequent first, ties by hash; for each block and
    bucket the counts of its words; number of buckets)
    """
    n_own = blocks.agg(F.coalesce(F.sum("n_own"), F.lit(0))).first()[0]
    n_buckets = int(max(64, partitions(blocks.sparkSession), n_own // 1_000_000))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            for block, tokens, own in zip(part["block"], part["tokens"], part["own"], strict=True):
                own = np.frombuffer(own, "<u8")
                n = np.bincount(np.frombuffer(tokens, "<u4"), minlength=len(own))
                order, edges = _by_bucket(own, n_buckets)
                rows = [b for b in range(n_buckets) if edges[b] < edges[b + 1]]
                cut = [order[edges[b] : edges[b + 1]] for b in rows]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows, pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "own": pa.array([own[c].tobytes() for c in cut], pa.binary()), "n": pa.array([n[c].astype("<i8").tobytes() for c in cut], pa.binary())})

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "<u8") for x in rows["own"]]
        own, at = np.unique(np.concatenate(parts), return_inverse=True)
        at = at.reshape(-1)
        n = np.bincount(at, np.concatenate([np.frombuffer(x, "<i8") for x in rows["n"]]), len(own)).astype(np.int64)
        top = np.lexsort((own, -n))[:OWN]
        back = [n[x].astype("<i8").tobytes() for x in np.split(at, np.cumsum([len(x) for x in parts])[:-1])]
        bucket = int(rows["bucket"].iloc[0])
        top_words = pd.DataFrame({"bucket": bucket, "word": own[top].astype("<u8").view("<i8"), "n": n[top], "block": 0, "counts": None})
        return pd.concat([top_words, pd.DataFrame({"bucket": bucket, "word": 0, "n": 0, "block": rows["block"].to_numpy(), "counts": back})])

    words = blocks.select("block", "tokens", "own").mapInArrow(count, "bucket long, block long, own binary, n binary").groupBy("bucket").applyInPandas(meet, "bucket long, word long, n long, block long, counts binary")
    words = written(words, "counts")
    top = words.where("counts is null").orderBy(F.col("n").desc(), "word").select("word").limit(OWN).collect()
    return np.array([r.word for r in top], "<i8").view("<u8"), words.where("counts is not null").select("block", "bucket", "counts"), n_buckets


def shared(blocks: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """For each number that words share how often they occur, all together."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(VOCABULARY, np.int64)
        for part in rows_of(batches):
            for tokens, own in zip(part["tokens"], part["own"], strict=True):
                n += np.bincount(numbered(np.frombuffer(own, "<u8"), vocabulary)[np.frombuffer(tokens, "<u4")], minlength=VOCABULARY)
        yield pa.RecordBatch.from_pydict({"number": pa.array(range(CLASSES), pa.int64()), "n": pa.array(n[OWN:], pa.int64())})

    out = np.zeros(CLASSES, np.int64)
    for r in blocks.select("tokens", "own").mapInArrow(add, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect():
        out[r.number] = r.n
    return out


def frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of the OWN most frequent words of all documents, most frequent first, ties by hash."""
    return counted(encoded(docs))[0]


def _bordered(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words with two border marks around each text, where each word stands in it)."""
    at = np.arange(len(ids)) + 2 * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    padded = np.full(len(ids) + 2 * len(lengths) + 2, BORDER, np.int64)
    padded[at] = ids
    return padded, at


def trained(docs: DataFrame, vocabulary: np.ndarray, seed: int = 0) -> np.ndarray:
    """The averaged network, packed."""
    return _trained(encoded(docs), vocabulary, seed)


def _trained(blocks: DataFrame, vocabulary: np.ndarray, seed: int) -> np.ndarray:
    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = start(seed)
        memory = {name: np.full(shape, 1e-6, np.float32) for name, shape in SHAPES.items()}
        around, targets = np.empty((0, len(PLACES)), np.int64), np.empty(0, np.int64)  # fewer words than a batch
        total, last, size = 0, 0, LEAST_BATCH
        for part in rows_of(batches):
            for lengths, tokens, own in zip(part["lengths"], part["tokens"], part["own"], strict=True):
                lengths = np.frombuffer(lengths, "<i8")
                ids = numbered(np.frombuffer(own, "<u8"), vocabulary)[np.frombuffer(tokens, "<u4")]
                padded, at = _bordered(ids, lengths)
                done = 0
                while done < len(at):
                    here = slice(done, done + size - len(targets))
                    done = min(here.stop, len(at))
                    around, targets = np.concatenate([around, padded[at[here, None] + PLACES]]), np.concatenate([targets, ids[here]])
                    if len(targets) == size:
                        step(net, memory, around, targets)
                        around, targets, total = around[:0], targets[:0], total + size
                        if total >= 32 * size:
                            size = min(2 * size, MOST_BATCH)
        if len(targets):
            step(net, memory, around, targets)
            total, last = total + len(targets), int(targets.sum())
        if total:
            cut = np.array_split(packed(net), CHUNKS)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int64()), "salt": pa.array([(last + total) % SALTS] * CHUNKS, pa.int64()), "weight": pa.array([total] * CHUNKS, pa.int64()), "part": pa.array([c.tobytes() for c in cut], pa.binary())})

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "part"])
        weight = rows["weight"].to_numpy(np.float64)
        flat = sum(w * np.frombuffer(x, "<f4").astype(np.float64) for w, x in zip(weight, rows["part"], strict=True)) / weight.sum()
        return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "salt": [0], "weight": [int(weight.sum())], "part": [flat.astype("<f4").tobytes()]})

    schema = "chunk long, salt long, weight long, part binary"
    parts = blocks.select("lengths", "tokens", "own").mapInArrow(train, schema)
    found = written(parts.groupBy("chunk", "salt").applyInPandas(mean, schema), "networks").groupBy("chunk").applyInPandas(mean, schema).orderBy("chunk").collect()
    return np.frombuffer(b"".join(bytes(r.part) for r in found), "<f4") if found else packed(start(seed))


def scores(docs: DataFrame, vocabulary: np.ndarray, network: np.ndarray) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean, n_unseen) for each row of docs(doc_id, text).

    Words that share a number are told apart by their counts in docs.
    """
    blocks = encoded(docs)
    return _scores(blocks, vocabulary, network, *counted(blocks)[1:])


def _scores(blocks: DataFrame, vocabulary: np.ndarray, network: np.ndarray, counts: DataFrame, n_buckets: int) -> DataFrame:
    together = shared(blocks, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_likelihood", pa.float64()), ("mean", pa.float64()), ("n_unseen", pa.int64())])

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        net = bounded(unpacked(network))
        doc_ids, nulls, lengths, tokens, own = (np.frombuffer(block.column(c)[0].as_py(), k) for c, k in (("doc_ids", "<i8"), ("nulls", bool), ("lengths", "<i8"), ("tokens", "<u4"), ("own", "<u8")))
        n = np.zeros(len(own), np.int64)
        if len(own):
            n[_by_bucket(own, n_buckets)[0]] = np.frombuffer(b"".join(known.sort_by("bucket").column("counts").to_pylist()), "<i8")
        ids = numbered(own, vocabulary)
        within = np.zeros(len(own))
        rest = ids >= OWN
        within[rest] = np.log(n[rest]) - np.log(together[ids[rest] - OWN])
        padded, at = _bordered(ids[tokens], lengths)
        log_p = within[tokens]
        for k in range(0, len(at), SLICE):
            here = at[k : k + SLICE]
            log_p[k : k + SLICE] += forward(net, padded[here[:, None] + PLACES], padded[here])[0]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        sums = np.round(np.diff(np.concatenate([[0.0], np.cumsum(log_p)])[ends]), 3)
        means = [s / k if k else None for s, k in zip(sums.tolist(), lengths.tolist(), strict=True)]
        # Words of a document that are all of the corpus's.
        pairs, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * max(len(own), 1) + tokens, return_counts=True)
        unseen = np.bincount(pairs // max(len(own), 1), times * (n[pairs % max(len(own), 1)] == times) if len(own) else None, len(lengths)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(lengths), pa.array(sums), pa.array(means, pa.float64()), pa.array(unseen)], schema=schema)

    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, "doc_id long, n_words long, log_likelihood double, mean double, n_unseen long")


def scored(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Count, train and score the same documents."""
    blocks = encoded(docs)
    vocabulary, *counts = counted(blocks)
    return _scores(blocks, vocabulary, _trained(blocks, vocabulary, seed), *counts)
