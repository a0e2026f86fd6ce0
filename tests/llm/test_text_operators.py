"""Operators that work text by text: quality rules, token files, SentencePiece, token counts."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from treeloom.llm import common, piece_codec, repetition, token_counts, token_files

ODD = ["", " ", "\n\n", "a", "\x1c \x85\n\x85\n\x85", "a b\na b", "a " * 300, "x" * 5000, "  a  b\t", "▁x ▁y", "日本 \U0001f600 \x00", "It's <|endoftext|> A<|STARTOFTEXT|>b ΑΣ é", "don't'll 'S", "́", "a ́b", "c\xa0d　e", "word, word. a., (b),", None]


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_counts(spark):
    for t in ODD + texts(spark):
        assert repetition.measure(t)[:5] == brute_counts(t)


def test_window_hashes_are_the_windows():
    rng = random.Random(1)
    for n in (1, 5, 7, 10, 20):
        ids = np.array([rng.randrange(3) for _ in range(200)])
        known = {}
        for i, h in enumerate(repetition.window_hashes(ids, n)):
            assert known.setdefault(tuple(ids[i : i + n]), h) == h
        assert len(set(known.values())) == len(known)


def test_a_collision_changes_nothing(monkeypatch):
    monkeypatch.setattr(repetition, "window_hashes", lambda ids, n: np.zeros(max(0, len(ids) - n + 1), np.uint64))
    t = "a b c d e f g a b c d e h"
    assert repetition.measure(t)[4] == brute_counts(t)[4] == 10


def test_quality_keeps_and_drops(spark):
    good = " ".join(f"w{i}" for i in range(200))
    rows = [(1, good, "x"), (2, None, "x"), (3, "few words", "x"), (4, "a b c d e f " * 50, "x"), (5, " ".join(f"w{i}***%%%" for i in range(100)), None), (1, good, "x"), (None, good, "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("n_words", F.lit("clash"))
    assert sorted((str(r.doc_id), r.kept, r.n_words) for r in repetition.keep_clean(d).collect()) == [("1", "x", "clash"), ("1", "x", "clash"), ("None", "y", "clash")]
    assert {r.doc_id: (r.base_failed, r.kept) for r in repetition.quality_rules(d).collect() if r.doc_id} == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False)}
    assert repetition.quality_rules(d.limit(0)).count() == 0 == repetition.keep_clean(d.limit(0)).count()


WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_are_the_librarys(spark):
    for most in (100, 10_000):
        e = token_files.WordEncoder(WORDS)
        e.cache.most = most
        assert e.by_word
        for t in ODD + texts(spark)[:60]:
            assert e.encode([t])[0].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids
    many = [*ODD, "hello", "hello,", "a.b, c.", "<|ENDOFTEXT|>a, B.", *texts(spark)]
    expected = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in many]
    ids, n = e.encode(many)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == expected
    for order in (1, -1):  # one at a time, by an encoder that knows nothing yet
        e = token_files.WordEncoder(WORDS)
        assert all(e.encode([t])[0].tolist() == x for t, x in list(zip(many, expected, strict=True))[::order])
    assert not token_files.splits_at_spaces(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("vocabulary", [49408, 1 << 20])
def test_token_files(spark, vocabulary, tmp_path):
    import zlib

    rows = [(5, "hello world"), (3, ""), (9, None), (None, "b"), (-2, "c " * 5000), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1))
    folder = f"file://{tmp_path}/t"
    index = token_files.write_token_files(d, WORDS, 2, folder, vocabulary, n_parts=3)
    found = token_files.token_rows(spark, folder, vocabulary).orderBy("start").collect()
    e, at = token_files.WordEncoder(WORDS), 0
    for row, (doc, text) in zip(found, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = e.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert index.agg(F.sum("n_tokens")).first()[0] == at
    assert token_files.encoded(d.limit(0), WORDS, 2).count() == 0


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_the_librarys(spark, codec):
    rng = random.Random(2)
    letters = "aaabbe thert  .,▁é\n\t<>s/0x41日本ﬁ\U0001f600\x00-'\"=_"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    for t in ODD + made + ["ababab" * 300, " " * 300 + "x"] + texts(spark):
        expected = [1, *codec.library.encode(t or ""), 2]
        assert codec.encode(t) == expected and codec.decode(np.array(expected)) == codec.library.decode(expected)


def test_decoding_any_ids(codec):
    rng = random.Random(3)
    for _ in range(1500):
        x = [rng.choice([rng.randrange(32000), rng.randrange(3, 300), rng.randrange(259, 600)]) for _ in range(rng.randrange(12))]
        x = [1, *x] if rng.random() < 0.3 else [1, *x, 2] if rng.random() < 0.5 else x
        assert codec.decode(np.array(x, int)) == codec.library.decode(x)


@pytest.mark.parametrize("most, most_bytes", [(50, 1 << 20), (1 << 20, 2000)])
def test_small_caches_give_the_same(spark, codec, most, most_bytes):
    known, codec.cache = codec.cache, common.RunCache(most, most_bytes)
    try:
        for t in texts(spark)[:40]:
            assert codec.encode(t) == [1, *codec.library.encode(t), 2]
            codec.cache.places([], codec._learn)  # makes room
            assert codec.cache.bytes <= most_bytes
    finally:
        codec.cache = known


def test_a_task_of_another_operator_empties_caches():
    token_files.encoder(WORDS).encode(["some words"])
    common.only("token_files")
    assert token_files.encoder.cache_info().currsize == 1
    common.only("ngram_join")
    assert token_files.encoder.cache_info().currsize == 0


def test_piece_frames(spark, codec):
    import hashlib

    model = public_tokenizers.path("piece_bpe_32k.model")
    d = spark.createDataFrame([(1, None), (2, "a  b"), (2, "a  b"), (None, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for r in piece_codec.encode_decode(d, model).collect():
        t = "a  b" if r.doc_id == 2 else ""
        ids = [1, *codec.library.encode(t), 2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest())
    assert [r.ids for r in piece_codec.encode_ids(d.where("doc_id = 1"), model).collect()] == [[1, 2]]
    assert piece_codec.encode_decode(d.limit(0), model).count() == 0 == piece_codec.encode_ids(d.limit(0), model).count()


def test_counts_after_edits():
    c = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(4)
    letters = "ab th'se  \n\t.,1é'll"
    for size in [0, 5, 50, 400, 3000] * 40:
        t = "".join(rng.choice(letters) for _ in range(size))
        x = token_counts.CountedText(t, c)
        for _ in range(6):
            a = rng.randrange(len(t) + 1)
            b = min(len(t), a + rng.choice([0, 0, 3, 30, 400]))
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 600])))
            t = t[:a] + new + t[b:]
            x.edit(a, b, new)
            assert x.text() == t and x.n_chars == len(t) and x.n_tokens == len(c.encoding.encode_ordinary(t))


def test_counts_touch_little():
    c = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    x = token_counts.CountedText("some words here " * 20000, c)
    x.edit(150_000, 150_003, "new")
    assert x.n_encoded < 12


def test_count_frames(spark):
    d = spark.createDataFrame([(1, None), (2, "a b c"), (2, "a b c"), (None, "x")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    out = token_counts.counted(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(r.n_tokens for r in out) == [0, 1, 3, 3] and len({r.n_tokens_after for r in out if r.doc_id == 2}) == 1
    for r in out:
        t = {1: "", 2: "a b c"}.get(r.doc_id, "x")
        for a, b, new in token_counts.edits_of(r.doc_id, len(t), 8):
            t = t[:a] + new + t[b:]
        assert (r.n_chars_after, r.n_tokens_after) == (len(t), len(token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encoding.encode_ordinary(t)))
    assert token_counts.counted(d.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
