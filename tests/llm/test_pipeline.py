"""The pipeline against a plain version of itself, and its queries."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_corpus_operators import brute_groups, brute_links, brute_targets
from treeloom.llm import mixing, queries, repetition
from treeloom.llm.common import written


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    now = {i for i, r in rows.items() if repetition.measure(r.text)[6]}
    now = {min(g) for g in brute_groups([(i, rows[i].text) for i in now]).values()}
    near = brute_links([(i, rows[i].text) for i in now])
    now = {i for i in now if near[i][1] == i}
    frames = []
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, SMALL), name)
        frames.append(at)
        if name != "pieces":
            assert at.columns == docs.columns
    assert {r.doc_id for r in frames[2].collect()} == now and frames[2].count() == len(now)
    sizes = Counter()
    for i in now:
        sizes[rows[i].source] += len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text or ""))
    plan = {r.doc_id: r for r in mixing.mixed(frames[2]).collect()}
    targets = brute_targets(dict(sizes))
    assert all(abs(plan[i].target - targets[rows[i].source]) < 1e-6 * targets[rows[i].source] for i in now)
    assert Counter(r.doc_id for r in frames[3].collect()) == Counter({i: plan[i].copies for i in now if plan[i].copies})
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in frames[4].collect():
        assert r.ids == [1, *library.encode(rows[r.doc_id].text), 2] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids).encode()).hexdigest()
    assert corpus_pipeline.run(spark, SMALL).count() == frames[4].count()


def test_an_empty_table_and_further_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SMALL)
        assert at.count() == 0
    at = docs.limit(40).selectExpr("*", "1 AS n", "'x' AS digest", "2 AS ids", "cast(null AS string) AS `a b`")
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = written(stage(spark, at, SMALL), name)
        assert at.columns[-4:] == ["n", "digest", "ids", "a b"] and at.count()


def test_rows_without_ids_stay(spark):
    text = lambda n: " ".join(f"{n}w{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3) + " x"), (5, text(3) + " y"), (6, text(4)), (6, text(5)), (6, text(5) + " z"), (7, None), (8, text(1).upper())]
    at = spark.createDataFrame([(d, "l", "s", t) for d, t in rows], "doc_id long, lang string, source string, text string")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = written(stage(spark, at, SMALL), name)
        counts.append(sorted((str(r.doc_id), r.text.lower()) for r in at.collect()))
    assert len(counts[0]) == 9 and len(counts[1]) == 8
    # 1 with its capitals, 3 without id, and one of 6's near copies go.
    kept = Counter(d for d, _ in counts[2])
    assert kept == {"None": 1, "5": 1, "6": 2, "8": 1} and {t for d, t in counts[2] if d in ("None", "5", "8")} == {text(2), text(3) + " y", text(1)}


def test_queries_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        found, expected = queries.QUERIES[name](spark, SMALL).toPandas(), c.execute(sql).df()
        columns = sorted(found.columns)
        assert columns == sorted(expected.columns)
        assert sorted(map(str, found[columns].itertuples(index=False))) == sorted(map(str, expected[columns].itertuples(index=False))), name
