"""The queries of this folder and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import html_wrappers, mixing, ngram_join, piece_codec, pseudo_likelihood, repetition, stream_dedup, token_counts, token_files, tool_calls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49408)


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_calls(_table(spark, sf_dir, "conversations"))


def op4_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.marked(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extracted(_table(spark, sf_dir, "pages"))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.scored(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_piece_codec": op2_piece_codec,
    "op3_tool_calls": op3_tool_calls,
    "op4_stream_dedup": op4_stream_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_html_wrappers": op7_html_wrappers,
    "op8_pseudo_likelihood": op8_pseudo_likelihood,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}

#: Row-wise regular expression of white space, as SQL string.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
goal AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS goal, sum(weight) AS all_weight FROM r),
o AS (SELECT *, 2 * source_size / weight::DOUBLE AS ratio FROM r),
c AS (SELECT ratio, sum(2 * source_size) OVER w AS capped, sum(weight) OVER w AS capped_weight, lead(ratio) OVER (ORDER BY ratio) AS next_ratio FROM o WINDOW w AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
levels AS (
  SELECT (goal / all_weight)::DOUBLE AS level, 0 AS capped FROM goal WHERE goal / all_weight < (SELECT min(ratio) FROM o)
  UNION ALL
  SELECT (goal - capped) / (all_weight - capped_weight), capped FROM c, goal WHERE all_weight > capped_weight AND ratio <= (goal - capped) / (all_weight - capped_weight) AND (next_ratio IS NULL OR next_ratio = ratio OR next_ratio > (goal - capped) / (all_weight - capped_weight))
),
t AS (SELECT r.source, source_size, least((2 * source_size)::DOUBLE, weight * (SELECT level FROM levels ORDER BY capped DESC LIMIT 1)) AS target FROM r),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
draws AS (
  SELECT d.doc_id, d.size, q.*, k, d.size * (floor(rate) + CASE WHEN ('0x' || substr(md5(k::VARCHAR || ':' || d.doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, range({mixing.SEEDS}) AS seeds(k)
),
seeds AS (SELECT source, arg_min(k, (off, k)) AS k FROM (SELECT source, k, abs(sum(taken) - any_value(target)) AS off FROM draws GROUP BY source, k) GROUP BY source)
SELECT doc_id, size, source_size, target, taken, CASE WHEN size > 0 THEN taken // size ELSE (floor(rate) + CASE WHEN ('0x' || substr(md5(draws.k::VARCHAR || ':' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT END AS copies
FROM draws JOIN seeds ON draws.source IS NOT DISTINCT FROM seeds.source AND draws.k = seeds.k
"""


def _later(n: int) -> str:
    """Characters of words in windows of n words that equal an earlier window."""
    return f"""
w{n} AS (SELECT doc_id, pos, word, n_words, CASE WHEN pos + {n - 1} <= n_words THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS gram FROM words),
g{n} AS (SELECT doc_id, pos, word, gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1 AS later, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM w{n}),
c{n} AS (SELECT doc_id, sum(CASE WHEN later_here THEN length(word) ELSE 0 END) AS later_chars, count(*) FILTER (twice_here) AS twice_words FROM (
  SELECT doc_id, word, bool_or(later) OVER w AS later_here, bool_or(twice) OVER w AS twice_here FROM g{n} WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) GROUP BY doc_id)"""


_LIMITS = repetition.Limits()
OP10_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS list FROM documents),
words AS (SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS pos, len(list) AS n_words FROM texts),
{_later(5)}, {_later(10)}, {_later(20)},
lines AS (SELECT doc_id, line, trim(line, E' \t\n\x0b\x0c\r') AS bare, row_number() OVER (PARTITION BY doc_id, line) AS n FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM texts)),
l AS (SELECT doc_id, count(*) FILTER (n > 1) AS n_dup_lines, coalesce(sum(length(bare)) FILTER (n > 1), 0) AS dup_line_chars, sum(length(bare)) AS line_chars FROM lines WHERE bare <> '' GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(list)::BIGINT AS n_words, coalesce(list_sum(list_transform(list, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c5.twice_words, 0)::BIGINT AS n_repeat_words, coalesce(c5.later_chars, 0) AS d5, coalesce(c10.later_chars, 0) AS d10, coalesce(c20.later_chars, 0) AS d20, coalesce(dup_line_chars, 0) AS dl, coalesce(line_chars, 0) AS lc
  FROM texts t LEFT JOIN c5 USING (doc_id) LEFT JOIN c10 USING (doc_id) LEFT JOIN c20 USING (doc_id) LEFT JOIN l USING (doc_id)
),
b AS (SELECT *, n_words < {_LIMITS.least_words} OR 100 * n_repeat_words > {_LIMITS.repeat_percent} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND d5 <= {_LIMITS.dup_5} * word_chars AND d10 <= {_LIMITS.dup_10} * word_chars AND d20 <= {_LIMITS.dup_20} * word_chars AND dl <= {_LIMITS.dup_lines} * greatest(lc, 1) AND n_symbols <= {_LIMITS.symbols} * word_chars AS kept
FROM b
"""

OP5_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON a = d.doc_id
"""

ORACLES: dict[str, str] = {"op5_ngram_join": OP5_SQL, "op4_stream_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op10_quality_rules": OP10_SQL}
