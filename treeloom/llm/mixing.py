"""Mixing sources to target weights (operator 6).

One aggregation sums the words of each source. Targets share 150 % of all words by weight, none
above twice its source's size: min(2 * size, weight * level), where the level is found by a few
passes over the table of sources, of which only sums reach the driver. The repetition rate of a
source is target / size; each document is emitted floor(rate) times, and once more when a draw
seeded by its hash falls below the fraction.

The draw is the hash of (seed, doc_id). Of SEEDS seeds each source takes the one whose taken words
come nearest its target, all of which one aggregation sums; so a source with few, very uneven
documents also comes near. A given seed's draw of a document depends on nothing else and falls below
the fraction with just that probability; choosing among seeds changes it the more, the fewer and the
more uneven a source's documents are.

Scale: texts are reduced to a word count in the scan, and nothing but (source, sums) is shuffled,
after partial aggregation, so a source with a third of all rows is one row from each task. The
table of sources returns to the rows by a broadcast if it has at most MOST_SOURCES rows of at most
MOST_BYTES, else by a join that salts frequent sources.

Edge cases: a null or empty text has size 0, and takes nothing. A null source is a source of its
own, ordered last. A source without words has target 0. Repeated doc_ids get the same draw. An
empty table gives an empty result. `mixture` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import WORD, hot_counts, ranked, salted_join, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEEDS = 16
MOST_SOURCES, MOST_BYTES = 4096, 4 << 20


def draw(doc_id: Column, seed: Column) -> Column:
    """A number of [0, 1) from the md5 of "seed:doc_id": its first 12 hexadecimal digits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs) with weight and target."""
    sizes = written(ranked(sizes, [F.col("source").asc_nulls_last()], "rank").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "targets")
    goal = share * float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    top = cap * F.col("source_size")
    level, known = None, -1
    while True:
        full = F.lit(False) if level is None else top <= F.col("weight") * level
        capped, open_weight, n = sizes.agg(F.coalesce(F.sum(F.when(full, top)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count(F.when(full, 1))).first()
        if n == known or not open_weight:
            break
        known, level = n, (goal - capped) / open_weight
    target = F.lit(0.0) if level is None else F.least(top.cast("double"), F.col("weight") * F.lit(level))
    return sizes.withColumn("target", target)


class Plan:
    """What the table of sources decides: rates and seeds, and how to bring them to rows."""

    def __init__(self, docs: DataFrame) -> None:
        size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
        self.sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
        sources = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        targets = written(source_targets(sources).select(_key(), "n", "source_size", "target", rate.alias("rate")), "rates")
        rows, size = targets.agg(F.count("*"), F.coalesce(F.sum(F.length("_key") + 64), F.lit(0))).first()
        self.hot = None if rows <= MOST_SOURCES and size <= MOST_BYTES else written(hot_counts(targets, "_key"), "hot")
        sums = self.with_sources(self.sizes.withColumn("_key", _key()), targets.select("_key", "rate")).groupBy("_key").agg(*(F.sum(F.when(draw(F.col("doc_id"), F.lit(k)) < _fraction(), F.col("size")).otherwise(0)).alias(f"d{k}") for k in range(SEEDS)))
        wanted = F.col("target") - F.floor("rate") * F.col("source_size")
        best = reduce(F.least, (F.struct(F.abs(F.col(f"d{k}") - wanted).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)))
        self.seeds = written(targets.join(sums, "_key").select("_key", "source_size", "target", "rate", best["seed"].alias("seed")), "seeds")

    def with_sources(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), "_key") if self.hot is None else salted_join(left, right, "_key", self.hot, F.col("doc_id"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("_key")


def _fraction() -> Column:
    return F.col("rate") - F.floor("rate")


def _copies() -> Column:
    return (F.floor("rate") + F.when(draw(F.col("doc_id"), F.col("seed")) < _fraction(), 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row of docs(doc_id, text, source)."""
    plan = Plan(docs)
    out = plan.with_sources(plan.sizes.withColumn("_key", _key()), plan.seeds).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """Each row of docs as often as the mix takes it, with the columns of docs."""
    plan = Plan(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")).withColumn("_key", _key())
    out = plan.with_sources(rows, plan.seeds.select("_key", "rate", "seed")).select("_row", _copies().cast("int").alias("copies")).where("copies > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_row.*")
