"""What rules ask of rows of many documents at once, as joins, windows and aggregations.

The evaluator answers these questions within one document; here a row is a heading, a key or an
event, and `group` the columns that say to which document it belongs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def later(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows that come after the first of their group, in the order of columns that no two rows share.

    The first is a minimum, which tasks find in part before the shuffle, so that no task sorts a group.
    """
    first = rows.groupBy(*group).agg(F.min(F.struct(*order)).alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group))
    return rows.alias("a").join(first.alias("b"), same).where(F.struct(*(F.col(f"a.{c}") for c in order)) > F.col("_first")).select("a.*")


def named_before(rows: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """The rows whose name an earlier row of their group has too."""
    return later(rows.where(F.col(name).isNotNull()), [*group, name], order)


def steps(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str = "gap") -> DataFrame:
    """rows with the difference of value from the row before; null for the first of a group. A group is sorted in one task."""
    return rows.withColumn(name, value - F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))


def missing_names(rows: DataFrame, has: DataFrame, key: str, names: list[str], name: str = "field") -> DataFrame:
    """(key, field): which of the names the row of each key has no value for; has: columns of these names by a unique key."""
    there = has.select(key, F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in names))).alias("_has"))
    wanted = F.array(*map(F.lit, names))
    return rows.select(key).join(there, key, "left").select(key, F.explode(F.array_except(wanted, F.coalesce("_has", F.array().cast("array<string>")))).alias(name))


def repeated(rows: DataFrame, value: str) -> DataFrame:
    """(value, n) of values that stand more than once."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def without(rows: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """The rows whose key no pin has."""
    return rows.join(pins.select(key).distinct(), key, "left_anti")


def header_union(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables under the union of their headers, in the order in which names first come; null where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
