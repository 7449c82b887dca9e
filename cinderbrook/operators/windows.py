"""Window functions with explicit frames, null order and tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, previous: str = "previous", following: str = "following") -> DataFrame:
    """The column's value in the row before and in the row behind, in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(previous, F.lag(column).over(w)).withColumn(following, F.lead(column).over(w))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in an order that should leave no ties."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def largest_with_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.withColumn("__rk", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last()))).where("__rk = 1").drop("__rk")


def change(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """The column less its value in the row before."""
    return df.withColumn(name, F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def rolling_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, name: str) -> DataFrame:
    """The sum over the row and the rows - 1 before it; null where the group has fewer."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == rows, F.sum(value).over(w)))


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def surrogate_keys(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Consecutive numbers from 1 in a global order, without sorting the table in one task.

    Ranges of the order are numbered each on its own and moved by the sizes of the ranges before.
    """
    ranged = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before, "__range").withColumn(name, F.col("__at") + F.col("__before")).drop("__range", "__at", "__n", "__before")


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, name: str = "chunk") -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.floor((at - 1) / size).cast("int"))


def with_group_value(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """An aggregate of the group on each of its rows."""
    return df.withColumn(name, value.over(Window.partitionBy(*keys)))


def consecutive_pairs(df: DataFrame, keys: Sequence[str], value: str, least_gap: float = 1e-7) -> DataFrame:
    """(from, to) of neighbouring distinct values that lie more than the gap apart."""
    w = Window.partitionBy(*keys).orderBy(value)
    paired = df.select(*keys, value).distinct().withColumn("to_value", F.lead(value).over(w)).withColumn("segment_index", F.row_number().over(w))
    return paired.where(F.col("to_value") - F.col(value) > least_gap).withColumnRenamed(value, "from_value")


def sampled_keys(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n keys chosen by a hash: the same ones on every run, whatever the partitions."""
    return df.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
