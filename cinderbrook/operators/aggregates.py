"""Aggregations: group statistics, weighted means, quantiles, pivots, shares and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_mean(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name or value))


def group_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, sd, missing and n of each group; groups without any value are left out. sd of a single value is null."""
    found = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count_if(F.col(value).isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))
    return found.where("mean is not null")


def weighted_mean(value: Column, weight: Column, valid: Column) -> Column:
    """Aggregate over the valid rows; null if they have no weight."""
    return F.sum(F.when(valid, value * weight)) / F.nullif(F.sum(F.when(valid, weight)), F.lit(0.0))


def coverage(weight: Column, valid: Column) -> Column:
    """Aggregate: the valid rows' part of all weight."""
    return F.coalesce(F.sum(F.when(valid, weight)), F.lit(0.0)) / F.nullif(F.sum(weight), F.lit(0.0))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ordered_array(value: str, order: str) -> Column:
    """Aggregate: the values in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def discrete_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Quantiles that are values of the group (PERCENTILE_DISC), exact."""
    return df.groupBy(*keys).agg(*(F.expr(f"percentile_disc({p}) within group (order by `{value}`)").alias(name) for name, p in points.items()))


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Quantiles by linear interpolation between order statistics (type 7), exact."""
    return df.groupBy(*keys).agg(*(F.percentile(F.col(value).cast("double"), p).alias(name) for name, p in points.items()))


def pivot_max(df: DataFrame, keys: Sequence[str], label: str, value: str, labels: Sequence[str]) -> DataFrame:
    """A column per label, the largest value of its rows."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(label) == one, F.col(value))).alias(str(one)) for one in labels))


def pivot_counts(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str], fill: int | None = None) -> DataFrame:
    """A column per label with its number of rows; labels a group lacks are null, or `fill`."""
    found = df.groupBy(*keys).pivot(label, list(labels)).agg(F.count(F.lit(1)))
    return found if fill is None else found.select(*keys, *(F.coalesce(F.col(f"`{x}`"), F.lit(fill)).alias(str(x)) for x in labels))


def pivot_measures(df: DataFrame, keys: Sequence[str], label: str, measures: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """A column measure_label for each of both."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(label) == one, F.col(m))).alias(f"{m}_{one}") for m in measures for one in labels))


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def complete_counts(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """Number of rows for each group and each label, 0 included."""
    counts = df.groupBy(*keys).agg(*(F.count_if(F.col(label) == one).alias(str(one)) for one in labels))
    return counts.unpivot(list(keys), [str(x) for x in labels], label, "n")


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, name: str = "percent") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.try_divide(F.lit(100.0) * F.col(value), total))


def mean_of_sums(df: DataFrame, keys: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """The mean over the inner groups of their sums."""
    return df.groupBy(*keys, *inner).agg(F.sum(value).alias("total")).groupBy(*keys).agg(F.avg("total").alias("mean_total"), F.count(F.lit(1)).alias("n_inner"))


def standardised(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / sd as new columns ending in _z; over groups, or over the whole table through one aggregated row."""
    stats = [f for c in columns for f in (F.avg(c).alias(f"__{c}_mean"), F.stddev_samp(c).alias(f"__{c}_sd"))]
    joined = df.join(df.groupBy(*keys).agg(*stats), list(keys), "left") if keys else df.crossJoin(F.broadcast(df.agg(*stats)))
    return joined.select(*df.columns, *(F.try_divide(F.col(c) - F.col(f"__{c}_mean"), F.col(f"__{c}_sd")).alias(f"{c}_z") for c in columns))


def standardised_by_site(df: DataFrame, site: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Scores of site-level columns over one row per site, joined back to all rows."""
    first = df.withColumn("__rn", F.row_number().over(Window.partitionBy(site).orderBy(*order))).where("__rn = 1").select(site, *columns)
    return df.join(standardised(first, columns).select(site, *(f"{c}_z" for c in columns)), site, "left")


def with_overall(df: DataFrame, group: str, keys: Sequence[str], aggregates: Sequence[Column], label: str = "all") -> DataFrame:
    """The aggregates by (group, keys) and by keys alone, the latter under the label."""
    each = df.groupBy(group, *keys).agg(*aggregates)
    return each.unionByName(df.groupBy(*keys).agg(*aggregates).withColumn(group, F.lit(label)))


def endpoint_degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    ends = edges.select(F.col(source).alias("vertex")).unionByName(edges.select(F.col(target).alias("vertex")))
    return ends.groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"))


def nested(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "data") -> DataFrame:
    """A row per group with its rows as an array of structs, in their own order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def unnested(df: DataFrame, name: str = "data") -> DataFrame:
    return df.select(*(c for c in df.columns if c != name), F.inline(name))


def largest_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key with its largest value, where rows only differ in it."""
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def class_composition(df: DataFrame, keys: Sequence[str], label: str, area: str, total: str) -> DataFrame:
    """Area of each class, in percent of all classes of the group and of the group's own total area."""
    by_class = df.groupBy(*keys, label).agg(F.sum(area).alias("class_area"), F.max(total).alias("__total"))
    return share_of_group(by_class, keys, "class_area", "percent_of_event").withColumn("percent_of_basin", F.try_divide(F.lit(100.0) * F.col("class_area"), F.col("__total"))).drop("__total")
