"""Joins: semi and anti filters, windows around events, look-backs, nearest values, stars and pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import event_set, years_after, years_before

#: A dimension of at most so many rows is broadcast; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 100_000


def dimension(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is checked to have at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def only_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose keys are in the other table."""
    return df.join(keys.select(*on), list(on), "left_semi")


def not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't in the other table. A null key counts as not in it (unlike NOT IN, which would drop all rows)."""
    return df.join(keys.select(*on), list(on), "left_anti")


def with_events_of(df: DataFrame, sets: DataFrame, event_col: str, events_col: str) -> DataFrame:
    """Rows whose event is a member of any set: an equality join on the sets' members."""
    members = sets.select(F.explode(events_col).alias(event_col)).distinct()
    return only_in(df, members, [event_col])


def or_else(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """The first source, and for keys that it lacks the second."""
    return first.unionByName(not_in(second, first, on))


def same_sets(left: DataFrame, right: DataFrame, on: Sequence[str], events_col: str = "events", how: str = "inner") -> DataFrame:
    """Join on keys and on event sets regardless of order; the set comes out sorted."""
    sort = lambda df: df.withColumn(events_col, event_set(F.col(events_col)))
    return sort(left).join(sort(right), [*on, events_col], how)


def segment(day: Column, start: Column, end: Column, years: int) -> Column:
    """'before' in [start - years, start), 'after' in (end, end + years]; null elsewhere, the events' own days included."""
    return F.when((day >= years_before(start, years)) & (day < start), "before").when((day > end) & (day <= years_after(end, years)), "after")


def window_join(observations: DataFrame, events: DataFrame, site: str, day: str, start: str, end: str, years: int) -> DataFrame:
    """Observations of a site with each of its events in whose windows they lie, and their segment."""
    joined = observations.join(events, site)
    return joined.withColumn("segment", segment(F.col(day), F.col(start), F.col(end), years)).where("segment is not null")


def look_back(observations: DataFrame, events: DataFrame, site: str, day: str, event_day: str, amount: str, months: int = 120) -> DataFrame:
    """Each observation row with the sum, the number and the age of the latest event in the months up to it; 0 where there are none."""
    keyed = observations.select(site, day).distinct()
    past = events.select(site, F.col(event_day).alias("__event_day"), F.col(amount).alias("__amount"))
    inside = F.col("__event_day").between(F.add_months(F.col(day), -months), F.col(day))
    found = keyed.join(past, site).where(inside).groupBy(site, day).agg(F.sum("__amount").alias("amount_sum"), F.count("__event_day").alias("n_events"), F.max("__event_day").alias("__last"))
    found = found.withColumn("days_since", F.datediff(F.col(day), "__last")).drop("__last")
    joined = observations.join(found, [site, day], "left")
    return joined.na.fill(0, ["amount_sum", "n_events", "days_since"])


def members(df: DataFrame, events_col: str, event_col: str = "event_id", position_col: str = "position") -> DataFrame:
    """A row per member of the array, numbered from 1."""
    others = [c for c in df.columns if c != events_col]
    return df.select(*others, F.posexplode(events_col).alias("__at", event_col)).withColumn(position_col, F.col("__at") + 1).drop("__at")


def outer_all(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of several tables on the same keys."""
    return reduce(lambda a, b: a.join(b, list(on), "outer"), tables)


def shared_columns_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both tables name."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def star(base: DataFrame, dimensions: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins of a base with each dimension; the small ones are broadcast."""
    return reduce(lambda df, side: df.join(dimension(side[0]), list(side[1]), "left"), dimensions, base)


def ordered_pairs(df: DataFrame, key: str, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows with key_1 < key_2 that agree in `on` (a grid cell, a region); columns end in _1 and _2."""
    one, two = (df.select(*(F.col(c).alias(c if c in on else f"{c}_{k}") for c in df.columns)) for k in (1, 2))
    return one.join(two, list(on)).where(F.col(f"{key}_1") < F.col(f"{key}_2"))


def nearest_value(points: DataFrame, grid: DataFrame, site: str, x: str, grid_x: str, values: Sequence[str]) -> DataFrame:
    """Each point with the values of its site's grid row nearest in x, the lower of two equally near; null where a site has no grid.

    Points and grid rows are sorted together: the nearest row is the last one before the point or the first one behind it, so
    nothing is compared pairwise.
    """
    row = F.struct(F.col(grid_x).alias("x"), *(F.col(v) for v in values))
    payload = points.columns
    marked = points.select(F.col(site).alias("__site"), F.col(x).alias("__x"), F.struct(*payload).alias("__point"), F.lit(None).alias("__row"))
    every = marked.unionByName(grid.select(F.col(site).alias("__site"), F.col(grid_x).alias("__x"), row.alias("__row")), allowMissingColumns=True)
    upward = Window.partitionBy("__site").orderBy(F.col("__x").asc_nulls_first(), F.col("__row").isNull())
    downward = Window.partitionBy("__site").orderBy(F.col("__x").desc_nulls_last(), F.col("__row").isNull())
    below = F.last("__row", ignorenulls=True).over(upward.rowsBetween(Window.unboundedPreceding, 0))
    above = F.last("__row", ignorenulls=True).over(downward.rowsBetween(Window.unboundedPreceding, 0))
    found = every.withColumn("__below", below).withColumn("__above", above).where("__point is not null")
    lower = F.col("__above").isNull() | (F.abs(F.col("__x") - F.col("__below.x")) <= F.abs(F.col("__above.x") - F.col("__x")))
    best = F.when(F.col("__x").isNull(), F.lit(None)).when(F.col("__below").isNotNull() & lower, F.col("__below")).otherwise(F.col("__above"))
    return found.withColumn("__best", best).select(*(F.col(f"__point.{c}").alias(c) for c in payload), *(F.col(f"__best.{v}").alias(v) for v in values))


def nearest_neighbour(points: DataFrame, targets: DataFrame, group: str, distance: Column, point_key: str, target_key: str) -> DataFrame:
    """Each point with the target of its group at the least distance, the smaller key of equals."""
    joined = points.join(targets, group).withColumn("distance", distance)
    return joined.groupBy(group, point_key).agg(F.min_by(F.struct(target_key, "distance"), F.struct("distance", target_key)).alias("__best")).select(group, point_key, f"__best.{target_key}", "__best.distance")


def value_grid(df: DataFrame, low: str, high: str, n: int, name: str = "x") -> DataFrame:
    """n evenly spaced values from low to high for each row."""
    step = (F.col(high) - F.col(low)) / (n - 1)
    return df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(name, F.col(low) + F.col("__k") * step).drop("__k")
