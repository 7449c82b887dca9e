"""Mixing sources to target weights, in DataFrame operations only.

Rows get a hash-random key; the leading digits of the key range-partition each source, so that a source's order is that of its
ranges and, within a range, of the keys. Sizes are summed per range, the sums are added up along the ranges of each source, and
rows add their own place within the range: prefix sums over a source of any size with no task that sees all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch

#: Weights of the sources in code point order, null last; they repeat.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST_EPOCHS = 3
#: Hexadecimal digits of the key that name a range: 16 ** RANGE_DIGITS ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): all words shared by weight, no target above `most` times its source's size.

    Sources in order of size to weight: those that stop come first. With k of them stopped, the rest share what those leave; the
    share a weight gets is fixed by the first k at which no further source stops. The table has a row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    stopped, left = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(after)
    share = (F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - stopped) / left
    ranked = ranked.withColumn("share", share)
    first = F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "share"))
    settled = F.min(first).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["share"]
    target = F.least(F.col("cap"), F.coalesce(settled, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    A source's rows stand in the order of MD5(seed:id). Its budget is the target rounded to whole words: each row is taken once
    for every whole epoch in the budget, and what remains is cut off the order's start, in the middle of a row if need be. So a
    source's taken words are its budget exactly. Ties in key and id stand by size. Null or wordless texts have size 0 and take
    0; a null source is a source of its own; a null id has a key as any other. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "mix")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    rows = scratch.keep(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "rows")
    targets = source_targets(rows, weights, most)
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(along), F.lit(0)))
    same_source = ranges.source.eqNullSafe(targets.source)
    ranges = ranges.join(targets, same_source).select(ranges.source.alias("in_source"), F.col("range").alias("in_range"), "range_start", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(ranges, placed.source.eqNullSafe(ranges.in_source) & (F.col("range") == F.col("in_range")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("in_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, with all columns, once for each time it takes any of their words.

    The one row of each source that its budget cuts stays whole. Rows that share an id are all taken as often as the one of them
    that is taken most.
    """
    mixed = mix_sources(df, id_col, text_col, source_col).where("taken > 0")
    times = mixed.groupBy(F.col(id_col).alias("__mix_id")).agg(F.max(F.ceil(F.col("taken") / F.col("size")).cast("int")).alias("__times"))
    joined = df.join(times, F.col(id_col).eqNullSafe(F.col("__mix_id")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*df.columns)
