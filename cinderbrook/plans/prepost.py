"""Observations before and after event groups, gated by coverage of flow quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import event_set
from ..operators.joins import same_sets, window_join
from ..operators.windows import first_per_key

#: Quartiles of flow that a window must hold observations in.
NEEDED = (2, 3, 4)
GROUP = ("usgs_site", "year", "start_date", "end_date")


def paired(observations: DataFrame, flow: DataFrame) -> DataFrame:
    """Observations with the flow and quartile of their site and day."""
    return observations.join(flow.select("usgs_site", "date", "flow", "quartile"), ["usgs_site", "date"])


def counts_before_after(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(site, start, end, events, before_count, after_count): observations on either side, however far away."""
    joined = pairs.select("usgs_site", "date").join(groups.select("usgs_site", "start_date", "end_date", "events"), "usgs_site")
    return joined.groupBy("usgs_site", "start_date", "end_date", "events").agg(F.count_if(F.col("date") < F.col("start_date")).alias("before_count"), F.count_if(F.col("date") > F.col("end_date")).alias("after_count"))


def complete_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.dropna(subset=["value_std", "flow", "quartile"])


def quartile_gate(segments: Sequence[str], needed: Sequence[int] = NEEDED) -> Column:
    """Aggregate: each needed quartile has an observation in each segment."""
    gate = F.lit(True)
    for s in segments:
        for q in needed:
            gate &= F.count_if((F.col("segment") == s) & (F.col("quartile") == q)) > 0
    return gate


def gated_groups(pairs: DataFrame, groups: DataFrame, *, years: int = 3, segments: Sequence[str] = ("before", "after"), needed: Sequence[int] = NEEDED) -> DataFrame:
    """Event groups whose windows hold the needed quartiles, with the windows' counts."""
    windows = window_join(complete_pairs(pairs).select("usgs_site", "date", "quartile"), groups.select(*GROUP, "cum_fire_area"), "usgs_site", "date", "start_date", "end_date", years)
    counts = windows.groupBy(*GROUP, "cum_fire_area").agg(F.count_if(F.col("segment") == "before").alias("before_count"), F.count_if(F.col("segment") == "after").alias("after_count"), quartile_gate(segments, needed).alias("__ok"))
    return counts.where("__ok").drop("__ok")


def largest_group(gated: DataFrame) -> DataFrame:
    """The largest group of each site; of equals the earliest. A null area counts as largest, as in a descending order by default."""
    return first_per_key(gated, ["usgs_site"], [F.col("cum_fire_area").desc_nulls_first(), F.col("start_date").asc_nulls_last(), F.col("end_date").asc_nulls_last()])


def window_observations(pairs: DataFrame, chosen: DataFrame, *, years: int = 3) -> DataFrame:
    """Each complete observation in either window of the chosen groups, with its segment and the groups' counts."""
    return window_join(complete_pairs(pairs).select("usgs_site", "date", "value_std", "flow", "quartile"), chosen, "usgs_site", "date", "start_date", "end_date", years)


def prepost_all(pairs: DataFrame, groups: DataFrame, *, years: int = 3) -> DataFrame:
    return window_observations(pairs, gated_groups(pairs, groups, years=years).drop("cum_fire_area"), years=years)


def prepost_largest(pairs: DataFrame, groups: DataFrame, *, years: int = 3, segments: Sequence[str] = ("before", "after")) -> DataFrame:
    """prepost_all for the largest valid group of each site, with its sorted event set; segments=('before',) gates before only."""
    chosen = largest_group(gated_groups(pairs, groups, years=years, segments=segments)).drop("cum_fire_area")
    events = groups.select(*GROUP, event_set(F.col("events")).alias("events"))
    return window_observations(pairs, chosen.join(events, list(GROUP)), years=years)


def summary_all(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Event groups with their unbounded counts; sets are compared regardless of order."""
    return same_sets(groups, counts.drop("start_date", "end_date"), ["usgs_site"])


def summary_largest(groups: DataFrame, largest: DataFrame) -> DataFrame:
    return groups.join(largest.select("usgs_site", "start_date", "end_date", "before_count", "after_count"), ["usgs_site", "start_date", "end_date"])


def export_order(df: DataFrame) -> DataFrame:
    """By site and year, the observations before an event group ahead of those after it."""
    return df.orderBy("usgs_site", "year", "start_date", F.desc("segment"), "date")
