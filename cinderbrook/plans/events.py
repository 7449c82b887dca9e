"""Events and their sets: intervals between them, season groups, running areas, coverage by a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import event_set, is_summer
from ..operators.joins import only_in


def event_intervals(events: DataFrame, site: str = "usgs_site", event: str = "event_id", day: str = "ig_date") -> DataFrame:
    """(site, ignition_date, event, pre_lo, pre_hi, post_lo, post_hi): [previous, this) and [this, next) for each event.

    Events of one day are one occasion. A null bound is open; occasions with an empty interval don't arise, as dates differ.
    """
    days = events.groupBy(site, F.col(day).alias("ignition_date")).agg(event_set(F.collect_list(event)).alias("events"))
    w = Window.partitionBy(site).orderBy("ignition_date")
    days = days.select(site, "ignition_date", "events", F.lag("ignition_date").over(w).alias("pre_lo"), F.col("ignition_date").alias("pre_hi"), F.col("ignition_date").alias("post_lo"), F.lead("ignition_date").over(w).alias("post_hi"))
    return days.withColumn(event, F.explode("events")).select(site, "ignition_date", event, "pre_lo", "pre_hi", "post_lo", "post_hi")


def event_areas(events: DataFrame, sites: DataFrame, site: str = "usgs_site") -> DataFrame:
    """Events with their areas in km² and the burned part of the site in percent, each rounded to two places; none is left out."""
    joined = events.join(sites.select(site, "catch_area"), site)
    return joined.withColumn("per_cent_burned", F.round(F.try_divide(F.lit(100.0) * F.col("fire_catch_area"), F.col("catch_area")), 2)).withColumn("fire_catch_area", F.round("fire_catch_area", 2)).withColumn("catch_area", F.round("catch_area", 2))


def season_groups(events: DataFrame, site: str = "usgs_site", event: str = "event_id", day: str = "ig_date", area: str = "area") -> DataFrame:
    """(site, year, start_date, end_date, events, fire_area): one group per site and summer, one per site and day at other times."""
    year, summer = F.year(day), is_summer(F.col(day))
    group_day = F.when(summer, F.lit(None)).otherwise(F.col(day))
    found = events.where(F.col(day).isNotNull()).groupBy(site, year.alias("year"), group_day.alias("__day"))
    found = found.agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"), F.array_sort(F.collect_set(event)).alias("events"), F.sum(area).alias("fire_area"))
    return found.drop("__day").distinct()


def event_ranges(groups: DataFrame, sites: DataFrame, site: str = "usgs_site") -> DataFrame:
    """Season groups with their neighbours, days between them, burned percentages and running totals.

    The previous end follows the order of ends, the next start that of starts, so overlapping groups may give negative days.
    """
    ends, starts = Window.partitionBy(site).orderBy("end_date", "start_date"), Window.partitionBy(site).orderBy("start_date", "end_date")
    found = groups.withColumn("previous_end_date", F.lag("end_date").over(ends)).withColumn("next_start_date", F.lead("start_date").over(starts))
    found = found.withColumn("days_since", F.datediff("start_date", "previous_end_date")).withColumn("days_until", F.datediff("next_start_date", "end_date"))
    found = found.withColumn("all_fire_area", F.sum("fire_area").over(ends.rowsBetween(Window.unboundedPreceding, 0)))
    percent = lambda c: F.round(F.try_divide(F.lit(100.0) * F.col(c), F.col("catch_area")), 2)
    found = found.withColumnRenamed("fire_area", "cum_fire_area").join(sites.select(site, "catch_area"), site)
    return found.withColumn("cum_per_cent_burned", percent("cum_fire_area")).withColumn("all_per_cent_burned", percent("all_fire_area"))


def coverage_by_series(events: DataFrame, flow: DataFrame, site: str = "usgs_site", day: str = "ig_date", flow_day: str = "date", flag: str = "Flow_cd") -> DataFrame:
    """Events within a site's record: first and last day, flagged records, and days of record before and behind the event."""
    spans = flow.groupBy(site).agg(F.min(flow_day).alias("min_date_q"), F.max(flow_day).alias("max_date_q"), F.count(flag).alias("records_q"))
    joined = only_in(events, flow, [site]).join(spans, site)
    joined = joined.withColumn("days_q_pre_fire", F.datediff(day, "min_date_q")).withColumn("days_q_post_fire", F.datediff("max_date_q", day))
    return joined.where("days_q_pre_fire >= 0 and days_q_post_fire >= 0")


def presence_log(sites: DataFrame, parts: dict[str, DataFrame], site: str = "usgs_site") -> DataFrame:
    """has_<part> for each site, and any_missing; ids are compared in lower case."""
    key = F.lower(site).alias(site)
    found = sites.select(key).distinct()
    for name, part in parts.items():
        found = found.join(part.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), site, "left")
    has: list[Column] = [F.coalesce(f"has_{name}", F.lit(False)) for name in parts]
    found = found.select(site, *(h.alias(f"has_{name}") for name, h in zip(parts, has)))
    return found.withColumn("any_missing", ~F.forall(F.array(*(f"has_{name}" for name in parts)), lambda x: x))


def distance_hits(sets: DataFrame, distances: DataFrame, site: str = "usgs_site", event: str = "event_id") -> DataFrame:
    """How many members of the sites' event sets have a distance."""
    each = sets.select(F.lower(site).alias(site), F.explode("events").alias(event)).distinct()
    known = distances.select(F.lower(site).alias(site), event).distinct().withColumn("__has", F.lit(True))
    return each.join(known, [site, event], "left").groupBy(F.coalesce("__has", F.lit(False)).alias("has_distance")).agg(F.count(F.lit(1)).alias("n"))


def sites_without(sites: DataFrame, present: DataFrame, site: str, present_site: str, prefix: str = "(?i)usgs-") -> DataFrame:
    """Sites that aren't present under their id without its prefix."""
    bare = sites.select(site).distinct().withColumn("bare_id", F.regexp_replace(site, prefix, ""))
    return bare.join(present.select(F.regexp_replace(present_site, prefix, "").alias("bare_id")).distinct(), "bare_id", "left_anti")


def named_features(features: DataFrame, name: str, length: str, pattern: str, n: int = 4) -> DataFrame:
    """Rows of the n longest names by summed length, and of names that match the pattern."""
    longest = features.groupBy(name).agg(F.sum(length).alias("total")).orderBy(F.desc("total"), name).limit(n).select(name)
    priority = features.where(F.col(name).rlike(f"(?i){pattern}")).select(name)
    return only_in(features, longest.unionByName(priority).distinct(), [name])
