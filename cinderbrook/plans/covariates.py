"""Covariates rolled up over event sets by area weight, behind quality gates, and the wide export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import event_set, numeric_text
from ..operators.aggregates import coverage, weighted_mean
from ..operators.joins import members, star
from ..operators.quality import QualityError, require_columns, require_labels, require_unique

#: Classes and what one counts in the severity index.
SEVERITY = {"low": 1, "moderate": 2, "high": 3}
COVER_GROUPS = ("forest", "shrub", "grass", "urban", "ag", "barren")


def exploded_sets(sets: DataFrame, site: str = "usgs_site") -> DataFrame:
    """(site, events, event_id, n_events): a row per member, the set sorted."""
    keyed = sets.select(site, event_set(F.col("events")).alias("events")).distinct().withColumn("set", F.col("events"))
    return members(keyed, "set").withColumn("n_events", F.size("events")).drop("position")


def roll_up(sets: DataFrame, values: DataFrame, weights: DataFrame, columns: Mapping[str, Column], *, bad: Column | None = None, site: str = "usgs_site") -> DataFrame:
    """For each event set the weighted means of the columns over events with value and positive weight, their coverage and flags.

    values: one row per (site, event_id); weights: (site, event_id, weight). has_missing: some event has no value; has_bad: some
    event's value is there but unusable.
    """
    joined = exploded_sets(sets, site).join(values.withColumn("__there", F.lit(True)), [site, "event_id"], "left").join(weights, [site, "event_id"], "left")
    aggregates = []
    for name, column in columns.items():
        valid = column.isNotNull() & F.col("weight").isNotNull()
        aggregates += [weighted_mean(column, F.col("weight"), valid).alias(name), coverage(F.col("weight"), valid).alias(f"{name}_coverage")]
    first = next(iter(columns.values()))
    is_bad = bad if bad is not None else F.col("__there") & first.isNull()
    missing = F.count_if(F.col("__there").isNull()).alias("n_missing")
    return joined.groupBy(site, "events", "n_events").agg(*aggregates, F.sum("weight").alias("total_weight"), missing, F.count_if(is_bad).alias("n_bad"), F.count_if(first.isNotNull()).alias("n_good"))


def index_roll_up(sets: DataFrame, evi: DataFrame, weights: DataFrame) -> DataFrame:
    """Vegetation index given as text: texts that are no numbers are bad, and reported as mixed only beside good ones."""
    number = numeric_text(F.col("median_post_evi"))
    found = roll_up(sets, evi.select("usgs_site", "event_id", "median_post_evi"), weights, {"weighted_evi": number}, bad=number.isNull())
    return found.withColumn("has_missing_evi", F.col("n_bad") > 0).withColumn("has_bad_data", (F.col("n_bad") > 0) & (F.col("n_good") > 0))


def severity_index(severity: DataFrame) -> DataFrame:
    """(site, event_id, severity_index): the plain sum if an event has one class, the sum by 1, 2, 3 if it has more; null if any value or class is unusable."""
    label, value = F.lower(F.trim("fire_severity")), F.col("severity_value")
    per_class = {c: F.sum(F.when(label == c, value)) for c in SEVERITY}
    n_classes = F.count_distinct(F.when(label.isin(*SEVERITY) & value.isNotNull(), label))
    plain = sum((F.coalesce(x, F.lit(0.0)) for x in per_class.values()), F.lit(0.0))
    graded = sum((F.coalesce(x, F.lit(0.0)) * SEVERITY[c] for c, x in per_class.items()), F.lit(0.0))
    invalid = F.count_if(value.isNull() | label.isNull() | ~label.isin(*SEVERITY))
    found = severity.groupBy("usgs_site", "event_id").agg(plain.alias("plain"), graded.alias("graded"), n_classes.alias("n_classes"), invalid.alias("n_invalid"))
    index = F.when((F.col("n_invalid") > 0) | (F.col("n_classes") == 0), None).when(F.col("n_classes") == 1, F.col("plain")).otherwise(F.col("graded"))
    return found.select("usgs_site", "event_id", index.alias("severity_index"))


def severity_roll_up(sets: DataFrame, severity: DataFrame, weights: DataFrame) -> DataFrame:
    found = roll_up(sets, severity_index(severity), weights, {"weighted_severity": F.col("severity_index")})
    return found.withColumn("has_missing_severity", F.col("n_missing") > 0).withColumn("has_bad_data", F.col("n_bad") > 0)


def cover_roll_up(sets: DataFrame, cover: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted means of the six cover groups; an event counts only with exactly one non-null row per group."""
    by_group = [F.max(F.when(F.col("landcover_group") == g, F.col("group_value"))).alias(g) for g in COVER_GROUPS]
    most = F.greatest(*(F.count_if(F.col("landcover_group") == g) for g in COVER_GROUPS))
    invalid = F.count_if(F.col("group_value").isNull() | F.col("landcover_group").isNull() | ~F.coalesce(F.col("landcover_group").isin(*COVER_GROUPS), F.lit(False)))
    wide = cover.groupBy("usgs_site", "event_id").agg(*by_group, ((most <= 1) & (invalid == 0)).alias("__valid"))
    columns = {f"weighted_{g}": F.when(F.col("__valid"), F.coalesce(F.col(g), F.lit(0.0))) for g in COVER_GROUPS}
    found = roll_up(sets, wide, weights, columns, bad=F.col("__there") & ~F.col("__valid"))
    return found.withColumn("has_missing_cover", F.col("n_missing") > 0).withColumn("has_bad_data", F.col("n_bad") > 0)


def strict_gate(rolled: DataFrame, *, reject_missing: bool) -> DataFrame:
    """The roll-up, if no set of several events is flawed; raises otherwise.

    Flaws are bad values, a total weight that isn't positive, and with reject_missing also events without a value.
    """
    flawed = (F.col("n_bad") > 0) | (F.lit(reject_missing) & (F.col("n_missing") > 0))
    no_weight = ~F.coalesce(F.col("total_weight") > 0, F.lit(False))
    several = F.col("n_events") > 1
    n_flawed, n_weightless = rolled.agg(F.count_if(several & flawed), F.count_if(several & no_weight)).first()
    if n_flawed or n_weightless:
        raise QualityError(f"{n_flawed} event sets with unusable values, {n_weightless} without weight")
    return rolled


def severity_sum(sets: DataFrame, severity: DataFrame) -> DataFrame:
    """Per site: the sum over its events of 1, 2 and 3 times the areas of low, moderate and high severity."""
    factor = F.lit(0.0)
    for c, f in SEVERITY.items():
        factor = F.when(F.col("fire_severity") == c, F.lit(float(f))).otherwise(factor)
    each = exploded_sets(sets).select("usgs_site", "event_id").distinct()
    return each.join(severity, ["usgs_site", "event_id"]).groupBy("usgs_site").agg(F.sum(factor * F.col("severity_value")).alias("severity_sum"))


@dataclass
class CovariateTables:
    """The right-hand sides of the wide export, each with at most one row per key."""

    ecoregion: DataFrame
    ranges: DataFrame
    elevation: DataFrame
    land_cover: DataFrame
    classifications: DataFrame
    evi: DataFrame
    severity: DataFrame


def covariate_export(base: DataFrame, tables: CovariateTables, labels: Sequence[str], group: Sequence[str] = ("usgs_site", "start_date", "end_date")) -> DataFrame:
    """Observations with all covariates of their site and event set; a missing covariate is null, no observation is lost or doubled.

    Raises if a site has a classification twice, or one that isn't among the labels.
    """
    require_columns(base, [*group, "events"])
    require_unique(tables.classifications, ["usgs_site", "fire_classification"])
    require_labels(tables.classifications, "fire_classification", labels)
    wide = tables.classifications.groupBy("usgs_site").pivot("fire_classification", list(labels)).agg(F.max("classification_value"))
    sides = [(tables.ecoregion, ["usgs_site"]), (tables.ranges, list(group)), (tables.elevation, ["usgs_site"]), (tables.land_cover, ["usgs_site"]), (wide, ["usgs_site"])]
    keyed = [(df.withColumn("events", event_set(F.col("events"))), ["usgs_site", "events"]) for df in (tables.evi, tables.severity)]
    return star(base.withColumn("events", event_set(F.col("events"))), [*sides, *keyed])


def histogram_classes(df: DataFrame, codes: DataFrame, site: str = "usgs_site") -> DataFrame:
    """Classes of histogram texts with their pixels and percentages."""
    from ..functions.scalars import parse_histogram
    from ..operators.aggregates import share_of_group

    rows = df.select(site, F.explode(parse_histogram(F.col("histogram"))).alias("class", "pixels"))
    rows = rows.select(site, F.col("class").try_cast("int").alias("class"), F.col("pixels").try_cast("double").alias("class_pixels")).where("class is not null")
    return share_of_group(rows, [site], "class_pixels", "class_percent").join(codes, "class", "left")
