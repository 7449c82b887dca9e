"""Standardising water chemistry and building one daily series per analyte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PATTERN_FACTORS, convert_by_code, convert_by_pattern, matches, unit_by_code
from ..operators.joins import only_in

#: Parameter codes of each analyte, its unit, and the patterns that pick its rows from other sources.
ANALYTES = {
    "nitrate": {"codes": ("00618", "00631", "71851"), "unit": "mg/L as N", "pattern": "nitrate|no3"},
    "ammonium": {"codes": ("71846", "00608"), "unit": "mg/L as N", "pattern": "ammoni|nh4"},
    "spcond": {"codes": ("00094", "00095", "90095"), "unit": "uS/cm", "pattern": "cond"},
    "orthop": {"codes": ("00660", "00671"), "unit": "mg/L as P", "pattern": "phosph|po4"},
}


def standardise_chemistry(results: DataFrame, study_sites: DataFrame) -> DataFrame:
    """Surface-water samples of the study sites with value_std and units_std.

    Quality-control samples and bed sediment go, and with them rows whose type or fraction is null: a negated match keeps none.
    """
    kept = results.where(F.col("ActivityMediaName").ilike("water")).where(matches(F.col("ActivityMediaSubdivisionName"), "Surface"))
    kept = kept.where(~matches(F.col("ActivityTypeCode"), "quality")).where(~matches(F.col("ResultSampleFractionText"), "bed sediment"))
    code, unit = F.col("USGSPCode"), F.col("`ResultMeasure.MeasureUnitCode`")
    kept = kept.withColumn("value_std", convert_by_code(F.col("ResultMeasureValue"), code)).withColumn("units_std", unit_by_code(unit, code, "mg/L as element"))
    return only_in(kept, study_sites, ["usgs_site"])


def analyte_series(standard: DataFrame, others: DataFrame, analyte: str, *, excluded_sites: str = "%bell%") -> DataFrame:
    """(usgs_site, date, value_std, analyte, units_std): daily means of the analyte's codes, with the other sources' rows.

    Other sources' rows keep their own label, so that a site and date may come twice; equal rows come once.
    """
    spec = ANALYTES[analyte]
    daily = standard.where(F.col("USGSPCode").isin(*spec["codes"])).groupBy("usgs_site", F.col("ActivityStartDate").alias("date")).agg(F.avg("value_std").alias("value_std"))
    daily = daily.select("usgs_site", "date", "value_std", F.lit(analyte).alias("analyte"), F.lit(spec["unit"]).alias("units_std"))
    rows = others.where(matches(F.col("analyte"), spec["pattern"])).where(~F.col("usgs_site").ilike(excluded_sites))
    value = convert_by_pattern(F.col("mean"), F.col("unit"), PATTERN_FACTORS.get(analyte, ()))
    rows = rows.select("usgs_site", "date", value.alias("value_std"), "analyte", F.lit(spec["unit"]).alias("units_std"))
    return daily.unionByName(rows).distinct()


def coalesce_analytes(df: DataFrame, preferred: str = "NO3_NO2", fallback: str = "NO3") -> DataFrame:
    """(usgs_site, date, value_std, analyte_std): the preferred analyte's mean where there is one, else the fallback's."""
    means = df.groupBy("usgs_site", "date").agg(*(F.avg(F.when(F.col("analyte_std") == a, F.col("value_std"))).alias(a) for a in (preferred, fallback)))
    found = means.withColumn("value_std", F.coalesce(preferred, fallback)).withColumn("analyte_std", F.when(F.col(preferred).isNotNull(), preferred).otherwise(fallback))
    return found.where("value_std is not null").select("usgs_site", "date", "value_std", "analyte_std")


def left_censored(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """log_value and censored ('left' at or below the group's limit of quantification, its least value; else 'none')."""
    limit = df.groupBy(*keys).agg(F.min(value).alias("loq"))
    joined = df.join(limit, keys)
    return joined.withColumn("censored", F.when(F.col(value) <= F.col("loq"), "left").otherwise("none")).withColumn("log_value", F.ln(F.greatest(value, "loq")))


def share_at_limit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: its least value as limit, and how many values are at it."""
    limit = df.groupBy(*keys).agg(F.min(value).alias("loq"))
    joined = df.join(limit, keys)
    found = joined.groupBy(*keys).agg(F.max("loq").alias("loq"), F.count(value).alias("n"), F.count_if(F.col(value) == F.col("loq")).alias("n_at_loq"))
    return found.withColumn("percent_at_loq", F.try_divide(F.lit(100.0) * F.col("n_at_loq"), F.col("n")))
