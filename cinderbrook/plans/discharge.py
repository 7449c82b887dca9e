"""Daily discharge: union of sources, quartile bands, complete calendars, ingest and screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quartile_code
from ..operators.aggregates import discrete_quantiles, duplicate_keys
from ..operators.joins import not_in, only_in
from ..operators.quality import require_columns, require_unique
from ..operators.windows import first_per_key


def union_discharge(gauged: DataFrame, others: DataFrame, study_sites: DataFrame) -> DataFrame:
    """(usgs_site, Date, Flow, Flow_cd): non-negative flows of the study sites and of other sources; equal rows come once."""
    one = only_in(gauged.where("Flow >= 0"), study_sites, ["usgs_site"]).select("usgs_site", "Date", "Flow", "Flow_cd")
    two = others.where("mean >= 0").select("usgs_site", F.col("date").alias("Date"), F.col("mean").alias("Flow"), F.lit(None).cast("string").alias("Flow_cd"))
    return one.unionByName(two).distinct()


def with_quartiles(flow: DataFrame, site: str = "usgs_site", value: str = "Flow") -> DataFrame:
    """quartile 1 to 4 by the site's discrete quartiles."""
    cuts = discrete_quantiles(flow, [site], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    banded = flow.join(cuts, site).withColumn("quartile", quartile_code(F.col(value), F.col("p25"), F.col("p50"), F.col("p75")))
    return banded.drop("p25", "p50", "p75")


def calendar(flow: DataFrame, site: str, day: str) -> DataFrame:
    """Every site and day between the site's first and last one."""
    span = flow.groupBy(site).agg(F.min(day).cast("date").alias("lo"), F.max(day).cast("date").alias("hi"))
    return span.select(site, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(day))


def complete_calendar(flow: DataFrame, site: str, day: str, value: str) -> DataFrame:
    """The series with a null row for each missing day between a site's first and last one."""
    missing = not_in(calendar(flow, site, day), flow, [site, day])
    return flow.select(site, day, value).unionByName(missing.withColumn(value, F.lit(None).cast(flow.schema[value].dataType)))


def gap_screen(flow: DataFrame, site: str, day: str, value: str, *, most_missing: int = 100) -> DataFrame:
    """Rows of sites whose complete calendar has at most so many days without a value."""
    missing = complete_calendar(flow, site, day, value).groupBy(site).agg(F.count_if(F.col(value).isNull()).alias("n_missing"))
    return only_in(flow, missing.where(F.col("n_missing") <= most_missing), [site])


def record_screen(flow: DataFrame, site: str, day: str, value: str, *, years: int = 25, least_years: int = 10, most_missing: int = 25) -> DataFrame:
    """Rows of the last years of each site's record, for sites with enough years and no year with too many missing days."""
    last = flow.groupBy(site).agg(F.add_months(F.max(day), -12 * years).alias("__from"))
    recent = flow.join(last, site).where(F.col(day) >= F.col("__from")).drop("__from")
    by_year = complete_calendar(recent, site, day, value).groupBy(site, F.year(day).alias("year")).agg(F.count_if(F.col(value).isNull()).alias("missing"))
    bad = by_year.groupBy(site).agg(F.count_distinct("year").alias("n_years"), F.max("missing").alias("worst")).where((F.col("n_years") < least_years) | (F.col("worst") > most_missing))
    return not_in(recent, bad, [site])


def validate_discharge(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return require_unique(require_columns(df, columns), keys)


def append_new(present: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with the incoming rows whose keys are new, a log row of what came, was there and was added)."""
    unique = first_per_key(incoming, keys, order)
    added = not_in(unique, present, keys)
    n = F.count(F.lit(1))
    log = incoming.agg(n.alias("n_incoming")).crossJoin(unique.agg(n.alias("n_unique"))).crossJoin(added.agg(n.alias("n_added")))
    return present.unionByName(added), log.withColumn("n_present", F.col("n_unique") - F.col("n_added"))


def merge_supplements(baseline: DataFrame, supplements: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The baseline and what supplements add; the baseline wins, then earlier supplements, then the order within one."""
    merged = baseline
    for supplement in supplements:
        merged = merged.unionByName(not_in(first_per_key(supplement, keys, order), merged, keys))
    return merged


def coverage_summary(df: DataFrame, site: str, day: str, value: str) -> DataFrame:
    """Per site: first and last day, days with a value, missing days in between."""
    found = df.groupBy(site).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(value).alias("n_days"))
    return found.withColumn("n_missing", F.datediff("last_day", "first_day") + 1 - F.col("n_days"))


def to_fetch(sites: DataFrame, checkpoint: DataFrame, site: str, done: Sequence[str] = ("success_data", "success_empty")) -> DataFrame:
    """Sites that no earlier run finished."""
    return not_in(sites.select(site).distinct(), checkpoint.where(F.col("status").isin(*done)), [site])


def fetch_status(rows: DataFrame, requested: DataFrame, failed: DataFrame, site: str) -> DataFrame:
    """(site, status, n): success_data, success_empty or error for each requested site."""
    n = rows.groupBy(site).agg(F.count(F.lit(1)).alias("n"))
    joined = requested.select(site).distinct().join(n, site, "left").join(failed.select(site).distinct().withColumn("__failed", F.lit(True)), site, "left")
    status = F.when(F.col("__failed"), "error").when(F.col("n") > 0, "success_data").otherwise("success_empty")
    return joined.select(site, status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return duplicate_keys(df, keys).orderBy(F.desc("n"), *keys)


def fetch_start(samples: DataFrame, site: str, day: str) -> DataFrame:
    """The month before each site's first sample, and the number in its id."""
    found = samples.groupBy(site).agg(F.add_months(F.min(day), -1).alias("start_date"))
    return found.withColumn("site_no", F.regexp_extract(site, "([0-9]+)$", 1))
