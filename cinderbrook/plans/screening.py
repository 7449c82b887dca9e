"""Which events of a site have a usable record around them: four ways to gate by flow bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percentile_band, segment_years
from ..operators.aggregates import linear_quantiles
from ..operators.windows import first_per_key, largest_with_ties

#: Quantile points of the six flow bands and the bands' labels.
POINTS = {"q025": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q975": 0.975}
BANDS = ("0-2.5", "2.5-25", "25-50", "50-75", "75-97.5", "97.5-100")
#: All but the outermost bands.
INNER = BANDS[1:5]
#: Flags of accepted records.
ACCEPTED = ("A", "A e")


def flow_bands(flow: DataFrame, site: str = "usgs_site", value: str = "flow") -> DataFrame:
    """Rows with the band of their flow among the site's quantiles (type 7)."""
    cuts = linear_quantiles(flow.dropna(subset=[value]), [site], value, POINTS)
    return flow.join(cuts, site).withColumn("band", percentile_band(F.col(value), [F.col(p) for p in POINTS], BANDS)).drop(*POINTS)


def accepted_only(flow: DataFrame, flag: str = "Flow_cd") -> DataFrame:
    return flow.where(F.col(flag).isin(*ACCEPTED))


def side(day: str, event_day: str, years: int):
    """'pre' in the years up to the event, 'post' in those behind it, else null."""
    return segment_years(F.col(day), F.col(event_day), years)


def band_counts(samples: DataFrame, events: DataFrame, *, years: int, site: str = "usgs_site", event: str = "event_id", event_day: str = "ig_date", day: str = "date") -> DataFrame:
    """A row per event of a sampled site, with its samples by side, and by side and band; 0 where there are none."""
    joined = events.join(samples.select(site, day, "band"), site).withColumn("side", side(day, event_day, years))
    by_band = [F.count_if((F.col("side") == s) & (F.col("band") == b)).alias(f"{s}_{b}") for s in ("pre", "post") for b in BANDS]
    totals = [F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("pre", "post")]
    return joined.groupBy(site, event, event_day, "per_cent_burned").agg(*totals, *by_band)


def gate_events(counts: DataFrame, *, least_pre: int, least_post: int, bands: Sequence[str], sides: Sequence[str]) -> DataFrame:
    """Events with enough samples on both sides and some in each of the bands on each of the sides."""
    ok = (F.col("n_pre") >= least_pre) & (F.col("n_post") >= least_post)
    for s in sides:
        for b in bands:
            ok &= F.col(f"`{s}_{b}`") > 0
    return counts.where(ok)


def best_event(gated: DataFrame, site: str = "usgs_site", event: str = "event_id") -> DataFrame:
    """The event that burned most of each site; of equals the smallest id."""
    return first_per_key(largest_with_ties(gated, [site], "per_cent_burned"), [site], [event])



def screen_largest_first(samples: DataFrame, flow: DataFrame, events: DataFrame, *, years: int = 4, least: tuple[int, int] = (10, 10), bands: Sequence[str] = INNER) -> DataFrame:
    """Each site's largest event, if enough samples (`least`: before, behind) lie on both sides and all `bands` of its record occur on both."""
    largest = best_event(events)
    return gate_events(band_counts(samples_in_bands(samples, flow), largest, years=years), least_pre=least[0], least_post=least[1], bands=bands, sides=("pre", "post"))


def screen_all_events(samples: DataFrame, flow: DataFrame, events: DataFrame, *, years: int = 5, least: tuple[int, int] = (10, 10), bands: Sequence[str] = INNER[:3]) -> DataFrame:
    """Of all events that pass, each site's largest; bands are those of its accepted record."""
    counts = band_counts(samples_in_bands(samples, accepted_only(flow)), events, years=years)
    return best_event(gate_events(counts, least_pre=least[0], least_post=least[1], bands=bands, sides=("pre", "post")))


def screen_sampled_days(samples: DataFrame, flow: DataFrame, events: DataFrame, *, years: int = 4, least: tuple[int, int] = (10, 10), bands: Sequence[str] = INNER) -> DataFrame:
    """As screen_all_events, with the bands of the flows on sampled days only."""
    days = samples.select("usgs_site", "date").distinct()
    sampled = flow.join(days, ["usgs_site", "date"], "left_semi")
    counts = band_counts(samples_in_bands(samples, sampled), events, years=years)
    return best_event(gate_events(counts, least_pre=least[0], least_post=least[1], bands=bands, sides=("pre", "post")))


def screen_before_only(samples: DataFrame, flow: DataFrame, events: DataFrame, *, years: int = 4, least: tuple[int, int] = (10, 1), bands: Sequence[str] = INNER) -> DataFrame:
    """Bands before the event only, by each event's own record in the years before it. Samples carry their flow."""
    windows = flow.dropna(subset=["flow"]).join(events.select("usgs_site", "event_id", "ig_date"), "usgs_site").where(side("date", "ig_date", years) == "pre")
    cuts = linear_quantiles(windows, ["usgs_site", "event_id"], "flow", POINTS)
    joined = events.join(samples.select("usgs_site", "date", "flow"), "usgs_site").join(cuts, ["usgs_site", "event_id"])
    joined = joined.withColumn("band", percentile_band(F.col("flow"), [F.col(p) for p in POINTS], BANDS)).withColumn("side", side("date", "ig_date", years))
    by_band = [F.count_if((F.col("side") == s) & (F.col("band") == b)).alias(f"{s}_{b}") for s in ("pre", "post") for b in BANDS]
    totals = [F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("pre", "post")]
    counts = joined.groupBy("usgs_site", "event_id", "ig_date", "per_cent_burned").agg(*totals, *by_band)
    return best_event(gate_events(counts, least_pre=least[0], least_post=least[1], bands=bands, sides=("pre",)))


def samples_in_bands(samples: DataFrame, flow: DataFrame) -> DataFrame:
    """Samples with the band of their site's flow on their day."""
    return samples.select("usgs_site", "date").join(flow_bands(flow).select("usgs_site", "date", "band"), ["usgs_site", "date"])


def hydrograph_flag(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples with Pass_Hydro: YES if the group's samples fall into all six bands."""
    wide = samples.groupBy(*keys).agg(*(F.count_if(F.col("band") == b).alias(b) for b in BANDS))
    every = F.lit(True)
    for b in BANDS:
        every &= F.col(f"`{b}`") > 0
    return samples.join(wide.select(*keys, F.when(every, "YES").otherwise("NO").alias("Pass_Hydro")), list(keys))


def records_by_event(samples: DataFrame, events: DataFrame, site: str = "usgs_site", day: str = "date", event_day: str = "ig_date", event: str = "event_id", analyte: str = "analyte") -> DataFrame:
    """(analyte, site, event, Before, After): samples of each event's site; without an event, or on its day, they are Before."""
    joined = samples.join(events, site, "outer")
    after = F.coalesce(F.col(day) > F.col(event_day), F.lit(False))
    return joined.groupBy(analyte, site, event).agg(F.count_if(~after & F.col(day).isNotNull()).alias("Before"), F.count_if(after).alias("After"))
