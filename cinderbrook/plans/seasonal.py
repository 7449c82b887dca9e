"""Seasonal signal of daily discharge by the discrete Fourier transform, and anomalies from it.

Days are sorted by site within their partitions, and all whole sites of a batch are worked on at once, as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import years_after, years_before

#: Harmonics of the year that make up the seasonal signal.
HARMONICS = 3
#: m³/s below which a day counts as without flow.
NO_FLOW = 0.1

METRICS = "years int, n_days long, rms_signal double, rms_noise double, snr double, hsaf double, hsam double, lsaf double, lsam double, fpext double, naa double, sigma_hf double, sigma_lf double, zero_days double"


def seasonal_signals(site: np.ndarray, n_sites: int, day_of_year: np.ndarray, log_flow: np.ndarray, harmonics: int = HARMONICS) -> np.ndarray:
    """The signal on each day: the mean and the strongest harmonics of its site's average year (day 366 takes day 365's place).

    Sites are numbers from 0. A day of the year that a site lacks has the site's mean.
    """
    day = np.minimum(day_of_year, 365) - 1
    known = np.isfinite(log_flow)
    cell = site[known] * 365 + day[known]
    sums = np.bincount(cell, log_flow[known], n_sites * 365).reshape(n_sites, 365)
    counts = np.bincount(cell, minlength=n_sites * 365).reshape(n_sites, 365)
    mean = per_site(np.bincount(site[known], log_flow[known], n_sites), np.bincount(site[known], minlength=n_sites), 0.0)
    spectrum = np.fft.rfft(np.where(counts > 0, sums / np.maximum(counts, 1), mean[:, None]), axis=1)
    strongest = np.argsort(-np.abs(spectrum[:, 1:]), axis=1, kind="stable")[:, :harmonics] + 1
    kept = np.zeros(spectrum.shape, bool)
    kept[:, 0] = True
    np.put_along_axis(kept, strongest, True, axis=1)
    return np.fft.irfft(np.where(kept, spectrum, 0), 365, axis=1)[site, day]


def per_site(sums: np.ndarray, counts: np.ndarray, none: float) -> np.ndarray:
    return np.where(counts > 0, sums / np.maximum(counts, 1), none)


def run_starts(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where runs of set flags begin; `first` marks rows that no run reaches over from before."""
    return flags & (first | ~np.concatenate([[False], flags[:-1]]))


def series_metrics(site: np.ndarray, n_sites: int, days: np.ndarray, flow: np.ndarray, harmonics: int = HARMONICS) -> dict[str, np.ndarray]:
    """Of each site's days, in order: averages over years. hsaf and lsaf count runs beyond the spread of positive and negative
    anomalies, hsam and lsam are the extreme anomalies, fpext the longest run above the signal in days, naa the sum of anomalies."""
    year_start = days.astype("datetime64[Y]")
    log_flow = np.log10(flow + 1)
    signal = seasonal_signals(site, n_sites, (days - year_start.astype("datetime64[D]")).astype(int) + 1, log_flow, harmonics)
    residual = log_flow - signal
    known = np.isfinite(residual)
    total = lambda rows, values: np.bincount(site[rows], values, n_sites)
    number = lambda rows: np.bincount(site[rows], minlength=n_sites)
    every = np.ones(len(site), bool)
    noise = np.sqrt(per_site(total(known, residual[known] ** 2), number(known), np.nan))
    level = per_site(total(every, signal), number(every), np.nan)
    strength = np.sqrt(per_site(total(every, (signal - level[site]) ** 2), number(every), np.nan))
    above, below = known & (residual > 0), known & (residual < 0)
    high, low = (np.sqrt(per_site(total(x, residual[x] ** 2), number(x), 0.0)) for x in (above, below))
    # the known days of one year of one site are a part
    part_site, part_residual, year = site[known], residual[known], year_start[known].astype(int)
    first = np.concatenate([[True], (np.diff(part_site) != 0) | (np.diff(year) != 0)])[: len(part_site)]
    parts, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    n_parts, owner = len(starts), part_site[starts]
    positive = part_residual > 0
    runs = run_starts(positive, first)
    lengths = np.bincount((np.cumsum(runs) - 1)[positive], minlength=int(runs.sum()))
    longest = np.zeros(n_parts)
    np.maximum.at(longest, parts[runs], lengths)
    count_runs = lambda flags: np.bincount(parts[run_starts(flags, first)], minlength=n_parts).astype(float)
    by_year = {
        "hsaf": count_runs(part_residual > high[part_site]), "hsam": np.maximum.reduceat(part_residual, starts) if n_parts else np.zeros(0),
        "lsaf": count_runs(part_residual < -low[part_site]), "lsam": np.minimum.reduceat(part_residual, starts) if n_parts else np.zeros(0),
        "fpext": longest, "naa": np.bincount(parts, part_residual, n_parts),
    }
    years = np.bincount(owner, minlength=n_sites)
    means = {name: per_site(np.bincount(owner, values, n_sites), years, np.nan) for name, values in by_year.items()}
    calendar = np.concatenate([[True], (np.diff(site) != 0) | (np.diff(year_start.astype(int)) != 0)])[: len(site)]
    dry = np.isfinite(flow) & (np.where(np.isfinite(flow), flow, 1) < NO_FLOW)
    with np.errstate(divide="ignore", invalid="ignore"):
        snr = np.where((noise > 0) & (strength > 0), 20 * np.log10(strength / noise), np.nan)
    return {"years": years, "n_days": number(known), "rms_signal": strength, "rms_noise": noise, "snr": snr} | means | {"sigma_hf": high, "sigma_lf": low, "zero_days": number(dry) / np.maximum(number(calendar), 1)}


def signal_metrics(days: pd.Series, flow: np.ndarray, harmonics: int = HARMONICS) -> dict[str, float]:
    """The metrics of one series."""
    found = series_metrics(np.zeros(len(days), int), 1, days.to_numpy("datetime64[D]"), flow, harmonics)
    return {name: values[0].item() for name, values in found.items()}


def whole_sites(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, each row's site as a number from 0, the sites' first rows) of sites in full, from rows sorted by site."""
    held: list[pa.RecordBatch] = []

    def parted(table: pa.Table) -> np.ndarray:
        codes = table.column(0).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last, end = batch.column(0)[batch.num_rows - 1], held[0].column(0)[0]
        if last == end or not (last.is_valid or end.is_valid):
            continue  # one site so far, and perhaps not all of it
        table = pa.Table.from_batches(held)
        starts = parted(table)
        whole, held = table.slice(0, int(starts[-1])), table.slice(int(starts[-1])).to_batches()
        yield whole, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), starts[:-1]
    if held:
        table = pa.Table.from_batches(held)
        starts = parted(table)
        yield table, np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)])), starts


def by_site(flow: DataFrame, site: str, day: str, value: str, work: Callable, schema: T.StructType) -> DataFrame:
    """work(rows, sites, starts, days, values) over all sites; rows without a day are left out."""
    rows = flow.select(F.col(site), F.col(day).cast("date").alias(day), F.col(value).cast("double").alias(value)).where(F.col(day).isNotNull())

    def worked(batches):
        for table, sites, starts in whole_sites(batches):
            days = table.column(1).combine_chunks().cast(pa.int32()).to_numpy().astype("datetime64[D]")
            yield from work(table, sites, starts, days, table.column(2).combine_chunks().to_numpy(zero_copy_only=False).astype(float)).to_batches()

    return rows.repartition(site).sortWithinPartitions(site, day).mapInArrow(worked, schema)


def flow_metrics(flow: DataFrame, site: str, day: str, value: str, harmonics: int = HARMONICS) -> DataFrame:
    """Per site the metrics of its daily series."""
    schema = T.StructType([T.StructField(site, flow.schema[site].dataType), *T._parse_datatype_string(METRICS).fields])

    def work(table, sites, starts, days, values):
        found = series_metrics(sites, len(starts), days, values, harmonics)
        number = lambda x: pa.array(x, from_pandas=False)
        columns = [table.column(0).take(pa.array(starts)), *(pc.cast(number(found[name]), pa.int32()) if name == "years" else number(found[name]) for name in found)]
        return pa.table(columns, names=[site, *found])

    return by_site(flow, site, day, value, work, schema)


def daily_anomalies(flow: DataFrame, site: str, day: str, value: str, harmonics: int = HARMONICS) -> DataFrame:
    """(site, day, value, signal, residual) of logarithmic flow."""
    schema = T.StructType([T.StructField(site, flow.schema[site].dataType), *T._parse_datatype_string(f"{day} date, {value} double, signal double, residual double").fields])

    def work(table, sites, starts, days, values):
        log_flow = np.log10(values + 1)
        signal = seasonal_signals(sites, len(starts), (days - days.astype("datetime64[Y]").astype("datetime64[D]")).astype(int) + 1, log_flow, harmonics)
        return table.append_column("signal", pa.array(signal)).append_column("residual", pa.array(log_flow - signal))

    return by_site(flow, site, day, value, work, schema)


def anomaly_sums(anomalies: DataFrame, events: DataFrame, site: str, day: str, event: str, event_day: str, years: int = 3) -> DataFrame:
    """Per event the sums of positive anomalies in the years before and behind it, its own day in both, and their difference."""
    joined = events.select(site, event, event_day).join(anomalies.select(site, day, "residual"), site)
    joined = joined.where(F.col(day).between(years_before(F.col(event_day), years), years_after(F.col(event_day), years)))
    positive = lambda when: F.sum(F.when(when & (F.col("residual") >= 0), F.col("residual")).otherwise(0.0))
    found = joined.groupBy(site, event, event_day).agg(positive(F.col(day) <= F.col(event_day)).alias("sum_before"), positive(F.col(day) >= F.col(event_day)).alias("sum_after"))
    return found.withColumn("difference", F.col("sum_before") - F.col("sum_after"))
