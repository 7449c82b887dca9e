"""Regressions of logarithms per site, prediction intervals, outlier shares, tests, and posterior summaries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import paired_power, paired_t, pairs_for_power, t_quantile, wilcoxon_p
from ..functions.scalars import slope_direction
from ..operators.aggregates import pivot_measures
from ..operators.joins import dimension


def site_fits(df: DataFrame, site: str, y: str, x: str, where: Column | None = None) -> DataFrame:
    """Least squares of ln(y) on ln(x) per site over positive values: slope, intercept, r2, n, mean_x, sxx and s."""
    rows = df.where((F.col(y) > 0) & (F.col(x) > 0))
    rows = rows if where is None else rows.where(where)
    ly, lx = F.ln(y), F.ln(x)
    fits = rows.groupBy(site).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"), F.count(F.lit(1)).alias("n"), F.avg(lx).alias("mean_x"), F.regr_sxx(ly, lx).alias("sxx"), F.regr_syy(ly, lx).alias("syy"), F.regr_sxy(ly, lx).alias("sxy"))
    rss = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    return fits.withColumn("s", F.sqrt(F.try_divide(rss, F.col("n") - 2))).drop("syy", "sxy").withColumn("slopedir", slope_direction(F.col("slope")))


def t_table(spark, largest_df: int = 2_000) -> DataFrame:
    """(df, t): 97.5 % quantiles of Student's t for 1 to largest_df degrees of freedom."""
    return spark.createDataFrame([(k, t_quantile(0.975, k)) for k in range(1, largest_df + 1)], "df long, t double")


def t_beyond(df: Column, z: float = 1.959963984540054) -> Column:
    """The 97.5 % quantile for many degrees of freedom, by its expansion around the normal one, z; exact to 1e-12 beyond 1,000."""
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return sum((F.lit(c) / F.pow(df.cast("double"), F.lit(k)) for k, c in enumerate(terms, 1)), F.lit(z))


def with_intervals(df: DataFrame, fits: DataFrame, site: str, y: str, x: str, *, prediction: bool = True, largest_df: int = 2_000) -> DataFrame:
    """Positive rows with fit, lwr, upr (on y's scale), residual rs and status.

    The interval is that of a new observation, or with prediction=False that of the mean. Quantiles of up to largest_df degrees of
    freedom come from a table, those beyond from an expansion; sites with fewer than three points have no interval.
    """
    quantiles = F.broadcast(t_table(df.sparkSession, largest_df))
    joined = df.where((F.col(y) > 0) & (F.col(x) > 0)).join(fits, site).withColumn("df", F.col("n") - 2).join(quantiles, "df", "left")
    joined = joined.withColumn("t", F.when(F.col("df") > largest_df, t_beyond(F.col("df"))).otherwise(F.col("t")))
    lx, line = F.ln(x), F.col("intercept") + F.col("slope") * F.ln(x)
    spread = F.col("t") * F.col("s") * F.sqrt(F.lit(1.0 if prediction else 0.0) + 1 / F.col("n") + F.try_divide(F.pow(lx - F.col("mean_x"), 2), F.col("sxx")))
    found = joined.withColumn("fit", F.exp(line)).withColumn("lwr", F.exp(line - spread)).withColumn("upr", F.exp(line + spread)).withColumn("rs", F.ln(y) - line)
    inside = (F.col(y) >= F.col("lwr")) & (F.col(y) <= F.col("upr"))
    return found.withColumn("status", F.when(inside, "Inside PI").when(~inside, "Outside PI")).drop("df", "t")


def outlier_shares(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Per group and period: points inside and outside the interval, all, and the outside share."""
    found = df.groupBy(*keys, period).agg(F.count_if(F.col("status") == "Inside PI").alias("inci"), F.count_if(F.col("status") == "Outside PI").alias("outci"))
    found = found.withColumn("total", F.col("inci") + F.col("outci"))
    return found.withColumn("wgt", F.try_divide(F.col("outci"), F.col("total")))


def wide_shares(shares: DataFrame, keys: Sequence[str], period: str, periods: Sequence[str]) -> DataFrame:
    return pivot_measures(shares, keys, period, ("wgt", "inci", "outci", "total"), periods)


def share_summary(shares: DataFrame, group: str, period: str, value: str, site: str) -> DataFrame:
    """n, sites, mean, sd, median and quartiles by group and period, and by period over all groups ('all'), to three places."""
    q = lambda p: F.bround(F.percentile(value, p), 3)
    aggregates = [F.count(F.lit(1)).alias("n_obs"), F.count_distinct(site).alias("n_sites"), F.bround(F.avg(value), 3).alias("mean"), F.bround(F.stddev_samp(value), 3).alias("sd"), q(0.5).alias("med"), q(0.25).alias("q25"), q(0.75).alias("q75")]
    grouped = shares.groupingSets([[group, period], [period]], group, period).agg(F.grouping_id().alias("__g"), *aggregates)
    return grouped.withColumn(group, F.when(F.col("__g") > 0, "all").otherwise(F.col(group))).drop("__g")


def paired_tests(wide: DataFrame, group: str, before: str, after: str, alpha: float = 0.05) -> DataFrame:
    """Per group, and over all sites ('all'): Cohen's d, t and signed-rank tests of after - before, power, pairs for 80 and 90 %.

    A group is one row per site; its differences are gathered in one task.
    """
    pairs = wide.select(F.col(group).cast("string").alias("group"), (F.col(after) - F.col(before)).alias("difference")).dropna()
    every = pairs.unionByName(pairs.withColumn("group", F.lit("all")))

    def tests(frame: pd.DataFrame) -> pd.DataFrame:
        differences = sorted(frame["difference"].tolist())
        if len(differences) < 3 or min(differences) == max(differences):
            return pd.DataFrame({"group": frame["group"][:1], "n_paired": len(differences)}).reindex(columns=["group", "n_paired", "cohens_d", "wilcox_p", "t_p", "power_pct", "n_for_80pct", "n_for_90pct"])
        t = paired_t(differences)
        d = t["cohens_d"]
        return pd.DataFrame([[frame["group"].iloc[0], t["n"], d, wilcoxon_p(differences), t["t_p"], 100 * paired_power(d, t["n"], alpha), pairs_for_power(d, 0.8, alpha), pairs_for_power(d, 0.9, alpha)]], columns=["group", "n_paired", "cohens_d", "wilcox_p", "t_p", "power_pct", "n_for_80pct", "n_for_90pct"])

    return every.groupBy("group").applyInPandas(tests, "group string, n_paired long, cohens_d double, wilcox_p double, t_p double, power_pct double, n_for_80pct double, n_for_90pct double")


def sensitivity(df: DataFrame, keys: Sequence[str], x: str, value: str, name: str = "gradient") -> DataFrame:
    """|change of value| per change of x between neighbouring rows."""
    w = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn(name, F.try_divide(F.abs(F.col(value) - F.lag(value).over(w)), F.col(x) - F.lag(x).over(w)))


def cell_sensitivity(df: DataFrame, x: str, y: str, value: str, points: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Quantiles of value per (x, y) cell, their gradients along x and along y, and the gradients' magnitude."""
    quantiles = df.groupBy(x, y).agg(*(F.percentile(value, p).alias(f"q{int(100 * p):02d}") for p in points))
    long = quantiles.unpivot([x, y], [f"q{int(100 * p):02d}" for p in points], "quantile", "level")
    along_x = sensitivity(long, ["quantile", y], x, "level", "gradient_x")
    both = sensitivity(along_x, ["quantile", x], y, "level", "gradient_y")
    return both.withColumn("magnitude", F.sqrt(F.col("gradient_x") ** 2 + F.col("gradient_y") ** 2))


def draw_summary(draws: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, sd, median and the middle half of posterior draws."""
    return draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.25).alias("lower"), F.percentile(value, 0.75).alias("upper"))


def site_slopes(population: DataFrame, random: DataFrame, sites: DataFrame, site: str = "usgs_site") -> DataFrame:
    """Per site the median and middle half over draws of: population slope + burned part x its slope + the site's own deviation.

    population: (draw, slope, burn_slope); random: (draw, site, deviation); sites: (site, per_cent_burned).
    """
    joined = random.join(dimension(population), "draw").join(dimension(sites), site)
    total = F.col("slope") + F.col("burn_slope") * F.col("per_cent_burned") + F.col("deviation")
    return joined.withColumn("total", total).groupBy(site).agg(F.percentile("total", 0.5).alias("median"), F.percentile("total", 0.25).alias("lower"), F.percentile("total", 0.75).alias("upper"))


def model_rows(df: DataFrame, site: str, order: str, columns: Sequence[str], width: int) -> DataFrame:
    """Per site its values in order, padded with zeros to `width`, and their number: the matrix form samplers read."""
    arrays = df.groupBy(site).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
    pad = lambda c: F.concat(F.transform("rows", lambda r: r[c].cast("double")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size("rows"), F.lit(0))))
    return arrays.select(site, F.size("rows").alias("n"), *(pad(c).alias(c) for c in columns))


def model_inputs(df: DataFrame, value: str, flow: str, burned: str, day: str, event_day: str) -> DataFrame:
    """Positive rows with logarithms, the post flag, and standardised covariates beside the constants that undo them."""
    rows = df.where((F.col(value) > 0) & (F.col(flow) > 0)).withColumn("log_value", F.ln(value)).withColumn("log_flow", F.ln(flow)).withColumn("post", (F.col(day) > F.col(event_day)).cast("int"))
    stats = rows.agg(*(f(c).alias(f"{c}_{n}") for c in ("log_flow", burned) for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))))
    joined = rows.crossJoin(F.broadcast(stats))
    return joined.withColumn("log_flow_z", F.try_divide(F.col("log_flow") - F.col("log_flow_mean"), F.col("log_flow_sd"))).withColumn("burned_z", F.try_divide(F.col(burned) - F.col(f"{burned}_mean"), F.col(f"{burned}_sd")))
