"""Registry of queries and their SQL, and the tables' roles as sites, flows, observations and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, and the roles they play.

    Customers are sites, an order day's total is the flow, the mean price of its lines the observation, and urgent orders are events
    with their price as area.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def flow(self) -> DataFrame:
        found = self.orders.groupBy(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderdate").cast("date").alias("date"))
        return found.agg(F.round(F.sum("o_totalprice"), 2).alias("flow"), F.max("o_orderstatus").alias("Flow_cd"))

    def observations(self) -> DataFrame:
        lines = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        found = lines.groupBy(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderdate").cast("date").alias("date"))
        return found.agg(F.round(F.avg("l_extendedprice"), 6).alias("value_std"))

    def events_on_sites(self) -> DataFrame:
        return self.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderdate").cast("date").alias("ig_date"), F.col("o_totalprice").alias("area"))

    def sites(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").cast("string").alias("usgs_site"), (F.abs("c_acctbal") + 1000).alias("catch_area"), F.col("c_nationkey").alias("region_id"))


#: The same roles in SQL, as common table expressions.
ROLES = {
    "flow": "flow AS (SELECT o_custkey::VARCHAR AS usgs_site, o_orderdate::DATE AS date, round(sum(o_totalprice), 2) AS flow, max(o_orderstatus) AS \"Flow_cd\" FROM orders GROUP BY 1, 2)",
    "banded": """cuts AS (SELECT usgs_site, quantile_disc(flow, 0.25) AS p25, quantile_disc(flow, 0.5) AS p50, quantile_disc(flow, 0.75) AS p75 FROM flow GROUP BY 1),
        banded AS (SELECT f.usgs_site, f.date, f.flow, CASE WHEN flow <= p25 THEN 1 WHEN flow <= p50 THEN 2 WHEN flow <= p75 THEN 3 ELSE 4 END AS quartile FROM flow f JOIN cuts USING (usgs_site))""",
    "obs": "obs AS (SELECT o_custkey::VARCHAR AS usgs_site, o_orderdate::DATE AS date, round(avg(l_extendedprice), 6) AS value_std FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "fires": "fires AS (SELECT o_custkey::VARCHAR AS usgs_site, o_orderkey::VARCHAR AS event_id, o_orderdate::DATE AS ig_date, o_totalprice AS area FROM orders WHERE o_orderpriority = '1-URGENT')",
    "sites": "sites AS (SELECT c_custkey::VARCHAR AS usgs_site, abs(c_acctbal) + 1000 AS catch_area, c_nationkey AS region_id FROM customer)",
    "groups": """groups AS (
            SELECT usgs_site, year(ig_date) AS year, min(ig_date) AS start_date, max(ig_date) AS end_date, list_sort(list(DISTINCT event_id)) AS events, round(sum(area), 2) AS fire_area
            FROM fires GROUP BY usgs_site, year(ig_date), CASE WHEN dayofyear(ig_date) BETWEEN 110 AND 250 THEN NULL ELSE ig_date END)""",
    "pairs": "pairs AS (SELECT o.usgs_site, o.date, o.value_std, b.flow, b.quartile FROM obs o JOIN banded b USING (usgs_site, date))",
    "ranges": """ranges AS (
            SELECT g.usgs_site, year, start_date, end_date, events, fire_area AS cum_fire_area,
                   lag(end_date) OVER e AS previous_end_date, lead(start_date) OVER s AS next_start_date,
                   sum(fire_area) OVER (PARTITION BY g.usgs_site ORDER BY end_date, start_date ROWS UNBOUNDED PRECEDING) AS all_fire_area, catch_area
            FROM groups g JOIN sites USING (usgs_site)
            WINDOW e AS (PARTITION BY g.usgs_site ORDER BY end_date, start_date), s AS (PARTITION BY g.usgs_site ORDER BY start_date, end_date))""",
    "windows": """windows AS (
            SELECT p.usgs_site, g.year, g.start_date, g.end_date, g.fire_area AS cum_fire_area, p.date, p.value_std, p.flow, p.quartile,
                   CASE WHEN p.date < g.start_date THEN 'before' ELSE 'after' END AS segment
            FROM pairs p JOIN groups g USING (usgs_site)
            WHERE (p.date >= g.start_date - INTERVAL 3 YEAR AND p.date < g.start_date) OR (p.date > g.end_date AND p.date <= g.end_date + INTERVAL 3 YEAR)),
        gate AS (
            SELECT usgs_site, year, start_date, end_date, cum_fire_area,
                   count(*) FILTER (segment = 'before') AS before_count, count(*) FILTER (segment = 'after') AS after_count,
                   count(DISTINCT quartile) FILTER (segment = 'before' AND quartile > 1) AS bq, count(DISTINCT quartile) FILTER (segment = 'after' AND quartile > 1) AS aq
            FROM windows GROUP BY ALL)""",
}


def sql(body: str, *roles: str) -> str:
    """SQL with the roles it reads put before it."""
    with_roles = [ROLES[r] for r in roles]
    return f"WITH {', '.join(with_roles)} {body}" if with_roles else body


def query(oracle: str | None = None):
    """Registers a function of Tables as a query under its own name."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return register
