"""Aggregations, windows, order and quality reports on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import circular_mean
from ..operators import aggregates as A
from ..operators import quality as Q
from ..operators import windows as W
from .registry import Tables, query, sql

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT user_id, ts::DATE AS date, event_type, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def daily_mean(t: Tables):
    rows = t.events.withColumn("date", F.col("ts").cast("date"))
    return A.daily_mean(rows, ["user_id", "date", "event_type"], "value").withColumn("value", F.round("value", 6))


@query("SELECT l_suppkey, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS sd, count(*) FILTER (l_discount IS NULL) AS missing, count(*) AS n FROM lineitem GROUP BY 1 HAVING avg(l_discount) IS NOT NULL")
def group_summary(t: Tables):
    found = A.group_summary(t.lineitem, ["l_suppkey"], "l_discount")
    return found.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("""SELECT l_suppkey, round(sum(l_discount * l_quantity) FILTER (l_returnflag <> 'N') / nullif(sum(l_quantity) FILTER (l_returnflag <> 'N'), 0), 9) AS mean,
          round(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'N'), 0) / nullif(sum(l_quantity), 0), 9) AS coverage FROM lineitem GROUP BY 1""")
def weighted_mean_coverage(t: Tables):
    valid = F.col("l_returnflag") != "N"
    return t.lineitem.groupBy("l_suppkey").agg(F.round(A.weighted_mean(F.col("l_discount"), F.col("l_quantity"), valid), 9).alias("mean"), F.round(A.coverage(F.col("l_quantity"), valid), 9).alias("coverage"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(DISTINCT o_orderpriority) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS priorities FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 1")
def conditional_counts_gate(t: Tables):
    other = ~F.col("o_orderstatus").eqNullSafe("F")
    found = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_distinct(F.when(other, F.col("o_orderpriority"))).alias("priorities"), F.count_if(F.col("o_orderstatus") == "O").alias("n_o"))
    return found.where("n_o > 1").drop("n_o")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables):
    return A.duplicate_keys(t.lineitem, ["l_orderkey", "l_partkey"])


@query("SELECT l_orderkey, array_to_string(list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey), ',') AS parts FROM lineitem GROUP BY 1")
def ordered_array(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(A.ordered_array("l_partkey", "l_linenumber"), lambda x: x.cast("string")), ",").alias("parts"))


@query("SELECT l_suppkey, quantile_disc(l_extendedprice, 0.25) AS p25, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.75) AS p75 FROM lineitem GROUP BY 1")
def discrete_quantiles(t: Tables):
    return A.discrete_quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.025), 6) AS q025, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.975), 6) AS q975 FROM lineitem GROUP BY 1")
def linear_quantiles(t: Tables):
    found = A.linear_quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", {"q025": 0.025, "q50": 0.5, "q975": 0.975})
    return found.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("q025", "q50", "q975")))


@query("SELECT round(degrees(atan2(avg(sin(radians(l_quantity * 7))), avg(cos(radians(l_quantity * 7))))), 6) AS direction, l_shipmode AS mode FROM (SELECT l_quantity, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 2")
def circular_means(t: Tables):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("mode")).agg(F.round(circular_mean(F.col("l_quantity") * 7), 6).alias("direction"))


@query("SELECT o_custkey, " + ", ".join(f"max(o_totalprice) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def label_pivot(t: Tables):
    return A.pivot_max(t.orders, ["o_custkey"], "o_orderpriority", "o_totalprice", PRIORITIES)


@query("SELECT o_custkey, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def count_pivot_filled(t: Tables):
    return A.pivot_counts(t.orders, ["o_custkey"], "o_orderpriority", PRIORITIES, fill=0)


@query("SELECT l_suppkey, " + ", ".join(f"max({m}) FILTER (l_returnflag = '{f}') AS {m}_{f}" for m in ("l_quantity", "l_tax") for f in "AN") + " FROM lineitem GROUP BY 1")
def measure_pivot(t: Tables):
    return A.pivot_measures(t.lineitem, ["l_suppkey"], "l_returnflag", ("l_quantity", "l_tax"), ("A", "N"))


@query("SELECT l_orderkey, l_linenumber, 'l_tax' AS name, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def unpivot_long(t: Tables):
    return A.to_long(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@query("WITH l AS (SELECT unnest(['1-URGENT', '2-HIGH', 'ABSENT']) AS o_orderpriority), c AS (SELECT DISTINCT o_custkey FROM orders) SELECT c.o_custkey, l.o_orderpriority, count(o.o_orderkey) AS n FROM c CROSS JOIN l LEFT JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderpriority = l.o_orderpriority GROUP BY 1, 2")
def zero_filled_counts(t: Tables):
    return A.complete_counts(t.orders, ["o_custkey"], "o_orderpriority", ("1-URGENT", "2-HIGH", "ABSENT"))


@query("SELECT c_nationkey, c_mktsegment, n, round(100e0 * n / sum(n) OVER (PARTITION BY c_nationkey), 6) AS percent FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)")
def share_of_group(t: Tables):
    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return A.share_of_group(counts, ["c_nationkey"], "n").withColumn("percent", F.round("percent", 6))


@query("SELECT o_custkey, round(avg(total), 4) AS mean_total, count(*) AS n_inner FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2) GROUP BY 1")
def mean_of_annual_sums(t: Tables):
    return A.mean_of_sums(t.orders.withColumn("y", F.year("o_orderdate")), ["o_custkey"], ["y"], "o_totalprice").withColumn("mean_total", F.round("mean_total", 4))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice_z, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size_z FROM part")
def zscore_global(t: Tables):
    found = A.standardised(t.part, ["p_retailprice", "p_size"])
    return found.select("p_partkey", F.round("p_retailprice_z", 6).alias("p_retailprice_z"), F.round("p_size_z", 6).alias("p_size_z"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_samp(l_quantity) OVER w, 0), 6) AS l_quantity_z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def zscore_by_group(t: Tables):
    return A.standardised(t.lineitem, ["l_quantity"], ["l_suppkey"]).select("l_orderkey", "l_linenumber", F.round("l_quantity_z", 6).alias("l_quantity_z"))


@query("""WITH f AS (SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
          z AS (SELECT o_custkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z FROM f)
          SELECT o_orderkey, round(z, 6) AS o_totalprice_z FROM orders LEFT JOIN z USING (o_custkey)""")
def zscore_over_sites(t: Tables):
    return A.standardised_by_site(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice_z", 6).alias("o_totalprice_z"))


@query("SELECT (year(o_orderdate) // 10 * 10)::INTEGER AS decade, count(*) AS n FROM orders GROUP BY 1")
def decade_histogram(t: Tables):
    from ..functions.scalars import decade

    return t.orders.groupBy(decade(F.col("o_orderdate")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vertex, count(*) AS degree FROM (SELECT 's' || l_suppkey AS vertex FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) GROUP BY 1")
def endpoint_degrees(t: Tables):
    edges = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return A.endpoint_degrees(edges, "a", "b")


@query("SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS sign, count(*) AS n FROM customer GROUP BY 1, 2 UNION ALL SELECT 'all', CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END, count(*) FROM customer GROUP BY 2")
def groups_and_overall(t: Tables):
    rows = t.customer.withColumn("sign", F.when(F.col("c_acctbal") > 0, "plus").otherwise("minus"))
    return A.with_overall(rows, "c_mktsegment", ["sign"], [F.count(F.lit(1)).alias("n")])


@query("SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1")
def nest_and_unnest(t: Tables):
    nested = A.nested(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    return A.unnested(nested).groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))


@query("""SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 2) AS class_area, round(100e0 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey), 6) AS percent_of_event,
          round(100e0 * sum(l_quantity) / max(l_extendedprice), 6) AS percent_of_basin FROM lineitem GROUP BY 1, 2""")
def class_composition(t: Tables):
    found = A.class_composition(t.lineitem, ["l_suppkey"], "l_returnflag", "l_quantity", "l_extendedprice")
    return found.withColumn("class_area", F.round("class_area", 2)).withColumn("percent_of_event", F.round("percent_of_event", 6)).withColumn("percent_of_basin", F.round("percent_of_basin", 6))


@query("SELECT o_orderkey, lag(o_orderdate::DATE) OVER w AS previous, lead(o_orderdate::DATE) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_neighbours(t: Tables):
    rows = t.orders.withColumn("date", F.col("o_orderdate").cast("date"))
    return W.neighbours(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "date").select("o_orderkey", "previous", "following")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def running_total(t: Tables):
    return W.running_total(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "running").select("o_orderkey", F.round("running", 2).alias("running"))


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) = 1")
def top_per_key(t: Tables):
    return W.first_per_key(t.customer, ["c_nationkey"], [F.col("c_acctbal").desc_nulls_last(), "c_custkey"]).select("c_nationkey", "c_custkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC NULLS LAST) = 1")
def largest_with_ties(t: Tables):
    return W.largest_with_ties(t.lineitem, ["l_suppkey"], "l_quantity").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS change, CASE WHEN count(*) OVER r = 3 THEN round(sum(o_totalprice) OVER r, 2) END AS rolling FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), r AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def change_and_rolling_sum(t: Tables):
    order = ["o_orderdate", "o_orderkey"]
    found = W.rolling_sum(W.change(t.orders, ["o_custkey"], order, "o_totalprice", "change"), ["o_custkey"], order, "o_totalprice", 3, "rolling")
    return found.select("o_orderkey", F.round("change", 2).alias("change"), F.round("rolling", 2).alias("rolling"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def surrogate_keys(t: Tables):
    return W.surrogate_keys(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("id").cast("long").alias("id"))


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4)::INTEGER AS chunk FROM orders")
def chunked_groups(t: Tables):
    return W.chunks(t.orders, ["o_custkey"], ["o_orderkey"], 4).select("o_orderkey", "chunk")


@query("SELECT p_partkey, min(p_retailprice) OVER (PARTITION BY p_brand) AS loq FROM part")
def group_constant(t: Tables):
    return W.with_group_value(t.part, ["p_brand"], F.min("p_retailprice"), "loq").select("p_partkey", "loq")


@query("SELECT l_orderkey, l_quantity AS from_value, to_value, segment_index::INTEGER AS segment_index FROM (SELECT l_orderkey, l_quantity, lead(l_quantity) OVER w AS to_value, row_number() OVER w AS segment_index FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)) WHERE to_value - l_quantity > 1.5")
def consecutive_pairs(t: Tables):
    return W.consecutive_pairs(t.lineitem, ["l_orderkey"], "l_quantity", 1.5)


@query("SELECT n_name, total FROM (SELECT n_name, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ORDER BY total DESC, n_name LIMIT 4")
def top_k_by_sum(t: Tables):
    sums = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return sums.orderBy(F.desc("total"), "n_name").limit(4)


@query("SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM orders GROUP BY 1")
def validated_summary(t: Tables):
    checked = Q.require_unique(Q.require_columns(t.orders, ["o_orderkey", "o_custkey"]), ["o_orderkey"])
    return Q.require_labels(checked, "o_orderpriority", PRIORITIES).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"))


@query(sql("SELECT usgs_site, count(*) AS n, min(date) AS first_day, max(date) AS last_day, (date_diff('day', min(date), max(date)) + 1 - count(flow))::BIGINT AS n_missing, count(flow) AS n_days FROM flow GROUP BY 1", "flow"))
def coverage_summary(t: Tables):
    from ..plans.discharge import coverage_summary as summary

    flow = t.flow()
    found = summary(flow, "usgs_site", "date", "flow").join(flow.groupBy("usgs_site").agg(F.count(F.lit(1)).alias("n")), "usgs_site")
    return found.withColumn("n_missing", F.col("n_missing").cast("long"))
