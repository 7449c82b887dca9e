"""Joins and set operations on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import quality as Q
from ..plans import discharge as D
from .registry import Tables, query, sql


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(t: Tables):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.only_in(t.orders, keys, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_filter(t: Tables):
    return J.not_in(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def row_value_in(t: Tables):
    return J.only_in(t.lineitem, t.lineitem.where("l_quantity >= 50"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query(sql("SELECT DISTINCT e.event_id, e.ig_date FROM fires e WHERE EXISTS (SELECT 1 FROM groups g WHERE list_contains(g.events, e.event_id) AND len(g.events) > 1)", "fires", "groups"))
def array_member_filter(t: Tables):
    from ..plans.events import season_groups

    groups = season_groups(t.events_on_sites()).where(F.size("events") > 1)
    return J.with_events_of(t.events_on_sites().select("event_id", "ig_date"), groups, "event_id", "events").distinct()


@query(sql("SELECT usgs_site, year, event_id, position::INTEGER AS position FROM (SELECT usgs_site, year, start_date, unnest(events) AS event_id, unnest(range(1, len(events) + 1)) AS position FROM groups)", "fires", "groups"))
def event_members(t: Tables):
    from ..plans.events import season_groups

    return J.members(season_groups(t.events_on_sites()), "events").select("usgs_site", "year", "event_id", "position")


@query(sql("""SELECT f.usgs_site, f.date, f.flow, count(e.event_id) AS n_events, coalesce(round(sum(e.area), 2), 0) AS amount_sum,
              coalesce(date_diff('day', max(e.ig_date), f.date), 0)::INTEGER AS days_since
              FROM flow f LEFT JOIN fires e ON e.usgs_site = f.usgs_site AND e.ig_date BETWEEN (f.date - INTERVAL 120 MONTH)::DATE AND f.date GROUP BY f.usgs_site, f.date, f.flow""", "flow", "fires"))
def burn_look_back(t: Tables):
    found = J.look_back(t.flow().select("usgs_site", "date", "flow"), t.events_on_sites(), "usgs_site", "date", "ig_date", "area")
    return found.withColumn("amount_sum", F.round("amount_sum", 2))


@query("""WITH p AS (SELECT l_suppkey AS site, row_number() OVER () AS rid, l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem WHERE l_returnflag = 'R'),
          g AS (SELECT l_suppkey AS site, l_extendedprice AS gx, min(l_quantity) AS fit FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 GROUP BY 1, 2)
          SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, arg_min(fit, (round(abs(x - gx), 6), gx)) AS fit FROM p LEFT JOIN g USING (site) GROUP BY rid""")
def nearest_grid_value(t: Tables):
    lines = t.lineitem.withColumnRenamed("l_suppkey", "site")
    points = lines.where("l_returnflag = 'R'").select("site", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    grid = lines.where("l_returnflag = 'A' and l_linenumber = 1").groupBy("site", F.col("l_extendedprice").alias("gx")).agg(F.min("l_quantity").alias("fit"))
    return J.nearest_value(points, grid, "site", "x", "gx", ["fit"]).select("l_orderkey", "l_linenumber", "fit")


@query("""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
          SELECT a.label, a.vec_id AS point, arg_min(b.vec_id, (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id)) AS target,
                 round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 9) AS distance
          FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1, 2""")
def nearest_in_group(t: Tables):
    e = t.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    points = e.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("point"), "x", "y")
    targets = e.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    square = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    return J.nearest_neighbour(points, targets, "label", F.sqrt(square), "point", "target").withColumn("distance", F.round("distance", 9))


@query("""SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS date, c_mktsegment, n_name, r_name, p_brand, s_name FROM lineitem
          LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def covariate_star_join(t: Tables):
    renamed = lambda df, key, to: df.withColumnRenamed(key, to)
    sides = [
        (renamed(t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date")), "o_orderkey", "l_orderkey"), ["l_orderkey"]),
        (renamed(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", "o_custkey"), ["o_custkey"]),
        (renamed(t.nation, "n_nationkey", "c_nationkey"), ["c_nationkey"]),
        (renamed(t.region, "r_regionkey", "n_regionkey"), ["n_regionkey"]),
        (renamed(t.part.select("p_partkey", "p_brand"), "p_partkey", "l_partkey"), ["l_partkey"]),
        (renamed(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", "l_suppkey"), ["l_suppkey"]),
    ]
    return J.star(t.lineitem, sides).select("l_orderkey", "l_linenumber", "date", "c_mktsegment", "n_name", "r_name", "p_brand", "s_name")


@query("SELECT a.s_suppkey AS s_suppkey_1, b.s_suppkey AS s_suppkey_2, a.s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def ordered_pairs(t: Tables):
    return J.ordered_pairs(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey", ["s_nationkey"]).select("s_suppkey_1", "s_suppkey_2", "s_nationkey")


@query("""SELECT * FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) USING (k)
          FULL JOIN (SELECT n_nationkey AS k, n_name FROM nation) USING (k)""")
def full_outer_reduce(t: Tables):
    one = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    two = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return J.outer_all([one, two, t.nation.select(F.col("n_nationkey").alias("k"), "n_name")], ["k"])


@query("""WITH r AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1)
          SELECT p_brand, round(lo + k * ((hi - lo) / 9), 6) AS x FROM r, range(0, 10) t(k)""")
def value_grid(t: Tables):
    ranges = t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return J.value_grid(ranges, "lo", "hi", 10).select("p_brand", F.round("x", 6).alias("x"))


@query(sql("SELECT b.usgs_site, b.date, o.value_std, b.flow, b.quartile FROM obs o JOIN banded b USING (usgs_site, date)", "flow", "banded", "obs"))
def obs_flow_join(t: Tables):
    from ..plans.prepost import paired

    return paired(t.observations(), D.with_quartiles(t.flow(), value="flow"))


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def update_from(t: Tables):
    changes = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return Q.updated(t.customer.select("c_custkey", "c_acctbal"), changes, ["c_custkey"], "c_acctbal")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def union_distinct(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).unionByName(t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def stacked_tables(t: Tables):
    from ..sources.readers import stacked

    return stacked([t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("""WITH p AS (SELECT user_id, ts::DATE AS d, event_type, value FROM events WHERE event_type <> 'view'), i AS (SELECT user_id, ts::DATE AS d, event_type, value FROM events)
          SELECT user_id, d, event_type, value FROM p UNION ALL
          SELECT user_id, d, event_type, min(value) FROM i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = i.user_id AND p.d = i.d AND p.event_type = i.event_type) GROUP BY 1, 2, 3""")
def anti_append_dedup(t: Tables):
    rows = t.events.select("user_id", F.col("ts").cast("date").alias("d"), "event_type", "value")
    return Q.insert_ignore(rows.where("event_type <> 'view'"), rows, ["user_id", "d", "event_type"], ["value"])


@query("""WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey % 10 <> 3)
          SELECT * FROM p UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 2 FROM orders WHERE o_custkey % 10 IN (3, 4) AND o_orderkey NOT IN (SELECT o_orderkey FROM p)""")
def replace_rows(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    incoming = rows.where("o_custkey % 10 in (3, 4)").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return Q.replace_where(rows, F.col("o_custkey") % 10 == 3, incoming, ["o_orderkey"])


@query("""WITH b AS (SELECT l_orderkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), s AS (SELECT l_orderkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
          r AS (SELECT l_orderkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
          SELECT * FROM b UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT * FROM r WHERE k NOT IN (SELECT k FROM b) AND k NOT IN (SELECT k FROM s)""")
def merge_supplements(t: Tables):
    part = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    return D.merge_supplements(part("A").groupBy("k").agg(F.min("v").alias("v")), [part("N"), part("R")], ["k"], ["v"])
