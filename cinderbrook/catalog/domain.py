"""The domain operators with customers as sites, order days as flow and urgent orders as events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import set_text
from ..plans import chemistry as C
from ..plans import covariates as V
from ..plans import discharge as D
from ..plans import events as E
from ..plans import prepost as P
from ..plans import screening as R
from .registry import Tables, query, sql


def banded_flow(t: Tables):
    return D.with_quartiles(t.flow(), value="flow").select("usgs_site", "date", "flow", "quartile")


def groups(t: Tables):
    found = E.season_groups(t.events_on_sites())
    return found.withColumn("fire_area", F.round("fire_area", 2))


def pairs(t: Tables):
    return P.paired(t.observations(), banded_flow(t))


def with_area(t: Tables):
    return groups(t).withColumnRenamed("fire_area", "cum_fire_area")


def texts(df):
    return df.withColumn("events", set_text(F.col("events")))


ARRAY = "'{' || array_to_string(events, ',') || '}' AS events"
PREPOST = "w.usgs_site, w.year, w.start_date, w.end_date, w.segment, w.date, w.value_std, w.flow, w.quartile, k.before_count, k.after_count"
SAME = "w.usgs_site = k.usgs_site AND w.year = k.year AND w.start_date = k.start_date AND w.end_date = k.end_date"
ROLES_TO_WINDOWS = ("flow", "banded", "obs", "fires", "groups", "pairs", "windows")
LARGEST = "row_number() OVER (PARTITION BY usgs_site ORDER BY cum_fire_area DESC NULLS FIRST, start_date NULLS LAST, end_date NULLS LAST) = 1"
COLUMNS = ["usgs_site", "year", "start_date", "end_date", "segment", "date", "value_std", "flow", "quartile", "before_count", "after_count"]


def chemistry_tables(t: Tables):
    """Results, other sources' rows and study sites."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    code = F.when(F.col("l_returnflag") == "A", "71851").when(F.col("l_returnflag") == "N", "00618").otherwise("99999")
    media = F.when(F.col("o_orderstatus") == "F", "Water").otherwise("Other")
    results = lines.select(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderdate").cast("date").alias("ActivityStartDate"), code.alias("USGSPCode"), F.col("l_quantity").alias("ResultMeasureValue"), F.lit("mg/l").alias("ResultMeasure.MeasureUnitCode"), media.alias("ActivityMediaName"), F.lit("Surface Water").alias("ActivityMediaSubdivisionName"), F.when(F.col("o_orderpriority").ilike("%low%"), "Quality Control").otherwise("Sample").alias("ActivityTypeCode"), F.lit("Dissolved").alias("ResultSampleFractionText"))
    study = t.customer.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("usgs_site"))
    others = t.supplier.select(F.when(F.col("s_name").contains("7"), "bell").otherwise(F.concat(F.lit("S"), "s_suppkey")).alias("usgs_site"), F.lit("2000-01-01").cast("date").alias("date"), F.lit("nitrate_N").alias("analyte"), (F.col("s_acctbal") / 14.0 * 1000.0 * 0.014007).alias("mean"), F.lit("uM").alias("unit"))
    return results, others, study


@query("""WITH s AS (SELECT l_orderkey, l_returnflag, l_quantity, o_custkey, o_orderdate::DATE AS date, o_orderpriority, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
          k AS (SELECT *, l_quantity * CASE l_returnflag WHEN 'A' THEN 14e0 / 62e0 ELSE 1e0 END AS v FROM s WHERE o_orderstatus ILIKE 'f' AND NOT regexp_matches(o_orderpriority, 'low', 'i') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'))
          SELECT o_custkey::VARCHAR AS usgs_site, date, round(avg(v), 6) AS value_std FROM k WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2
          UNION SELECT 'S' || s_suppkey, DATE '2000-01-01', round(s_acctbal * 0.014007::DOUBLE, 6) FROM supplier WHERE s_name NOT ILIKE '%7%'""")
def analyte_union_daily_mean(t: Tables):
    results, others, study = chemistry_tables(t)
    found = C.analyte_series(C.standardise_chemistry(results, study), others, "nitrate")
    return found.select("usgs_site", "date", F.round("value_std", 6).alias("value_std"))


@query("SELECT o_custkey::VARCHAR AS usgs_site, o_orderdate::DATE AS date, o_totalprice AS flow FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) UNION SELECT 'S' || s_suppkey, DATE '2000-01-01', s_acctbal FROM supplier WHERE s_acctbal >= 0")
def flow_union_nonneg(t: Tables):
    gauged = t.orders.select(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderdate").cast("date").alias("Date"), F.col("o_totalprice").alias("Flow"), F.lit("A").alias("Flow_cd"))
    others = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("usgs_site"), F.lit("2000-01-01").cast("date").alias("date"), F.col("s_acctbal").alias("mean"))
    study = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("usgs_site"))
    return D.union_discharge(gauged, others, study).select("usgs_site", F.col("Date").alias("date"), F.col("Flow").alias("flow"))


@query(sql("SELECT usgs_site, date, flow, quartile FROM banded", "flow", "banded"))
def flow_quartile_band(t: Tables):
    return banded_flow(t)


@query(sql("""SELECT usgs_site, ignition_date, unnest(events) AS event_id, lag(ignition_date) OVER w AS pre_lo, ignition_date AS pre_hi, ignition_date AS post_lo, lead(ignition_date) OVER w AS post_hi
              FROM (SELECT usgs_site, ig_date AS ignition_date, list(DISTINCT event_id) AS events FROM fires GROUP BY 1, 2) WINDOW w AS (PARTITION BY usgs_site ORDER BY ignition_date)""", "fires"))
def event_intervals(t: Tables):
    return E.event_intervals(t.events_on_sites())


@query(sql("SELECT usgs_site, event_id, round(area, 2) AS fire_catch_area, round(catch_area, 2) AS catch_area, round(100e0 * area / catch_area, 2) AS per_cent_burned FROM fires JOIN sites USING (usgs_site)", "fires", "sites"))
def event_areas(t: Tables):
    events = t.events_on_sites().withColumnRenamed("area", "fire_catch_area")
    return E.event_areas(events, t.sites()).select("usgs_site", "event_id", "fire_catch_area", "catch_area", "per_cent_burned")


@query(sql(f"SELECT usgs_site, year, start_date, end_date, {ARRAY}, fire_area FROM groups", "fires", "groups"))
def season_groups(t: Tables):
    return texts(groups(t))


@query(sql(f"""SELECT usgs_site, year, start_date, end_date, {ARRAY}, cum_fire_area, previous_end_date, next_start_date, date_diff('day', previous_end_date, start_date)::INTEGER AS days_since,
               date_diff('day', end_date, next_start_date)::INTEGER AS days_until, round(all_fire_area, 2) AS all_fire_area, round(100e0 * cum_fire_area / catch_area, 2) AS cum_per_cent_burned FROM ranges""", "fires", "sites", "groups", "ranges"))
def event_ranges_agg(t: Tables):
    found = E.event_ranges(groups(t), t.sites()).withColumn("all_fire_area", F.round("all_fire_area", 2))
    return texts(found).drop("catch_area", "all_per_cent_burned")


@query(sql("""SELECT f.usgs_site, f.event_id, min_date_q, max_date_q, records_q, date_diff('day', min_date_q, ig_date)::INTEGER AS days_q_pre_fire, date_diff('day', ig_date, max_date_q)::INTEGER AS days_q_post_fire
              FROM fires f JOIN (SELECT usgs_site, min(date) AS min_date_q, max(date) AS max_date_q, count("Flow_cd") AS records_q FROM flow WHERE flow > 20000 GROUP BY 1) USING (usgs_site)
              WHERE ig_date >= min_date_q AND ig_date <= max_date_q""", "flow", "fires"))
def coverage_days(t: Tables):
    found = E.coverage_by_series(t.events_on_sites(), t.flow().where("flow > 20000"))
    return found.select("usgs_site", "event_id", "min_date_q", "max_date_q", "records_q", "days_q_pre_fire", "days_q_post_fire")


@query(sql(f"SELECT g.usgs_site, start_date, end_date, {ARRAY}, count(*) FILTER (date < start_date) AS before_count, count(*) FILTER (date > end_date) AS after_count FROM pairs p JOIN groups g USING (usgs_site) GROUP BY ALL", "flow", "banded", "obs", "fires", "groups", "pairs"))
def counts_before_after(t: Tables):
    return texts(P.counts_before_after(pairs(t), with_area(t)))


@query(sql(f"SELECT usgs_site, year, start_date, end_date, cum_fire_area, before_count, after_count FROM gate WHERE bq = 3 AND aq = 3 QUALIFY {LARGEST}", *ROLES_TO_WINDOWS))
def largest_valid_event(t: Tables):
    return P.largest_group(P.gated_groups(pairs(t), with_area(t)))


@query(sql(f"SELECT {PREPOST} FROM windows w JOIN gate k ON {SAME} WHERE bq = 3 AND aq = 3", *ROLES_TO_WINDOWS))
def prepost_observations(t: Tables):
    return P.prepost_all(pairs(t), with_area(t)).select(*COLUMNS)


@query(sql(f"SELECT {PREPOST}, '{{' || array_to_string(g.events, ',') || '}}' AS events FROM windows w JOIN (SELECT * FROM gate WHERE bq = 3 AND aq = 3 QUALIFY {LARGEST}) k ON {SAME} JOIN groups g ON g.usgs_site = k.usgs_site AND g.year = k.year AND g.start_date = k.start_date AND g.end_date = k.end_date", *ROLES_TO_WINDOWS))
def prepost_largest_event(t: Tables):
    return texts(P.prepost_largest(pairs(t), with_area(t))).select(*COLUMNS, "events")


@query(sql(f"SELECT {PREPOST} FROM windows w JOIN (SELECT * FROM gate WHERE bq = 3 QUALIFY {LARGEST}) k ON {SAME}", *ROLES_TO_WINDOWS))
def pre_only_observations(t: Tables):
    return P.prepost_largest(pairs(t), with_area(t), segments=("before",)).select(*COLUMNS)


@query(sql(f"SELECT g.usgs_site, year, start_date, end_date, {ARRAY}, fire_area AS cum_fire_area, count(*) FILTER (date < start_date) AS before_count, count(*) FILTER (date > end_date) AS after_count FROM groups g JOIN pairs p USING (usgs_site) GROUP BY ALL", "flow", "banded", "obs", "fires", "groups", "pairs"))
def export_summary_all(t: Tables):
    shuffled = with_area(t).withColumn("events", F.reverse("events"))
    return texts(P.summary_all(shuffled, P.counts_before_after(pairs(t), with_area(t))))


@query(sql(f"SELECT g.usgs_site, g.year, g.start_date, g.end_date, {ARRAY}, before_count, after_count FROM groups g JOIN (SELECT * FROM gate WHERE bq = 3 AND aq = 3 QUALIFY {LARGEST}) k ON g.usgs_site = k.usgs_site AND g.start_date = k.start_date AND g.end_date = k.end_date", *ROLES_TO_WINDOWS))
def export_summary_largest(t: Tables):
    found = P.summary_largest(with_area(t), P.largest_group(P.gated_groups(pairs(t), with_area(t))))
    return texts(found).select("usgs_site", "year", "start_date", "end_date", "events", "before_count", "after_count")


@query(sql("SELECT o.usgs_site, o.date, value_std, flow, quartile FROM pairs o", "flow", "banded", "obs", "pairs"))
def paired_export(t: Tables):
    return pairs(t).orderBy("usgs_site", "date")


SETS = "members AS (SELECT usgs_site, events, unnest(events) AS event_id FROM (SELECT DISTINCT usgs_site, events FROM groups))"
EVI_TEXT = "CASE WHEN event_id::BIGINT % 7 = 0 THEN 'NA' WHEN event_id::BIGINT % 7 = 1 THEN ' ' || (event_id::BIGINT % 50)::VARCHAR || ' ' ELSE (event_id::BIGINT % 50)::VARCHAR END"


def evi_values(t: Tables):
    number = F.col("event_id").cast("long")
    text = F.when(number % 7 == 0, "NA").when(number % 7 == 1, F.concat(F.lit(" "), (number % 50).cast("string"), F.lit(" "))).otherwise((number % 50).cast("string"))
    return t.events_on_sites().where(number % 11 != 0).select("usgs_site", "event_id", text.alias("median_post_evi"))


def weights(t: Tables):
    return t.events_on_sites().select("usgs_site", "event_id", F.col("area").alias("weight"))


@query("WITH " + sql("""SELECT usgs_site, '{' || array_to_string(events, ',') || '}' AS events, round(sum(v * area) FILTER (v IS NOT NULL) / nullif(sum(area) FILTER (v IS NOT NULL), 0), 6) AS weighted_evi,
              round(coalesce(sum(area) FILTER (v IS NOT NULL), 0) / sum(area), 6) AS weighted_evi_coverage, count(*) FILTER (v IS NULL) > 0 AS has_missing_evi,
              count(*) FILTER (v IS NULL) > 0 AND count(v) > 0 AS has_bad_data
              FROM (SELECT m.*, area, CASE WHEN event_id::BIGINT % 11 = 0 THEN NULL WHEN event_id::BIGINT % 7 = 0 THEN NULL ELSE (event_id::BIGINT % 50)::DOUBLE END AS v FROM members m JOIN fires USING (usgs_site, event_id)) GROUP BY usgs_site, events""", "fires", "groups").removeprefix("WITH ").replace(" SELECT usgs_site, '{'", f", {SETS} SELECT usgs_site, '{{'", 1))
def weighted_event_rollup(t: Tables):
    found = V.index_roll_up(groups(t), evi_values(t), weights(t))
    return texts(found).select("usgs_site", "events", F.round("weighted_evi", 6).alias("weighted_evi"), F.round("weighted_evi_coverage", 6).alias("weighted_evi_coverage"), "has_missing_evi", "has_bad_data")


@query("""WITH s AS (SELECT l_orderkey::VARCHAR AS event_id, CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'moderate' ELSE 'high' END AS c, l_quantity AS v FROM lineitem)
          SELECT event_id, round(CASE WHEN count(DISTINCT c) = 1 THEN sum(v) ELSE sum(v * CASE c WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END) END, 2) AS severity_index FROM s GROUP BY 1""")
def severity_index(t: Tables):
    label = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "moderate").otherwise("high")
    rows = t.lineitem.select(F.lit("x").alias("usgs_site"), F.col("l_orderkey").cast("string").alias("event_id"), label.alias("fire_severity"), F.col("l_quantity").alias("severity_value"))
    return V.severity_index(rows).select("event_id", F.round("severity_index", 2).alias("severity_index"))


def severity_rows(t: Tables):
    lines = t.lineitem.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "moderate").otherwise("high")
    return lines.select(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderkey").cast("string").alias("event_id"), label.alias("fire_severity"), F.col("l_quantity").alias("severity_value"))


SEVERITY_SQL = """s AS (SELECT l_orderkey::VARCHAR AS event_id, CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'moderate' ELSE 'high' END AS c, l_quantity AS v FROM lineitem),
          i AS (SELECT event_id, CASE WHEN count(DISTINCT c) = 1 THEN sum(v) ELSE sum(v * CASE c WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END) END AS x FROM s GROUP BY 1)"""


@query(sql("", "fires", "groups") + f""", {SETS}, {SEVERITY_SQL}
          SELECT usgs_site, '{{' || array_to_string(events, ',') || '}}' AS events, round(sum(x * area) FILTER (x IS NOT NULL) / nullif(sum(area) FILTER (x IS NOT NULL), 0), 4) AS weighted_severity, count(*) FILTER (x IS NULL) > 0 AS has_missing_severity
          FROM members JOIN fires USING (usgs_site, event_id) LEFT JOIN i USING (event_id) GROUP BY usgs_site, events""")
def severity_index_rollup(t: Tables):
    found = V.severity_roll_up(groups(t), severity_rows(t), weights(t))
    return texts(found).select("usgs_site", "events", F.round("weighted_severity", 4).alias("weighted_severity"), "has_missing_severity")


@query(sql("", "fires", "groups") + f""", {SETS}, c AS (SELECT l_orderkey::VARCHAR AS event_id, sum(l_quantity) FILTER (l_returnflag = 'A') AS forest, sum(l_quantity) FILTER (l_returnflag = 'N') AS shrub FROM lineitem GROUP BY 1)
          SELECT usgs_site, '{{' || array_to_string(events, ',') || '}}' AS events, round(sum(coalesce(forest, 0) * area) FILTER (c.event_id IS NOT NULL) / nullif(sum(area) FILTER (c.event_id IS NOT NULL), 0), 4) AS weighted_forest,
                 round(sum(coalesce(shrub, 0) * area) FILTER (c.event_id IS NOT NULL) / nullif(sum(area) FILTER (c.event_id IS NOT NULL), 0), 4) AS weighted_shrub, count(*) FILTER (c.event_id IS NULL) > 0 AS has_missing_cover
          FROM members LEFT JOIN fires USING (usgs_site, event_id) LEFT JOIN c USING (event_id) GROUP BY usgs_site, events""")
def group_share_rollup(t: Tables):
    lines = t.lineitem.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.when(F.col("l_returnflag") == "A", "forest").when(F.col("l_returnflag") == "N", "shrub").otherwise("grass")
    cover = lines.groupBy(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderkey").cast("string").alias("event_id"), label.alias("landcover_group")).agg(F.sum("l_quantity").alias("group_value"))
    found = V.cover_roll_up(groups(t), cover, weights(t))
    return texts(found).select("usgs_site", "events", F.round("weighted_forest", 4).alias("weighted_forest"), F.round("weighted_shrub", 4).alias("weighted_shrub"), "has_missing_cover")


@query(sql("", "fires", "groups") + f""", {SETS}, s AS (SELECT l_orderkey::VARCHAR AS event_id, sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS v FROM lineitem GROUP BY 1)
          SELECT usgs_site, round(sum(v), 2) AS severity_sum FROM (SELECT DISTINCT usgs_site, event_id FROM members) JOIN s USING (event_id) GROUP BY 1""")
def severity_sum(t: Tables):
    return V.severity_sum(groups(t), severity_rows(t)).withColumn("severity_sum", F.round("severity_sum", 2))


@query("""SELECT c_nationkey AS region_id, c_mktsegment AS usgs_site FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, sum(abs(c_acctbal)) AS a FROM customer GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, round(a, 2) DESC, c_nationkey) = 1""")
def dominant_class(t: Tables):
    from ..plans.spatial import dominant_region

    shares = t.customer.groupBy(F.col("c_mktsegment").alias("usgs_site"), F.col("c_nationkey").alias("region_id")).agg(F.count(F.lit(1)).alias("percent_overlap"), F.round(F.sum(F.abs("c_acctbal")), 2).alias("overlap_area"))
    return dominant_region(shares).select("usgs_site", "region_id")


@query("""WITH e AS (SELECT user_id, ts::DATE AS date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), s AS (SELECT user_id, min(date) AS lo, max(date) AS hi FROM e GROUP BY 1),
          c AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM s) SELECT c.user_id, c.date, e.value FROM c LEFT JOIN e USING (user_id, date)""")
def calendar_complete(t: Tables):
    rows = t.events.groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(F.round(F.avg("value"), 6).alias("value"))
    return D.complete_calendar(rows, "user_id", "date", "value")


@query("""WITH e AS (SELECT DISTINCT user_id, ts::DATE AS date FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, date_diff('day', min(date), max(date)) + 1 - count(*) AS missing FROM e GROUP BY 1)
          SELECT e.user_id, e.date FROM e JOIN s USING (user_id) WHERE missing <= 18""")
def gap_screen(t: Tables):
    rows = t.events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(F.max("value").alias("value"))
    return D.gap_screen(rows, "user_id", "date", "value", most_missing=18).select("user_id", "date")


@query(sql("""SELECT r.usgs_site, r.date, r.flow FROM recent r WHERE r.usgs_site NOT IN (SELECT usgs_site FROM (
              SELECT usgs_site, year(date) AS y, count(*) - count(flow) AS missing FROM complete GROUP BY 1, 2) GROUP BY 1 HAVING count(DISTINCT y) < 4 OR max(missing) > 360)""", "flow").replace(" SELECT r.usgs_site", """, recent AS (SELECT f.* FROM flow f JOIN (SELECT usgs_site, (max(date) - INTERVAL 60 MONTH)::DATE AS lo FROM flow GROUP BY 1) USING (usgs_site) WHERE date >= lo),
              calendar AS (SELECT usgs_site, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM recent GROUP BY usgs_site), complete AS (SELECT c.usgs_site, c.date, r.flow FROM calendar c LEFT JOIN recent r USING (usgs_site, date)) SELECT r.usgs_site""", 1))
def record_screen(t: Tables):
    return D.record_screen(t.flow().select("usgs_site", "date", "flow"), "usgs_site", "date", "flow", years=5, least_years=4, most_missing=360)


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), i AS (SELECT user_id, event_type FROM events)
          SELECT (SELECT count(*) FROM i) AS n_incoming, (SELECT count(*) FROM (SELECT DISTINCT * FROM i)) AS n_unique, (SELECT count(*) FROM (SELECT DISTINCT * FROM i EXCEPT SELECT * FROM p)) AS n_added, (SELECT count(*) FROM p) AS n_present""")
def ingest_log(t: Tables):
    present = t.events.where("event_id % 2 = 0").select("user_id", "event_type").distinct()
    return D.append_new(present, t.events.select("user_id", "event_type"), ["user_id", "event_type"], ["user_id", "event_type"])[1]


@query("""SELECT c_custkey AS site, CASE WHEN c_custkey % 13 = 0 THEN 'error' WHEN count(o_orderkey) > 0 THEN 'success_data' ELSE 'success_empty' END AS status, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def fetch_status(t: Tables):
    sites = t.customer.select(F.col("c_custkey").alias("site"))
    return D.fetch_status(t.orders.select(F.col("o_custkey").alias("site")), sites, sites.where("site % 13 = 0"), "site")


@query("SELECT c_custkey AS site FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P'))")
def sites_to_fetch(t: Tables):
    checkpoint = t.orders.select(F.col("o_custkey").alias("site"), F.col("o_orderstatus").alias("status"))
    return D.to_fetch(t.customer.select(F.col("c_custkey").alias("site")), checkpoint, "site", ("F", "P"))


@query("SELECT o_custkey::VARCHAR AS site, (min(o_orderdate::DATE) - INTERVAL 1 MONTH)::DATE AS start_date, o_custkey::VARCHAR AS site_no FROM orders GROUP BY o_custkey")
def fetch_start(t: Tables):
    return D.fetch_start(t.orders.select(F.col("o_custkey").cast("string").alias("site"), F.col("o_orderdate").cast("date").alias("date")), "site", "date")


@query("""SELECT o_custkey::VARCHAR AS usgs_site, o_orderdate::DATE AS date, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'F'), avg(o_totalprice) FILTER (o_orderstatus = 'O')), 6) AS value_std,
          CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'NO3_NO2' ELSE 'NO3' END AS analyte_std FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def coalesce_analytes(t: Tables):
    label = F.when(F.col("o_orderstatus") == "F", "NO3_NO2").when(F.col("o_orderstatus") == "O", "NO3").otherwise("other")
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderdate").cast("date").alias("date"), label.alias("analyte_std"), F.col("o_totalprice").alias("value_std"))
    return C.coalesce_analytes(rows).withColumn("value_std", F.round("value_std", 6))


@query("SELECT p_brand, min(p_size) AS loq, count(p_size) AS n, count(*) FILTER (p_size = m) AS n_at_loq, round(100e0 * count(*) FILTER (p_size = m) / count(p_size), 6) AS percent_at_loq FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY 1")
def share_at_limit(t: Tables):
    return C.share_at_limit(t.part, ["p_brand"], "p_size").withColumn("percent_at_loq", F.round("percent_at_loq", 6))


@query("SELECT p_partkey, CASE WHEN p_size <= m THEN 'left' ELSE 'none' END AS censored, round(ln(greatest(p_size, m)), 9) AS log_value FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS m FROM part)")
def left_censored(t: Tables):
    return C.left_censored(t.part, "p_size", ["p_brand"]).select("p_partkey", "censored", F.round("log_value", 9).alias("log_value"))


BANDED = """q AS (SELECT usgs_site, quantile_cont(flow, 0.025) AS a, quantile_cont(flow, 0.25) AS b, quantile_cont(flow, 0.5) AS c, quantile_cont(flow, 0.75) AS d, quantile_cont(flow, 0.975) AS e FROM flow GROUP BY 1),
    bands AS (SELECT f.usgs_site, f.date, flow, CASE WHEN flow <= a THEN '0-2.5' WHEN flow <= b THEN '2.5-25' WHEN flow <= c THEN '25-50' WHEN flow <= d THEN '50-75' WHEN flow <= e THEN '75-97.5' ELSE '97.5-100' END AS band FROM flow f JOIN q USING (usgs_site))"""


@query(sql("", "flow") + f""", {BANDED} SELECT usgs_site, """ + ", ".join(f"count(*) FILTER (band = '{b}') AS \"{b}\"" for b in R.BANDS) + " FROM bands GROUP BY 1")
def percentile_bands_pivot(t: Tables):
    from ..operators.aggregates import pivot_counts

    return pivot_counts(R.flow_bands(t.flow()), ["usgs_site"], "band", R.BANDS, fill=0)


@query(sql("", "flow", "obs", "fires", "sites") + f""", {BANDED}, s AS (SELECT o.usgs_site, o.date, band FROM obs o JOIN bands USING (usgs_site, date)),
    k AS (SELECT f.usgs_site, f.event_id, f.ig_date, round(100e0 * area / catch_area, 2) AS per_cent_burned, s.band, CASE WHEN s.date >= f.ig_date - INTERVAL 4 YEAR AND s.date < f.ig_date THEN 'pre' WHEN s.date > f.ig_date AND s.date <= f.ig_date + INTERVAL 4 YEAR THEN 'post' END AS side
          FROM fires f JOIN sites USING (usgs_site) JOIN s USING (usgs_site))
    SELECT usgs_site, event_id, count(*) FILTER (side = 'pre') AS n_pre, count(*) FILTER (side = 'post') AS n_post, count(*) FILTER (side = 'pre' AND band = '25-50') AS pre_mid, count(*) FILTER (side = 'post' AND band = '97.5-100') AS post_top FROM k GROUP BY 1, 2""")
def screening_band_counts(t: Tables):
    found = R.band_counts(R.samples_in_bands(t.observations(), t.flow()), burned_events(t), years=4)
    return found.select("usgs_site", "event_id", "n_pre", "n_post", F.col("pre_25-50").alias("pre_mid"), F.col("`post_97.5-100`").alias("post_top"))


def burned_events(t: Tables):
    return E.event_areas(t.events_on_sites().withColumnRenamed("area", "fire_catch_area"), t.sites()).select("usgs_site", "event_id", "ig_date", "per_cent_burned")


def gate_sql(bands: str, least: tuple[int, int], sides: tuple[str, ...], years: int, choose_first: bool = False, record: str = "SELECT * FROM flow") -> str:
    """record: the flows whose quantiles make the bands."""
    names = bands.split("|")
    gates = " AND ".join(f"count(*) FILTER (side = '{s}' AND band = '{b}') > 0" for s in sides for b in names)
    chosen = "largest AS (SELECT * FROM burned QUALIFY row_number() OVER (PARTITION BY usgs_site ORDER BY per_cent_burned DESC, event_id) = 1)" if choose_first else "largest AS (SELECT * FROM burned)"
    return sql("", "flow", "obs", "fires", "sites") + f""", record AS ({record}), {BANDED.replace("FROM flow", "FROM record")}, s AS (SELECT o.usgs_site, o.date, band FROM obs o JOIN bands USING (usgs_site, date)),
    {BURNED}, {chosen},
    k AS (SELECT f.*, s.band, {SIDE.format(years=years)} AS side FROM largest f JOIN s USING (usgs_site)),
    {GATED.format(least=least, gates=gates)}"""


BURNED = "burned AS (SELECT f.usgs_site, f.event_id, f.ig_date, round(100e0 * area / catch_area, 2) AS per_cent_burned FROM fires f JOIN sites USING (usgs_site))"
SIDE = "CASE WHEN s.date >= f.ig_date - INTERVAL {years} YEAR AND s.date < f.ig_date THEN 'pre' WHEN s.date > f.ig_date AND s.date <= f.ig_date + INTERVAL {years} YEAR THEN 'post' END"
GATED = """g AS (SELECT usgs_site, event_id, per_cent_burned, count(*) FILTER (side = 'pre') AS n_pre, count(*) FILTER (side = 'post') AS n_post FROM k GROUP BY 1, 2, 3 HAVING count(*) FILTER (side = 'pre') >= {least[0]} AND count(*) FILTER (side = 'post') >= {least[1]} AND {gates})
    SELECT usgs_site, event_id, n_pre, n_post FROM g QUALIFY row_number() OVER (PARTITION BY usgs_site ORDER BY per_cent_burned DESC, event_id) = 1"""
SCREENED = ["usgs_site", "event_id", "n_pre", "n_post"]


@query(gate_sql("2.5-25|25-50", (2, 2), ("pre", "post"), 5, True))
def screening_largest_first(t: Tables):
    return R.screen_largest_first(t.observations(), t.flow(), burned_events(t), years=5, least=(2, 2), bands=R.INNER[:2]).select(*SCREENED)


@query(gate_sql("2.5-25|25-50|50-75", (3, 3), ("pre", "post"), 5, record="SELECT * FROM flow WHERE \"Flow_cd\" <> 'P'"))
def screening_all_events(t: Tables):
    flow = t.flow().withColumn("Flow_cd", F.when(F.col("Flow_cd") != "P", "A").otherwise("P"))
    return R.screen_all_events(t.observations(), flow, burned_events(t), least=(3, 3)).select(*SCREENED)


@query(gate_sql("2.5-25|25-50|50-75|75-97.5", (2, 2), ("pre", "post"), 4, record="SELECT f.* FROM flow f SEMI JOIN obs USING (usgs_site, date)"))
def screening_sampled_days(t: Tables):
    return R.screen_sampled_days(t.observations(), t.flow(), burned_events(t), least=(2, 2)).select(*SCREENED)


@query(sql("", "flow", "obs", "fires", "sites") + f""", {BURNED},
    q AS (SELECT f.usgs_site, f.event_id, quantile_cont(flow, 0.025) AS a, quantile_cont(flow, 0.25) AS b, quantile_cont(flow, 0.5) AS c, quantile_cont(flow, 0.75) AS d, quantile_cont(flow, 0.975) AS e
          FROM burned f JOIN flow s USING (usgs_site) WHERE {SIDE.format(years=4)} = 'pre' GROUP BY 1, 2),
    s AS (SELECT o.usgs_site, o.date, flow FROM obs o JOIN flow USING (usgs_site, date)),
    k AS (SELECT f.*, CASE WHEN flow <= a THEN '0-2.5' WHEN flow <= b THEN '2.5-25' WHEN flow <= c THEN '25-50' WHEN flow <= d THEN '50-75' WHEN flow <= e THEN '75-97.5' ELSE '97.5-100' END AS band, {SIDE.format(years=4)} AS side
          FROM burned f JOIN s USING (usgs_site) JOIN q USING (usgs_site, event_id)),
    {GATED.format(least=(4, 1), gates=" AND ".join(f"count(*) FILTER (side = 'pre' AND band = '{b}') > 0" for b in ("2.5-25", "25-50", "50-75", "75-97.5")))}""")
def screening_before_gate(t: Tables):
    samples = t.observations().join(t.flow().select("usgs_site", "date", "flow"), ["usgs_site", "date"])
    return R.screen_before_only(samples, t.flow(), burned_events(t), least=(4, 1)).select(*SCREENED)


@query(sql("", "flow", "obs") + f""", {BANDED}, s AS (SELECT o.usgs_site, o.date, band FROM obs o JOIN bands USING (usgs_site, date))
    SELECT usgs_site, date, CASE WHEN count(DISTINCT band) OVER (PARTITION BY usgs_site) = 6 THEN 'YES' ELSE 'NO' END AS "Pass_Hydro" FROM s""")
def hydrograph_flag(t: Tables):
    return R.hydrograph_flag(R.samples_in_bands(t.observations(), t.flow()), ["usgs_site"]).select("usgs_site", "date", "Pass_Hydro")


@query(sql("""SELECT 'nitrate' AS analyte, o.usgs_site, f.event_id, count(*) FILTER (f.ig_date IS NULL OR o.date <= f.ig_date) AS "Before", count(*) FILTER (o.date > f.ig_date) AS "After" FROM obs o LEFT JOIN fires f USING (usgs_site) GROUP BY ALL
              UNION ALL SELECT NULL, f.usgs_site, f.event_id, 0, 0 FROM fires f WHERE f.usgs_site NOT IN (SELECT usgs_site FROM obs)""", "obs", "fires"))
def records_by_event(t: Tables):
    return R.records_by_event(t.observations().withColumn("analyte", F.lit("nitrate")), t.events_on_sites().select("usgs_site", "event_id", "ig_date"))


@query("""SELECT lower(c_custkey::VARCHAR) AS usgs_site, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders, c_custkey IN (SELECT s_suppkey FROM supplier) AS has_suppliers,
          NOT (c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT s_suppkey FROM supplier)) AS any_missing FROM customer""")
def presence_log(t: Tables):
    site = lambda c: F.col(c).cast("string").alias("usgs_site")
    return E.presence_log(t.customer.select(site("c_custkey")), {"orders": t.orders.select(site("o_custkey")), "suppliers": t.supplier.select(site("s_suppkey"))})


@query(sql("", "fires", "groups") + f", {SETS} SELECT event_id::BIGINT % 3 <> 0 AS has_distance, count(*) AS n FROM (SELECT DISTINCT usgs_site, event_id FROM members) GROUP BY 1")
def distance_hits(t: Tables):
    known = t.events_on_sites().where(F.col("event_id").cast("long") % 3 != 0)
    return E.distance_hits(groups(t), known)


@query("SELECT s_name AS site, regexp_replace(s_name, 'supplier', '', 'i') AS bare_id FROM supplier WHERE regexp_replace(s_name, 'supplier', '', 'i') NOT IN (SELECT regexp_replace(s_name, 'supplier', '', 'i') FROM supplier WHERE s_acctbal > 0)")
def sites_without_lines(t: Tables):
    sites = t.supplier.select(F.col("s_name").alias("site"))
    return E.sites_without(sites, t.supplier.where("s_acctbal > 0"), "site", "s_name", "(?i)supplier").select("site", "bare_id")


@query("""WITH l AS (SELECT p_brand FROM (SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1) ORDER BY total DESC, p_brand LIMIT 4)
          SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM l) OR regexp_matches(p_brand, '#1[12]$', 'i')""")
def named_features(t: Tables):
    rows = t.part.select("p_partkey", "p_brand", F.round("p_retailprice", 2).cast("decimal(20,2)").alias("length"))
    return E.named_features(rows, "p_brand", "length", "#1[12]$").select("p_partkey", "p_brand")
