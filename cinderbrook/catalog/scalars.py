"""Predicates, conversions and scalar functions on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.joins import or_else
from .registry import Tables, query, sql

FACTORS = {"A": 14.0 / 62.0, "R": 14.0 / 18.0}


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_returnflag WHEN 'A' THEN 14e0 / 62e0 WHEN 'R' THEN 14e0 / 18e0 ELSE 1e0 END, 6) AS value_std,
          CASE WHEN l_returnflag IN ('A', 'R') THEN 'element' ELSE l_linestatus END AS units_std FROM lineitem""")
def unit_standardise(t: Tables):
    code = F.col("l_returnflag")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.convert_by_code(F.col("l_quantity"), code, FACTORS), 6).alias("value_std"), S.unit_by_code(F.col("l_linestatus"), code, "element", FACTORS).alias("units_std"))


@query("""SELECT p_partkey, round(CASE WHEN p_type ILIKE '%steel%' THEN p_retailprice * 14e0 / 1000e0 WHEN p_type ILIKE '%um%' THEN p_retailprice * 0.030974::DOUBLE ELSE p_retailprice END, 6) AS value_std FROM part""")
def unit_by_pattern(t: Tables):
    value = S.convert_by_pattern(F.col("p_retailprice"), F.col("p_type"), (("%steel%", 14.0 / 1000.0), ("%um%", 0.030974)))
    return t.part.select("p_partkey", F.round(value, 6).alias("value_std"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '00618' WHEN '2-HIGH' THEN '00095' ELSE o_orderpriority END AS code FROM orders")
def code_normalise(t: Tables):
    return t.orders.select("o_orderkey", S.mapped(F.col("o_orderpriority"), {"1-URGENT": "00618", "2-HIGH": "00095"}).alias("code"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'a', 'i') AND NOT regexp_matches(p_type, 'steel|x', 'i') AND p_brand NOT ILIKE '%11'")
def regex_predicates(t: Tables):
    return t.part.where(S.matches(F.col("p_name"), "a") & ~S.matches(F.col("p_type"), "steel|x") & ~F.col("p_brand").ilike("%11")).select("p_partkey", "p_name")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'promo', 'i') THEN 'one' WHEN regexp_matches(p_type, 'steel', 'i') THEN 'two'
          WHEN regexp_matches(p_type, 'o', 'i') THEN 'three' END AS label FROM part""")
def first_match_label(t: Tables):
    return t.part.select("p_partkey", S.first_match(F.col("p_type"), (("promo", "one"), ("steel", "two"), ("o", "three"))).alias("label"))


@query("SELECT o_orderkey, dayofyear(o_orderdate) BETWEEN 110 AND 250 AS summer FROM orders")
def season_predicate(t: Tables):
    return t.orders.select("o_orderkey", S.is_summer(F.col("o_orderdate")).alias("summer"))


@query("SELECT event_id, value FROM events WHERE value > 0 AND ln(value) > 0")
def positive_log_filter(t: Tables):
    return t.events.where((F.col("value") > 0)).where(F.ln("value") > 0).select("event_id", "value")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def accepted_flags(t: Tables):
    return t.orders.where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, CASE WHEN p_size NOT IN (1, 50) AND p_size BETWEEN 3 AND 45 THEN p_size END AS size FROM part")
def sentinel_removal(t: Tables):
    return t.part.select("p_partkey", S.without_sentinels(F.col("p_size"), (1, 50), 3, 45).alias("size"))


@query("""SELECT event_id, TRY_CAST(props ->> 'k' AS DOUBLE) AS k FROM events""")
def numeric_text_guard(t: Tables):
    return t.events.select("event_id", S.numeric_text(F.get_json_object("props", "$.k")).alias("k"))


@query("""SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 3 YEAR)::DATE AS lo, (o_orderdate::DATE + INTERVAL 3 YEAR)::DATE AS hi,
          date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS days, (year(o_orderdate) // 10 * 10)::INTEGER AS decade FROM orders""")
def date_arithmetic(t: Tables):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", S.years_before(day, 3).alias("lo"), S.years_after(day, 3).alias("hi"), F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"), S.decade(day).alias("decade"))


@query("""SELECT l_orderkey, '{' || array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR)), ',') || '}' AS parts, count(DISTINCT l_partkey)::INTEGER AS n
          FROM lineitem GROUP BY 1""")
def event_set_text(t: Tables):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("parts"))
    return sets.select("l_orderkey", S.set_text(S.event_set(F.col("parts"))).alias("parts"), F.size(S.event_set(F.col("parts"))).alias("n"))


@query("""SELECT l_orderkey, u.part FROM (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS part FROM lineitem) u""")
def event_set_round_trip(t: Tables):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("parts"))
    text = sets.select("l_orderkey", S.set_text(S.event_set(F.col("parts"))).alias("text"))
    return text.select("l_orderkey", F.explode(S.parse_set(F.col("text"))).alias("part"))


@query("""SELECT o_custkey, o_orderpriority AS class, count(*)::DOUBLE AS pixels FROM orders GROUP BY 1, 2""")
def histogram_parse(t: Tables):
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    text = counts.groupBy("o_custkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat("o_orderpriority", F.lit("="), F.col("n").cast("string"))), ", "), F.lit("}")).alias("histogram"))
    return text.select("o_custkey", F.explode(S.parse_histogram(F.regexp_replace("histogram", " SPECIFIED", "_SPECIFIED"))).alias("class", "pixels")).select("o_custkey", F.regexp_replace("class", "_SPECIFIED", " SPECIFIED").alias("class"), F.col("pixels").try_cast("double").alias("pixels"))


@query("SELECT p_partkey, (p_size & 248) = 0 AND (p_size & 1) = 0 AS clear FROM part")
def qa_bits(t: Tables):
    return t.part.select("p_partkey", S.bits_clear(F.col("p_size"), (0, 3, 4, 5, 6, 7)).alias("clear"))


@query("""WITH b AS (SELECT vec_id, embedding[1]::DOUBLE * 0.0000275::DOUBLE - 0.2::DOUBLE AS nir, embedding[2]::DOUBLE * 0.0000275::DOUBLE - 0.2::DOUBLE AS red, embedding[3]::DOUBLE * 0.0000275::DOUBLE - 0.2::DOUBLE AS blue FROM embeddings)
          SELECT vec_id, round((nir - red) / nullif(nir + red, 0), 9) AS ndvi, round(2.5::DOUBLE * (nir - red) / nullif(nir + 6 * red - 7.5::DOUBLE * blue + 1, 0), 9) AS evi, round(10 * nir - 9.8::DOUBLE * red + 2, 9) AS mirbi FROM b""")
def spectral_indices(t: Tables):
    nir, red, blue = (S.reflectance(F.col("embedding")[k].cast("double")) for k in range(3))
    return t.embeddings.select("vec_id", F.round(S.normalised_difference(nir, red), 9).alias("ndvi"), F.round(S.evi(nir, red, blue), 9).alias("evi"), F.round(S.mirbi(nir, red), 9).alias("mirbi"))


@query("""SELECT s_suppkey, lower(trim(s_name)) AS key, nullif(trim(substr(s_name, 30)), '') AS rest, regexp_extract(s_name, '([0-9]+)$', 1) AS number, lpad(s_suppkey::VARCHAR, 8, '0') AS padded,
          s_acctbal * 0.028316846592::DOUBLE AS m3s FROM supplier""")
def text_functions(t: Tables):
    return t.supplier.select("s_suppkey", F.lower(F.trim("s_name")).alias("key"), S.blank_to_null(F.substring("s_name", 30, 1000)).alias("rest"), F.regexp_extract("s_name", "([0-9]+)$", 1).alias("number"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("padded"), (F.col("s_acctbal") * S.CFS_TO_M3S).alias("m3s"))


@query("""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT), -1) AS number FROM pages""")
def url_parts(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.coalesce(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long"), F.lit(-1)).alias("number"))


@query(sql("SELECT usgs_site, date, flow FROM flow WHERE date < DATE '1997-01-01' UNION ALL SELECT usgs_site, date, value_std FROM obs WHERE NOT EXISTS (SELECT 1 FROM flow f WHERE f.usgs_site = obs.usgs_site AND f.date = obs.date AND f.date < DATE '1997-01-01')", "flow", "obs"))
def fallback_source(t: Tables):
    first = t.flow().where("date < date'1997-01-01'").select("usgs_site", "date", "flow")
    return or_else(first, t.observations().withColumnRenamed("value_std", "flow"), ["usgs_site", "date"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'middle' WHEN o_totalprice IS NOT NULL THEN 'high' END AS band, CASE WHEN o_totalprice / 100000 - 1 >= 0.2 THEN 'positive' WHEN o_totalprice / 100000 - 1 <= -0.2 THEN 'negative' ELSE 'neutral' END AS direction FROM orders")
def categorise(t: Tables):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", S.percentile_band(price, [F.lit(50000), F.lit(150000)], ("low", "middle", "high")).alias("band"), S.slope_direction(price / 100000 - 1).alias("direction"))
