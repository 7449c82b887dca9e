"""Exports and loads, rebuilds, gates and the wide export: what writes a table does so below the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import depth_to_discharge, local_date
from ..operators import quality as Q
from ..operators.aggregates import largest_by
from ..operators.joins import shared_columns_join
from ..operators.windows import position, sampled_keys
from ..plans import covariates as V
from ..plans import events as E
from ..plans import network as N
from ..plans import prepost as P
from ..plans import rebuild as B
from ..plans import spatial as S
from ..sources import readers as I
from ..sources import writers as O
from . import domain as D
from .models import BOXES, boxes
from .registry import ORACLE_SQL, Tables, query, sql


@query(ORACLE_SQL["prepost_observations"])
def exported_observations(t: Tables):
    """The export's ordered CSV, read back with its types."""
    rows, folder = D.prepost_observations(t), O.shared_folder(t.spark, "export")
    O.write_csv(P.export_order(rows), folder)
    return I.read_csv(t.spark, folder, rows.schema)


@query(ORACLE_SQL["season_groups"])
def exported_groups(t: Tables):
    """CSV with event sets as texts such as {a,b}."""
    folder = O.shared_folder(t.spark, "groups")
    O.write_csv(D.groups(t), folder, ["usgs_site", "start_date"])
    return I.read_csv(t.spark, folder, D.season_groups(t).schema)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 2 THEN o_totalprice END AS price FROM orders")
def custom_missing_tokens(t: Tables):
    """CSV in which NA, -999 and blanks stand for missing values."""
    price = F.when(F.col("o_orderkey") % 5 == 0, "NA").when(F.col("o_orderkey") % 5 == 1, "-999").when(F.col("o_orderkey") % 5 == 2, "").otherwise(F.col("o_totalprice").cast("string"))
    folder = O.shared_folder(t.spark, "tokens")
    O.write_csv(t.orders.select("o_orderkey", price.alias("price")), folder)
    return I.read_csv(t.spark, folder, "o_orderkey long, price double", na=("", "NA", "-999"))


@query("SELECT o_custkey::VARCHAR AS site_no, o_orderdate::DATE AS date, round(o_totalprice, 2) AS flow FROM orders")
def commented_gauge_rows(t: Tables):
    """Tab-separated text with comment lines and a row of type tokens."""
    folder = O.shared_folder(t.spark, "gauges")
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("site_no"), F.col("o_orderdate").cast("date").cast("string").alias("datetime"), F.col("o_totalprice").cast("string").alias("flow"))
    extra = t.spark.createDataFrame([("# retrieved", "", ""), ("15s", "20d", "14n")], rows.schema)
    extra.unionByName(rows).write.option("header", True).option("sep", "\t").csv(folder)
    found = I.read_commented_tsv(t.spark, folder, "date", {"datetime": "date"})
    return found.select("site_no", "date", F.round(F.col("flow").cast("double"), 2).alias("flow"))


AREAS = f"WITH {BOXES} SELECT site, round((x2 - x1) * (y2 - y1), 6) AS area FROM b"


@query(AREAS)
def geojson_layer(t: Tables):
    folder = O.shared_folder(t.spark, "layers")
    O.write_layers({"boxes": boxes(t).select("usgs_site", F.col("geometry").alias("rings"))}, folder)
    found = I.read_geojson_lines(t.spark, f"{folder}/boxes.geojsonl")
    return found.select(F.col("properties")["usgs_site"].alias("site"), F.round(G.polygon_area(F.col("rings")), 6).alias("area"))


@query(AREAS)
def binary_polygons(t: Tables):
    packed = boxes(t).select(F.col("usgs_site").alias("site"), O.well_known_binary("geometry").alias("shape"))
    return I.wkb_polygons(packed, "shape").select("site", F.round(G.polygon_area(F.col("rings")), 6).alias("area"))


@query(f"""WITH {BOXES}, d AS (SELECT vec_id::VARCHAR AS site, abs(embedding[6]::DOUBLE) * 0.1::DOUBLE AS off FROM embeddings)
           SELECT site, CASE WHEN off <= 0.02 AND off / (2 * (y2 - y1) + off) < 0.005 THEN 4 ELSE 5 END AS n_points FROM b JOIN d USING (site)""")
def simplified_rings(t: Tables):
    """Boxes with a dent below: it goes if it is shallow and hardly changes the area."""
    dent = t.embeddings.select(F.col("vec_id").cast("string").alias("usgs_site"), (F.abs(F.col("embedding")[5].cast("double")) * 0.1).alias("off"))
    ring = F.array(G.point(F.col("x1"), F.col("y1")), G.point((F.col("x1") + F.col("x2")) / 2, F.col("y1") - F.col("off")), *(G.point(F.col(x), F.col(y)) for x, y in (("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    found = boxes(t).join(dent, "usgs_site").select(F.col("usgs_site").alias("site"), S.simplified(F.array(ring), 0.02).alias("geometry"))
    return found.select("site", F.size(F.get("geometry", F.lit(0))).alias("n_points"))


@query(sql(f"""SELECT usgs_site, start_date, end_date, '{{' || array_to_string(events, ',') || '}}' AS events, count(*) FILTER (date < start_date) AS before_count, count(*) FILTER (date > end_date) AS after_count
              FROM groups JOIN (SELECT usgs_site, date FROM ({ORACLE_SQL["analyte_union_daily_mean"]}) JOIN banded USING (usgs_site, date)) USING (usgs_site) GROUP BY ALL""", "flow", "banded", "fires", "groups"))
def rebuilt_counts(t: Tables):
    """The counts of an analyte, as the rebuild of all its tables stored them."""
    folder = O.shared_folder(t.spark, "rebuilt")
    results, others, study = D.chemistry_tables(t)
    B.rebuild(results, others, study, D.banded_flow(t), D.with_area(t), folder, ["nitrate"])
    return D.texts(t.spark.read.parquet(f"{folder}/nitrate_counts"))


@query("SELECT * FROM (VALUES ('water_chem_std', 'success'), ('nitrate', 'success'), ('gold', 'warning'), ('check', 'error')) AS v(step, status)")
def rebuild_log(t: Tables):
    """An unknown analyte is a warning, and the tables that it leaves out fail the last check."""
    results, others, study = D.chemistry_tables(t)
    outcomes = B.rebuild(results, others, study, D.banded_flow(t), D.with_area(t), O.shared_folder(t.spark, "rebuilt"), ["nitrate", "gold"])
    return t.spark.createDataFrame([(o.step, o.status) for o in outcomes], "step string, status string")


@query(ORACLE_SQL["severity_index_rollup"])
def gated_rollup(t: Tables):
    """The severity roll-up behind its gate, which raises if a set of several events has unusable values or no weight."""
    found = V.strict_gate(V.severity_roll_up(D.groups(t), D.severity_rows(t), D.weights(t)), reject_missing=False)
    return D.texts(found).select("usgs_site", "events", F.round("weighted_severity", 4).alias("weighted_severity"), "has_missing_severity")


EXPORT_SETS = ORACLE_SQL["severity_index_rollup"]


@query(sql(f"""SELECT g.usgs_site, g.start_date, g.end_date, '{{' || array_to_string(g.events, ',') || '}}' AS events, g.fire_area, n_name AS ecoregion, g.year AS range_year, c_acctbal AS elevation, c_mktsegment AS land_cover,
               k."F", k."O", weighted_evi, weighted_severity
               FROM groups g LEFT JOIN customer ON c_custkey::VARCHAR = g.usgs_site LEFT JOIN nation ON n_nationkey = c_nationkey
               LEFT JOIN (SELECT o_custkey::VARCHAR AS usgs_site, nullif(count(*) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS "F", nullif(count(*) FILTER (o_orderstatus = 'O'), 0)::DOUBLE AS "O" FROM orders GROUP BY 1) k ON k.usgs_site = g.usgs_site
               LEFT JOIN ({ORACLE_SQL["weighted_event_rollup"]}) v ON v.usgs_site = g.usgs_site AND v.events = '{{' || array_to_string(g.events, ',') || '}}'
               LEFT JOIN ({EXPORT_SETS}) s ON s.usgs_site = g.usgs_site AND s.events = '{{' || array_to_string(g.events, ',') || '}}'""", "fires", "groups"))
def covariate_table(t: Tables):
    """Event groups with the covariates of their site, their window and their event set."""
    site = F.col("c_custkey").cast("string").alias("usgs_site")
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    classes = t.orders.where("o_orderstatus in ('F', 'O')").groupBy(F.col("o_custkey").cast("string").alias("usgs_site"), F.col("o_orderstatus").alias("fire_classification")).agg(F.count(F.lit(1)).cast("double").alias("classification_value"))
    tables = V.CovariateTables(
        ecoregion=customers.select(site, F.col("n_name").alias("ecoregion")),
        ranges=E.event_ranges(D.groups(t), t.sites()).select("usgs_site", "start_date", "end_date", F.col("year").alias("range_year")),
        elevation=t.customer.select(site, F.col("c_acctbal").alias("elevation")),
        land_cover=t.customer.select(site, F.col("c_mktsegment").alias("land_cover")),
        classifications=classes,
        evi=V.index_roll_up(D.groups(t), D.evi_values(t), D.weights(t)).select("usgs_site", "events", F.round("weighted_evi", 6).alias("weighted_evi")),
        severity=V.severity_roll_up(D.groups(t), D.severity_rows(t), D.weights(t)).select("usgs_site", "events", F.round("weighted_severity", 4).alias("weighted_severity")),
    )
    return D.texts(V.covariate_export(D.groups(t).drop("year"), tables, ["F", "O"]))


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def swapped_table(t: Tables):
    """A table rewritten with one row per key: staged, its keys checked, then put in the old one's place."""
    path = f"{O.shared_folder(t.spark, 'swapped')}/largest"
    rows = largest_by(t.orders, ["o_custkey"], "o_totalprice")
    O.write_table(rows.where(F.lit(False)), path)
    Q.swapped_write(rows, path, ["o_custkey"])
    return t.spark.read.parquet(path)


@query("SELECT c_custkey::VARCHAR AS usgs_site FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY 1 LIMIT 20")
def sites_left_to_run(t: Tables):
    """At most 20 sites that two appended checkpoints don't list; a run's site limit is the operator's own."""
    folder = O.shared_folder(t.spark, "log")
    done = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("usgs_site"), "o_orderkey")
    for part in (0, 1):
        O.append_checkpoint(done.where(F.col("o_orderkey") % 2 == part).select("usgs_site"), folder)
    return N.sites_to_run(t.customer.select(F.col("c_custkey").cast("string").alias("usgs_site")), t.spark.read.parquet(folder), 20)


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def local_dates(t: Tables):
    return t.orders.select("o_orderkey", local_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("day"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def shared_names_join(t: Tables):
    nations = t.nation.select("n_name", F.col("n_regionkey").alias("r_regionkey"))
    return shared_columns_join(nations, t.region.select("r_regionkey", "r_name")).select("n_name", "r_name")


@query("SELECT site, month, row_number() OVER (PARTITION BY site ORDER BY month)::INTEGER AS month_index FROM (SELECT DISTINCT o_custkey AS site, date_trunc('month', o_orderdate)::DATE AS month FROM orders)")
def month_positions(t: Tables):
    months = t.orders.select(F.col("o_custkey").alias("site"), F.trunc("o_orderdate", "month").alias("month")).distinct()
    return position(months, ["site"], ["month"], "month_index")


@query("SELECT o_orderkey, round(o_totalprice * 0.001 * 2500 * 1000 / 86400, 6) AS discharge FROM orders")
def depth_discharge(t: Tables):
    return t.orders.select("o_orderkey", F.round(depth_to_discharge(F.col("o_totalprice"), F.lit(2500.0)), 6).alias("discharge"))


@query("SELECT least(25, count(DISTINCT o_custkey)) AS n_sites, least(25, count(DISTINCT o_custkey)) AS n_rows FROM orders")
def sampled_sites(t: Tables):
    """A sample of 25 sites holds so many, each once, all of them known."""
    chosen = sampled_keys(t.orders, "o_custkey", 25).join(t.orders.select("o_custkey").distinct(), "o_custkey")
    return chosen.agg(F.count_distinct("o_custkey").alias("n_sites"), F.count(F.lit(1)).alias("n_rows"))
