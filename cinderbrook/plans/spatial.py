"""Overlays of polygons: a grid gives equality keys, bounding boxes and exact areas decide."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import bounding_box, boxes_meet, covered_area, first_shared_cell, grid_cells, is_upright, outermost, overlap_area, simplify_guarded, spheroidal_area
from ..operators.joins import not_in
from ..operators.windows import first_per_key
from .tiles import SIDES, batch_of, met, numbers, tiled

RINGS = "array<array<struct<x:double,y:double>>>"


def as_rings(value) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in ring], float) for ring in value if len(ring) > 2] if value is not None else []


@F.arrow_udf(T.DoubleType())
def overlap_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([overlap_area(as_rings(x), as_rings(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@F.arrow_udf(T.DoubleType())
def covered_udf(site: pa.Array, polygons: pa.Array) -> pa.Array:
    return pa.array([covered_area(as_rings(x), [as_rings(p) for p in y]) for x, y in zip(site.to_pylist(), polygons.to_pylist())], pa.float64())


@F.arrow_udf(T.DoubleType())
def spheroidal_area_udf(a: pa.Array) -> pa.Array:
    return pa.array([spheroidal_area(as_rings(x)) for x in a.to_pylist()], pa.float64())


def simplified(geometry: Column, tolerance: float, most_change: float = 0.005) -> Column:
    """Polygons with each ring simplified, unless that changes its area by the part given or more."""

    @F.arrow_udf(RINGS)
    def rings_udf(polygons: pa.Array) -> pa.Array:
        shape = lambda ring: [{"x": x, "y": y} for x, y in simplify_guarded(ring, tolerance, most_change).tolist()]
        return pa.array([None if rings is None else [shape(ring) for ring in as_rings(rings)] for rings in polygons.to_pylist()], polygons.type)

    return rings_udf(geometry)


def boxed(df: DataFrame, geom: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a polygon and its `__box`: upright rectangles, which their boxes describe, and the others."""
    found = df.where(F.size(geom) > 0).withColumn("__box", bounding_box(F.get(F.col(geom), F.lit(0))))
    upright = F.coalesce(is_upright(F.col(geom)), F.lit(False))
    return found.where(upright), found.where(~upright)


def other_overlay(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, cell: float) -> DataFrame:
    """The pairs of `overlay` of which at least one is no upright rectangle, with all columns of both."""
    def dealt(df, name):
        return df.withColumnRenamed("__box", name).withColumn("__cell", F.explode(grid_cells(F.col(name), cell)))

    def met(one, two):
        joined = dealt(one, "__box_a").join(dealt(two, "__box_b"), "__cell")
        joined = joined.where(boxes_meet(F.col("__box_a"), F.col("__box_b")) & (F.col("__cell") == first_shared_cell(F.col("__box_a"), F.col("__box_b"), cell)))
        return joined.drop("__cell", "__box_a", "__box_b")

    (plain_a, other_a), (plain_b, other_b) = boxed(left, left_geom), boxed(right, right_geom)
    found = met(other_a, plain_b.unionByName(other_b)).unionByName(met(plain_a, other_b))
    return found.withColumn("overlap_area", overlap_udf(left_geom, right_geom)).where("overlap_area > 0")


def overlay(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, cell: float) -> DataFrame:
    """Pairs of polygons that overlap: the other columns of both, which differ in name, and the overlap's planar area.

    Both sides are dealt to the cells their boxes touch and joined by cell; a pair stays in the first cell that both share, so it
    is measured once. Pairs of upright rectangles are measured by their boxes alone, in tiles; no pair is shuffled. A tile's pairs
    come by the right side's rows, whose columns so repeat in a row and take little room in files.
    """
    left_columns, right_columns = ([c for c in df.columns if c != geom] for df, geom in ((left, left_geom), (right, right_geom)))

    def pairs(a, b, i, j):
        for rows, others, w, h in met(b, a, i, j, cell):
            w *= h
            r, c = np.nonzero(w > 0)
            if len(r):
                ra, cb = pa.array(others[c]), pa.array(rows[r])
                yield batch_of(**{k: a[k].take(ra) for k in left_columns}, **{k: b[k].take(cb) for k in right_columns}, overlap_area=w[r, c])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for df, columns in ((left, left_columns), (right, right_columns)) for f in df.select(*columns).schema)
    upright = tiled(boxed(left, left_geom)[0], boxed(right, right_geom)[0], left_columns, right_columns, cell, pairs, f"{schema}, overlap_area double")
    return upright.unionByName(other_overlay(left, right, left_geom, right_geom, cell).drop(left_geom, right_geom))


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")


def marked(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `many`: whether others have their keys."""
    return df.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def share_inside(sites: DataFrame, area: DataFrame, cell: float, least_percent: float = 75.0) -> DataFrame:
    """Sites of which at least so many percent (to one place) lie inside the union of the polygons of `area`, which may overlap.

    Upright sites inside a single upright polygon are whole; of the others' clipped rectangles, those inside another one are left out.
    """
    from ..functions.geometry import polygon_area

    key, corners = sites.schema["usgs_site"].dataType.simpleString(), ", ".join(f"{s} double" for s in SIDES)
    plain, other = boxed(sites, "geometry")
    named = area.select(F.col("geometry").alias("area_geometry"))
    plain_area = boxed(named, "area_geometry")[0]

    def whole(a, b, i, j):
        x1, y1, x2, y2 = numbers(a, *SIDES)
        full = np.zeros(len(x1), bool)
        for rows, _, w, h in met(a, b, i, j, cell):
            full[rows] |= ((w == (x2 - x1)[rows, None]) & (h == (y2 - y1)[rows, None])).any(axis=1)
        rows = pa.array(np.flatnonzero(full & (x2 > x1) & (y2 > y1)))
        if len(rows):
            yield batch_of(**{c: a[c].take(rows) for c in ("usgs_site", *SIDES)})

    def clipped(a, b, i, j):
        mine, theirs = np.column_stack(numbers(a, *SIDES)), np.column_stack(numbers(b, *SIDES))
        found: dict[int, list[np.ndarray]] = {}
        for rows, others, w, h in met(a, b, i, j, cell):
            hit = (w > 0) & (h > 0)
            for k in np.flatnonzero(hit.any(axis=1)):
                row, there = mine[rows[k]], theirs[others[hit[k]]]
                found.setdefault(int(rows[k]), []).append(np.hstack([np.maximum(row[:2], there[:, :2]), np.minimum(row[2:], there[:, 2:])]))
        for row, parts in found.items():
            kept = outermost(np.vstack(parts))
            polygons = [[[{"x": x, "y": y} for x, y in ((p, q), (r, q), (r, s), (p, s))]] for p, q, r, s in kept.tolist()]
            yield batch_of(**{c: a[c].take(pa.array([row])) for c in ("usgs_site", *SIDES)}, parts=pa.array([polygons], pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))))

    by_box = ["usgs_site", *SIDES]
    boxes = plain.select("*", *(F.col("__box")[s].alias(s) for s in SIDES))
    full = tiled(plain, plain_area, ["usgs_site"], [], cell, whole, f"usgs_site {key}, {corners}").distinct()
    left = boxes.join(full, by_box, "left_anti")
    parts = tiled(left, plain_area, ["usgs_site"], [], cell, clipped, f"usgs_site {key}, {corners}, parts array<{RINGS}>")
    beside = other_overlay(left.select(*by_box, "geometry"), named, "geometry", "area_geometry", cell).select(*by_box, F.array("area_geometry").alias("parts"))
    of_left = parts.unionByName(beside).groupBy(*by_box).agg(F.flatten(F.collect_list("parts")).alias("parts"))
    of_left = left.join(of_left, by_box).withColumn("inside", covered_udf("geometry", "parts"))
    of_full = boxes.join(full, by_box).withColumn("inside", polygon_area(F.col("geometry")))
    of_other = other_overlay(other.drop("__box").select("usgs_site", "geometry"), named, "geometry", "area_geometry", cell).groupBy("usgs_site", "geometry").agg(F.collect_list("area_geometry").alias("parts"))
    of_other = other.join(of_other, ["usgs_site", "geometry"]).withColumn("inside", covered_udf("geometry", "parts"))
    found = of_left.select(*sites.columns, "inside").unionByName(of_full.select(*sites.columns, "inside")).unionByName(of_other.select(*sites.columns, "inside"))
    found = found.withColumn("ecoregion_pct", F.round(F.lit(100.0) * F.try_divide("inside", polygon_area(F.col("geometry"))), 1))
    return found.drop("inside").where(F.col("ecoregion_pct") >= least_percent)


def events_on_sites(sites: DataFrame, events: DataFrame, cell: float) -> DataFrame:
    """(usgs_site, event_id, ig_date, overlap_area) of events whose polygon overlaps a site's, each such row once.

    Rows can only be equal where a site's or an event's id is repeated: only those pairs are compared.
    """
    one, two = sites.select("usgs_site", "geometry"), events.select("event_id", "ig_date", F.col("geometry").alias("event_geometry"))
    found = lambda a, b: overlay(a, b, "geometry", "event_geometry", cell)
    if repeats(one, ["usgs_site"]).isEmpty() and repeats(two, ["event_id", "ig_date"]).isEmpty():
        return found(one, two)
    one, two = marked(one, ["usgs_site"]), marked(two, ["event_id", "ig_date"])
    (once_a, many_a), (once_b, many_b) = ((df.where("not many").drop("many"), df.where("many").drop("many")) for df in (one, two))
    several = found(many_a, two.drop("many")).unionByName(found(once_a, many_b)).distinct()
    return found(once_a, once_b).unionByName(several)


def add_events_on_sites(present: DataFrame, sites: DataFrame, events: DataFrame, cell: float) -> DataFrame:
    """The overlay with what new sites or events add; pairs already present stay as they are.

    Pairs of a new site or a new event can't be present. Of the others, an event's pairs are all present if their number and two
    64-bit sums of hashes agree with the overlay's; only where they don't, pairs are compared one by one.
    """
    def pairs_of(pairs, name):
        sums = [F.sum(h("usgs_site", "event_id").cast("decimal(20,0)")).alias(f"{name}_{k}") for k, h in enumerate((F.xxhash64, lambda *c: F.xxhash64(F.lit("again"), *c)))]
        return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias(f"{name}_n"), *sums)

    known_events, known_sites = present.select("event_id").distinct(), present.select("usgs_site").distinct()
    new_events, old_events = (events.join(known_events, "event_id", how) for how in ("left_anti", "left_semi"))
    new_sites, old_sites = (sites.join(known_sites, "usgs_site", how) for how in ("left_anti", "left_semi"))
    old_pairs = lambda of: events_on_sites(old_sites, of, cell)
    before, now = pairs_of(present, "before"), pairs_of(old_pairs(old_events), "now")
    agree = [F.col(f"before_{k}") == F.col(f"now_{k}") for k in ("n", 0, 1)]
    changed = now.join(before, "event_id").where(~(agree[0] & agree[1] & agree[2])).select("event_id")
    added = events_on_sites(sites, new_events, cell).unionByName(events_on_sites(new_sites, old_events, cell))
    if not changed.isEmpty():
        again = old_pairs(events.join(changed, "event_id", "left_semi"))
        added = added.unionByName(not_in(again, present.join(changed, "event_id", "left_semi"), ["usgs_site", "event_id"]))
    return present.unionByName(added)


def region_shares(sites: DataFrame, regions: DataFrame, cell: float, manual: DataFrame | None = None, excluded: tuple = (68,)) -> DataFrame:
    """(usgs_site, region_id, overlap_area, percent_overlap), with manual rows for sites that the overlay lacks."""
    from ..functions.geometry import polygon_area

    kept = regions.where(~F.col("region_id").isin(*excluded)).select("region_id", F.col("geometry").alias("region_geometry"))
    measured = sites.select("usgs_site", "geometry", polygon_area(F.col("geometry")).alias("__area"))  # once per site, not per pair
    parts = overlay(measured, kept, "geometry", "region_geometry", cell)
    return with_manual(parts, manual)


def with_manual(parts: DataFrame, manual: DataFrame | None) -> DataFrame:
    found = parts.withColumn("percent_overlap", F.lit(100.0) * F.try_divide("overlap_area", "__area")).select("usgs_site", "region_id", "overlap_area", "percent_overlap")
    return found if manual is None else found.unionByName(not_in(manual, found, ["usgs_site"]))


def dominant_region(shares: DataFrame) -> DataFrame:
    """The region that covers most of each site: by percent, then area, then the smaller id; null shares rank first, as by default."""
    return first_per_key(shares, ["usgs_site"], [F.col("percent_overlap").desc_nulls_first(), F.col("overlap_area").desc_nulls_first(), F.col("region_id").asc_nulls_last()])


def dominant_regions(sites: DataFrame, regions: DataFrame, cell: float, manual: DataFrame | None = None, excluded: tuple = (68,)) -> DataFrame:
    """dominant_region of region_shares: of a site's upright regions each tile hands on the first only, so pairs aren't shuffled."""
    from ..functions.geometry import polygon_area

    kept = regions.where(~F.col("region_id").isin(*excluded)).select("region_id", F.col("geometry").alias("region_geometry"))
    measured = sites.select("usgs_site", "geometry", polygon_area(F.col("geometry")).alias("__area"))

    def first(a, b, i, j):
        order = pa.compute.sort_indices(b["region_id"], null_placement="at_end").to_numpy().astype(np.int64)  # of equal areas the smaller id
        best, which = np.zeros(len(a["x1"])), np.zeros(len(a["x1"]), np.int64)
        for rows, others, w, h in met(a, b, i, j, cell, order):
            w *= h
            at = w.argmax(axis=1)
            best[rows], which[rows] = w[np.arange(len(rows)), at], others[at]
        rows = np.flatnonzero(best > 0)
        if len(rows):
            yield batch_of(usgs_site=a["usgs_site"].take(pa.array(rows)), __area=a["__area"].take(pa.array(rows)), region_id=b["region_id"].take(pa.array(which[rows])), overlap_area=best[rows])

    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((sites, "usgs_site"), (regions, "region_id"))}
    upright = tiled(boxed(measured, "geometry")[0], boxed(kept, "region_geometry")[0], ["usgs_site", "__area"], ["region_id"], cell, first, f"usgs_site {kind['usgs_site']}, __area double, region_id {kind['region_id']}, overlap_area double")
    parts = upright.unionByName(other_overlay(measured, kept, "geometry", "region_geometry", cell).drop("geometry", "region_geometry"))
    return dominant_region(with_manual(parts, manual))


def pairwise_overlap(sites: DataFrame, cell: float) -> DataFrame:
    """(site_1, site_2, overlap_area, percent_of_1, percent_of_2) of sites that overlap, each pair once."""
    from ..functions.geometry import polygon_area

    # areas once per site, not per pair
    one, two = (sites.select(F.col("usgs_site").alias(f"site_{k}"), F.col("geometry").alias(f"geometry_{k}"), polygon_area(F.col("geometry")).alias(f"__area_{k}")) for k in (1, 2))
    found = overlay(one, two, "geometry_1", "geometry_2", cell).where("site_1 < site_2")
    percent = lambda k: F.lit(100.0) * F.try_divide("overlap_area", f"__area_{k}")
    return found.select("site_1", "site_2", "overlap_area", percent(1).alias("percent_of_1"), percent(2).alias("percent_of_2"))


def zonal_statistics(pixels: DataFrame, keys: list[str], fill: tuple = (), scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Plain statistics of the pixels that touch a zone, fill values left out."""
    value = F.col("value") * scale + offset
    kept = pixels.where(F.col("value").isNotNull() & (~F.col("value").isin(*fill) if fill else F.lit(True)))
    return kept.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))


def zonal_mode(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent value of each zone; of equals the smallest."""
    counts = pixels.dropna(subset=["value"]).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


def zones_by_median(pixels: DataFrame, keys: list[str], most: float, forced: DataFrame | None = None) -> DataFrame:
    """(keys, median) of the zones whose median is at most `most`, and of the forced zones (keys) whatever theirs is."""
    medians = pixels.dropna(subset=["value"]).groupBy(*keys).agg(F.median("value").alias("median"))
    wanted = F.col("median") <= most
    if forced is None:
        return medians.where(wanted)
    marked = medians.join(forced.select(*keys, F.lit(True).alias("__forced")).distinct(), keys, "left")
    return marked.where(wanted | F.col("__forced")).drop("__forced")


def terrain_slope(pixels: DataFrame, grid: Sequence[str], x: str, y: str, value: str, *, size: float = 1.0) -> DataFrame:
    """Slope in degrees of each pixel of elevation grids, by the weighted differences across its eight neighbours.

    x and y are column and row numbers, `size` a pixel's side; a pixel without all eight neighbours has a null slope.
    """
    row = Window.partitionBy(*grid, y).orderBy(x)
    column = Window.partitionBy(*grid, x).orderBy(y)
    beside = lambda value, over, by: F.when((F.lag(by).over(over) == F.col(by) - 1) & (F.lead(by).over(over) == F.col(by) + 1), value)
    left, right = F.lag(value).over(row), F.lead(value).over(row)
    across = pixels.select(*grid, x, y, value, beside(right - left, row, x).alias("__dx"), beside(left + 2 * F.col(value) + right, row, x).alias("__sum"))
    dx = beside(F.lag("__dx").over(column) + 2 * F.col("__dx") + F.lead("__dx").over(column), column, y) / (8 * size)
    dy = beside(F.lead("__sum").over(column) - F.lag("__sum").over(column), column, y) / (8 * size)
    return across.select(*grid, x, y, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"))


def class_shares(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Covered area of each class and its share of the zone's."""
    from ..operators.aggregates import share_of_group

    return share_of_group(pixels.groupBy(*keys, "value").agg(F.sum("coverage_area").alias("class_area")), keys, "class_area")


def frequency_map(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """A map value -> number of pixels for each zone."""
    counts = pixels.dropna(subset=["value"]).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("histogram"))


def seasonal_composite(scenes: list[DataFrame], keys: list[str], event_day: str, value: str, *, first: int = 171, last: int = 244, year: int = 3) -> DataFrame:
    """Mean of the clear observations in the season of the given year after the event, else of that and the following year."""
    merged = scenes[0]
    for scene in scenes[1:]:
        merged = merged.unionByName(scene)
    rows = merged.where(F.col("clear") & F.dayofyear("date").between(first, last)).withColumn("__after", F.year("date") - F.year(event_day))
    primary = F.avg(F.when(F.col("__after") == year, F.col(value)))
    fallback = F.avg(F.when(F.col("__after").between(year, year + 1), F.col(value)))
    return rows.groupBy(*keys).agg(F.coalesce(primary, fallback).alias("composite")).where("composite is not null")


def burned_watersheds(sites: DataFrame, events: DataFrame, cell: float) -> DataFrame:
    """Per site: number of events, their whole area (from acres) and the area within the site, in km².

    Tiles of upright polygons hand on sums. Events are counted there too, but for those whose site or event has several polygons:
    their ids are handed on, and each counts once.
    """
    from ..functions.scalars import ACRES_TO_KM2

    one = marked(sites.select("usgs_site", "geometry"), ["usgs_site"]).withColumnRenamed("many", "site_many")
    two = marked(events.select("event_id", F.col("acres").cast("double").alias("acres"), F.col("geometry").alias("event_geometry")), ["event_id"]).withColumnRenamed("many", "event_many")
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((one, "usgs_site"), (two, "event_id"))}

    def sums(a, b, i, j):
        n = len(a["x1"])
        once, known, within, acres, ids = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), [[] for _ in range(n)]
        (site_many,), (event_many,) = numbers(a, "site_many"), numbers(b, "event_many")
        has_id, has_acres = (np.asarray(b[c].is_valid()) for c in ("event_id", "acres"))
        amount = np.where(has_acres, np.nan_to_num(numbers(b, "acres")[0].astype(float), nan=0.0), 0.0)
        several = bool(site_many.any() or event_many.any())
        summed = np.column_stack([has_acres, amount, has_id & ~event_many]).astype(float)
        for rows, others, w, h in met(a, b, i, j, cell):
            w *= h
            hit = w > 0
            within[rows] += w.sum(axis=1)
            found = hit.astype(float) @ summed[others]
            known[rows] += found[:, 0].astype(np.int64)
            acres[rows] += found[:, 1]
            once[rows] += np.where(site_many[rows], 0, found[:, 2]).astype(np.int64)
            if several:
                for r, c in zip(*np.nonzero(hit & has_id[others] & (event_many[others] | site_many[rows, None]))):
                    ids[rows[r]].append(others[c])
        rows = np.flatnonzero(within > 0)
        if len(rows):
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(ids[r]) for r in rows)]), pa.int32()), b["event_id"].take(pa.array([x for r in rows for x in ids[r]], pa.int64())))
            yield batch_of(usgs_site=a["usgs_site"].take(pa.array(rows)), n=once[rows], ids=lists, acres=pa.array(acres[rows], mask=known[rows] == 0), within=within[rows])

    upright = tiled(boxed(one, "geometry")[0], boxed(two, "event_geometry")[0], ["usgs_site", "site_many"], ["event_id", "acres", "event_many"], cell, sums, f"usgs_site {kind['usgs_site']}, n long, ids array<{kind['event_id']}>, acres double, within double")
    others, many = other_overlay(one, two, "geometry", "event_geometry", cell), F.col("site_many") | F.col("event_many")
    id_known = F.col("event_id").isNotNull()
    others = others.select("usgs_site", F.when(id_known & ~many, 1).otherwise(0).cast("long").alias("n"), F.when(id_known & many, F.array("event_id")).otherwise(F.array().cast(f"array<{kind['event_id']}>")).alias("ids"), "acres", F.col("overlap_area").alias("within"))
    found = upright.unionByName(others).groupBy("usgs_site").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"), F.sum("acres").alias("acres"), F.sum("within").alias("within"))
    return found.select("usgs_site", (F.col("n") + F.size(F.array_distinct("ids"))).alias("n_events"), (F.col("acres") * ACRES_TO_KM2).alias("total_km2"), (F.col("within") / 1e6).alias("within_km2"))


def clip_lines(lines: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(usgs_site, line_id, start_fraction, end_fraction): the stretches of lines inside the polygons.

    Straight lines that are neither level nor upright are clipped to upright rectangles in tiles; the others one by one.
    """
    from ..functions.geometry import interpolate, line_boundary_fractions, point_in_polygon

    ids = lines.withColumn("__box", bounding_box(F.col("line")))
    end = lambda k, c: F.get("line", F.lit(k))[c]
    slanting = F.coalesce((F.size("line") == 2) & (end(0, "x") != end(1, "x")) & (end(0, "y") != end(1, "y")), F.lit(False))
    plain, other = boxed(polygons.select("usgs_site", "geometry"), "geometry")

    def met_by(one: DataFrame, two: DataFrame) -> DataFrame:
        one = one.withColumnRenamed("__box", "__a").withColumn("__cell", F.explode(grid_cells(F.col("__a"), cell)))
        two = two.withColumnRenamed("__box", "__b").withColumn("__cell", F.explode(grid_cells(F.col("__b"), cell)))
        joined = one.join(two, "__cell").where(boxes_meet(F.col("__a"), F.col("__b")) & (F.col("__cell") == first_shared_cell(F.col("__a"), F.col("__b"), cell)))
        return joined.select("usgs_site", "line_id", "line", "geometry")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                points, rings = np.array([(p["x"], p["y"]) for p in row["line"]]), as_rings(row["geometry"])
                cuts = sorted({0.0, 1.0, *(f for ring in rings for f in line_boundary_fractions(points, ring))})
                out += [(row["usgs_site"], row["line_id"], a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1e-12 and point_in_polygon(tuple(interpolate(points, (a + b) / 2)), rings)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["usgs_site", "line_id", "start_fraction", "end_fraction"])

    def clipped(a, b, i, j):
        px, py, qx, qy = numbers(a, "px", "py", "qx", "qy")
        x1, y1, x2, y2 = numbers(b, *SIDES)
        dx, dy = qx - px, qy - py
        for rows, others, w, h in met(a, b, i, j, cell):
            r, c = np.nonzero((w > 0) & (h > 0))
            r, c = rows[r], others[c]
            left, right, low, high = (x1[c] - px[r]) / dx[r], (x2[c] - px[r]) / dx[r], (y1[c] - py[r]) / dy[r], (y2[c] - py[r]) / dy[r]
            start = np.maximum(np.maximum(np.minimum(left, right), np.minimum(low, high)), 0.0)
            stop = np.minimum(np.minimum(np.maximum(left, right), np.maximum(low, high)), 1.0)
            inside = stop - start > 1e-12
            if inside.any():
                yield batch_of(usgs_site=b["usgs_site"].take(pa.array(c[inside])), line_id=a["line_id"].take(pa.array(r[inside])), start_fraction=start[inside], end_fraction=stop[inside])

    schema = "usgs_site string, line_id long, start_fraction double, end_fraction double"
    straight = ids.where(slanting).select("line_id", "__box", end(0, "x").alias("px"), end(0, "y").alias("py"), end(1, "x").alias("qx"), end(1, "y").alias("qy"))
    upright = tiled(straight, plain, ["line_id", "px", "py", "qx", "qy"], ["usgs_site"], cell, clipped, schema)
    pairs = met_by(ids.where(~slanting), plain.unionByName(other)).unionByName(met_by(ids.where(slanting), other))
    return upright.unionByName(pairs.mapInArrow(stretches, schema))
