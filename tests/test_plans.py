"""Domain operators on hand-made rows: boundaries, nulls, ties, gates, geometry, networks, files and streams."""

from __future__ import annotations

import datetime as dt
import math
import random
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderbrook.functions import distributions as P
from cinderbrook.functions import geometry as G
from cinderbrook.functions import scalars as S
from cinderbrook.operators import joins as J
from cinderbrook.operators import quality as Q
from cinderbrook.operators import windows as W
from cinderbrook.plans import chemistry, covariates, discharge, events, network, prepost, seasonal, spatial, statistics
from cinderbrook.plans.rebuild import rebuild
from cinderbrook.sources import readers, writers
from cinderbrook.streaming import ingest

D = dt.date


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_library_stands_without_the_corpus_subpackage():
    code = "import sys; sys.modules['cinderbrook.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op1_') for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


@pytest.mark.parametrize("text, number", [("0.31", 0.31), (" 0.31 ", 0.31), ("5.", None), ("1e-1", 0.1), ("", None), (None, None), ("NA", None), ("+.5", 0.5)])
def test_numeric_text(spark, text, number):
    assert spark.createDataFrame([(text,)], "x string").select(S.numeric_text(F.col("x"))).first()[0] == number


def test_null_rejecting_negation_units_and_identifiers(spark):
    df = spark.createDataFrame([("Quality", "uM"), (None, "vacuum"), ("plain", None)], "x string, u string")
    assert values(df.where(~S.matches(F.col("x"), "quality")), "x") == [("plain",)]
    assert values(df.select("u", S.convert_by_pattern(F.lit(2.0), F.col("u"), (("%um%", 0.5),)).alias("v")), "u", "v") == [("uM", 1.0), ("vacuum", 1.0), (None, 2.0)]
    assert S.checked_identifier("a_1") == "a_1"
    with pytest.raises(ValueError):
        S.checked_identifier("a; drop table")


def test_window_segments_at_their_edges(spark):
    days = [D(2001, 2, 28), D(2001, 3, 1), D(2004, 2, 28), D(2004, 2, 29), D(2004, 3, 5), D(2004, 3, 6), D(2007, 3, 5), D(2007, 3, 6), None]
    df = spark.createDataFrame([(d,) for d in days], "d date").withColumn("s", J.segment(F.col("d"), F.lit(D(2004, 2, 29)), F.lit(D(2004, 3, 5)), 3))
    assert {r.d: r.s for r in df.collect()} == dict(zip(days, ["before", "before", "before", None, None, "after", "after", None, None]))


def test_season_groups_and_intervals(spark):
    fires = [("a", "1", D(2001, 4, 19)), ("a", "2", D(2001, 4, 20)), ("a", "3", D(2001, 9, 7)), ("a", "4", D(2001, 9, 8)), ("a", "5", D(2001, 9, 8)), ("a", "5", D(2001, 9, 8)), ("b", "6", D(2004, 4, 19)), ("b", "7", None)]
    df = spark.createDataFrame([(*f, 1.0) for f in fires], "usgs_site string, event_id string, ig_date date, area double")
    got = values(events.season_groups(df).withColumn("events", S.set_text(F.col("events"))), "usgs_site", "start_date", "end_date", "events", "fire_area")
    assert got == [("a", D(2001, 4, 19), D(2001, 4, 19), "{1}", 1.0), ("a", D(2001, 4, 20), D(2001, 9, 7), "{2,3}", 2.0), ("a", D(2001, 9, 8), D(2001, 9, 8), "{4,5}", 3.0), ("b", D(2004, 4, 19), D(2004, 4, 19), "{6}", 1.0)]
    spans = {r.event_id: (r.pre_lo, r.post_hi) for r in events.event_intervals(df.where("usgs_site = 'a'")).collect()}
    assert spans["1"] == (None, D(2001, 4, 20)) and spans["5"] == spans["4"] == (D(2001, 9, 7), None)


def test_largest_group_by_brute_force(spark):
    rng = random.Random(7)
    start = D(2000, 1, 1)
    obs = [(f"s{rng.randrange(4)}", start + dt.timedelta(rng.randrange(3_000)), rng.choice([1.0, None, 2.0]), rng.choice([1.0, None, 3.0, 4.0]), rng.randint(1, 4)) for _ in range(400)]
    groups = [(f"s{k % 4}", 2000 + k, s, s + dt.timedelta(rng.randrange(60)), rng.choice([1.0, 2.0, 2.0, None]), ["e"]) for k in range(24) for s in [start + dt.timedelta(rng.randrange(3_000))]]
    o = spark.createDataFrame(obs, "usgs_site string, date date, value_std double, flow double, quartile int")
    g = spark.createDataFrame(groups, "usgs_site string, year int, start_date date, end_date date, cum_fire_area double, events array<string>")

    def shifted(day, years):
        try:
            return day.replace(year=day.year + years)
        except ValueError:
            return day.replace(year=day.year + years, day=28)

    best = {}
    for site, year, a, b, area, _ in groups:
        sides = {"before": set(), "after": set()}
        for s, d, v, f, q in obs:
            if s == site and v is not None and f is not None:
                if shifted(a, -3) <= d < a:
                    sides["before"].add(q)
                elif b < d <= shifted(b, 3):
                    sides["after"].add(q)
        if all({2, 3, 4} <= x for x in sides.values()):
            key = (area is not None, -(area or 0), a, b)
            best[site] = min(best.get(site, (key, year)), (key, year))
    got = {r.usgs_site: r.year for r in prepost.largest_group(prepost.gated_groups(o, g)).collect()}
    assert got == {s: y for s, (_, y) in best.items()} and got


def test_calendar_merge_and_screens(spark):
    flow = spark.createDataFrame([("a", D(2000, 2, 27), 1.0), ("a", D(2000, 3, 1), None), ("b", D(2001, 1, 1), 2.0)], "site string, day date, v double")
    assert values(discharge.complete_calendar(flow, "site", "day", "v"), "site", "day", "v") == [("a", D(2000, 2, 27), 1.0), ("a", D(2000, 2, 28), None), ("a", D(2000, 2, 29), None), ("a", D(2000, 3, 1), None), ("b", D(2001, 1, 1), 2.0)]
    assert {r.site for r in discharge.gap_screen(flow, "site", "day", "v", most_missing=2).collect()} == {"b"}
    base = spark.createDataFrame([(1, "base")], "k int, v string")
    more = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a")], "k int, v string")
    assert values(discharge.merge_supplements(base, [more, spark.createDataFrame([(2, "late"), (3, "c")], "k int, v string")], ["k"], ["v"]), "k", "v") == [(1, "base"), (2, "a"), (3, "c")]
    one = spark.createDataFrame([("x", 5.0)] * 3 + [("x", 7.0)], "usgs_site string, Flow double")
    assert values(discharge.with_quartiles(one), "Flow", "quartile") == [(5.0, 1)] * 3 + [(7.0, 4)]


def test_quality_gates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    for check in (lambda: Q.require_unique(df, ["k"]), lambda: Q.require_columns(df, ["w"]), lambda: Q.require_labels(df, "v", ["a"]), lambda: Q.require_none(df, F.col("v") == "b", "odd"), lambda: Q.require_tables(df.sparkSession, ["nowhere"])):
        with pytest.raises(Q.QualityError):
            check()
    sets = spark.createDataFrame([("s", ["1", "2"]), ("t", ["3"])], "usgs_site string, events array<string>")
    weights = spark.createDataFrame([("s", "1", 1.0), ("s", "2", 3.0), ("t", "3", 0.0)], "usgs_site string, event_id string, weight double")
    evi = lambda rows: covariates.index_roll_up(sets, spark.createDataFrame(rows, "usgs_site string, event_id string, median_post_evi string"), weights)
    good = covariates.strict_gate(evi([("s", "1", "1"), ("s", "2", " 2 "), ("t", "3", "NA")]), reject_missing=True)
    assert {r.usgs_site: (r.weighted_evi, r.has_missing_evi, r.has_bad_data) for r in good.collect()} == {"s": (1.75, False, False), "t": (None, True, False)}
    with pytest.raises(Q.QualityError):
        covariates.strict_gate(evi([("s", "1", "1"), ("s", "2", "5.")]), reject_missing=True)
    with pytest.raises(Q.QualityError):
        covariates.strict_gate(evi([("s", "1", "1")]), reject_missing=True)
    covariates.strict_gate(evi([("s", "1", "1")]).withColumn("n_bad", F.lit(0)), reject_missing=False)


def test_severity_index_cases(spark):
    rows = [("1", "low", 2.0), ("2", "low", 1.0), ("2", " High ", 2.0), ("3", "odd", 1.0), ("4", "low", None), ("5", "moderate", 4.0), ("5", "moderate", 1.0)]
    df = spark.createDataFrame([("s", *r) for r in rows], "usgs_site string, event_id string, fire_severity string, severity_value double")
    assert {r.event_id: r.severity_index for r in covariates.severity_index(df).collect()} == {"1": 2.0, "2": 7.0, "3": None, "4": None, "5": 5.0}


def test_covariate_export_guards_and_keeps_rows(spark):
    base = spark.createDataFrame([("s", D(2000, 1, 1), D(2000, 1, 2), ["b", "a"], 1.0)] * 2, "usgs_site string, start_date date, end_date date, events array<string>, v double")
    site = lambda name: spark.createDataFrame([("s", 1.0)], f"usgs_site string, {name} double")
    by_set = lambda name: spark.createDataFrame([("s", ["a", "b"], 2.0)], f"usgs_site string, events array<string>, {name} double")
    ranges = spark.createDataFrame([("s", D(2000, 1, 1), D(2000, 1, 2), 9)], "usgs_site string, start_date date, end_date date, days_since int")
    classes = spark.createDataFrame([("s", "low", 3.0)], "usgs_site string, fire_classification string, classification_value double")
    tables = covariates.CovariateTables(site("eco"), ranges, site("elev"), site("nlcd"), classes, by_set("evi"), by_set("sev"))
    got = covariates.covariate_export(base, tables, ["low", "high"]).collect()
    assert len(got) == 2 and {(r.eco, r.days_since, r.low, r.high, r.evi, r.sev) for r in got} == {(1.0, 9, 3.0, None, 2.0, 2.0)}
    tables.classifications = classes.unionByName(classes)
    with pytest.raises(Q.QualityError):
        covariates.covariate_export(base, tables, ["low", "high"])
    tables.classifications = classes
    with pytest.raises(Q.QualityError):
        covariates.covariate_export(base, tables, ["high"])


def test_chemistry_drops_null_types_and_doubles(spark):
    columns = "usgs_site string, ActivityStartDate date, USGSPCode string, ResultMeasureValue double, `ResultMeasure.MeasureUnitCode` string, ActivityMediaName string, ActivityMediaSubdivisionName string, ActivityTypeCode string, ResultSampleFractionText string"
    row = ("a", D(2000, 1, 1), "71851", 62.0, "mg/l", "WATER", "Surface Water", "Sample", "Dissolved")
    results = spark.createDataFrame([row, (*row[:7], None, "Dissolved"), (*row[:7], "Quality", "x"), (*row[:8], None), ("z", *row[1:]), (*row[:2], "00618", 2.0, *row[4:])], columns)
    standard = chemistry.standardise_chemistry(results, spark.createDataFrame([("a",)], "usgs_site string"))
    others = spark.createDataFrame([("b", D(2000, 1, 1), "NO3", 1_000.0, "uM"), ("b", D(2000, 1, 1), "NO3", 1_000.0, "uM"), ("Bell 3", D(2000, 1, 1), "NO3", 1.0, "mg"), ("b", D(2000, 1, 2), "PO4", 1.0, "mg")], "usgs_site string, date date, analyte string, mean double, unit string")
    assert values(chemistry.analyte_series(standard, others, "nitrate"), "usgs_site", "value_std", "analyte") == [("a", pytest.approx(8.0), "nitrate"), ("b", pytest.approx(14.0), "NO3")]


def test_quantiles_tests_and_power():
    assert P.t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-4) and P.t_quantile(0.975, 30) == pytest.approx(2.042272, abs=1e-6)
    assert P.noncentral_t_cdf(1.5, 12, 0.0) == pytest.approx(P.t_cdf(1.5, 12), abs=1e-8)
    assert P.paired_power(0.5, 34) == pytest.approx(0.8078, abs=1e-4) and P.pairs_for_power(0.5, 0.8) == 34
    assert P.wilcoxon_p([1.0, 2.0, 3.0, 4.0, 5.0, -0.5]) == pytest.approx(0.05906, abs=2e-4)
    assert P.paired_t([1.0, 2.0, 3.0, 4.0])["t"] == pytest.approx(3.8730, abs=1e-4)


def test_prediction_interval_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(1, 50, 30)
    y = np.exp(0.4 + 0.7 * np.log(x) + rng.normal(0, 0.3, 30))
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)] + [("s", 0.0, 1.0), ("t", 1.0, 1.0)], "site string, x double, y double")
    got = {r.x: r for r in statistics.with_intervals(df, statistics.site_fits(df, "site", "y", "x"), "site", "y", "x").where("site = 's'").collect()}
    lx, ly = np.log(x), np.log(y)
    slope, intercept = np.polyfit(lx, ly, 1)
    s = math.sqrt(((ly - intercept - slope * lx) ** 2).sum() / 28)
    half = P.t_quantile(0.975, 28) * s * np.sqrt(1 + 1 / 30 + (lx - lx.mean()) ** 2 / ((lx - lx.mean()) ** 2).sum())
    for a, b, h in zip(x.tolist(), ly.tolist(), half.tolist()):
        middle = intercept + slope * math.log(a)
        assert (got[a].lwr, got[a].upr) == pytest.approx((math.exp(middle - h), math.exp(middle + h)))
        assert got[a].status == ("Inside PI" if abs(b - middle) <= h else "Outside PI")
    assert len(got) == 30


coordinates = st.tuples(st.integers(-6, 6), st.integers(-6, 6))


@settings(deadline=None, max_examples=40)
@given(st.lists(coordinates, min_size=3, max_size=7, unique=True), st.lists(coordinates, min_size=3, max_size=7, unique=True))
def test_overlap_of_star_shaped_polygons(a, b):
    """Against a count of fine grid cells' middles."""

    def star(points):
        center = np.mean(points, axis=0) + [0.013, 0.017]
        return np.array(sorted(points, key=lambda p: math.atan2(p[1] - center[1], p[0] - center[0])), float)

    one, two = star(a), star(b)
    grid = np.arange(-6, 6, 0.25) + 0.125 + 1e-5
    inside = sum(G.point_in_polygon((x, y), [one]) and G.point_in_polygon((x, y), [two]) for x in grid for y in grid) / 16
    assert G.overlap_area([one], [two]) == pytest.approx(inside, abs=6)
    assert G.overlap_area([one], [one]) == pytest.approx(abs(G.shoelace(one)), abs=1e-6)


def test_areas_with_holes_and_on_the_spheroid():
    square, hole = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(1, 1), (2, 1), (2, 2), (1, 2)], float)
    bent = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    assert G.overlap_area([square, hole], [square]) == pytest.approx(15) and G.overlap_area([bent], [square]) == pytest.approx(10)
    assert G.spheroidal_area([np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)]) == pytest.approx(12_308_463_894, rel=1e-7)
    x, y = G.albers(np.array([-96.0, -110.0]), np.array([23.0, 35.0]))
    assert (x[0], y[0]) == pytest.approx((0, 0), abs=1e-6) and x[1] < -1_200_000 and 1_300_000 < y[1] < 1_500_000


def test_linear_referencing():
    line = np.array([(0, 0), (3, 0), (3, 4)], float)
    assert G.locate(line, np.array([2.0, 1.0])) == pytest.approx((2 / 7, 1.0)) and G.interpolate(line, 5 / 7).tolist() == pytest.approx([3, 2])
    assert np.allclose(G.substring(line, 1 / 7, 4 / 7), [[1, 0], [3, 0], [3, 1]])
    assert G.line_boundary_fractions(line, np.array([(1, -1), (2, -1), (2, 1), (1, 1)], float)) == pytest.approx([1 / 7, 2 / 7])


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 9)), max_size=16))
def test_shortest_paths_by_brute_force(raw):
    edges = [(k, a, b, float(c)) for k, (a, b, c) in enumerate(raw)]
    best = {0: 0.0}
    for _ in range(9):
        for _, a, b, c in edges:
            for p, q in ((a, b), (b, a)):
                if p in best and best[p] + c < best.get(q, math.inf):
                    best[q] = best[p] + c
    costs, steps = network.shortest_paths(edges, 0)
    assert costs == best and set(steps) == set(best)
    for vertex, cost in costs.items():
        path, at = network.path_to(vertex, steps), 0
        assert sum(edges[e][3] for e in path) == cost
        for e in path:
            at = edges[e][2] if edges[e][1] == at else edges[e][1]
        assert at == vertex


def test_steps_of_a_long_chain_stay_small():
    edges = [(k, k, k + 1, 1.0) for k in range(6_000)]
    costs, steps = network.shortest_paths(edges, 0)
    assert costs[6_000] == 6_000 and len(steps) == 6_001 and network.path_to(6_000, steps) == list(range(6_000))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.floats(-3, 3), st.floats(-3, 3)), min_size=1, max_size=25), st.sampled_from([0.1, 0.5, 1.0]))
def test_close_points_are_one_vertex(points, tolerance):
    got = network.close_points(np.array(points), tolerance).tolist()
    group = list(range(len(points)))
    for _ in points:
        for a, (x, y) in enumerate(points):
            for b, (v, w) in enumerate(points):
                if math.hypot(x - v, y - w) <= tolerance:
                    group[a] = group[b] = min(group[a], group[b])
    assert [got.index(g) for g in got] == [group.index(g) for g in group]


def test_line_ends_two_millimetres_apart_are_one_vertex_across_cells(spark):
    """The ends lie on either side of a cell's edge; a third line is a metre off."""
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = [("s", 1, line((0, 0), (10.249, 0.749))), ("s", 2, line((10.251, 0.751), (20, 0))), ("s", 3, line((21, 0), (30, 0)))]
    edges = {r.edge_id: (r.source, r.target) for r in network.build_topology(spark.createDataFrame(lines, "usgs_site string, edge_id long, line array<struct<x:double,y:double>>")).collect()}
    assert edges[1][1] == edges[2][0] and edges[2][1] != edges[3][0] and len({v for e in edges.values() for v in e}) == 5


def test_distance_status_and_touch(spark):
    edges = spark.createDataFrame([("s", 1, 1, 2, 5.0), ("s", 2, 2, 3, 1.0), ("s", 3, 8, 9, 1.0), ("u", 4, 1, 2, 1.0)], "usgs_site string, edge_id long, source long, target long, cost double")
    starts = spark.createDataFrame([("s", 1)], "usgs_site string, vertex_id long")
    vertices = spark.createDataFrame([("s", "near", 3), ("s", "near", 2), ("s", "far", 9), ("s", "touch", 9)], "usgs_site string, event_id string, vertex_id long")
    fires = spark.createDataFrame([("s", "near"), ("s", "far"), ("s", "none"), ("s", "touch"), ("u", "x")], "usgs_site string, event_id string")
    touches = spark.createDataFrame([("s", "touch", 5.0), ("s", "far", 5.1)], "usgs_site string, event_id string, distance_m double")
    got = {r.event_id: (r.distance_m, r.path_edge_ids, r.status, r.is_pour_point_touch) for r in network.site_distances(edges, starts, vertices, fires, touches).collect()}
    assert got["near"] == (5.0, [1], "ok", False) and got["touch"] == (0.0, [], "ok", True)
    assert (got["far"][2], got["none"][2], got["x"][2]) == ("unreachable", "no_intersection", "error")


def test_topology_snaps_crossings_and_splits(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    points = "array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([("s", 1, line((0, 0), (10, 0))), ("s", 2, line((10.1, 0), (20, 0))), ("s", 3, line((0, 0)))], f"usgs_site string, edge_id long, line {points}")
    edges = network.build_topology(lines)
    assert values(edges, "edge_id", "source", "target") == [(1, 1, 2), (2, 2, 3)]
    snaps = network.snap_points(spark.createDataFrame([("s", 7, 4.0, 3.0), ("s", 8, 20.0, 0.1)], "usgs_site string, point_id long, x double, y double"), edges)
    assert values(snaps, "point_id", "edge_id", "fraction", "is_exact_vertex") == [(7, 1, pytest.approx(0.4), False), (8, 2, pytest.approx(1.0), True)]
    box = [line((2, -1), (6, -1), (6, 1), (2, 1))]
    fires = spark.createDataFrame([("s", "e", box), ("s", "around", [line((9, -5), (30, -5), (30, 5), (9, 5))])], f"usgs_site string, event_id string, geometry array<{points}>")
    crossings = network.event_crossings(edges, fires)
    assert values(crossings.where("event_id = 'e'"), "edge_id", "fraction", "on_boundary") == [(1, pytest.approx(0.2), True), (1, pytest.approx(0.6), True)]
    parts = network.split_fractions(crossings.where("event_id = 'e'"), snaps, edges)
    assert [r[1:] for r in values(parts.where("edge_id = 1"), "edge_id", "from_value", "to_value")] == [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 1.0)]
    assert network.split_edges(edges, parts).where("original_edge_id = 1").select(F.sum(G.line_length(F.col("line")))).first()[0] == pytest.approx(10.0)


def test_overlaps_count_at_their_middle_and_events_get_vertices(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    points = "array<struct<x:double,y:double>>"
    assert G.shared_stretches(np.array([(0.0, 0.0), (4.0, 0.0), (10.0, 0.0)]), np.array([(2.0, 0.0), (6.0, 0.0), (6.0, 3.0), (2.0, 3.0)])) == [pytest.approx((0.2, 0.6))]
    lines = spark.createDataFrame([("s", 1, line((0, 0), (10, 0))), ("s", 2, line((10, 0), (20, 0)))], f"usgs_site string, edge_id long, line {points}")
    fires = spark.createDataFrame([("s", "along", [line((2, 0), (6, 0), (6, 3), (2, 3))]), ("s", "across", [line((12, -1), (14, -1), (14, 1), (12, 1))]), ("s", "around", [line((-9, -9), (40, -9), (40, 9), (-9, 9))]), ("s", "off", [line((0, 5), (1, 5), (1, 6), (0, 6))])], f"usgs_site string, event_id string, geometry array<{points}>")
    edges = network.build_topology(lines)
    crossings = network.event_crossings(edges, fires)
    assert values(crossings, "event_id", "edge_id", "fraction", "on_boundary") == sorted([("across", 2, pytest.approx(0.2), True), ("across", 2, pytest.approx(0.4), True), ("along", 1, pytest.approx(0.4), True), ("around", 1, 0.5, False), ("around", 2, 0.5, False)], key=str)
    snaps = crossings.select("usgs_site", "edge_id", "fraction", F.lit(True).alias("is_exact_vertex"))
    parts = network.split_edges(edges, network.split_fractions(crossings, snaps, edges)).withColumn("edge_id", F.col("original_edge_id") * 100 + F.col("segment_index"))
    split = network.build_topology(parts).withColumn("cost", F.col("length_m"))
    vertices = network.event_vertices(split, crossings)
    assert {r.event_id: r.n for r in vertices.groupBy("event_id").agg(F.count("vertex_id").alias("n")).collect()} == {"across": 2, "along": 1, "around": 2}
    start = split.where("start_fraction = 0 and original_edge_id = 1").select("usgs_site", F.col("source").alias("vertex_id"))
    got = {r.event_id: (r.distance_m, r.status) for r in network.site_distances(split, start, vertices, fires).collect()}
    assert got == {"along": (pytest.approx(4.0), "ok"), "across": (pytest.approx(12.0), "ok"), "around": (pytest.approx(5.0), "ok"), "off": (None, "no_intersection")}


def test_binary_polygons_and_workbooks(spark, tmp_path):
    import struct
    import zipfile

    from cinderbrook.sources import readers

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 0.0)]
    hole = [(0.2, 0.1), (0.3, 0.1), (0.3, 0.2), (0.2, 0.1)]
    polygon = lambda o, rings: struct.pack(o + "BII", o == "<", 3, len(rings)) + b"".join(struct.pack(f"{o}I{2 * len(r)}d", len(r), *(c for p in r for c in p)) for r in rings)
    several = struct.pack(">BII", 0, 6, 2) + polygon("<", [ring, hole]) + polygon(">", [ring])
    high = struct.pack("<BIII", 1, 0xA0000003, 4326, 1) + struct.pack("<I12d", 4, *(c for x, y in ring for c in (x, y, 9.0)))
    df = spark.createDataFrame([(1, polygon("<", [ring])), (2, several), (3, None), (4, high)], "k int, geom binary")
    got = sorted((r.k, [[(p.x, p.y) for p in one] for one in r.rings]) for r in readers.wkb_polygons(df, "geom").collect())
    assert got == [(1, [ring]), (2, [ring]), (2, [ring, hole]), (4, [ring])]
    with pytest.raises(ValueError):
        readers.parse_wkb(struct.pack("<BIdd", 1, 1, 0.0, 0.0))

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    texts = "".join(f"<si><t>{x}</t></si>" for x in ("site", "day", "value", "a"))
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row><row r="3"><c r="A3" t="s"><v>3</v></c><c r="B3"><v>36526</v></c><c r="D3"><v>1.5</v></c></row><row r="4"><c r="A4" t="inlineStr"><is><t>b</t></is></c><c r="D4" t="str"><v>n/a</v></c></row>'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as out:
        out.writestr("xl/sharedStrings.xml", f"<sst {space}>{texts}</sst>")
        out.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>")
    book = readers.read_workbook(spark, str(tmp_path / "book.xlsx"), "site string, day date, value double, other int").where("site is not null").collect()
    assert sorted((r.site, str(r.day), r.value, r.other) for r in book) == [("a", "2000-01-01", 1.5, None), ("b", "None", None, None)]


def test_paths_clipping_and_sampling(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = spark.createDataFrame([("s", 1, line((0, 0), (5, 0))), ("s", 2, line((9, 0), (5, 0))), ("s", 3, line((9, 0), (9, 3)))], "usgs_site string, edge_id long, line array<struct<x:double,y:double>>")
    edges = network.build_topology(lines).withColumn("cost", F.col("length_m"))
    vertex = {(r.edge_id, k): r[k] for r in edges.collect() for k in ("source", "target")}
    starts = spark.createDataFrame([("s", vertex[1, "source"])], "usgs_site string, vertex_id long")
    goal = spark.createDataFrame([("s", "e", vertex[3, "target"])], "usgs_site string, event_id string, vertex_id long")
    fires = spark.createDataFrame([("s", "e"), ("s", "none")], "usgs_site string, event_id string")
    paths = network.event_paths(network.site_distances(edges, starts, goal, fires), edges).collect()
    assert [(r.event_id, r.distance_m, r.path_edge_ids, r.n_edges, len(r.lines)) for r in paths] == [("e", 12.0, [1, 2, 3], 3, 1), ("none", None, [], 0, 0)]
    assert [(p.x, p.y) for p in paths[0].lines[0]] in ([(0, 0), (5, 0), (9, 0), (9, 3)], [(9, 3), (9, 0), (5, 0), (0, 0)])
    box = spark.createDataFrame([("s", [line((1, -1), (3, -1), (3, 1), (1, 1))])], f"usgs_site string, geometry {spatial.RINGS}")
    clipped = spatial.clip_lines(lines.withColumnRenamed("edge_id", "line_id").drop("usgs_site"), box, 2.0)
    assert values(clipped, "line_id", "start_fraction", "end_fraction") == [(1, pytest.approx(0.2), pytest.approx(0.6))]
    keys = spark.range(100).withColumnRenamed("id", "k")
    assert values(W.sampled_keys(keys, "k", 5), "k") == values(W.sampled_keys(keys.repartition(7), "k", 5), "k")


def test_rebuild_warns_per_analyte(spark, tmp_path):
    columns = "usgs_site string, ActivityStartDate date, USGSPCode string, ResultMeasureValue double, `ResultMeasure.MeasureUnitCode` string, ActivityMediaName string, ActivityMediaSubdivisionName string, ActivityTypeCode string, ResultSampleFractionText string"
    results = spark.createDataFrame([("a", D(2000, 1, 1), "00618", 1.0, "mg/l", "Water", "Surface Water", "Sample", "Dissolved")], columns)
    others = spark.createDataFrame([], "usgs_site string, date date, analyte string, mean double, unit string")
    flow = spark.createDataFrame([("a", D(2000, 1, 1), 1.0, 2)], "usgs_site string, date date, flow double, quartile int")
    groups = spark.createDataFrame([("a", 2000, D(2000, 2, 1), D(2000, 2, 1), 1.0, ["e"])], "usgs_site string, year int, start_date date, end_date date, cum_fire_area double, events array<string>")
    got = rebuild(results, others, results.select("usgs_site"), flow, groups, str(tmp_path), ["nitrate", "gold"])
    assert [(o.step, o.status) for o in got] == [("water_chem_std", "success"), ("nitrate", "success"), ("gold", "warning"), ("check", "error")]
    assert values(spark.read.parquet(f"{tmp_path}/nitrate_counts"), "before_count", "after_count") == [(1, 0)]


def test_overlay_finds_each_pair_once(spark):
    ring = lambda x, y, w: [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]]
    schema = f"usgs_site string, geometry {spatial.RINGS}"
    sites = spark.createDataFrame([("a", ring(0, 0, 10)), ("b", ring(5, 5, 10)), ("c", ring(100, 0, 1)), ("d", [])], schema)
    assert values(spatial.pairwise_overlap(sites, 2.0), "site_1", "site_2", "overlap_area", "percent_of_2") == [("a", "b", 25.0, 25.0)]
    area = spark.createDataFrame([(ring(0, 0, 8),), (ring(100, 0, 5),)], f"geometry {spatial.RINGS}")
    assert values(spatial.share_inside(sites, area, 3.0, 60.0), "usgs_site", "ecoregion_pct") == [("a", 64.0), ("c", 100.0)]


def test_t_quantiles_beyond_the_table(spark):
    from cinderbrook.functions.distributions import t_quantile
    from cinderbrook.plans.statistics import t_beyond

    got = spark.createDataFrame([(1_001,), (2_001,), (50_000,), (10_000_000,)], "df long").select("df", t_beyond(F.col("df")).alias("t")).collect()
    assert all(r.t == pytest.approx(t_quantile(0.975, r.df), abs=1e-9) for r in got)
    points = spark.createDataFrame([("s", math.exp(k % 7 / 3 + (k % 5) / 50), math.exp(k % 7)) for k in range(300)], "site string, y double, x double")
    fits = statistics.site_fits(points, "site", "y", "x")
    table, beyond = (sorted(statistics.with_intervals(points, fits, "site", "y", "x", largest_df=n).select("y", "lwr", "upr").collect()) for n in (2_000, 100))
    assert all(a == pytest.approx(b, rel=1e-6) for a, b in zip(table, beyond))


def test_seasonal_signal_recovers_a_sine():
    import pandas as pd

    days = pd.Series(pd.date_range("2000-01-01", "2009-12-31"))
    wave = 1 + 0.5 * np.sin(2 * np.pi * days.dt.dayofyear.to_numpy() / 365)
    found = seasonal.signal_metrics(days, 10**wave - 1)
    assert found["rms_signal"] == pytest.approx(0.5 / math.sqrt(2), rel=0.01) and found["snr"] > 30 and found["zero_days"] == 0
    assert math.isnan(seasonal.signal_metrics(days[:3], np.array([np.nan] * 3))["snr"])


def test_series_of_many_sites_at_once_are_those_of_each(spark):
    """In batches that cut through sites; with gaps, leap days, missing and dry days, one-day sites and a null site."""
    import pandas as pd

    rng = np.random.default_rng(2)
    frames = []
    for k, n in enumerate((1, 900, 40, 7, 400, 2)):
        days = pd.Series(pd.to_datetime("2003-11-20") + pd.to_timedelta(np.sort(rng.choice(1_500, n, replace=False)), "D"))
        flow = np.where(rng.random(n) < 0.2, np.nan, rng.choice([0.0, 0.05, 1.0, 30.0], n) * rng.random(n))
        frames.append((f"s{k}" if k != 3 else None, days, flow))
    rows = [(s, d.date(), None if math.isnan(f) else float(f)) for s, days, flow in frames for d, f in zip(days, flow)]
    df = spark.createDataFrame([*rows, ("s1", None, 1.0)], "site string, day date, flow double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.site: r.asDict() for r in seasonal.flow_metrics(df, "site", "day", "flow").collect()}
        signal = {(r.site, r.day): r.residual for r in seasonal.daily_anomalies(df, "site", "day", "flow").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {s for s, *_ in frames} and len(signal) == len(rows)
    for s, days, flow in frames:
        alone = seasonal.signal_metrics(days, flow)
        assert all(got[s][name] == pytest.approx(value, nan_ok=True) for name, value in alone.items())


square = st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4), st.integers(1, 4), st.booleans())


@settings(deadline=None, max_examples=60)
@given(square, st.lists(square, max_size=6))
def test_covered_area_counts_overlaps_once(site, others):
    """Boxes and diamonds on a grid, against small squares; a diamond's edges cross the boxes'."""

    def corners(x, y, w, h, tilted):
        return np.array([(x, y + h / 2), (x + w / 2, y), (x + w, y + h / 2), (x + w / 2, y + h)] if tilted else [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)

    steps = (np.arange(0, 11, 0.05) + 0.025)
    gx, gy = np.meshgrid(steps, steps)

    def inside(x, y, w, h, tilted):
        return np.abs(gx - x - w / 2) / (w / 2) + np.abs(gy - y - h / 2) / (h / 2) < 1 if tilted else (gx > x) & (gx < x + w) & (gy > y) & (gy < y + h)

    union = np.zeros(gx.shape, bool)
    for other in others:
        union |= inside(*other)
    got = G.covered_area([corners(*site)], [[corners(*other)] for other in others])
    assert got == pytest.approx((union & inside(*site)).sum() * 0.0025, abs=0.25)
    if not site[4] and not any(o[4] for o in others):
        assert got == pytest.approx((union & inside(*site)).sum() * 0.0025, abs=1e-9)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("site,v,d\n01,-999,2000-01-01\n02,1.5,.\n03,x,2000-02-30\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "site string, v double, d date", na=(".", "-999", "NA"))
    assert values(got, "site", "v", "d") == [("01", None, D(2000, 1, 1)), ("02", 1.5, None), ("03", None, None)]
    (tmp_path / "b.tsv").write_text("# note\nsite\tdatetime\t1_00060_00003\t2_00010_00001\n5s\t20d\t14n\t14n\nx\t2000-01-01\t3\t4\n")
    table = readers.read_commented_tsv(spark, str(tmp_path / "b.tsv"), "datetime")
    assert table.count() == 1 and readers.first_column(table, "00060_00003$") == "1_00060_00003"
    assert values(readers.unexpected_columns(table, ["1_00060_00003"]), "column") == [("2_00010_00001",)]
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"1"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[2,2],[3,2],[3,3],[2,2]]]]}}]}')
    assert [r.rings[0][1].x for r in readers.read_geojson(spark, str(tmp_path / "c.json")).collect()] == [1.0, 3.0]
    df = spark.createDataFrame([(2, ["b"]), (1, ["a", "c"])], "k int, events array<string>")
    writers.write_csv(df, str(tmp_path / "out"), ["k"], single_file=True)
    assert next((tmp_path / "out").glob("part-*")).read_text() == 'k,events\n1,"{a,c}"\n2,{b}\n'
    writers.write_table(df, str(tmp_path / "t"), "k", keys=["k"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_table(df, str(tmp_path / "t"))
    Q.swapped_write(df.limit(1), str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    with pytest.raises(Q.QualityError):
        Q.swapped_write(df.unionByName(df), str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert writers.commented(df, {"k": "key"}).schema["k"].metadata == {"comment": "key"}


def test_replayed_fetch_keeps_failures_apart(spark):
    def fetch(site):
        if site == "bad":
            raise RuntimeError("no answer")
        return [{"site": site, "v": 1.0}] if site == "a" else []

    rows, failed = readers.replay_fetch(spark, spark.createDataFrame([("a",), ("bad",), ("none",)], "site string"), fetch, "site string, v double")
    requested = spark.createDataFrame([("a",), ("bad",), ("none",)], "site string")
    assert values(discharge.fetch_status(rows, requested, failed, "site"), "site", "status", "n") == [("a", "success_data", 1), ("bad", "error", 0), ("none", "success_empty", 0)]


def test_streams(spark, tmp_path):
    rows = [("a", dt.datetime(2000, 1, d, h), float(h)) for d in (1, 2, 9) for h in (1, 3)]
    batch = spark.createDataFrame(rows + rows[:1], "site string, ts timestamp, v double")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), batch.schema)
    unique = ingest.without_repeats(stream, ["site", "ts"], "ts", "30 days")
    for _ in range(2):
        ingest.append_new_rows(unique, str(tmp_path / "out"), ["site", "ts"], str(tmp_path / f"ck{_}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    query = ingest.daily_means(stream, "site", "ts", "v").writeStream.format("memory").queryName("means").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.date, r["mean"]) for r in spark.table("means").collect()} >= {(D(2000, 1, 2), 2.0)}
    fires = spark.createDataFrame([("a", D(2000, 1, 5), D(2000, 1, 5))], "site string, s date, e date")
    assert ingest.paired_with_events(stream.withColumn("day", F.to_date("ts")), fires, "site", "day", "s", "e").isStreaming


def test_holes_of_other_lengths(spark):
    """Rings of a polygon differ in their numbers of points; every operator on polygons takes them."""
    points = lambda *a: [(float(x), float(y)) for x, y in a]
    holed = [points((0, 0), (4, 0), (4, 4), (0, 4)), points((1, 1), (2, 1), (1, 2))]
    corner = [points((0, 0), (4, 0), (0, 4))]
    shapes = spark.createDataFrame([("a", holed), ("b", corner)], "usgs_site string, geometry array<array<struct<x:double,y:double>>>")
    both = spatial.pairwise_overlap(shapes, 2.0).first()
    assert (both.overlap_area, both.percent_of_2) == pytest.approx((7.5, 93.75))
    shares = {r.usgs_site: r.ecoregion_pct for r in spatial.share_inside(shapes, shapes.where("usgs_site = 'b'"), 2.0, 1.0).collect()}
    assert shares == {"a": 48.4, "b": 100.0}
    packed = shapes.select("usgs_site", writers.well_known_binary("geometry").alias("shape"))
    read = {r.usgs_site: r.rings for r in readers.wkb_polygons(packed, "shape").collect()}
    assert [len(ring) for ring in read["a"]] == [5, 4] and len(read["b"]) == 1
    simple = {r.usgs_site: r.g for r in shapes.select("usgs_site", spatial.simplified(F.col("geometry"), 0.01).alias("g")).collect()}
    assert [len(ring) for ring in simple["a"]] == [4, 3]
    line = points((-1, 1.5), (2, 1.5), (5, 1.5))
    lines = spark.createDataFrame([(1, line)], "line_id long, line array<struct<x:double,y:double>>")
    kept = sorted((r.usgs_site, round(6 * r.start_fraction, 6), round(6 * r.end_fraction, 6)) for r in spatial.clip_lines(lines, shapes, 2.0).collect())
    assert kept == [("a", 1, 2), ("a", 2.5, 5), ("b", 1, 3.5)]
    edges = lines.selectExpr("'s' AS usgs_site", "line_id AS edge_id", "line")
    met = network.event_crossings(edges, shapes.selectExpr("'s' AS usgs_site", "usgs_site AS event_id", "geometry")).collect()
    assert sorted((r.event_id, round(6 * r.fraction, 6)) for r in met) == [("a", 1), ("a", 2), ("a", 2.5), ("a", 5), ("b", 1), ("b", 3.5)]
    turns = np.random.default_rng(7).normal(size=(40, 2))
    many = G.line_boundary_fractions(turns, turns[:10] + 0.1)
    assert many == pytest.approx(G.few_crossings(turns.tolist(), (turns[:10] + 0.1).tolist())) and many


def test_paths_of_uneven_lines(spark):
    """Lines of a path differ in their numbers of points."""
    point = "array<struct<x:double,y:double>>"
    edges = spark.createDataFrame([("s", 1, [(0.0, 0.0), (1.0, 0.0)]), ("s", 2, [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0)])], f"usgs_site string, edge_id long, line {point}")
    found = spark.createDataFrame([("s", "f", 3.0, "ok", [1, 2]), ("s", "g", None, "unreachable", [])], "usgs_site string, event_id string, distance_m double, status string, path_edge_ids array<long>")
    one, none = network.event_paths(found, edges).collect()
    assert (one.n_edges, [len(line) for line in one.lines]) == (2, [4]) and (none.n_edges, none.lines) == (0, [])


def test_look_back_keeps_equal_rows(spark):
    observations = spark.sql("SELECT * FROM VALUES ('s', DATE'2001-01-01', 1), ('s', DATE'2001-01-01', 1), ('s', DATE'1999-01-01', 2), ('t', NULL, 3) AS v(site, day, n)")
    events = spark.sql("SELECT 's' AS site, DATE'2000-01-01' AS burned, 5D AS amount")
    got = sorted((r.n, r.amount_sum, r.n_events, r.days_since) for r in J.look_back(observations, events, "site", "day", "burned", "amount").collect())
    assert got == [(1, 5, 1, 366), (1, 5, 1, 366), (2, 0, 0, 0), (3, 0, 0, 0)]
