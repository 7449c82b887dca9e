"""Overlays of many boxes in tiles: the pairs of SQL, without shuffling them; repeated ids; unions of boxes; clipped lines."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pytest
from test_catalog import rows

from cinderbrook import catalog
from cinderbrook.catalog import models, registry
from cinderbrook.functions import geometry as G
from cinderbrook.plans import spatial

SHAPES = f"usgs_site string, geometry {spatial.RINGS}"


def box(x, y, w, h):
    return [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """1,000 boxes, of which one in five pairs overlap, as the given vectors' do."""
    folder, rng = tmp_path_factory.mktemp("dense"), np.random.default_rng(3)
    vectors = rng.normal(size=(1_000, 8)) / 8
    spark.createDataFrame([(k, k % 5, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def written(spark):
    return sum(e.totalShuffleWrite() for e in map(spark.sparkContext._jsc.sc().statusStore().executorList(False).apply, [0]))


def agrees(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got, found = catalog.QUERIES[name](spark, folder), con.sql(catalog.ORACLE_SQL[name])
    values = got.collect()
    assert sorted(got.columns) == sorted(found.columns) and rows(got.columns, values) == rows(found.columns, found.fetchall())
    return len(values)


@pytest.mark.parametrize("name", ["event_overlay_added", "region_shares", "sites_in_study_area", "burned_watersheds", "event_overlay", "pairwise_overlap"])
def test_pairs_of_boxes_are_not_shuffled(spark, dense, name):
    before = written(spark)
    agrees(spark, dense, name)
    time.sleep(1)  # the listener is a little late
    assert written(spark) - before < 2_000_000  # 200,000 pairs


@pytest.mark.parametrize("name", ["clipped_lines", "event_overlay"])
def test_tiles_shuffle_no_more_if_the_input_has_many_partitions(spark, dense, name):
    vectors = spark.read.parquet(f"{dense}/embeddings.parquet").repartition(64).localCheckpoint()

    class Dealt(registry.Tables):
        embeddings = vectors

    before = written(spark)
    assert getattr(models, name)(Dealt(spark, dense)).count() > 100_000
    time.sleep(1)  # the listener is a little late
    assert written(spark) - before < 2_000_000


def test_an_events_pairs_follow_each_other(spark, dense):
    got = catalog.QUERIES["event_overlay"](spark, dense).collect()
    changes = lambda c: sum(a[c] != b[c] for a, b in zip(got, got[1:]))
    assert changes("event_id") < changes("usgs_site") / 5


def test_lines_are_clipped_by_whole_arrays(spark, dense):
    began = time.time()
    assert agrees(spark, dense, "clipped_lines") > 100_000
    assert time.time() - began < 40


def test_level_and_bent_lines_beside_slanting_ones(spark):
    shapes = spark.createDataFrame([("a", box(0, 0, 4, 4)), ("b", [box(0, 0, 4, 4)[0][:3]])], SHAPES)
    lines = {1: [(-1, 1), (5, 3)], 2: [(-1, 2), (5, 2)], 3: [(-1, 1), (2, 1), (2, 5)], 4: [(1, 1), (1, 1)]}
    frame = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in line]) for k, line in lines.items()], "line_id long, line array<struct<x:double,y:double>>")
    got = sorted((r.usgs_site, r.line_id, round(r.start_fraction, 6), round(r.end_fraction, 6)) for r in spatial.clip_lines(frame, shapes, 2.0).collect())
    rings = {k: [np.array([(p["x"], p["y"]) for p in r]) for r in g] for k, g in (("a", box(0, 0, 4, 4)), ("b", [box(0, 0, 4, 4)[0][:3]]))}
    want = []
    for site, shape in rings.items():
        for k, line in lines.items():
            points = np.array(line, float)
            cuts = sorted({0.0, 1.0, *(G.line_boundary_fractions(points, shape[0]) if k != 4 else [])})
            want += [(site, k, round(a, 6), round(b, 6)) for a, b in zip(cuts, cuts[1:]) if G.point_in_polygon(tuple(G.interpolate(points, (a + b) / 2) if k != 4 else points[0]), shape)]
    assert got == sorted(want)


def test_repeated_ids_count_once(spark):
    sites = spark.createDataFrame([("a", box(0, 0, 4, 4)), ("a", box(10, 0, 4, 4)), ("b", box(0, 0, 4, 4)), ("c", [box(0, 0, 4, 4)[0][:3]])], SHAPES)
    events = spark.createDataFrame([("e", 2.0, box(1, 1, 1, 1)), ("e", 2.0, box(11, 1, 1, 1)), ("f", 3.0, box(1, 1, 12, 1)), (None, None, box(3, 3, 1, 1))], f"event_id string, acres double, geometry {spatial.RINGS}").selectExpr("*", "DATE'2000-01-01' AS ig_date")
    found = spatial.events_on_sites(sites, events, 2.0)
    plain = spatial.overlay(sites, events.select("event_id", "ig_date", events.geometry.alias("g")), "geometry", "g", 2.0).distinct()
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.select(*found.columns).collect()))
    counts = {r.usgs_site: (r.n_events, round(r.within_km2 * 1e6, 6)) for r in spatial.burned_watersheds(sites, events, 2.0).collect()}
    pairs = spatial.overlay(sites, events.select("event_id", events.geometry.alias("g")), "geometry", "g", 2.0).collect()
    assert counts == {s: (len({r.event_id for r in pairs if r.usgs_site == s} - {None}), round(sum(r.overlap_area for r in pairs if r.usgs_site == s), 6)) for s in "abc"}
    assert counts["a"][0] == counts["b"][0] == 2


def test_added_overlays_keep_what_is_there(spark):
    sites = spark.createDataFrame([("a", box(0, 0, 4, 4)), ("b", box(1, 1, 4, 4))], SHAPES)
    events = spark.createDataFrame([("e", box(1, 1, 1, 1)), ("f", box(2, 2, 1, 1)), ("g", box(2, 2, 2, 2))], f"event_id string, geometry {spatial.RINGS}").selectExpr("*", "DATE'2000-01-01' AS ig_date")
    for known in ([], [("a", "e")], [("a", "e"), ("b", "e")], [("a", "e"), ("b", "f")], [("b", "f"), ("b", "f"), ("z", "g")], [("b", "e"), ("b", "f"), ("b", "g")]):
        present = spark.createDataFrame([(s, e, None, -1.0) for s, e in known], "usgs_site string, event_id string, ig_date date, overlap_area double")
        got = sorted((r.usgs_site, r.event_id, r.overlap_area == -1) for r in spatial.add_events_on_sites(present, sites, events, 2.0).collect())
        assert got == sorted([(s, e, True) for s, e in known] + [(s, e, False) for s in "ab" for e in "efg" if (s, e) not in known])


def test_union_of_boxes_inside_a_box():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30):
        low = rng.integers(0, 12, (n, 2))
        boxes = np.hstack([low, low + rng.integers(1, 6, (n, 2))]).astype(float)
        cells = np.zeros((20, 20), bool)
        for x1, y1, x2, y2 in boxes.astype(int):
            cells[x1:x2, y1:y2] = True
        assert G.covered_box(np.array([3.0, 2, 15, 11]), boxes) == cells[3:15, 2:11].sum()
