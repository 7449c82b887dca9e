"""Queries and operators read all rows of their tables."""

from __future__ import annotations

from cinderbrook import catalog


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"


def test_distances_take_all_lines_as_edges_and_events(spark, tmp_path):
    # 1 - part 10 (5) - 2 - part 11 (1): the way to part 11 needs second lines; (1, 1) is there twice
    lines = [(1, 1, 10, 1, 5.0, "A"), (1, 1, 12, 1, 2.0, "A"), (1, 2, 10, 2, 3.0, "A"), (2, 2, 11, 2, 1.0, "A"), (4, 1, 20, 7, 1.0, "N")]
    stored(spark, tmp_path, "lineitem", lines, LINES)
    got = catalog.QUERIES["site_event_distances"](spark, str(tmp_path)).collect()
    assert len({(r.usgs_site, r.event_id) for r in got}) == len(got) == 5
    assert sorted((r.usgs_site, r.distance_m, r.n_edges, r.status) for r in got) == [("A", 2.0, 1, "ok"), ("A", 5.0, 1, "ok"), ("A", 5.0, 1, "ok"), ("A", 9.0, 3, "ok"), ("N", 1.0, 1, "ok")]
    log = {r.usgs_site: (r.n_events, r.n_ok) for r in catalog.QUERIES["distance_run_log"](spark, str(tmp_path)).collect()}
    assert log == {"A": (4, 4), "N": (1, 1)}


def vectors(spark, folder, rows):
    stored(spark, folder, "embeddings", [(k, label, [float(x) for x in v]) for k, label, v in rows], "vec_id long, label int, embedding array<float>")


def test_regions_of_any_id_can_be_dominant(spark, tmp_path):
    # boxes: 3 covers nearly all of 7 (by half its own area), 5 only a corner
    vectors(spark, tmp_path, [(7, 0, [0, 0, 0.1, 0.1]), (3, 0, [0, 0, 0.2, 0.1]), (5, 0, [0.1, 0.1, 0.1, 0.1])])
    got = {r.usgs_site: r.region_id for r in catalog.QUERIES["region_shares"](spark, str(tmp_path)).collect()}
    assert got == {"7": 3, "3": 3, "5": 5}


def test_points_snap_to_lines_of_any_id(spark, tmp_path):
    # 10 runs far off; 11 passes by the points, which lie on (vec_id 10) and beside it (11)
    vectors(spark, tmp_path, [(10, 0, [5, 5, 6, 5, 7, 5, 1, 0]), (11, 0, [0, 0, 2, 0, 2, 2, 2.5, 1]), (12, 1, [0, 0, 0, 0, 0, 0, 3, 4])])
    got = {r.point_id: (r.edge_id, round(r.fraction, 6), round(r.distance_m, 6)) for r in catalog.QUERIES["snapped_points"](spark, str(tmp_path)).collect()}
    assert got == {10: (11, 0.25, 0.0), 11: (11, 0.75, 0.5), 12: (12, 0.0, 5.0)}
