"""Folds with null keys, manifests, route documents, text trees and curves."""

import math

import pytest
from pyspark.sql import functions as F

from trailnet.functions import geo
from trailnet.operators import folds, route
from trailnet.sources import kml, sinks


def test_fold_keeps_null_and_large_keys(spark):
    big = (1 << 53) + 1
    rows = [(k, ms) for k in (None, big, big - 1) for ms in (0, 10, 60, 70)]
    df = spark.createDataFrame(rows, "user_id long, ms long").repartition(3)
    got = folds.fold(df, ["user_id"], ["ms"], folds.throttle(50), "publish boolean")
    assert got.schema.simpleString() == "struct<user_id:bigint,ms:bigint,publish:boolean>"
    assert {(r.user_id, r.ms) for r in got.where("publish").collect()} == {(k, ms) for k in (None, big, big - 1) for ms in (0, 60)}
    none = spark.createDataFrame([], "user_id long, ms long")
    assert folds.fold(none, ["user_id"], ["ms"], folds.throttle(50), "publish boolean").count() == 0


def test_fold_nan_key_and_missing_accuracy(spark):
    df = spark.createDataFrame([(math.nan, 1, None, None), (math.nan, 2, 30.0, "MOVING"), (math.nan, 3, 5.0, "MOVING"), (math.nan, 4, 5.0, "STATIONARY")], "k double, ms long, accuracy double, motion string")
    got = folds.fold(df, ["k"], ["ms"], folds.gate(25.0), "accepted boolean").orderBy("ms").collect()
    assert [r.accepted for r in got] == [True, False, True, False]


def test_smooth_bearing():
    step = folds.smooth_bearing()
    state, out = step(None, {"ms": 0, "target": 359.0})
    assert out == {"bearing": 359.0}
    state, out = step(state, {"ms": 50, "target": 0.2})
    assert out == {"bearing": 359.0}  # within the deadband, over north
    state, out = step(state, {"ms": 1000, "target": 9.0})  # no more than 100 ms count
    assert out["bearing"] == pytest.approx((359 + 10 * (1 - math.exp(-100 / 2200))) % 360)


def test_curve_ends_and_stands_still(spark):
    at = lambda t: geo.hermite(F.lit(10.0), F.lit(20.0), F.lit(11.0), F.lit(21.0), F.lit(0.0), F.lit(90.0), F.lit(t))
    head = lambda t, lat=11.0: geo.hermite_bearing(F.lit(10.0), F.lit(20.0), F.lit(lat), F.lit(21.0 if lat > 10 else 20.0), F.lit(0.0), F.lit(90.0), F.lit(t))
    r = spark.range(1).select(at(0.0).alias("a"), at(1.0).alias("b"), head(0.0).alias("h0"), head(1.0).alias("h1"), head(0.5, 10.0).isNotNull().alias("still")).first()
    assert (r.a.lat, r.a.lon) == (10.0, 20.0) and r.b.lat == pytest.approx(11.0) and r.b.lon == pytest.approx(21.0)
    assert r.h0 == pytest.approx(0.0) and r.h1 == pytest.approx(90.0) and r.still


def entry(page, local=None):
    return (page, None, None, None, None, local, None, None, None, None)


def test_manifests(spark, tmp_path):
    schema = f"path string, {kml.MANIFEST_SCHEMA}"
    docs = spark.createDataFrame([("new", 2, {"ES01-01a": entry("x.kml")}), ("old", None, {"7": entry("ES02a_03b_a-b.kml"), "8": entry(" ", "data/raw/ES02a/ES02a_04_b-c.kml")}), ("none", 1, None)], schema)
    rows = kml.manifest_tracks(docs)
    assert {(r.path, r.route_id) for r in rows.collect()} == {("new", "ES01-01a"), ("old", "ES02a-03b"), ("old", "ES02a-04")}
    out = str(tmp_path / "manifest")
    for part in ("path = 'old'", "path = 'new'"):
        sinks.write_manifest(rows.where(part).coalesce(1), out)
    assert [r.route_id for r in spark.read.json(out).collect()] == ["ES01-01a"] and not (tmp_path / "manifest.tmp").exists()
    twice = spark.createDataFrame([("old", 1, {"7": entry("ES02a_03b_a-b.kml"), "8": entry("ES02a_03b_c-d.kml")})], schema)
    with pytest.raises(Exception, match="Duplicate route id"):
        kml.manifest_tracks(twice).collect()


def test_route_documents(spark):
    schema = f"stem string, {kml.GROUP_SCHEMA}"
    line = [[1.0, 2.0, 3.0], [1.5], [1.1, 2.1]]
    group = lambda pts: ("ES01", None, " ", "Way", [("10a", None, "a", None, None, True, pts), ("02a", "", "b", "c", False, None, pts), ("03b", None, "b", "c", False, False, pts), ("04a", None, "b", "c", False, False, pts[:1])])
    tracks = kml.canonical_tracks(spark.createDataFrame([group(line)], schema))
    assert {(r.route, r.name, r.section, r.to_key, r.pseudo_from, len(r.points)) for r in tracks.collect()} == {("ES01", "Way", "10a", "", False, 2), ("ES01", "Way", "02a", "c", False, 2)}
    doc = sinks.route_documents(tracks).first().document
    assert doc.startswith('{"schema":4,"route_group_id":"ES01","name":"Way","tracks":[{"section_id":"02a"') and '"coordinates":[[1.0,2.0,3.0],[1.1,2.1,null]]' in doc
    with pytest.raises(Exception, match="Invalid coordinate in/ES01/10a"):
        kml.canonical_tracks(spark.createDataFrame([("ES01", None, None, None, [("10a", None, None, None, None, None, [[91.0, 0.0], [1.0, 1.0]])])], schema)).collect()


def test_text_tree(spark):
    edges = spark.createDataFrame([("a", "b", "1 km"), ("b", "a", "1 km"), ("b", "c", "2 km"), ("c", "d", "4 km"), ("a", "e", "3 km")], "src string, dst string, caption string")
    lines = [r.line for r in sinks.tree_lines(route.group_tree(edges, F.lit("a"))).orderBy("sort_path").collect()]
    assert lines == ["a", "├─ b  (1 km)", "│  ├─ a  (1 km; cycle)", "│  └─ c  (2 km)", "│     └─ d  (4 km)", "└─ e  (3 km)"]
