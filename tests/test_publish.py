"""Versions behind a pointer: readers see one whole version, whatever fails."""

import pytest
from pyspark.sql import functions as F

from trailnet.operators import route, spatial
from trailnet.sources import kml, publish as P


def test_a_version_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "net")
    assert P.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        P.read_current(spark, path, "nodes")
    nodes = spark.createDataFrame([("a", 1, None), ("é", None, 2.5)], "place string, n int, lat double")
    edges = spark.range(50).select(F.col("id").alias("edge"), F.array(F.lit("x")).alias("routes"))
    first = P.publish({"nodes": nodes, "edges": edges}, path)
    reader = P.read_current(spark, path, "nodes")
    assert sorted(map(tuple, reader.collect()), key=str) == sorted(map(tuple, nodes.collect()), key=str) and reader.schema == nodes.schema
    assert P.current(spark, path)["tables"]["edges"]["rows"] == 50

    # A task fails in the second table: the pointer stays, the reader between sees the first version.
    broken = edges.withColumn("edge", F.when(F.col("edge") == 49, F.raise_error(F.lit("task lost")).cast("long")).otherwise(F.col("edge")))
    with pytest.raises(Exception, match="task lost"):
        P.publish({"nodes": nodes.limit(0), "edges": broken}, path)
    assert P.current(spark, path)["version"] == first and P.read_current(spark, path, "nodes").count() == 2

    second = P.publish({"nodes": nodes.limit(1), "edges": edges}, path)
    assert P.current(spark, path)["version"] == second and P.read_current(spark, path, "nodes").count() == 1
    assert reader.count() == 2
    assert P.prune(spark, path) == 2 and P.read_current(spark, path, "edges").count() == 50


def test_manifests_have_one_row_for_an_id(spark, tmp_path):
    path = str(tmp_path / "m")
    one = spark.createDataFrame([("ES01-01a", "x"), ("ES01-02a", "y")], "route_id string, sha256 string")
    P.publish_manifest(one, path)
    with pytest.raises(Exception, match="Duplicate route id"):
        P.publish_manifest(one.union(one.limit(1)), path)
    assert P.read_current(spark, path, "manifest").count() == 2


def test_counters_of_files(spark):
    files = spark.createDataFrame([("a", "<coordinates>1,2,3 4,5 x,y 6,7,8</coordinates><coordinates>9,9,9</coordinates>"), ("b", "<coordinates></coordinates>"), ("c", "none")], "path string, content string")
    assert sorted(map(tuple, kml.counters(files).collect())) == [("a", 4, 3, True), ("b", 0, 0, False), ("c", 0, 0, False)]


def test_the_index_must_have_tracks_once(spark):
    rows = spark.createDataFrame([("ES10c_03a_moclin-alcala.kml", "1"), ("ES10c_04a_a-b.kml", "2")], "page_filename string, download_id string")
    assert kml.required_index(rows).count() == 2
    with pytest.raises(Exception, match="Duplicate route id"):
        kml.required_index(rows.union(rows.limit(1))).collect()
    with pytest.raises(Exception, match="no tracks"):
        kml.required_index(rows.limit(0)).collect()


def test_a_root_is_one_place(spark):
    rows = [(f"santiago{i:02d}", f"santiago{i:02d}") for i in range(20)] + [("azofra@1", "azofra"), ("azofra@2", "azofra"), ("leon", "leon")]
    places = spark.createDataFrame(rows, "place_key string, name_key string")
    assert tuple(route.resolve_root(places, "leon", {}).first()) == ("leon", "leon", 0)
    assert route.resolve_root(places, "stgo", {"stgo": "leon"}).first().place_key == "leon"
    assert route.resolve_root(places, "azofra@2", {}).first().place_key == "azofra@2"
    with pytest.raises(Exception, match="azofra is one of: azofra@1, azofra@2"):
        route.resolve_root(places, "azofra", {}).collect()
    with pytest.raises(Exception, match=r"santiago00, .*santiago11, \.\.\."):
        route.resolve_root(places, "santiago", {}).collect()
    with pytest.raises(Exception, match="No place"):
        route.resolve_root(places, "burgos", {}).collect()


def test_bearing_is_live_or_the_routes(spark):
    segments = spark.createDataFrame([(1, 0, 42.0, -3.0, 42.0, -2.9), (1, 1, 42.0, -2.9, 42.1, -2.9)], "track int, segment int, lat1 double, lon1 double, lat2 double, lon2 double")
    queries = spark.createDataFrame([(1, 42.001, -2.95, None), (2, 42.05, -2.901, None), (3, 42.05, -2.901, 12.5), (4, None, None, None)], "query int, lat double, lon double, course double")
    got = {r["query"]: (r.bearing, r.live) for r in spatial.route_bearing(queries, segments).collect()}
    assert got[1] == (pytest.approx(90, abs=0.1), False) and got[2] == (pytest.approx(0, abs=1e-6), False) and got[3] == (12.5, True) and got[4] == (None, False)
    none = {r["query"]: r.bearing for r in spatial.route_bearing(queries, segments.limit(0)).collect()}
    assert none == {1: None, 2: None, 3: 12.5, 4: None}
