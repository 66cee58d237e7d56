import json
import math

from pyspark.sql import functions as F

from trailnet.functions import geo, names
from trailnet.operators import folds, graph, network, points, spatial, trips
from trailnet.sources import kml, sinks

UNIT = math.pi * 6371008.8 / 180


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_haversine(spark):
    assert abs(value(spark, geo.haversine_m(0.0, 0.0, 1.0, 0.0)) - UNIT) < 0.01
    assert value(spark, geo.haversine_m(3.0, 4.0, 5.0, 6.0)) == value(spark, geo.haversine_m(5.0, 6.0, 3.0, 4.0))
    assert value(spark, geo.haversine_m(0.0, 0.0, 0.0, 0.0)) == 0
    assert value(spark, geo.haversine_m(F.lit(None).cast("double"), 0.0, 1.0, 0.0)) is None


def test_names_and_colours(spark):
    one = lambda c: value(spark, c)
    assert one(names.normalize_color(F.lit("  #AABBCC  "))) == "#AABBCC" and one(names.normalize_color(F.lit("not-a-color"))) == names.DEFAULT_COLOR
    assert [one(names.darken(F.lit(c), F.lit(a))) for c, a in (("#ffffff", 0.25), ("#123456", 1.0), ("#AA112233", 0.0))] == ["#BFBFBF", "#000000", "#112233"]
    assert one(names.route_id(F.lit("PT08a_20a_muge-santarem.kml"))) == "PT08a-20a" and one(names.route_id(F.lit("x.kml"))) is None
    assert one(names.title_words(F.lit("alcala_la_real"))) == "Alcala la Real"
    assert one(names.normalize_place(F.lit("pueyo_de_fañanas"))) == one(names.normalize_place(F.lit("pueyodefananas")))
    ends = one(names.label_ends(F.lit("variante-norte_de_azofra")))
    assert (ends.from_raw, ends.to_raw) == ("variante", "norte de azofra") and one(names.is_pseudo(F.lit("variante"))) and one(names.label_ends(F.lit("a-b-c"))) is None
    assert one(names.route_name(F.lit("A - B - C"), F.lit("X"))) == "B - C" and one(names.route_name(F.lit(None).cast("string"), F.lit("X"))) == "X"
    assert one(names.format_distance(F.lit(1234.0))) == "1,23km" and one(names.format_speed(F.lit(3.6))) == "3,6 km/h" and one(names.format_duration(F.lit(3725))) == "1 h 02 min"
    assert one(names.human_bytes(F.lit(1536))) == "1.50 KiB"


def test_nearest_segment(spark):
    seg = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.01)], "track int, segment int, lat1 double, lon1 double, lat2 double, lon2 double")
    q = spark.createDataFrame([(1, 0.001, 0.005), (2, 40.0, 50.0)], "query int, lat double, lon double")
    got = {r["query"]: r for r in spatial.nearest_segment(q, seg).collect()}
    assert abs(got[1].distance_m - math.pi * 6371008.8 / 180000) < 0.05 and abs(got[1].t - 0.5) < 1e-6 and got[2].track == 0


def test_shortest_path(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (1, 2, 1.0), (0, 2, 9.0), (7, 8, 1.0)], "src int, dst int, weight double")
    got = {r.node: r.distance_m for r in graph.shortest_paths(e, spark.createDataFrame([(0,)], "source int")).collect()}
    assert got == {0: 0.0, 1: 5.0, 2: 6.0}


def test_travel_statistics(spark):
    s = 1_000_000
    step = [(1, 1 * s, 47.0, 8.0), (1, 11 * s, 47.000089932, 8.0)]
    rows = [(2, *x[1:]) for x in step[:1]] + step + [(3, s, 47.0, 8.0), (3, 11 * s, 47.0000089932, 8.0), (3, 21 * s, 47.0000989252, 8.0), (4, s, 47.0, 8.0), (4, 11 * s, 47.03, 8.0), (5, s, 47.0, 8.0), (5, 961 * s, 47.0001, 8.0)]
    df = spark.createDataFrame(rows, "user_id int, us long, lat double, lon double")
    got = {r.user_id: (r.moving_kmh and round(r.moving_kmh, 1), r.total_kmh and round(r.total_kmh, 1)) for r in trips.trip_stats(df).collect()}
    assert got == {1: (3.6, 3.6), 2: (None, None), 3: (3.6, 1.8), 4: (None, 0.0), 5: (None, 0.0)}
    folded = folds.fold(df, ["user_id"], ["us"], folds.travel(3.0, 250.0, 15 * 60 * s), "distance_m double, moving_us long")
    assert {r.user_id: round(r.d, 3) for r in folded.groupBy("user_id").agg(F.max("distance_m").alias("d")).collect()} == {r.user_id: round(r.distance_m, 3) for r in trips.trip_stats(df).collect()}


def test_motion(spark):
    def run(samples):
        state, out = None, []
        for ms, m in samples:
            state, x = folds.motion(state, {"ms": ms, "magnitude_sq": m})
            out.append(x["motion"])
        return out

    assert run([(1000, 1.0), (2499, 1.0), (2500, 1.0)]) == ["UNKNOWN", "UNKNOWN", "STATIONARY"]
    assert run([(5000, 4.0), (6499, 4.0), (6500, 4.0)]) == ["UNKNOWN", "UNKNOWN", "MOVING"]
    assert run([(1000, 1), (2500, 1), (2600, 49)])[-1] == "STATIONARY"


def test_places(spark):
    unit = 4000 / UNIT
    df = spark.createDataFrame([(1, "n", 0.0, 0.0), (2, "n", unit, 0.0), (3, "n", 2 * unit, 0.0), (4, "n", 0.45, 0.0), (5, "m", 0.0, 0.0)], "place int, name string, lat double, lon double")
    got = {r.place_key: r.observations for r in spatial.cluster_places(df, "place", "name", 5000.0).collect()}
    assert got == {"n@1": 3, "n@2": 1, "m": 1}


def test_network(spark):
    t = spark.createDataFrame([("r", 1, "a", "b", 5.0, True), ("r", 2, "a", "b", 6.0, True), ("r", 3, "b", "b", 1.0, False), ("q", 4, "c", "d", 1.0, True), ("q", 5, "d", "c", 1.0, True)], "route string, track int, from_key string, to_key string, length_m double, primary boolean")
    assert {r.edge_id: (r.kind, r.representative) for r in network.edge_families(t, F.lit(0)).collect()} == {"a>b#1": ("SHARED", 1), "c>d#1": ("SINGLE", 4), "d>c#1": ("SINGLE", 5)}
    assert {r.kind for r in network.edge_families(t.where("track < 3"), F.col("track")).collect()} == {"ALTERNATIVE"}
    got = {r.route: (r.topology, r.cyclic_places, r.parallel_pairs) for r in network.topology(t).collect()}
    assert got == {"r": ("LINEAR", 0, 1), "q": ("NETWORK", 2, 0)}


def test_files_to_features(spark, tmp_path):
    (tmp_path / "ES01a").mkdir()
    (tmp_path / "ES01a/ES01a_01a_muge-santa_rem.kml").write_text("<k><coordinates>\n 1.0,2.0,3.0 x,y 1.5,2.5 7\n</coordinates><coordinates>4,5,6 7,8,9</coordinates></k>")
    (tmp_path / "ES01a/ES01a_02a_a-b-c.kml").write_text("<k/>")
    files = kml.read_files(spark, str(tmp_path))
    pts = kml.coordinates(files)
    assert sorted((r.part, r.lat, r.lon, r.ele) for r in pts.collect()) == [(0, 2.0, 1.0, 3.0), (0, 2.5, 1.5, None), (1, 5.0, 4.0, 6.0), (1, 8.0, 7.0, 9.0)]
    t = {r.section_id: r for r in kml.tracks_of(files).collect()}
    assert t["01a"].track_id == "ES01a:01a" and t["01a"].to_raw == "santa rem" and t["02a"].from_raw is None
    assert kml.invalid(files).count() == 1
    f = sinks.geojson_features(pts, ["path"], keys=("path", "part")).collect()
    assert [json.loads(r.feature)["geometry"]["coordinates"] for r in sorted(f, key=lambda r: r.part)] == [[[1.0, 2.0], [1.5, 2.5]], [[4.0, 5.0], [7.0, 8.0]]]
    assert kml.checksums(spark, str(tmp_path)).count() == 2


def test_polygon_and_index(spark):
    doc = spark.createDataFrame([("p", "name\n1\n 0 0\n 1 0\n 1 1\nEND\n!2\n 5 5\n 6 5\n 6 6\nEND\nEND\n")], "path string, content string")
    assert [(r.lon, r.lat) for r in kml.polygons(doc).orderBy("seq").collect()] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    page = spark.createDataFrame([('<table><tr><td>a_1.kml</td><a href="/get/file/12"></tr><tr>none</tr></table>',)], "html string")
    assert [tuple(r) for r in kml.index_rows(page).collect()] == [("a_1.kml", "12")]


def test_routes_document(spark, tmp_path):
    doc = {"routes": [{"route_group_id": "g", "name": "n", "tracks": [{"section_id": "1", "from_key": " ", "to_key": "b", "pseudo_to": True, "coordinates": [[1, 2, 3], [4, 5], [6]]}, {"section_id": "2", "coordinates": [[1, 2]]}]}, {"route_group_id": "h", "tracks": []}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    (row,) = kml.read_routes(spark, str(tmp_path / "r.json")).collect()
    assert (row.route, row.section, row.from_key, row.to_key, row.route_color, [tuple(p) for p in row.points]) == ("g", "1", None, None, names.DEFAULT_COLOR, [(1, 2, 3), (4, 5, None)])


def test_slopes_and_samples(spark):
    df = spark.createDataFrame([(1, i, 0.0, i * 0.001, float(i)) for i in range(10)], "track int, seq int, lat double, lon double, ele double")
    s = points.slope_window(df).orderBy("seq").collect()
    assert all(abs(r.slope - 100 / (UNIT * 0.001)) < 1e-6 for r in s)
    assert [r.seq for r in points.reduce_samples(df, 3).orderBy("seq").collect()] == [0, 4, 8, 9]
