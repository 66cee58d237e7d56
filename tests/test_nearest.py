"""Nearest tracks against all segments, and how many of them are compared."""

import math
import random

from trailnet.operators import spatial
from trailnet.operators.folds import haversine

SEGMENTS = "track int, segment int, route string, lat1 double, lon1 double, lat2 double, lon2 double"


def to_segment(lat, lon, a, b, c, d):
    wide = max(0.2, abs(math.cos(math.radians((lat + a + c) / 3))))
    x, y, px, py = (d - b) * wide, c - a, (lon - b) * wide, lat - a
    t = max(0.0, min(1.0, (px * x + py * y) / (x * x + y * y))) if x * x + y * y > 1e-9 / 111195.0**2 else 0.0
    # The nearest in a plane, as the operator compares.
    return math.hypot(px - x * t, py - y * t), haversine(lat, lon, a + (c - a) * t, b + (d - b) * t)


def world(seed=3, tracks=60, steps=12):
    rng, segments = random.Random(seed), []
    for track in range(tracks):
        lat, lon, size = rng.uniform(40, 42), rng.uniform(-4, -1), rng.choice([0.0005, 0.01, 0.3])
        for k in range(steps):
            to = (lat + rng.uniform(-1, 1) * size, lon + rng.uniform(-1, 1) * size)
            segments.append((track, k, "AB"[track % 2], lat, lon, *to))
            lat, lon = to
    queries = [(q, "AB"[q % 2], rng.uniform(39.5, 42.5), rng.uniform(-4.5, -0.5)) for q in range(150)] + [(200 + i, "A", s[3], s[4]) for i, s in enumerate(segments[:40])]
    return segments, queries + [(300, "A", None, 1.0), (301, "C", 41.0, -2.0), (302, None, 41.0, -2.0), (303, "A", 41.0, -2.0), (304, "A", 41.0, -2.0)]


def test_nearest_segment_and_its_candidates(spark):
    segments, queries = world()
    report = {}
    got = {r["query"]: r for r in spatial.nearest_segment(spark.createDataFrame(queries, "query int, route string, lat double, lon double"), spark.createDataFrame(segments, SEGMENTS), report=report).collect()}
    assert len(got) == len(queries) and got[300].track is None
    for q, _, lat, lon in queries:
        if lat is not None:
            want = min(to_segment(lat, lon, *s[3:]) for s in segments)[1]
            assert abs(got[q].distance_m - want) <= 0.01 + 1e-4 * want
    assert report["spots"] <= len(queries) - 3 and report["comparisons"] < 0.25 * report["spots"] * len(segments)


def test_nearest_on_route(spark):
    segments, queries = world(9)
    got = {r["query"]: r for r in spatial.nearest_on_route(spark.createDataFrame(queries, "query int, route string, lat double, lon double"), spark.createDataFrame(segments, SEGMENTS)).collect()}
    assert got[301].track is None and got[302].track is None and len(got) == len(queries)
    for q, route, lat, lon in queries[:190]:
        want = min(to_segment(lat, lon, *s[3:]) for s in segments if s[2] == route)[1]
        assert abs(got[q].distance_m - want) <= 0.01 + 1e-4 * want and got[q].track % 2 == "AB".index(route)


def test_many_rows_at_one_spot_are_one_to_compare(spark):
    from pyspark.sql import functions as F

    crowd = spark.range(200_000).select("id", F.lit("a").alias("name"), F.lit(42.0).alias("lat"), F.lit(-3.0).alias("lon"))
    more = spark.createDataFrame([(300_000, "a", 42.0005, -3.0), (300_001, "b", 42.0005, -3.0), (300_002, "a", 43.0, -3.0), (300_003, "a", None, -3.0), (300_004, None, 42.0, -3.0)], "id long, name string, lat double, lon double")
    got = spatial.single_link_clusters(crowd.unionByName(more), "id", 100.0, ["name"])
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes == {0: 200_001, 300_001: 1, 300_002: 1, 300_003: 1, 300_004: 1}
    assert got.count() == 200_005
