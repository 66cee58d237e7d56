"""Queries on profiles, slices and geometry families, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import points as P
from ..operators import profile as O
from ..operators import spatial as S
from .frames import PLACES_SQL, POINTS_SQL, haversine_sql, places, points, rounded, rounded_sql, table


def _routed(spark, sf_dir):
    return points(spark, sf_dir).withColumn("route", F.col("track") % 10)


def render_thinning(spark, sf_dir):
    return O.render_points(points(spark, sf_dir), 120.0).select("track", "seq")


def track_slice(spark, sf_dir):
    p = points(spark, sf_dir)
    n = p.groupBy("track").agg(F.max("seq").alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slice"), F.col("c_custkey"), "c_nationkey").join(n, F.col("c_custkey") % 100 == F.col("track"))
    seg = lambda a: (F.col("c_custkey") * a + F.col("c_nationkey")) % (F.col("n") - 1) + 1
    c = c.select("slice", "track", seg(17).alias("from_seg"), F.lit(0.25).alias("from_t"), seg(29).alias("to_seg"), F.lit(0.5).alias("to_t"))
    at = lambda side: p.select("track", F.col("seq").alias(f"{side}_seg"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
    c = c.join(at("from"), ["track", "from_seg"]).join(at("to"), ["track", "to_seg"])
    out = O.track_slices(p, c)
    return out.groupBy("slice").agg(F.count("*").alias("points"), rounded(F.sum(F.col("k") * F.col("lat")), 4).alias("lat_sum"), rounded(F.sum(F.col("k") * F.col("lon")), 4).alias("lon_sum"))


def profile_build(spark, sf_dir):
    p = O.profile(_routed(spark, sf_dir), 2000.0)
    return p.select("route", "track", "seq", rounded(F.col("along_m"), 1).alias("along_m"), rounded(F.col("ele"), 6).alias("ele"), "break_before")


def gap_features(spark, sf_dir):
    return O.gap_features(_routed(spark, sf_dir)).select("route", "track", rounded(F.col("gap_m"), 2).alias("gap_m"))


def next_climb(spark, sf_dir):
    p = _routed(spark, sf_dir)
    stops = p.where("seq % 40 = 0").select("route", "track", "seq", (F.col("track") * 1000 + F.col("seq")).alias("place"))
    out = O.climb_to_next(p, stops)
    return out.select("track", "seq", "place", rounded(F.col("distance_m"), 1).alias("distance_m"), rounded(F.col("climb_m"), 5).alias("climb_m"))


def nearest_on_route(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("seq")
    seg = _routed(spark, sf_dir).select("route", "track", F.col("seq").alias("segment"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 IS NOT NULL")
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), (F.col("s_suppkey") % 12).alias("route"), (F.lit(40.01) + (F.col("s_suppkey") % 13).cast("double") / 1000).alias("lat"), (F.lit(-3.01) + (F.col("s_suppkey") % 17).cast("double") / 1000).alias("lon"))
    return S.nearest_on_route(q, seg).select("query", rounded(F.col("distance_m"), 2).alias("distance_m"))


def _twins(spark, sf_dir):
    """Each track and a copy of it, moved north by 0, 11 or 89 metres."""
    p = points(spark, sf_dir)
    moved = p.withColumn("lat", F.col("lat") + F.element_at(F.array(F.lit(0.0), F.lit(0.0001), F.lit(0.0008)), (F.col("track") % 3 + 1).cast("int"))).withColumn("track", F.col("track") + 1_000_000)
    return P.along(p.unionByName(moved))


def geometry_families(spark, sf_dir):
    p = _twins(spark, sf_dir)
    t = p.select("track").distinct().select("track", (F.col("track") % 1_000_000).alias("from_key"), F.lit(-1).cast("long").alias("to_key"))
    return O.geometry_families(t, p)


def orient_variants(spark, sf_dir):
    p = points(spark, sf_dir)
    e = p.groupBy("track").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("s"), F.max_by(F.struct("lat", "lon"), "seq").alias("e"))
    e = e.select("track", (F.col("track") % 40).alias("from_name"), (F.col("track") % 37 + 40).alias("to_name"), F.col("s.lat").alias("alat"), F.col("s.lon").alias("alon"), F.col("e.lat").alias("blat"), F.col("e.lon").alias("blon"))
    c = places(spark, sf_dir).where("primary").select((F.col("place") % 90).alias("name"), "lat", "lon").where("name % 3 <> 0")
    return O.orient_variants(e, c).select("track", "reversed", rounded(F.col("score_m"), 1).alias("score_m"), "evidence")


QUERIES = {f.__name__: f for f in (render_thinning, track_slice, profile_build, gap_features, next_climb, nearest_on_route, geometry_families, orient_variants)}

STEP = haversine_sql("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")
WAY_SQL = f"""SELECT *, sum(step) OVER (PARTITION BY route ORDER BY track, seq ROWS UNBOUNDED PRECEDING) AS along FROM (SELECT track % 10 AS route, track, seq, lat, lon, ele, coalesce({STEP}, CAST(0 AS DOUBLE)) AS step,
    coalesce(lag(track) OVER w <> track AND {STEP} >= 0.05, false) AS brk, coalesce(lead(track) OVER w <> track, true) AS forced, row_number() OVER w AS k, lag(track) OVER w AS before FROM ({POINTS_SQL}) WINDOW w AS (PARTITION BY track % 10 ORDER BY track, seq))"""
_FAR = haversine_sql("t.a", "t.o", "f.lat", "f.lon")
ORACLE_SQL = {
    "render_thinning": f"""WITH RECURSIVE f AS (SELECT *, lead(seq) OVER (PARTITION BY track ORDER BY seq) IS NULL AS last FROM ({POINTS_SQL})), t(track, seq, kept, last, a, o) AS (SELECT track, seq, true, last, lat, lon FROM f WHERE seq = 1 UNION ALL
        SELECT f.track, f.seq, {_FAR} >= 120, f.last, CASE WHEN {_FAR} >= 120 THEN f.lat ELSE t.a END, CASE WHEN {_FAR} >= 120 THEN f.lon ELSE t.o END FROM t JOIN f ON f.track = t.track AND f.seq = t.seq + 1)
        SELECT track, seq FROM t WHERE (kept OR last) AND NOT (seq = 1 AND last)""",
    "track_slice": f"""WITH p AS MATERIALIZED ({POINTS_SQL}), n AS (SELECT track, max(seq) AS n FROM p GROUP BY track), c AS (SELECT c_custkey AS slice, track, (c_custkey * 17 + c_nationkey) % (n - 1) + 1 AS i, (c_custkey * 29 + c_nationkey) % (n - 1) + 1 AS j FROM customer JOIN n ON c_custkey % 100 = track),
        b AS (SELECT slice, 1 AS part, CASE WHEN i <= j THEN seq ELSE -seq END AS pos, lat, lon FROM c JOIN p USING (track) WHERE (i <= j AND seq > i AND seq <= j) OR (i > j AND seq <= i AND seq > j)
          UNION ALL SELECT slice, 0, 0, lat, lon FROM c JOIN p ON p.track = c.track AND p.seq = i UNION ALL SELECT slice, 2, 0, lat, lon FROM c JOIN p ON p.track = c.track AND p.seq = j),
        r AS (SELECT *, row_number() OVER w AS k, {haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM b WINDOW w AS (PARTITION BY slice ORDER BY part, pos))
        SELECT slice, count(*) AS points, {rounded_sql('sum(k * lat)', 4)} AS lat_sum, {rounded_sql('sum(k * lon)', 4)} AS lon_sum FROM r WHERE NOT (part = 2 AND step <= 0.05) GROUP BY slice""",
    "profile_build": f"""WITH RECURSIVE f AS MATERIALIZED ({WAY_SQL}), t(route, track, seq, along, ele, brk, k, emit, last) AS (SELECT route, track, seq, along, ele, brk, k, true, along FROM f WHERE k = 1 UNION ALL
        SELECT route, track, seq, along, ele, brk, k, e, CASE WHEN e THEN along ELSE last END FROM (SELECT f.route, f.track, f.seq, f.along, f.ele, f.brk, f.k, t.last,
          f.brk OR ((f.forced OR f.along - t.last >= 2000) AND f.along - t.last >= 0.01) AS e FROM t JOIN f ON f.route = t.route AND f.k = t.k + 1))
        SELECT route, track, seq, {rounded_sql('along', 1)} AS along_m, {rounded_sql('ele', 6)} AS ele, brk AS break_before FROM t WHERE emit""",
    "gap_features": f"SELECT route, track, {rounded_sql('step', 2)} AS gap_m FROM ({WAY_SQL}) WHERE before <> track AND step >= 0.05",
    "next_climb": f"""WITH f AS MATERIALIZED ({WAY_SQL}), u AS (SELECT *, coalesce(greatest(CAST(0 AS DOUBLE), ele - last_value(ele IGNORE NULLS) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + CASE WHEN ele IS NULL THEN NULL ELSE 0 END), CAST(0 AS DOUBLE)) AS raw,
          ele IS NOT NULL AND last_value(ele IGNORE NULLS) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AS known FROM f),
        c AS (SELECT *, sum(CASE WHEN known THEN raw ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY route ORDER BY track, seq ROWS UNBOUNDED PRECEDING) AS climb FROM u),
        s AS (SELECT route, k, track * 1000 + seq AS place, along, climb FROM c WHERE seq % 40 = 0)
        SELECT c.track, c.seq, s.place, {rounded_sql('s.along - c.along', 1)} AS distance_m, {rounded_sql('s.climb - c.climb', 5)} AS climb_m FROM c ASOF LEFT JOIN s ON c.route = s.route AND c.k <= s.k""",
    "nearest_on_route": f"""WITH s AS (SELECT track % 10 AS k, lat AS a, lon AS o, lead(lat) OVER w AS b, lead(lon) OVER w AS p FROM ({POINTS_SQL}) WINDOW w AS (PARTITION BY track ORDER BY seq)),
        q AS (SELECT s_suppkey AS query, s_suppkey % 12 AS k, CAST(40.01 AS DOUBLE) + CAST(s_suppkey % 13 AS DOUBLE) / 1000 AS lat, CAST(-3.01 AS DOUBLE) + CAST(s_suppkey % 17 AS DOUBLE) / 1000 AS lon FROM supplier),
        h AS (SELECT *, greatest(CAST(0.2 AS DOUBLE), abs(cos(radians((lat + a + b) / 3)))) AS w FROM q LEFT JOIN (SELECT * FROM s WHERE b IS NOT NULL) s USING (k)),
        g AS (SELECT *, radians(p - o) * w * 6371008.8 AS x, radians(b - a) * 6371008.8 AS y, radians(lon - o) * w * 6371008.8 AS px, radians(lat - a) * 6371008.8 AS py FROM h),
        t AS (SELECT *, CASE WHEN x * x + y * y > 1e-9 THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (px * x + py * y) / (x * x + y * y))) ELSE CAST(0 AS DOUBLE) END AS t FROM g)
        SELECT query, {rounded_sql(f"min({haversine_sql('lat', 'lon', 'a + (b - a) * t', 'o + (p - o) * t')})", 2)} AS distance_m FROM t GROUP BY query""",
    # Even samples of each track and of its copy, laid against each other in both directions.
    "geometry_families": f"""WITH p AS (SELECT track, seq, lat, lon FROM ({POINTS_SQL}) UNION ALL SELECT track + 1000000, seq, lat + [CAST(0 AS DOUBLE), 0.0001, 0.0008][track % 3 + 1], lon FROM ({POINTS_SQL})),
        a AS (SELECT *, coalesce(sum({haversine_sql('plat', 'plon', 'lat', 'lon')}) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING), CAST(0 AS DOUBLE)) AS along FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM p WINDOW w AS (PARTITION BY track ORDER BY seq))),
        l AS (SELECT track, max(along) AS total FROM a GROUP BY track), n AS (SELECT track, along, lat, lon, lead(along) OVER w AS na, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM a WINDOW w AS (PARTITION BY track ORDER BY along, seq)),
        g AS (SELECT * FROM n WHERE na > along), k AS (SELECT track, total, i, total / 100 * i AS at FROM l, (SELECT unnest(range(101)) AS i)),
        s AS (SELECT k.track, k.total, k.i, g.lat + (g.nlat - g.lat) * least(CAST(1 AS DOUBLE), (k.at - g.along) / (g.na - g.along)) AS lat, g.lon + (g.nlon - g.lon) * least(CAST(1 AS DOUBLE), (k.at - g.along) / (g.na - g.along)) AS lon FROM k ASOF JOIN g ON k.track = g.track AND k.at >= g.along),
        d AS (SELECT x.track, abs(any_value(x.total) - any_value(y.total)) / greatest(any_value(x.total), any_value(y.total)) AS diff, max(CASE WHEN x.i = y.i THEN {haversine_sql('x.lat', 'x.lon', 'y.lat', 'y.lon')} END) AS f, max(CASE WHEN x.i = 100 - y.i THEN {haversine_sql('x.lat', 'x.lon', 'y.lat', 'y.lon')} END) AS r
          FROM s x JOIN s y ON y.track = x.track + 1000000 AND (x.i = y.i OR x.i = 100 - y.i) GROUP BY x.track)
        SELECT track, track AS family FROM d UNION ALL SELECT track + 1000000, CASE WHEN least(f, r) <= 30 AND diff <= 0.02 THEN track ELSE track + 1000000 END FROM d""",
    "orient_variants": f"""WITH e AS (SELECT track, track % 40 AS f, track % 37 + 40 AS t, arg_min(lat, seq) AS alat, arg_min(lon, seq) AS alon, arg_max(lat, seq) AS blat, arg_max(lon, seq) AS blon FROM ({POINTS_SQL}) GROUP BY track),
        c AS (SELECT place % 90 AS name, lat, lon FROM ({PLACES_SQL}) WHERE "primary" AND place % 90 % 3 <> 0), x AS (SELECT track, 0 AS r, f AS name, alat AS plat, alon AS plon FROM e UNION ALL SELECT track, 0, t, blat, blon FROM e UNION ALL SELECT track, 1, f, blat, blon FROM e UNION ALL SELECT track, 1, t, alat, alon FROM e),
        n AS (SELECT track, r, x.name, min({haversine_sql('plat', 'plon', 'c.lat', 'c.lon')}) AS d FROM x LEFT JOIN c ON x.name = c.name GROUP BY track, r, x.name), w AS (SELECT track, r, coalesce(sum(d), CAST(0 AS DOUBLE)) AS s, count(d) AS ev FROM n GROUP BY track, r)
        SELECT track, r = 1 AS reversed, {rounded_sql('s', 1)} AS score_m, ev AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY s, -ev, r) AS k FROM w) WHERE k = 1""",
}
