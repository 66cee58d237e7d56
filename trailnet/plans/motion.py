"""Queries on points and positions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import points as P
from ..operators import trips as T
from .frames import FIXES_SQL, POINTS_SQL, TRACKS_SQL, fixes, haversine_sql, points, rounded, rounded_sql, table, tracks

RULES = {"min_move_m": 3.0, "max_jump_m": 5000.0, "max_gap_us": 12 * 3600 * 1_000_000}
SEG_SQL = f"""SELECT *, coalesce({haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, CAST(0 AS DOUBLE)) AS seg_m
    FROM ({POINTS_SQL}) WINDOW w AS (PARTITION BY track ORDER BY seq)"""
MOVES_SQL = f"""SELECT *, coalesce(gap_us > 0 AND gap_us <= {RULES['max_gap_us']} AND move_m >= 3 AND move_m <= 5000, false) AS counts FROM (
    SELECT *, us - lag(us) OVER w AS gap_us, {haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS move_m
    FROM ({FIXES_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY us))"""


def polyline_length(spark, sf_dir):
    return P.polyline_length(points(spark, sf_dir)).select("track", "points", rounded(F.col("length_m")).alias("length_m"))


def chainage(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("length_m", F.col("length_m").cast("decimal(18,2)"))
    return P.chainage(t).select("route", "track", F.col("base_m").cast("double").alias("base_m"))


def along_track(spark, sf_dir):
    return P.along(points(spark, sf_dir)).select("track", "seq", rounded(F.col("along_m"), 2).alias("along_m"))


def positive_ascent(spark, sf_dir):
    return P.positive_ascent(points(spark, sf_dir)).select("track", rounded(F.col("ascent_m")).alias("ascent_m"))


def slope_window(spark, sf_dir):
    known = points(spark, sf_dir).where("ele IS NOT NULL")
    whole = known.withColumn("lat", F.lit(40.0)).withColumn("lon", F.lit(-3.0) + F.col("seq").cast("double") / F.lit(4000.0))
    return P.slope_window(whole).select("track", "seq", rounded(F.col("slope"), 2).alias("slope"))


def trip_stats(spark, sf_dir):
    r = T.trip_stats(fixes(spark, sf_dir), **RULES)
    return r.select("user_id", "fixes", rounded(F.col("distance_m")).alias("distance_m"), "moving_us", "total_us", rounded(F.col("moving_kmh"), 6).alias("moving_kmh"), rounded(F.col("total_kmh"), 6).alias("total_kmh"))


def trip_sessions(spark, sf_dir):
    r = T.sessions(fixes(spark, sf_dir), **RULES)
    return r.select("user_id", "session", "start_us", "end_us", "fixes", rounded(F.col("distance_m")).alias("distance_m"))


def bbox(spark, sf_dir):
    r = P.bounds(points(spark, sf_dir))
    return r.select("track", "points", *[rounded(F.col(c), 6).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon", "center_lat", "center_lon")], rounded(F.col("radius_m")).alias("radius_m"))


def profile_reduce(spark, sf_dir):
    return P.reduce_samples(points(spark, sf_dir), 100).select("track", "seq", "ele")


def profile_fragments(spark, sf_dir):
    s = P.along(points(spark, sf_dir)).withColumn("break_before", (F.col("seq") % 50 == 0))
    return P.fragments(s).select("track", "fragment", rounded(F.col("first_m"), 2).alias("first_m"), rounded(F.col("last_m"), 2).alias("last_m"), "min_ele", "max_ele", "samples")


def slope_segments(spark, sf_dir):
    s = P.along(points(spark, sf_dir)).withColumn("break_before", (F.col("seq") % 50 == 0))
    strength = geo.slope_strength(F.col("slope"))
    return P.slope_segments(s).select("track", "seq", rounded(F.col("slope"), 3).alias("slope"), rounded(strength, 5).alias("strength"))


def visible_elevation(spark, sf_dir):
    return P.visible_elevation(points(spark, sf_dir)).select("track", "seq", rounded(F.col("x"), 6).alias("x"))


def monotone_stops(spark, sf_dir):
    p = points(spark, sf_dir).where("ele IS NOT NULL")
    return P.monotone(p, F.col("ele") / F.lit(800.0), ["track"], ["seq"]).select("track", "seq", rounded(F.col("position"), 6).alias("position"))


def gap_report(spark, sf_dir):
    p = points(spark, sf_dir)
    ends = p.groupBy("track").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("s"), F.max_by(F.struct("lat", "lon"), "seq").alias("e"))
    ends = ends.select((F.col("track") % 10).alias("route"), F.col("track").alias("section"), F.col("s.lat").alias("start_lat"), F.col("s.lon").alias("start_lon"), F.col("e.lat").alias("end_lat"), F.col("e.lon").alias("end_lon"))
    return P.gap_report(ends).select("route", "section", "next_section", rounded(F.col("gap_m")).alias("gap_m"), rounded(F.col("best_gap_m")).alias("best_gap_m"), "skipped")


def tile_xy(spark, sf_dir):
    f = fixes(spark, sf_dir)
    t = f.withColumn("t", geo.tile_xy("lat", "lon", F.lit(12.0)))
    return t.groupBy(F.col("t.x").alias("x"), F.col("t.y").alias("y"), geo.tms_row(F.col("t.y"), F.lit(12.0)).alias("tms_y")).agg(F.count("*").alias("fixes"))


def bearings(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("us")
    f = fixes(spark, sf_dir).withColumn("to_lat", F.lead("lat").over(w)).withColumn("to_lon", F.lead("lon").over(w)).where("to_lat IS NOT NULL")
    b = geo.initial_bearing("lat", "lon", "to_lat", "to_lon")
    there = f.withColumn("b", b).withColumn("d", geo.destination("lat", "lon", "b", F.lit(1000.0)))
    return there.select("user_id", "us", rounded(F.col("b"), 6).alias("bearing"), rounded(F.col("d.lat"), 8).alias("lat"), rounded(F.col("d.lon"), 8).alias("lon"), rounded(geo.shortest_angle(F.lit(90.0), F.col("b")), 6).alias("turn"))


def hysteresis(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.hysteresis(e, "value", 50.0, 80.0, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "active")


def asof_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # The first type in the alphabet sets a state, the others ask for it.
    first = e.agg(F.min("event_type").alias("t"))
    e = e.join(F.broadcast(first))
    left = e.where("event_type <> t").select("user_id", "event_id", "ts")
    right = e.where("event_type = t").select("user_id", "ts", F.col("value").alias("state"))
    return T.as_of(left, right, ["user_id"], "ts", ["state"]).select("user_id", "event_id", "state")


QUERIES = {f.__name__: f for f in (
    polyline_length, chainage, along_track, positive_ascent, slope_window, trip_stats, trip_sessions, bbox, profile_reduce, profile_fragments, slope_segments,
    visible_elevation, monotone_stops, gap_report, tile_xy, bearings, hysteresis, asof_state)}

R = rounded_sql
ORACLE_SQL = {
    "polyline_length": f"SELECT track, count(*) AS points, {R('sum(seg_m)')} AS length_m FROM ({SEG_SQL}) GROUP BY track",
    "chainage": f"""SELECT route, track, CAST(coalesce(sum(CAST(length_m AS DECIMAL(18, 2))) OVER (PARTITION BY route ORDER BY track
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS base_m FROM ({TRACKS_SQL})""",
    "along_track": f"SELECT track, seq, {R('sum(seg_m) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING)', 2)} AS along_m FROM ({SEG_SQL})",
    "positive_ascent": f"""SELECT track, {R('coalesce(sum(greatest(CAST(0 AS DOUBLE), ele - last_ele)) FILTER (ele IS NOT NULL AND last_ele IS NOT NULL), CAST(0 AS DOUBLE))')} AS ascent_m FROM (
        SELECT track, ele, last_value(ele IGNORE NULLS) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ele FROM ({POINTS_SQL})) GROUP BY track""",
    "slope_window": f"""WITH p AS (SELECT track, seq, ele, CAST(40 AS DOUBLE) AS lat, CAST(-3 AS DOUBLE) + CAST(seq AS DOUBLE) / CAST(4000 AS DOUBLE) AS lon FROM ({POINTS_SQL}) WHERE ele IS NOT NULL),
        s AS (SELECT *, coalesce({haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, CAST(0 AS DOUBLE)) AS seg_m FROM p WINDOW w AS (PARTITION BY track ORDER BY seq)),
        c AS (SELECT *, sum(seg_m) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM s),
        q AS (SELECT x.track, x.seq,
            coalesce((SELECT max((y.m, y.ele)) FROM c y WHERE y.track = x.track AND y.m <= x.m - 50), (SELECT min((y.m, y.ele)) FROM c y WHERE y.track = x.track)) AS a,
            coalesce((SELECT min((y.m, y.ele)) FROM c y WHERE y.track = x.track AND y.m >= x.m + 50), (SELECT max((y.m, y.ele)) FROM c y WHERE y.track = x.track)) AS b FROM c x)
        SELECT track, seq, {R('CASE WHEN b[1] - a[1] > 1 THEN (b[2] - a[2]) * 100 / (b[1] - a[1]) ELSE CAST(0 AS DOUBLE) END', 2)} AS slope FROM q""",
    "trip_stats": f"""SELECT user_id, fixes, {R('distance_m')} AS distance_m, moving_us, total_us,
        {R('CASE WHEN moving_us > 0 THEN distance_m / (CAST(moving_us AS DOUBLE) / 1e6) * CAST(3.6 AS DOUBLE) END', 6)} AS moving_kmh,
        {R('CASE WHEN total_us > 0 THEN distance_m / (CAST(total_us AS DOUBLE) / 1e6) * CAST(3.6 AS DOUBLE) END', 6)} AS total_kmh FROM (
        SELECT user_id, count(*) AS fixes, coalesce(sum(move_m) FILTER (counts), CAST(0 AS DOUBLE)) AS distance_m, CAST(coalesce(sum(gap_us) FILTER (counts), 0) AS BIGINT) AS moving_us, max(us) - min(us) AS total_us
        FROM ({MOVES_SQL}) GROUP BY user_id)""",
    "trip_sessions": f"""SELECT user_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS fixes, {R('coalesce(sum(move_m) FILTER (counts), CAST(0 AS DOUBLE))')} AS distance_m FROM (
        SELECT *, CAST(sum(CASE WHEN gap_us <= {RULES['max_gap_us']} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM ({MOVES_SQL})) GROUP BY user_id, session""",
    "bbox": f"""WITH p AS ({POINTS_SQL}), b AS (SELECT track, count(*) AS points, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon,
        (min(lat) + max(lat)) / 2 AS center_lat, (min(lon) + max(lon)) / 2 AS center_lon FROM p GROUP BY track)
        SELECT track, points, {', '.join(f"{R(c, 6)} AS {c}" for c in ('min_lat', 'min_lon', 'max_lat', 'max_lon', 'center_lat', 'center_lon'))},
        (SELECT {R(f"max({haversine_sql('center_lat', 'center_lon', 'lat', 'lon')})")} FROM p WHERE p.track = b.track) AS radius_m FROM b""",
    "profile_reduce": f"""SELECT track, seq, ele FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM ({POINTS_SQL}))
        WHERE i = 0 OR i = n - 1 OR i % CAST(ceil(n / CAST(100 AS DOUBLE)) AS BIGINT) = 0""",
    "profile_fragments": f"""SELECT track, fragment, {R('arg_min(m, seq)', 2)} AS first_m, {R('arg_max(m, seq)', 2)} AS last_m, min(ele) AS min_ele, max(ele) AS max_ele, count(*) AS samples FROM (
        SELECT track, seq, ele, sum(seg_m) OVER w AS m, CAST(sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS fragment FROM ({SEG_SQL}) WINDOW w AS (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING))
        GROUP BY track, fragment HAVING min(ele) IS NOT NULL""",
    "slope_segments": f"""SELECT track, seq, {R('slope')} AS slope, {R('sign(slope) * greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (abs(slope) - 1) / 11))', 5)} AS strength FROM (
        SELECT track, seq, CASE WHEN m - fm > 1 THEN (ele - fe) * 100 / (m - fm) ELSE CAST(0 AS DOUBLE) END AS slope FROM (
        SELECT track, seq, ele, m, lag(m) OVER w AS fm, lag(ele) OVER w AS fe FROM (SELECT *, sum(seg_m) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM ({SEG_SQL})) WINDOW w AS (PARTITION BY track ORDER BY seq))
        WHERE seq % 50 <> 0 AND fe IS NOT NULL AND ele IS NOT NULL AND fm IS NOT NULL)""",
    "visible_elevation": f"""SELECT track, seq, {R('greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (ele - lo) / (hi - lo)))', 6)} AS x FROM (
        SELECT track, seq, ele, CASE WHEN b - a < 0.001 THEN a - 0.5 ELSE a END AS lo, CASE WHEN b - a < 0.001 THEN b + 0.5 ELSE b END AS hi FROM (
        SELECT *, min(ele) OVER (PARTITION BY track) AS a, max(ele) OVER (PARTITION BY track) AS b FROM ({POINTS_SQL})) WHERE ele IS NOT NULL)""",
    "monotone_stops": f"""SELECT track, seq, {R('max(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ele / CAST(800 AS DOUBLE)))) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING)', 6)} AS position
        FROM ({POINTS_SQL}) WHERE ele IS NOT NULL""",
    "gap_report": f"""WITH e AS (SELECT track % 10 AS route, track AS section, arg_min(lat, seq) AS slat, arg_min(lon, seq) AS slon, arg_max(lat, seq) AS elat, arg_max(lon, seq) AS elon FROM ({POINTS_SQL}) GROUP BY track),
        n AS (SELECT *, lead(section) OVER w AS ns, lead(slat) OVER w AS nslat, lead(slon) OVER w AS nslon, lead(elat) OVER w AS nelat, lead(elon) OVER w AS nelon FROM e WINDOW w AS (PARTITION BY route ORDER BY section))
        SELECT route, section, ns AS next_section, {R(haversine_sql('elat', 'elon', 'nslat', 'nslon'))} AS gap_m,
        {R('least(' + ', '.join(haversine_sql(f'{a}lat', f'{a}lon', f'n{b}lat', f'n{b}lon') for a in 'es' for b in 'es') + ')')} AS best_gap_m, ns - section - 1 AS skipped FROM n WHERE ns IS NOT NULL""",
    "tile_xy": f"""SELECT x, y, 4095 - y AS tms_y, count(*) AS fixes FROM (SELECT CAST(greatest(0, least(4095, floor((lon + 180) / 360 * 4096))) AS BIGINT) AS x,
        CAST(greatest(0, least(4095, floor((1 - asinh(tan(radians(lat))) / CAST(3.141592653589793 AS DOUBLE)) / 2 * 4096))) AS BIGINT) AS y FROM ({FIXES_SQL})) GROUP BY x, y""",
    "bearings": f"""WITH f AS (SELECT user_id, us, radians(lat) AS a, radians(lon) AS o, radians(lead(lat) OVER w) AS b, radians(lead(lon) OVER w) AS p FROM ({FIXES_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY us)),
        g AS (SELECT *, (degrees(atan2(sin(p - o) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(p - o))) + 360) % 360 AS bearing FROM f WHERE b IS NOT NULL),
        h AS (SELECT *, asin(sin(a) * cos(1000 / {geo.EARTH_RADIUS_M}::DOUBLE) + cos(a) * sin(1000 / {geo.EARTH_RADIUS_M}::DOUBLE) * cos(radians(bearing))) AS ta, (bearing - 90 + 360) % 360 AS turn FROM g)
        SELECT user_id, us, {R('bearing', 6)} AS bearing, {R('degrees(ta)', 8)} AS lat,
        {R(f'degrees(o + atan2(sin(radians(bearing)) * sin(1000 / {geo.EARTH_RADIUS_M}::DOUBLE) * cos(a), cos(1000 / {geo.EARTH_RADIUS_M}::DOUBLE) - sin(a) * sin(ta)))', 8)} AS lon,
        {R('CASE WHEN turn > 180 THEN turn - 360 ELSE turn END', 6)} AS turn FROM h""",
    "hysteresis": """SELECT user_id, event_id, coalesce(last_value(CASE WHEN value <= 50 THEN true WHEN value > 80 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM events""",
    "asof_state": """WITH t AS (SELECT min(event_type) AS t FROM events), l AS (SELECT user_id, event_id, ts FROM events, t WHERE event_type <> t), r AS (SELECT user_id, ts, max(value) AS state FROM events, t WHERE event_type = t GROUP BY user_id, ts)
        SELECT l.user_id, l.event_id, r.state FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
}
