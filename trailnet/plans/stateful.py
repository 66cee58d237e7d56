"""Queries that fold rules over ordered rows, and their SQL where recursion can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import folds as D
from ..operators import points as P
from .frames import FIXES_SQL, accel, fixes, haversine_sql, points, rounded, rounded_sql, table

SPACING_M = 3000.0
ACCEL_SQL = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 700 AS ms, value / CAST(100 AS DOUBLE) AS m FROM events"


def thin_points(spark, sf_dir):
    return D.fold(fixes(spark, sf_dir), ["user_id"], ["us"], D.thin(SPACING_M), "kept boolean").select("user_id", "us", "kept")


def ewma_motion(spark, sf_dir):
    return D.fold(accel(spark, sf_dir), ["user_id"], ["ms"], D.ewma, "mean_sq double").select("user_id", "ms", rounded(F.col("mean_sq"), 6).alias("mean_sq"))


def motion_fsm(spark, sf_dir):
    a = accel(spark, sf_dir).withColumn("magnitude_sq", F.col("magnitude_sq") * 4)
    return D.fold(a, ["user_id"], ["ms"], D.motion, "motion string").select("user_id", "ms", "motion")


def profile_samples(spark, sf_dir):
    s = P.along(points(spark, sf_dir)).withColumn("break_before", F.col("seq") % 50 == 0)
    return D.fold(s, ["track"], ["seq"], D.profile_samples(2000.0), "emit boolean").where("emit").select("track", "seq")


def smoothed_bearing(spark, sf_dir):
    a = accel(spark, sf_dir).select("user_id", "ms", (F.floor(F.col("ms") / 700) * 37).alias("at_ms"), (F.abs("magnitude_sq") * 97.0 % 360).alias("target"))
    steps = D.fold(a.withColumnsRenamed({"ms": "turn_ms", "at_ms": "ms"}), ["user_id"], ["ms"], D.smooth_bearing(), "bearing double")
    return steps.select("user_id", F.col("turn_ms").alias("ms"), rounded(F.col("bearing"), 6).alias("bearing"))


def heading_curves(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n, k = F.col("c_custkey"), F.col("c_custkey").cast("double")
    lat, lon, t = k / 1000, k / 500, (n % 101).cast("double") / 100
    way = (lat, lon, (n % 4 + 1).cast("double") / 100, (n % 3).cast("double") / 50, k * 7.25 % 360, k * 13.5 % 360)
    at = G.hermite_from(*way, t)
    return c.select("c_custkey", rounded(at["lat"], 6).alias("lat"), rounded(at["lon"], 6).alias("lon"), rounded(G.hermite_bearing_from(*way, t), 3).alias("bearing"))


QUERIES = {f.__name__: f for f in (thin_points, ewma_motion, motion_fsm, profile_samples, smoothed_bearing, heading_curves)}
_TURN = "((f.target - t.b + 540) % CAST(360 AS DOUBLE) - 180)"
_SIZE = "0.55 * sqrt(up * up + across * across)"


def _axis(direct: str, part: str, m0: str, whole: str, m1: str) -> str:
    return f"(({m0}) * {part}(radians(a)) * {_SIZE} + ({whole}) * {direct} + ({m1}) * {part}(radians(b)) * {_SIZE})"


_AT = "t * t * t - 2 * t * t + t", "3 * t * t - 2 * t * t * t", "t * t * t - t * t"
_PACE = "3 * t * t - 4 * t + 1", "6 * t - 6 * t * t", "3 * t * t - 2 * t"
ORACLE_SQL = {
    "smoothed_bearing": f"""WITH RECURSIVE f AS (SELECT user_id, k, ms, (abs(m) * 97) % CAST(360 AS DOUBLE) AS target FROM ({ACCEL_SQL})), t(user_id, k, ms, b) AS (SELECT user_id, k, ms, target FROM f WHERE k = 1 UNION ALL
          SELECT f.user_id, f.k, f.ms, CASE WHEN abs({_TURN}) <= 1.25 THEN t.b ELSE (t.b + {_TURN} * (1 - exp(CAST(-37 AS DOUBLE) / 2200)) + 360) % CAST(360 AS DOUBLE) END FROM t JOIN f ON f.user_id = t.user_id AND f.k = t.k + 1)
        SELECT user_id, ms, {rounded_sql('b', 6)} AS bearing FROM t""",
    "heading_curves": f"""WITH c AS (SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS k, CAST(c_custkey % 101 AS DOUBLE) / 100 AS t, CAST(c_custkey % 4 + 1 AS DOUBLE) / 100 AS up, CAST(c_custkey % 3 AS DOUBLE) / 50 AS wide FROM customer),
        e AS (SELECT c_custkey, t, k / 1000 AS lat, k / 500 AS lon, up, greatest(CAST(0.2 AS DOUBLE), cos(radians((k / 1000 + k / 1000 + up) / 2))) AS scale, wide, (k * CAST(7.25 AS DOUBLE)) % CAST(360 AS DOUBLE) AS a, (k * CAST(13.5 AS DOUBLE)) % CAST(360 AS DOUBLE) AS b FROM c),
        s AS (SELECT *, wide * scale AS across FROM e),
        h AS (SELECT *, degrees(atan2({_axis('across', 'sin', *_PACE)}, {_axis('up', 'cos', *_PACE)})) AS way FROM s)
        SELECT c_custkey, {rounded_sql(f"lat + {_axis('up', 'cos', *_AT)}", 6)} AS lat, {rounded_sql(f"lon + {_axis('across', 'sin', *_AT)} / scale", 6)} AS lon, {rounded_sql('CASE WHEN way < 0 THEN way + 360 ELSE way END')} AS bearing FROM h""",
    "thin_points": f"""WITH RECURSIVE f AS (SELECT user_id, us, lat, lon, row_number() OVER (PARTITION BY user_id ORDER BY us) AS k FROM ({FIXES_SQL})),
        t(user_id, k, us, kept, a, o) AS (SELECT user_id, k, us, true, lat, lon FROM f WHERE k = 1 UNION ALL
          SELECT f.user_id, f.k, f.us, {haversine_sql('t.a', 't.o', 'f.lat', 'f.lon')} >= {SPACING_M}, CASE WHEN {haversine_sql('t.a', 't.o', 'f.lat', 'f.lon')} >= {SPACING_M} THEN f.lat ELSE t.a END,
          CASE WHEN {haversine_sql('t.a', 't.o', 'f.lat', 'f.lon')} >= {SPACING_M} THEN f.lon ELSE t.o END FROM t JOIN f ON f.user_id = t.user_id AND f.k = t.k + 1)
        SELECT user_id, us, kept FROM t""",
    "ewma_motion": f"""WITH RECURSIVE f AS ({ACCEL_SQL}), t(user_id, k, ms, r) AS (SELECT user_id, k, ms, m FROM f WHERE k = 1 UNION ALL
        SELECT f.user_id, f.k, f.ms, CASE WHEN t.r = 0 THEN f.m ELSE CAST(0.96 AS DOUBLE) * t.r + CAST({1 - 0.96!r} AS DOUBLE) * f.m END FROM t JOIN f ON f.user_id = t.user_id AND f.k = t.k + 1)
        SELECT user_id, ms, {rounded_sql('r', 6)} AS mean_sq FROM t""",
    "motion_fsm": f"""WITH RECURSIVE f AS (SELECT user_id, k, ms, m * 4 AS m FROM ({ACCEL_SQL})), z AS (SELECT user_id, k, ms, m FROM f),
        t(user_id, k, ms, r, still, go, now) AS (SELECT user_id, k, ms, m, CASE WHEN sqrt(m) < 1.5 THEN ms END, CASE WHEN sqrt(m) > 1.8 THEN ms END, 'UNKNOWN' FROM z WHERE k = 1 UNION ALL
          SELECT user_id, k, ms, r, CASE WHEN sqrt(r) < 1.5 THEN coalesce(still, ms) END, CASE WHEN sqrt(r) > 1.8 THEN coalesce(go, ms) END,
            CASE WHEN sqrt(r) < 1.5 AND ms - coalesce(still, ms) >= 1500 THEN 'STATIONARY' WHEN sqrt(r) > 1.8 AND ms - coalesce(go, ms) >= 1500 THEN 'MOVING' ELSE now END
          FROM (SELECT z.user_id, z.k, z.ms, CASE WHEN t.r = 0 THEN z.m ELSE CAST(0.96 AS DOUBLE) * t.r + CAST({1 - 0.96!r} AS DOUBLE) * z.m END AS r, t.still, t.go, t.now FROM t JOIN z ON z.user_id = t.user_id AND z.k = t.k + 1))
        SELECT user_id, ms, now AS motion FROM t""",
}
