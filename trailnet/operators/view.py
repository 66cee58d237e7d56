"""What a view of tracks asks: rows in sight, the nearest of some samples, the last positions, the course over a distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, initial_bearing


def in_view(bounds: DataFrame, lat: Column, lon: Column, radius_m: float) -> DataFrame:
    """Rows of bounds(center_lat, center_lon, radius_m) whose circle meets the circle around (lat, lon)."""
    return bounds.where(haversine_m(lat, lon, "center_lat", "center_lon") <= F.col("radius_m") + F.lit(float(radius_m)))


def nearest_sample(samples: DataFrame, value: str, wanted: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Of each group the row whose value is nearest to wanted; the first of equals."""
    best = F.min_by(F.struct(*[c for c in samples.columns if c not in keys]), F.struct(F.abs(F.col(value) - wanted), *order))
    return samples.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def pick_handle(handles: DataFrame, x: Column, y: Column, reach: float = 34.0) -> DataFrame:
    """Of handles(view, handle, priority, hx, hy) the nearest within reach of a touch, by view; ties by priority."""
    d = F.hypot(F.col("hx") - x, F.col("hy") - y)
    near = handles.withColumn("_d", d).where(F.col("_d") <= reach)
    return near.groupBy("view").agg(F.min_by("handle", F.struct("_d", "priority")).alias("handle"))


def gap_breaks(rows: DataFrame, row: str, keys: list[str], px: float = 2.0, most_px: float = 80.0) -> DataFrame:
    """rows with break_before: the first of a group, or more than most_px below the one before."""
    step = (F.col(row) - F.lag(row).over(Window.partitionBy(*keys).orderBy(row))) * px
    return rows.withColumn("break_before", step.isNull() | (step > most_px))


def rightmost_per_row(points: DataFrame, keys: list[str], px: float = 2.0) -> DataFrame:
    """Of points(x, y, seq) the one with the largest x in each strip of px; the first of equals."""
    strip = F.floor(F.col("y") / px).cast("long")
    return points.withColumn("strip", strip).groupBy(*keys, "strip").agg(F.min_by(F.struct("x", "y", "seq"), F.struct(-F.col("x"), "seq")).alias("_r")).select(*keys, "strip", "_r.*")


def last_positions(fixes: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return fixes.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def course_over(fixes: DataFrame, baseline_m: float = 10.0, n: int = 80, keys=("user_id",), order=("us",)) -> DataFrame:
    """(keys, course) from the last n positions of each group: the bearing from the latest one at least baseline_m back along the way to the newest; null if the way is shorter."""
    recent = last_positions(fixes, n, list(keys), list(order))
    w = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = recent.withColumn("_seg", F.coalesce(haversine_m("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w)), F.lit(0.0)))
    d = d.withColumn("_way", F.sum("_seg").over(back))
    newest = d.groupBy(*keys).agg(F.max_by(F.struct("lat", "lon"), F.struct(*order)).alias("_n"))
    old = d.where(F.col("_way") >= baseline_m).groupBy(*keys).agg(F.max_by(F.struct("lat", "lon"), F.struct(*order)).alias("_o"))
    return newest.join(old, list(keys), "left").select(*keys, F.when(F.col("_o").isNotNull(), initial_bearing(F.col("_o.lat"), F.col("_o.lon"), F.col("_n.lat"), F.col("_n.lon"))).alias("course"))


def topology_sweep(ends: DataFrame, thresholds=(50.0, 100.0, 250.0, 500.0, 1000.0)) -> DataFrame:
    """(threshold_m, route, components): tracks of a route as one component where ends are no farther apart than a threshold.

    ends: route, track, side, lat, lon. Near pairs are found once, at the largest threshold."""
    from .graph import components
    from .spatial import near_pairs

    e = ends.withColumn("id", F.struct("route", "track", "side"))
    pairs = near_pairs(e, "id", max(thresholds), ["route"])
    each = F.explode(F.array(*map(F.lit, thresholds)))
    node = lambda c: F.struct("threshold_m", F.col(f"{c}.route").alias("route"), F.col(f"{c}.track").alias("track"))
    links = pairs.withColumn("threshold_m", each).where("distance_m <= threshold_m").select(node("a").alias("src"), node("b").alias("dst"))
    nodes = ends.select("route", "track").distinct().withColumn("threshold_m", each).select(F.struct("threshold_m", "route", "track").alias("node"))
    labels = components(nodes, links)
    return labels.groupBy("node.threshold_m", "node.route").agg(F.countDistinct("component").alias("components"))
