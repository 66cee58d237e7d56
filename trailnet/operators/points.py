"""Ordered points of tracks: lengths, distances along, ascent, slopes, bounds, thinning to a number of samples.

All are windows over (track, seq) or groupings by track: one shuffle by track serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m


def _along(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def segments(points: DataFrame, keys=("track",), order=("seq",)) -> DataFrame:
    """points with seg_m: the distance from the point before (0 for the first)."""
    w = _along(list(keys), list(order))
    d = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return points.withColumn("seg_m", F.coalesce(d, F.lit(0.0)))


def along(points: DataFrame, keys=("track",), order=("seq",)) -> DataFrame:
    """points with seg_m and along_m, the distance from the start."""
    w = _along(list(keys), list(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return segments(points, keys, order).withColumn("along_m", F.sum("seg_m").over(w))


def polyline_length(points: DataFrame, keys=("track",), order=("seq",)) -> DataFrame:
    return segments(points, keys, order).groupBy(*keys).agg(F.sum("seg_m").alias("length_m"), F.count("*").alias("points"))


def chainage(tracks: DataFrame, route: str = "route", order=("track",), length: str = "length_m") -> DataFrame:
    """tracks with base_m: the lengths of the route's tracks before, without the gaps between them."""
    w = Window.partitionBy(route).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return tracks.withColumn("base_m", F.coalesce(F.sum(length).over(w), F.lit(0).cast(dict(tracks.dtypes)[length])))


def fill_elevation(points: DataFrame, keys=("track",), order=("seq",)) -> DataFrame:
    """points with last_ele: the last known elevation before each point."""
    w = _along(list(keys), list(order)).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("last_ele", F.last("ele", ignorenulls=True).over(w))


def positive_ascent(points: DataFrame, keys=("track",), order=("seq",)) -> DataFrame:
    """Metres climbed, each elevation against the last known one."""
    up = F.greatest(F.lit(0.0), F.col("ele") - F.col("last_ele"))
    return fill_elevation(points, keys, order).groupBy(*keys).agg(F.coalesce(F.sum(up), F.lit(0.0)).alias("ascent_m"))


def slope_window(points: DataFrame, half_m: float = 50.0, keys=("track",), order=("seq",)) -> DataFrame:
    """points with slope: percent between the nearest vertices at least half_m before and after, or the ends of the stretch.

    A segment without length ends a stretch; a run of a metre or less has slope 0. Needs known elevations.
    """
    pts = along(points, keys, order)
    run = _along(list(keys), list(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = _along(list(keys), list(order))
    still = F.when((F.col("seg_m") <= 0) & (F.row_number().over(w) > 1), 1).otherwise(0)
    pts = pts.withColumn("_still", still).withColumn("_stretch", F.sum("_still").over(run))
    by = ", ".join([*keys, "_stretch"])
    frame = lambda what, bounds: F.expr(f"{what} OVER (PARTITION BY {by} ORDER BY along_m RANGE BETWEEN {bounds})")
    half = f"CAST({half_m} AS DOUBLE)"
    pair = "struct(along_m, ele)"
    before = F.coalesce(frame(f"max({pair})", f"UNBOUNDED PRECEDING AND {half} PRECEDING"), frame(f"min({pair})", "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"))
    # From the end backwards: a frame that grows is added to, one that shrinks would be read anew for each row.
    ahead = F.expr(f"min({pair}) OVER (PARTITION BY {by} ORDER BY -along_m RANGE BETWEEN UNBOUNDED PRECEDING AND {half} PRECEDING)")
    after = F.coalesce(ahead, frame(f"max({pair})", "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"))
    pts = pts.withColumn("_a", before).withColumn("_b", after)
    distance = F.col("_b.along_m") - F.col("_a.along_m")
    slope = F.when(distance > 1.0, (F.col("_b.ele") - F.col("_a.ele")) * 100.0 / distance).otherwise(F.lit(0.0))
    return pts.withColumn("slope", slope).drop("_still", "_stretch", "_a", "_b")


def bounds(points: DataFrame, keys=("track",)) -> DataFrame:
    """Bounding box of each track, its centre, and the radius around it that holds every point. The box is joined back by track."""
    box = points.groupBy(*keys).agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"), F.count("*").alias("points"))
    box = box.withColumn("center_lat", (F.col("min_lat") + F.col("max_lat")) / 2.0).withColumn("center_lon", (F.col("min_lon") + F.col("max_lon")) / 2.0)
    far = points.join(box, list(keys)).groupBy(*keys).agg(F.max(haversine_m("center_lat", "center_lon", "lat", "lon")).alias("radius_m"))
    return box.join(far, list(keys))


def reduce_samples(points: DataFrame, most: int, keys=("track",), order=("seq",), breaks: str | None = None) -> DataFrame:
    """Every so many points that at most about most stay; the first, the last and those at breaks always do."""
    w = _along(list(keys), list(order))
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(w) - 1
    df = points.withColumn("_i", i).withColumn("_n", n)
    keep = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("_i") % F.ceil(F.col("_n") / F.lit(float(most))) == 0)
    if breaks:
        keep = keep | F.col(breaks)
    return df.where(keep).drop("_i", "_n")


def monotone(df: DataFrame, value: Column, keys, order, name: str = "position") -> DataFrame:
    """name: the largest value, held between 0 and 1, up to each row."""
    w = _along(list(keys), list(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).over(w))


def fragments(samples: DataFrame, keys=("track",), order=("seq",)) -> DataFrame:
    """Stretches of a profile between breaks (break_before): first and last distance, least and greatest elevation; none without elevation."""
    w = _along(list(keys), list(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = samples.withColumn("fragment", F.sum(F.col("break_before").cast("int")).over(w))
    out = own.groupBy(*keys, "fragment").agg(
        F.min_by("along_m", F.struct(*order)).alias("first_m"), F.max_by("along_m", F.struct(*order)).alias("last_m"),
        F.min("ele").alias("min_ele"), F.max("ele").alias("max_ele"), F.count("*").alias("samples"),
    )
    return out.where("min_ele IS NOT NULL")


def slope_segments(samples: DataFrame, keys=("track",), order=("seq",)) -> DataFrame:
    """Neighbouring samples with elevations and no break between them, and their slope."""
    w = _along(list(keys), list(order))
    df = samples.withColumn("from_m", F.lag("along_m").over(w)).withColumn("from_ele", F.lag("ele").over(w))
    df = df.where("NOT break_before AND from_ele IS NOT NULL AND ele IS NOT NULL AND from_m IS NOT NULL")
    run = F.col("along_m") - F.col("from_m")
    return df.withColumn("slope", F.when(run > 1.0, (F.col("ele") - F.col("from_ele")) * 100.0 / run).otherwise(F.lit(0.0)))


def visible_elevation(samples: DataFrame, keys=("track",)) -> DataFrame:
    """samples with x, the elevation between the group's least (0) and greatest (1); an even profile spans a metre."""
    w = Window.partitionBy(*keys)
    df = samples.withColumn("_lo", F.min("ele").over(w)).withColumn("_hi", F.max("ele").over(w)).where("_lo IS NOT NULL AND ele IS NOT NULL")
    flat = F.col("_hi") - F.col("_lo") < 0.001
    lo, hi = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    return df.withColumn("x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ele") - lo) / (hi - lo)))).drop("_lo", "_hi")


def gap_report(ends: DataFrame, route: str = "route", order=("section",)) -> DataFrame:
    """For each two tracks in a row of a route: the gap from end to start, the least gap of any two ends, and skipped numbers.

    ends: route, section (number), start_lat, start_lon, end_lat, end_lon."""
    w = Window.partitionBy(route).orderBy(*order)
    nxt = {c: F.lead(c).over(w) for c in ("section", "start_lat", "start_lon", "end_lat", "end_lon")}
    df = ends.withColumns({f"next_{c}": x for c, x in nxt.items()}).where("next_section IS NOT NULL")
    d = lambda a, b: haversine_m(f"{a}_lat", f"{a}_lon", f"next_{b}_lat", f"next_{b}_lon")
    return df.select(
        route, "section", "next_section", d("end", "start").alias("gap_m"),
        F.least(d("end", "start"), d("end", "end"), d("start", "start"), d("start", "end")).alias("best_gap_m"), (F.col("next_section") - F.col("section") - 1).alias("skipped"),
    )
