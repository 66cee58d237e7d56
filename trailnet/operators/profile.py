"""Slices of tracks, thinning for display, elevation profiles along routes, and the climb to the next place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from . import folds
from .cells import near
from .graph import components, stored, unsent
from .route import SAME_M, compare_geometry, resampled

#: Metres under which a gap or an end counts as closed, and under which two samples are one.
CLOSED_M, REPEATED_M = 0.05, 0.01
#: Up to how many tracks between two places each is held against each, without cells.
FEW = 32


def render_points(points: DataFrame, spacing_m: float = 12.0, keys=("track",), order=("seq",)) -> DataFrame:
    """points as they are drawn: the ends, and between them those at least spacing_m from the last one kept; nothing of tracks with one point."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ends = points.withColumn("_first", F.lag("lat").over(w).isNull()).withColumn("_last", F.lead("lat").over(w).isNull())
    kept = folds.fold(ends, list(keys), list(order), folds.thin(spacing_m), "kept boolean")
    return kept.where("(kept OR _last) AND NOT (_first AND _last)").drop("_first", "_last", "kept")


def forward(from_track: Column, from_at: Column, to_track: Column, to_at: Column) -> Column:
    """Whether a way between two positions goes with the order of tracks; within one track, of positions."""
    return F.when(from_track != to_track, from_track < to_track).otherwise(from_at <= to_at)


def track_slices(points: DataFrame, slices: DataFrame) -> DataFrame:
    """(slice, k, lat, lon): the way along a track between two hits, from k = 1.

    points: track, seq, lat, lon; slices: slice, track, from_seg, from_t, from_lat, from_lon, to_seg, to_t, to_lat, to_lon, where segment s leads from point s to
    s + 1. The vertices between come in the order of travel, either way; the last hit is left out if it is no farther than CLOSED_M from the vertex before.
    """
    ahead = F.struct("from_seg", "from_t") <= F.struct("to_seg", "to_t")
    s = slices.withColumn("_ahead", ahead)
    inside = F.when(F.col("_ahead"), (F.col("seq") > F.col("from_seg")) & (F.col("seq") <= F.col("to_seg"))).otherwise((F.col("seq") <= F.col("from_seg")) & (F.col("seq") > F.col("to_seg")))
    between = s.join(points.select("track", "seq", "lat", "lon"), "track").where(inside)
    between = between.select("slice", F.lit(1).alias("_part"), F.when(F.col("_ahead"), F.col("seq")).otherwise(-F.col("seq")).cast("long").alias("_at"), "lat", "lon")
    end = lambda side, part: s.select("slice", F.lit(part).alias("_part"), F.lit(0).cast("long").alias("_at"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon"))
    w = Window.partitionBy("slice").orderBy("_part", "_at")
    both = end("from", 0).union(between).union(end("to", 2))
    both = both.withColumn("k", F.row_number().over(w)).withColumn("_step", haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"))
    return both.where(~((F.col("_part") == 2) & (F.col("_step") <= CLOSED_M))).select("slice", "k", "lat", "lon")


def route_way(points: DataFrame) -> DataFrame:
    """points(route, track, seq, lat, lon, ele) with along_m from the route's start, gaps between its tracks included, and break_before at the first point after a gap."""
    w = Window.partitionBy("route").orderBy("track", "seq")
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"), F.lit(0.0))
    df = points.withColumn("_step", step).withColumn("break_before", F.coalesce((F.lag("track").over(w) != F.col("track")) & (F.col("_step") >= CLOSED_M), F.lit(False)))
    return df.withColumn("along_m", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")


def gap_features(points: DataFrame) -> DataFrame:
    """(route, track, from_lat, from_lon, lat, lon, gap_m): the gaps of CLOSED_M and more before tracks; closed ones are no features."""
    w = Window.partitionBy("route").orderBy("track", "seq")
    df = points.select("route", "track", "lat", "lon", *[F.lag(c).over(w).alias(f"from_{c}") for c in ("track", "lat", "lon")]).where("from_track <> track")
    return df.withColumn("gap_m", haversine_m("from_lat", "from_lon", "lat", "lon")).where(F.col("gap_m") >= CLOSED_M).drop("from_track")


def emission(spacing_m: float):
    """emit: the first sample, those at breaks or forced, and those at least spacing_m from the last one emitted; none that repeats it, unless at a break."""

    def step(state, row):
        at = row["along_m"]
        if state is None or row["break_before"]:
            return (at,), {"emit": True}
        go = (bool(row.get("forced")) or at - state[0] >= spacing_m) and at - state[0] >= REPEATED_M
        return ((at,) if go else state), {"emit": go}

    return step


def profile(points: DataFrame, spacing_m: float) -> DataFrame:
    """(route, track, seq, along_m, ele, break_before): the samples of each route's elevation profile; distances run on over gaps, elevations are not made up there."""
    w = Window.partitionBy("route").orderBy("track", "seq")
    way = route_way(points)
    way = way.withColumn("forced", F.lead("track").over(w).isNull() | (F.lead("track").over(w) != F.col("track")))
    return folds.fold(way, ["route"], ["track", "seq"], emission(spacing_m), "emit boolean").where("emit").select("route", "track", "seq", "along_m", "ele", "break_before")


def climb_to_next(points: DataFrame, stops: DataFrame) -> DataFrame:
    """points(route, track, seq, ...) with place, distance_m and climb_m to the next of stops(route, track, seq, place) at or after each point; nulls at the route's end.

    Distances include gaps, climbs don't: an elevation is held against the last known one of its own track.
    """
    w = Window.partitionBy("route").orderBy("track", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("route", "track").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    up = F.coalesce(F.greatest(F.lit(0.0), F.col("ele") - F.last("ele", ignorenulls=True).over(own)), F.lit(0.0))
    # greatest() passes over a null: without a known elevation on either side nothing is climbed.
    up = F.when(F.col("ele").isNotNull() & F.last("ele", ignorenulls=True).over(own).isNotNull(), up).otherwise(F.lit(0.0))
    df = route_way(points).withColumn("_up", up).withColumn("_climb", F.sum("_up").over(w))
    df = df.join(stops, ["route", "track", "seq"], "left")
    back = Window.partitionBy("route").orderBy(F.desc("track"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_n", F.last(F.when(F.col("place").isNotNull(), F.struct("place", "along_m", "_climb")), ignorenulls=True).over(back))
    return df.select("route", "track", "seq", F.col("_n.place").alias("place"), (F.col("_n.along_m") - F.col("along_m")).alias("distance_m"), (F.col("_n._climb") - F.col("_climb")).alias("climb_m"))


def geometry_families(tracks: DataFrame, points: DataFrame, samples: int = 101) -> DataFrame:
    """(track, family): tracks(track, from_key, to_key) between the same places whose geometries are IDENTICAL or SAME, in chains; family is the least track.

    points: track, seq, along_m, lat, lon. Tracks are compared within a pair of places only, and there only those whose middles (of an odd number of samples, the same from
    either end) are as near as they must be.
    """
    t = tracks.where("from_key <> to_key").select("track", "from_key", "to_key")
    middle = stored(t.join(resampled(points, samples, (samples - 1) // 2).drop("k"), "track").withColumn("_n", F.count("*").over(Window.partitionBy("from_key", "to_key"))))
    one = lambda where: middle.where(where).drop("_n").withColumnRenamed("track", "a")
    other = lambda where: middle.where(where).drop("_n").withColumnsRenamed({"track": "b", "lat": "to_lat", "lon": "to_lon"})
    # The few tracks between most places meet at once, the many between some in cells.
    few = unsent(one(F.col("_n") <= FEW)).join(unsent(other(F.col("_n") <= FEW)), ["from_key", "to_key"]).where("a < b").where(haversine_m("lat", "lon", "to_lat", "to_lon") <= SAME_M)
    many = near(one(F.col("_n") > FEW), other(F.col("_n") > FEW), SAME_M, ["from_key", "to_key"]).where("a < b")
    pairs = few.select("a", "b").unionByName(many.select("a", "b"))
    alike = compare_geometry(pairs, points, samples).where("class IN ('IDENTICAL', 'SAME')")
    return components(t.select(F.col("track").alias("node")), alike.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("track"), F.col("component").alias("family"))


def orient_variants(ends: DataFrame, centres: DataFrame) -> DataFrame:
    """(track, reversed, score_m, evidence): the direction in which a track's ends lie nearer to known centres of its names.

    ends: track, from_name, to_name, alat, alon, blat, blon; centres: name, lat, lon. A direction's score sums the distances of its ends to the nearest centre of their
    names, over those that have one (evidence). The least score wins, then more evidence, then forward.
    """
    e = ends.withColumn("x", F.explode(F.array(*[
        F.struct(F.lit(r).alias("r"), F.col(name).alias("name"), F.col(f"{p}lat").alias("plat"), F.col(f"{p}lon").alias("plon"))
        for r, name, p in ((0, "from_name", "a"), (0, "to_name", "b"), (1, "from_name", "b"), (1, "to_name", "a"))
    ]))).select("track", "x.*")
    near = e.join(centres, "name", "left").groupBy("track", "r", "name", "plat", "plon").agg(F.min(haversine_m("plat", "plon", "lat", "lon")).alias("d"))
    ways = near.groupBy("track", "r").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("score_m"), F.count("d").alias("evidence"))
    best = ways.groupBy("track").agg(F.min(F.struct("score_m", (-F.col("evidence")).alias("less"), "r")).alias("m"))
    return best.select("track", (F.col("m.r") == 1).alias("reversed"), F.col("m.score_m").alias("score_m"), (-F.col("m.less")).alias("evidence"))
