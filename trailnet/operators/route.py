"""Along routes: orientation of tracks, measuring between two positions, the next place, trees of places, comparing geometries."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m
from .graph import bounded_paths, shared_dir, shortest_paths, stored, unsent

#: Fixed value: the largest separation of tracks of the same geometry.
SAME_M = 30.0

_END = "struct<track:bigint,alat:double,alon:double,blat:double,blon:double>"


def orient_spine(ends: DataFrame, route: str = "route") -> DataFrame:
    """(route, cost_m, reversals, flags): for each route the directions of its tracks that make the gaps from end to start least in sum.

    ends: route, track, alat, alon, blat, blon, in the order of track. A fold over the route's tracks carries the best cost for the last track forward
    and reversed; ties go to fewer reversals, then to forward. flags: which tracks are reversed. A route's tracks are gathered in one row.
    """
    own = ends.groupBy(route).agg(F.array_sort(F.collect_list(F.struct(F.col("track").cast("long").alias("track"), "alat", "alon", "blat", "blon"))).cast(f"array<{_END}>").alias("t"))
    zero = lambda n: F.struct(F.lit(0.0).alias("cost"), F.lit(n).alias("rev"), F.array(F.lit(bool(n))).alias("flags"))

    def step(state: Column, i: Column) -> Column:
        prev, cur = F.get(F.col("t"), i - 1), F.get(F.col("t"), i)

        def into(reverse: bool) -> Column:
            lat, lon = (cur["blat"], cur["blon"]) if reverse else (cur["alat"], cur["alon"])
            ways = []
            for name, side in (("f", "b"), ("r", "a")):
                s = state[name]
                gap = haversine_m(prev[f"{side}lat"], prev[f"{side}lon"], lat, lon)
                ways.append(F.struct((s["cost"] + gap).alias("cost"), (s["rev"] + int(reverse)).alias("rev"), F.concat(s["flags"], F.array(F.lit(reverse))).alias("flags")))
            return F.when((ways[1]["cost"] < ways[0]["cost"]) | ((ways[1]["cost"] == ways[0]["cost"]) & (ways[1]["rev"] < ways[0]["rev"])), ways[1]).otherwise(ways[0])

        return F.struct(into(False).alias("f"), into(True).alias("r"))

    start = F.struct(zero(0).alias("f"), zero(1).alias("r"))
    best = F.aggregate(F.when(F.size("t") > 1, F.sequence(F.lit(1), F.size("t") - 1)).otherwise(F.array().cast("array<int>")), start, step)
    out = own.withColumn("s", best)
    back = (F.col("s.r.cost") < F.col("s.f.cost")) | ((F.col("s.r.cost") == F.col("s.f.cost")) & (F.col("s.r.rev") < F.col("s.f.rev")))
    pick = F.when(back, F.col("s.r")).otherwise(F.col("s.f"))
    return out.select(route, pick["cost"].alias("cost_m"), pick["rev"].alias("reversals"), pick["flags"].alias("flags"))


def orient_greedy(ends: DataFrame, route: str = "route") -> DataFrame:
    """(route, flags): the first track is reversed if its start is nearer to the second track than its end; each other if its end is nearer to the way so far."""
    own = ends.groupBy(route).agg(F.array_sort(F.collect_list(F.struct(F.col("track").cast("long").alias("track"), "alat", "alon", "blat", "blon"))).cast(f"array<{_END}>").alias("t"))
    at = lambda i: F.get(F.col("t"), i)
    d = lambda p, x, q, y: haversine_m(p[f"{x}lat"], p[f"{x}lon"], q[f"{y}lat"], q[f"{y}lon"])
    one, two = at(F.lit(0)), at(F.lit(1))
    first = F.coalesce(F.least(d(one, "a", two, "a"), d(one, "a", two, "b")) < F.least(d(one, "b", two, "a"), d(one, "b", two, "b")), F.lit(False))

    def step(flags: Column, i: Column) -> Column:
        prev, cur, was = at(i - 1), at(i), F.element_at(flags, -1)
        gap = lambda side: F.when(was, d(prev, "a", cur, side)).otherwise(d(prev, "b", cur, side))
        return F.concat(flags, F.array(gap("b") < gap("a")))

    more = F.when(F.size("t") > 1, F.sequence(F.lit(1), F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
    return own.select(route, F.aggregate(more, F.array(first), step).alias("flags"))


def partial_m(along: Column, length: Column, side: Column) -> Column:
    """From a position on a track to its start (side 0) or end (side 1)."""
    held = F.greatest(F.lit(0.0), F.least(along, length))
    return F.when(side == 0, held).otherwise(length - held)


def same_route_m(queries: DataFrame, tracks: DataFrame, gaps: DataFrame) -> DataFrame:
    """queries(query, route, from_track, from_m, to_track, to_m) with distance_m along the route, the gaps between its tracks included, without other routes.

    tracks: route, track, base_m (chainage). gaps: route, track, gap_m to the next track.
    """
    w = Window.partitionBy("route").orderBy("track").rowsBetween(Window.unboundedPreceding, -1)
    at = tracks.join(gaps, ["route", "track"], "left").select("route", "track", "base_m", F.coalesce(F.sum("gap_m").over(w), F.lit(0.0)).alias("gaps_m"))
    side = lambda p: at.select("route", F.col("track").alias(f"{p}_track"), (F.col("base_m") + F.col("gaps_m")).alias(f"{p}_base"))
    out = queries.join(side("from"), ["route", "from_track"]).join(side("to"), ["route", "to_track"])
    return out.withColumn("distance_m", F.abs(F.col("to_base") + F.col("to_m") - F.col("from_base") - F.col("from_m"))).drop("from_base", "to_base")


def cross_route_m(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """queries with distance_m: the least of the four ways over the ends of the two tracks, a partial track, the shortest path between ends, a partial track.

    queries: query, from_track, from_m, from_len, to_track, to_m, to_len. edges: src, dst, weight between ends struct(track, side). Unreachable: null.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    q = queries.withColumn("_s", sides).withColumn("_e", F.explode(F.array(F.lit(0), F.lit(1))))
    q = q.withColumn("source", F.struct(F.col("from_track").alias("track"), F.col("_s").alias("side"))).withColumn("node", F.struct(F.col("to_track").alias("track"), F.col("_e").alias("side")))
    between = shortest_paths(edges, q.select("source").distinct(), targets=None)
    hit = q.join(between, ["source", "node"])
    total = partial_m(F.col("from_m"), F.col("from_len"), F.col("_s")) + F.col("distance_m") + partial_m(F.col("to_m"), F.col("to_len"), F.col("_e"))
    best = hit.groupBy("query").agg(F.min(total).alias("distance_m"))
    return queries.join(best, "query", "left")


def next_place(stops: DataFrame, positions: DataFrame) -> DataFrame:
    """positions(query, route, at_m) with the next of stops(route, place, at_m) at or after it, and the way there; null at the route's end."""
    both = stops.select("route", "at_m", F.col("place"), F.lit(None).cast(dict(positions.dtypes)["query"]).alias("query")).unionByName(positions.select("route", "at_m", F.lit(None).cast(dict(stops.dtypes)["place"]).alias("place"), "query"))
    # From the end backwards, so that the frame only grows.
    w = Window.partitionBy("route").orderBy(F.desc("at_m"), F.col("place").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nxt = F.last(F.when(F.col("place").isNotNull(), F.struct("place", F.col("at_m").alias("stop_m"))), ignorenulls=True).over(w)
    out = both.withColumn("n", nxt).where("query IS NOT NULL")
    return out.select("query", "route", "at_m", F.col("n.place").alias("place"), (F.col("n.stop_m") - F.col("at_m")).alias("distance_m"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with place, their rank in the whole order from 1.

    Ranges of the order are ranked by themselves, and each adds the counts of those before it; no task sorts all rows, and a hot value of
    the first key is divided by the others.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written: the limits of the ranges are from a sample, and must be the same for ranks and counts.
    dealt = stored(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = dealt.groupBy("_range").count()
    before = before.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = dealt.withColumn("place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(before), "_range").withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_before")


def resampled(points: DataFrame, samples: int = 101, only: int | None = None) -> DataFrame:
    """(track, k, lat, lon): samples points at even distances along each track of points(track, along_m, lat, lon); only: the one of that k."""
    w = Window.partitionBy("track").orderBy("along_m", "seq")
    seg = points.select("track", "along_m", "lat", "lon", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("along_m", "lat", "lon")], F.max("along_m").over(Window.partitionBy("track")).alias("total"))
    step = F.col("total") / F.lit(float(samples - 1))
    # The samples that lie within a segment; its own start belongs to it, the track's end to the last one.
    low = F.ceil(F.col("along_m") / step)
    high = F.when(F.col("n_along_m") >= F.col("total"), F.lit(samples - 1)).otherwise(F.ceil(F.col("n_along_m") / step) - 1)
    seg = seg.where("n_along_m > along_m")
    if only is None:
        seg = seg.withColumn("k", F.explode(F.when(high >= low, F.sequence(low, high.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    else:
        seg = seg.withColumn("k", F.lit(only).cast("long")).where((low <= only) & (high >= only))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") * step - F.col("along_m")) / (F.col("n_along_m") - F.col("along_m"))))
    return seg.select("track", "k", (F.col("lat") + (F.col("n_lat") - F.col("lat")) * t).alias("lat"), (F.col("lon") + (F.col("n_lon") - F.col("lon")) * t).alias("lon"))


def _apart(batches, samples: int):
    """For each pair of lines the largest distance of even samples, in either direction, and both lengths; pairs with a line of no length are left out."""
    share = np.linspace(0.0, 1.0, samples)
    for batch in batches:
        sides = []
        for side in "ab":
            lists = [batch.column(f"{side}_{c}") for c in ("at", "lat", "lon")]
            starts = lists[0].offsets.to_numpy()
            at, lat, lon = (x.values.to_numpy(zero_copy_only=False) for x in lists)
            length = np.array([at[hi - 1] for hi in starts[1:]]) if len(starts) > 1 else np.zeros(0)
            where = np.empty((2, len(length), samples))
            for i, (lo, hi) in enumerate(itertools.pairwise(starts)):
                want = share * length[i]
                where[0, i], where[1, i] = np.interp(want, at[lo:hi], lat[lo:hi]), np.interp(want, at[lo:hi], lon[lo:hi])
            sides.append((length, np.radians(where)))
        (la, (alat, alon)), (lb, (blat, blon)) = sides

        def far(lat, lon, alat=alat, alon=alon):
            up, across = np.sin((lat - alat) / 2), np.sin((lon - alon) / 2)
            h = up * up + np.cos(alat) * np.cos(lat) * across * across
            return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h))).max(axis=1, initial=0.0)

        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *map(pa.array, (far(blat, blon), far(blat[:, ::-1], blon[:, ::-1]), la, lb))], names=["a", "b", "fwd", "rev", "la", "lb"])
        yield out.filter(pa.array((la > 0) & (lb > 0)))


def compare_geometry(pairs: DataFrame, points: DataFrame, samples: int = 101, same=(SAME_M, 0.02), near=(100.0, 0.05)) -> DataFrame:
    """pairs(a, b) with separation_m, the largest distance of even samples in the better of the two directions, and class: IDENTICAL, SAME, NEAR, ALTERNATIVE.

    A track is one row with its points; samples are made where two lines meet, and are never rows. points: track, seq, along_m, lat, lon.
    """
    own = points.where("along_m IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("track").agg(F.array_sort(F.collect_list(F.struct("along_m", "seq", "lat", "lon"))).alias("p"))
    own = own.select("track", F.col("p.along_m").alias("at"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    side = lambda s: unsent(own.withColumnsRenamed({"track": s, "at": f"{s}_at", "lat": f"{s}_lat", "lon": f"{s}_lon"}))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    kind = dict(both.dtypes)
    far = both.mapInArrow(lambda batches: _apart(batches, samples), f"a {kind['a']}, b {kind['b']}, fwd double, rev double, la double, lb double")
    sep, diff = F.least("fwd", "rev"), F.abs(F.col("la") - F.col("lb")) / F.greatest("la", "lb")
    kind = F.when((sep == 0) & (diff == 0), "IDENTICAL").when((sep <= same[0]) & (diff <= same[1]), "SAME").when((sep <= near[0]) & (diff <= near[1]), "NEAR").otherwise("ALTERNATIVE")
    return far.select("a", "b", sep.alias("separation_m"), kind.alias("class"))


def semantic_bridges(gaps: DataFrame, edges: DataFrame, max_tracks: int = 8) -> DataFrame:
    """Chains of up to max_tracks tracks over directed edges that bridge gaps(start, goal, gap_m), no longer than 100 km or three times the gap."""
    return bounded_paths(edges, gaps, max_tracks)


def group_tree(edges: DataFrame, root: Column) -> DataFrame:
    """Rows of the tree below root over edges(src, dst, caption), in the order of sort_path: depth, place, caption, and cycle where a place is among its own ancestors (not followed).

    Shared places are shown under each parent. A level is a join with the edges; the last one is that where every branch has ended, as cycles do.
    """
    spark = edges.sparkSession
    folder, written = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", []
    level = spark.range(1).select(root.alias("place"), F.lit(None).cast("string").alias("caption"), F.array(root).alias("path"), F.array(F.concat(root.cast("string"))).alias("sort_path"), F.lit(False).alias("cycle"))
    while True:
        level = level.withColumn("depth", F.lit(len(written)))
        path = f"{folder}/{len(written)}"
        level.write.parquet(path)
        level = spark.read.schema(level.schema).parquet(path)
        if written and level.isEmpty():
            break
        written.append(path)
        open_ = level.where("NOT cycle").select("path", "sort_path", F.col("place").alias("src"))
        level = open_.join(edges, "src").select(
            F.col("dst").alias("place"), "caption", F.array_append("path", F.col("dst")).alias("path"),
            F.array_append("sort_path", F.concat_ws("/", F.lower(F.col("dst").cast("string")), "caption")).alias("sort_path"), F.array_contains("path", F.col("dst")).alias("cycle"),
        )
    return spark.read.schema(level.schema).parquet(*written).select("depth", "place", "caption", "cycle", "sort_path")


def root_candidates(places: DataFrame, wanted: str, aliases: dict[str, str]) -> DataFrame:
    """Rows of places(place_key, name_key) that wanted names, by the first rule that finds any: alias or key, name, containment."""
    key = F.lit(aliases.get(wanted, wanted))
    tier = F.when(F.col("place_key") == key, 0).when(F.col("name_key") == key, 1).when(F.contains("name_key", key) | F.contains(key, F.col("name_key")), 2)
    t = places.withColumn("tier", tier).where("tier IS NOT NULL")
    return t.join(F.broadcast(t.agg(F.min("tier").alias("tier"))), "tier").select("place_key", "name_key", "tier")


def resolve_root(places: DataFrame, wanted: str, aliases: dict[str, str], most_named: int = 12) -> DataFrame:
    """The one row of root_candidates. Fails when it is computed where there is none, or where there are several, of which it names the first most_named."""
    few = root_candidates(places, wanted, aliases).orderBy("place_key").limit(most_named + 1)
    all_ = few.agg(F.array_sort(F.collect_list(F.struct("place_key", "name_key", "tier"))).alias("c"))
    names = F.array_join(F.transform(F.slice("c", 1, most_named), lambda x: x["place_key"].cast("string")), ", ")
    more = F.when(F.size("c") > most_named, ", ...").otherwise("")
    error = F.when(F.size("c") == 0, F.lit(f"No place is named {wanted}")).otherwise(F.concat(F.lit(f"{wanted} is one of: "), names, more))
    one = F.when(F.size("c") == 1, F.col("c")[0]).otherwise(F.raise_error(error).cast("struct<place_key:string,name_key:string,tier:int>"))
    return all_.select(one.alias("r")).select("r.*")
