"""The network of places: edge families from tracks, degrees, topology, synchronisation, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, cyclic
from .route import placed

#: The classes of a route's topology.
CLASSES = ("EMPTY", "LINEAR", "NETWORK", "DISCONNECTED", "OTHER")


def edge_families(tracks: DataFrame, family: Column) -> DataFrame:
    """One row per (from_key, to_key) and family of tracks between them; tracks that start and end at one place make no edge.

    representative: the track with the most points (points, if there), then the least length, then the least track. family_index counts a pair's
    families by their least order (order, if there, else track); kind is SINGLE (one track), SHARED (one family of several) or ALTERNATIVE (several families).
    """
    own = tracks.where("from_key <> to_key").withColumn("_family", family)
    n = -F.col("points") if "points" in tracks.columns else F.lit(0)
    out = own.groupBy("from_key", "to_key", "_family").agg(
        F.count("*").alias("tracks"), F.min("length_m").alias("length_min_m"), F.max("length_m").alias("length_max_m"),
        F.min_by("track", F.struct(n, "length_m", "track")).alias("representative"), F.array_sort(F.collect_set("route")).alias("routes"), F.min("order" if "order" in tracks.columns else "track").alias("_first"),
    )
    pair = Window.partitionBy("from_key", "to_key")
    out = out.withColumn("family_index", F.row_number().over(pair.orderBy("_first"))).withColumn("families", F.count("*").over(pair))
    kind = F.when(F.col("families") > 1, "ALTERNATIVE").when(F.col("tracks") > 1, "SHARED").otherwise("SINGLE")
    edge = F.concat_ws("", F.col("from_key").cast("string"), F.lit(">"), F.col("to_key").cast("string"), F.lit("#"), F.col("family_index").cast("string"))
    return out.withColumn("kind", kind).withColumn("edge_id", edge).drop("_family", "_first")


def logical_edges(tracks: DataFrame) -> DataFrame:
    """One row per (from_key, to_key): tracks, least and greatest length, and whether a variant is among them."""
    return tracks.groupBy("from_key", "to_key").agg(F.count("*").alias("tracks"), F.min("length_m").alias("length_min_m"), F.max("length_m").alias("length_max_m"), F.bool_or(~F.col("primary")).alias("contains_variant"))


def degrees(edges: DataFrame) -> DataFrame:
    """(place, incoming, outgoing, is_merge, is_branch) by distinct neighbours of edges(from_key, to_key)."""
    pairs = edges.select("from_key", "to_key").where("from_key <> to_key").distinct()
    ends = pairs.select(F.col("from_key").alias("place"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(pairs.select("to_key", F.lit(1), F.lit(0)))
    out = ends.groupBy("place").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    return out.withColumn("is_merge", F.col("incoming") > 1).withColumn("is_branch", F.col("outgoing") > 1)


def ranked_components(edges: DataFrame) -> DataFrame:
    """(place, component_id, places): weak components, numbered from 1 by size, largest first, ties by their least place."""
    pairs = edges.where("from_key <> to_key").select(F.col("from_key").alias("src"), F.col("to_key").alias("dst")).distinct()
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    labels = components(nodes, pairs)
    sizes = labels.groupBy("component").agg(F.count("*").alias("places"))
    ranks = placed(sizes, [F.desc("places"), F.col("component").asc()]).withColumnRenamed("place", "component_id")
    return labels.join(ranks, "component").select(F.col("node").alias("place"), "component_id", "places")


def topology(tracks: DataFrame) -> DataFrame:
    """One row per route: components, sources, sinks, branches, merges, parallel pairs, cyclic places, class. Neighbours count once.

    LINEAR: one chain from one source to one sink. NETWORK: connected, with a branch, a merge or a cycle. DISCONNECTED: several components.
    EMPTY: no edge. OTHER: the rest.
    """
    edges = tracks.where("from_key <> to_key").select("route", F.struct("route", F.col("from_key").alias("k")).alias("src"), F.struct("route", F.col("to_key").alias("k")).alias("dst"))
    pairs = edges.groupBy("route", "src", "dst").agg(F.count("*").alias("n"))
    ends = pairs.select("route", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(pairs.select("route", "dst", F.lit(1), F.lit(0)))
    nodes = ends.groupBy("route", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    labels = components(nodes.select("node"), pairs.select("src", "dst"))
    loops = cyclic(pairs.select("src", "dst")).select("node", F.lit(1).alias("loop"))
    full = nodes.join(labels, "node").join(loops, "node", "left")
    per = full.groupBy("route").agg(
        F.countDistinct("component").alias("components"), F.count_if(F.col("i") == 0).alias("sources"), F.count_if(F.col("o") == 0).alias("sinks"),
        F.count_if(F.col("o") > 1).alias("branches"), F.count_if(F.col("i") > 1).alias("merges"), F.count("loop").alias("cyclic_places"), F.count("*").alias("places"),
    )
    par = pairs.groupBy("route").agg(F.count_if(F.col("n") > 1).alias("parallel_pairs"), F.count("*").alias("pairs"))
    out = tracks.select("route").distinct().join(per.join(par, "route"), "route", "left").na.fill(0)
    kind = (
        F.when(F.col("pairs") == 0, "EMPTY").when(F.col("components") > 1, "DISCONNECTED")
        .when((F.col("branches") > 0) | (F.col("merges") > 0) | (F.col("cyclic_places") > 0), "NETWORK").when((F.col("sources") == 1) & (F.col("sinks") == 1), "LINEAR").otherwise("OTHER")
    )
    return out.withColumn("topology", kind)


def class_histogram(topologies: DataFrame) -> DataFrame:
    """Routes per class, with a zero for classes that have none."""
    classes = topologies.sparkSession.createDataFrame([(c,) for c in CLASSES], "topology string")
    found = topologies.groupBy("topology").agg(F.count("*").alias("n"))
    return classes.join(found, "topology", "left").select("topology", F.coalesce("n", F.lit(0)).alias("routes"))


def network_stats(tracks: DataFrame, families: DataFrame) -> DataFrame:
    """One row of counters: tracks, those that collapse to a place, edges, shared and alternative ones, pairs with alternatives."""
    t = tracks.agg(F.count("*").alias("tracks"), F.count_if(F.col("from_key") == F.col("to_key")).alias("collapsed"))
    pairs = families.groupBy("from_key", "to_key").agg(F.count("*").alias("n"), F.sum("tracks").alias("m")).agg(F.count_if(F.col("n") > 1).alias("alternative_pairs"), F.sum(F.greatest(F.lit(0), F.col("m") - 1)).alias("parallel_tracks"))
    e = families.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "SHARED").alias("shared"), F.count_if(F.col("kind") == "ALTERNATIVE").alias("alternative"), F.sum("tracks").alias("edge_tracks"))
    return t.join(e).join(pairs)


def membership(tracks: DataFrame) -> DataFrame:
    """(place, routes): the routes that touch each place, sorted."""
    ends = tracks.select(F.col("from_key").alias("place"), "route").union(tracks.select("to_key", "route"))
    return ends.groupBy("place").agg(F.array_sort(F.collect_set("route")).alias("routes"))


def catalog(tracks: DataFrame, keys=("route",)) -> DataFrame:
    """Tracks, primary tracks and length of each route, and in all (a row with null keys)."""
    return tracks.rollup(*keys).agg(F.count("*").alias("tracks"), F.count_if("primary").alias("primary_tracks"), F.sum("length_m").alias("length_m"))


def sync_status(remote: DataFrame, local: DataFrame, keys: list[str], checksum: str, update: bool = False) -> DataFrame:
    """keys and status of remote and local records, each unique by keys: NEW, UNCHANGED, UPDATED or SKIPPED (changed; by update), REPAIRED (local is invalid), STALE (local only; never deleted).

    local has valid, whether its file is whole."""
    r = remote.select(*keys, F.col(checksum).alias("_r"), F.lit(True).alias("_there"))
    l = local.select(*keys, F.col(checksum).alias("_l"), "valid")  # noqa: E741
    status = (
        F.when(F.col("_there").isNull(), "STALE").when(F.col("valid").isNull(), "NEW").when(~F.col("valid"), "REPAIRED")
        .when(F.col("_r").eqNullSafe(F.col("_l")), "UNCHANGED").otherwise("UPDATED" if update else "SKIPPED")
    )
    return r.join(l, keys, "full").select(*keys, status.alias("status"))


def stale(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    return local.join(remote, keys, "left_anti")


def endpoint_graph(ends: DataFrame, max_transfer_m: float = 5000.0) -> DataFrame:
    """(src, dst, weight, kind) between the ends of tracks, nodes (track, 0) and (track, 1), each edge once.

    ends: route, track, side, lat, lon, place (may be null), length_m. TRACK: along a track. GAP: from a track's end to the start of the next of its
    route. TRANSFER: between ends of different tracks at one place, no more than max_transfer_m apart.
    """
    from ..functions.geo import haversine_m

    node = F.struct("track", "side")
    a = ends.where("side = 0").select("route", "track", node.alias("src"), "lat", "lon", "length_m")
    b = ends.where("side = 1").select("track", node.alias("dst"), F.col("lat").alias("elat"), F.col("lon").alias("elon"))
    whole = a.join(b, "track")
    track = whole.select("src", "dst", F.col("length_m").alias("weight"), F.lit("TRACK").alias("kind"))
    w = Window.partitionBy("route").orderBy("track")
    gap = whole.withColumn("n", F.lead(F.struct(F.col("src").alias("node"), "lat", "lon")).over(w)).where("n IS NOT NULL")
    gap = gap.select(F.col("dst").alias("src"), F.col("n.node").alias("dst"), haversine_m("elat", "elon", F.col("n.lat"), F.col("n.lon")).alias("weight"), F.lit("GAP").alias("kind"))
    p = ends.where("place IS NOT NULL").select("place", node.alias("src"), "lat", "lon")
    q = p.select("place", F.col("src").alias("dst"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    near = p.join(q, "place").where("src < dst AND src.track <> dst.track").withColumn("weight", haversine_m("lat", "lon", "_lat", "_lon")).where(F.col("weight") <= max_transfer_m)
    return track.union(gap).union(near.select("src", "dst", "weight", F.lit("TRANSFER")))
