"""From track files to the network, end to end: which place every end of a track is, and the nodes, edges and counters that follow.

Ends of primary tracks make the places: those of one name that are joined by steps of up to a radius. Ends of other tracks are attached to these by
name, whatever their distance; what is left makes places of its own. Nothing depends on the order of rows: each stage reads the one before as a
whole, and numbers go by position. Places with names that hold each other are then merged, tracks between the same places grouped by geometry.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_pseudo
from .graph import stored
from .merging import complete_link, merged_records
from .network import edge_families, ranked_components
from .profile import geometry_families, orient_variants
from .spatial import alias_pairs, attach_variants, by_position, single_link_clusters

#: Within what distance ends of one name are one place, by default and at least.
RADIUS_M, LEAST_RADIUS_M = 5000.0, 1000.0
PRIMARY, VARIANT_ONLY = "primary_tracks", "variant_only_tracks"


class Identity(NamedTuple):
    """occurrences: a row for each end of a track that has a place. places: a row for each. attachments, splits: what to look over."""

    occurrences: DataFrame
    places: DataFrame
    attachments: DataFrame
    splits: DataFrame


class Network(NamedTuple):
    """nodes, edges and their counters (one row); tracks that make no edge, and the alias candidates that were not merged."""

    nodes: DataFrame
    edges: DataFrame
    counters: DataFrame
    detached: DataFrame
    collapsed: DataFrame
    merges: DataFrame
    candidates: DataFrame


def _observed(tracks: DataFrame) -> DataFrame:
    """Two rows for each of tracks(track, route, from_key, to_key, from_name, to_name, alat, ..., reversed): where the end of each role lies."""

    def end(role: str, own: str, other: str):
        at = lambda c: F.when(F.col("reversed"), F.col(f"{other}{c}")).otherwise(F.col(f"{own}{c}")).alias(c)
        return F.struct(F.lit(role).alias("role"), F.col(f"{role}_key").alias("name"), F.col(f"{role}_name").alias("display"), at("lat"), at("lon"))

    df = tracks.withColumn("_e", F.explode(F.array(end("from", "a", "b"), end("to", "b", "a"))))
    return df.select(F.struct("track", "_e.role").alias("occurrence"), "track", "route", "_e.*")


def _clustered(observed: DataFrame, radius_m: float, source: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences with their place, places): ends of one name in steps of up to radius_m, numbered by mean position, then least track."""
    labels = single_link_clusters(observed, "occurrence", radius_m, ["name"]).withColumnRenamed("node", "occurrence")
    members = stored(observed.join(labels, "occurrence"))
    groups = members.groupBy("name", "component").agg(
        F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"), F.count("*").alias("observations"), F.min("track").alias("_first"),
        F.array_sort(F.collect_set("display")).alias("aliases"), F.array_sort(F.collect_set("route")).alias("routes"),
    )
    own = Window.partitionBy("name")
    groups = groups.withColumn("cluster_index", F.row_number().over(own.orderBy(*by_position("_lat", "_lon", "_first")))).withColumn("cluster_count", F.count("*").over(own))
    key = F.when(F.col("cluster_count") > 1, F.concat("name", F.lit("@"), F.col("cluster_index").cast("string"))).otherwise(F.col("name"))
    # The centres are what is told of places, and what is measured from: seven digits.
    groups = stored(groups.select(
        "component", key.alias("place"), "name", F.col("aliases")[0].alias("display"), F.round("_lat", 7).alias("lat"), F.round("_lon", 7).alias("lon"),
        "observations", "aliases", "routes", "cluster_index", "cluster_count", F.lit(source).alias("source"),
    ))
    return members.join(groups.select("component", "place"), "component").select("occurrence", "track", "role", "route", "name", "display", "place"), groups.drop("component")


def place_identity(tracks: DataFrame, radius_m: float = RADIUS_M) -> Identity:
    """The place of every end of tracks(track, route, primary, from_key, to_key, from_name, to_name, alat, alon, blat, blon, reversed).

    a is where a track's geometry begins and b where it ends; reversed (null: no) says of primary tracks that they run from b to a, and is found for others from the places of
    their names. Tracks without a name at an end, or with a pseudo name, have no place. Places are name, or name@index where a name has several. An end of another
    track goes to a place of its own name, else of a name that holds it or is held by it, those of its own route first; of these to the nearest. Fails where radius_m is under LEAST_RADIUS_M.
    """
    if radius_m < LEAST_RADIUS_M:
        raise ValueError(f"places are merged within {LEAST_RADIUS_M} m at least")
    tracks = tracks.select("track", "route", "primary", "from_key", "to_key", "from_name", "to_name", "alat", "alon", "blat", "blon", "reversed")
    named = stored(tracks.where(F.col("from_key").isNotNull() & F.col("to_key").isNotNull() & ~is_pseudo(F.col("from_key")) & ~is_pseudo(F.col("to_key"))))
    primary = F.coalesce("primary", F.lit(False))
    known, main = _clustered(stored(_observed(named.where(primary).withColumn("reversed", F.coalesce("reversed", F.lit(False))))), radius_m, PRIMARY)
    others = named.where(~primary).drop("reversed")
    ends = others.select("track", F.col("from_key").alias("from_name"), F.col("to_key").alias("to_name"), "alat", "alon", "blat", "blon")
    turned = orient_variants(ends, main.select("name", "lat", "lon")).select("track", "reversed")
    seen = stored(_observed(others.join(turned, "track")))
    to = attach_variants(seen.select(F.col("occurrence").alias("variant"), "name", "lat", "lon", "route"), main.select("place", "name", "lat", "lon", "routes"), main.select("name").distinct())
    to = stored(seen.join(to.withColumnRenamed("variant", "occurrence"), "occurrence"))
    reason = F.when(F.col("by_alias"), "variant_endpoint_name_alias_primary_place").otherwise("variant_endpoint_exact_name_primary_place")
    attachments = to.where("place IS NOT NULL").select("track", "role", "route", "display", "name", "place", F.round("distance_m", 1).alias("distance_m"), (F.col("distance_m") > radius_m).alias("outside"), reason.alias("reason"))
    rest, more = _clustered(to.where("place IS NULL").drop("place", "by_alias", "distance_m"), radius_m, VARIANT_ONLY)
    added = attachments.groupBy("place").agg(F.count("*").alias("attached"), F.collect_set("route").alias("_routes"), F.collect_set("display").alias("_aliases"))
    none = F.array().cast("array<string>")
    joined = lambda a, b: F.array_sort(F.array_union(a, F.coalesce(b, none))).alias(a)
    main = main.join(added, "place", "left").select("place", "name", "display", "lat", "lon", "observations", F.coalesce("attached", F.lit(0).cast("long")).alias("attached"), joined("aliases", "_aliases"), joined("routes", "_routes"), "cluster_index", "cluster_count", "source")
    more = more.withColumn("attached", F.col("observations"))
    places = main.unionByName(more)
    splits = places.where("cluster_count > 1").groupBy("name", "source").agg(F.max("cluster_count").alias("clusters"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("displays"))
    names = "track", "role", "route", "name", "display", "place"
    occurrences = known.select(*names).unionByName(to.where("place IS NOT NULL").select(*names)).unionByName(rest.select(*names))
    return Identity(stored(occurrences), stored(places), attachments, splits)


def global_network(tracks: DataFrame, points: DataFrame, radius_m: float = RADIUS_M) -> Network:
    """Nodes, edges and counters of tracks (as for place_identity, with length_m, points, section) and points(track, seq, along_m, lat, lon).

    Fails where a track with names has an end without a place.
    """
    own = place_identity(tracks, radius_m)
    pairs = stored(alias_pairs(own.places.select("place", "name", "lat", "lon"), "place", "name", radius_m))
    merged = stored(complete_link(own.places.select("place", "lat", "lon"), pairs, radius_m))
    records = merged_records(own.places.select("place", F.col("display").alias("name"), "lat", "lon", "observations", "routes"), merged)
    ends = own.occurrences.join(merged, "place").select("track", "role", F.col("merged").alias("place"))
    start, goal = (ends.where(F.col("role") == r).select("track", F.col("place").alias(f"_{r}")) for r in ("from", "to"))
    pseudo = F.coalesce(is_pseudo(F.col("from_key")) | is_pseudo(F.col("to_key")), F.lit(False))
    told = tracks.where(F.col("from_key").isNotNull() & F.col("to_key").isNotNull()).withColumn("_pseudo", pseudo)
    placed = told.join(start, "track", "left").join(goal, "track", "left")
    missing = ~F.col("_pseudo") & (F.col("_from").isNull() | F.col("_to").isNull())
    placed = stored(placed.withColumn("_ok", F.when(missing, F.raise_error(F.concat(F.lit("no place for an end of track "), F.col("track").cast("string"))).cast("boolean")).otherwise(F.lit(True))).where("_ok"))
    brief = lambda df, *more: df.select("track", "route", "section", F.round("length_m", 3).alias("length_m"), *more)
    detached = brief(placed.where("_pseudo"), "from_key", "to_key")
    collapsed = brief(placed.where("NOT _pseudo AND _from = _to"), F.col("_from").alias("place"))
    open_ = stored(placed.where("NOT _pseudo AND _from <> _to").drop("from_key", "to_key").withColumnsRenamed({"_from": "from_key", "_to": "to_key"}))
    family = geometry_families(open_, points.join(open_.select("track"), "track", "left_semi"))
    edges = stored(edge_families(open_.join(family, "track").withColumn("order", F.struct("route", "section", "track")), F.col("family")))
    turns = edges.select(F.col("from_key").alias("place"), F.lit(0).alias("i"), F.lit(1).alias("o"), "edge_id").unionByName(edges.select(F.col("to_key").alias("place"), F.lit(1).alias("i"), F.lit(0).alias("o"), "edge_id"))
    turns = turns.groupBy("place").agg(
        F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"), F.array_sort(F.collect_set(F.when(F.col("i") == 1, F.col("edge_id")))).alias("incoming_edges"), F.array_sort(F.collect_set(F.when(F.col("o") == 1, F.col("edge_id")))).alias("outgoing_edges")
    )
    nodes = turns.join(ranked_components(edges).drop("places"), "place").join(records.withColumnRenamed("merged", "place"), "place")
    nodes = stored(nodes.withColumn("is_merge", F.col("incoming") >= 2).withColumn("is_branch", F.col("outgoing") >= 2))
    where = merged.select(F.col("place").alias("_p"), "merged")
    left = pairs.join(where.withColumnsRenamed({"_p": "a", "merged": "_a"}), "a").join(where.withColumnsRenamed({"_p": "b", "merged": "_b"}), "b").where("_a <> _b")
    on = nodes.select(F.col("place").alias("_n"))
    touching = left.join(on, F.col("_a") == F.col("_n"), "left_semi").unionByName(left.join(on, F.col("_b") == F.col("_n"), "left_semi")).distinct()
    candidates = stored(touching.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "a_name", "b_name", "distance_m"))
    merges = merged.where("place <> merged")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    per_pair = edges.groupBy("from_key", "to_key").agg(F.count("*").alias("n")).agg(F.count("*").alias("logical_pairs"), F.count_if(F.col("n") > 1).alias("alternative_pairs"))
    rows = [
        nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.max("component_id"), F.lit(0)).cast("long").alias("weak_components")),
        edges.agg(F.count("*").alias("edge_families"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("tracks") - 1)), F.lit(0)).alias("merged_duplicate_source_tracks")),
        per_pair, count(detached, "detached_variant_tracks"), count(collapsed, "collapsed_alias_connector_tracks"), count(own.splits, "spatially_split_normalized_names"),
        count(merges, "automatic_alias_merges"), count(candidates, "alias_candidates"),
        own.attachments.agg(F.count("*").alias("variant_endpoints_attached_to_primary_places"), F.count_if("outside").alias("variant_endpoints_forced_outside_radius")),
    ]
    counters = rows[0]
    for one in rows[1:]:  # one row each
        counters = counters.join(one)
    return Network(nodes, edges, counters, detached, collapsed, merges, candidates)
