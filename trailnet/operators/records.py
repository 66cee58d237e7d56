"""Records of tracks, routes and places from the network's pieces, with the checks that stop a build, and its audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import texts as T
from ..functions.geo import haversine_m
from .network import membership


def checked(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """df; the job fails with message at the first row where ok doesn't hold. The check is part of the plan, so it costs no pass of its own."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def in_scope(tracks: DataFrame, code: str = "code") -> DataFrame:
    """Tracks whose code is of a country in scope. A code of France is a sign of wrong data: it stops the job."""
    fine = checked(tracks, ~F.startswith(F.coalesce(F.col(code), F.lit("")), F.lit("FR")), F.concat(F.lit("out of scope: "), F.col(code)))
    return fine.where(F.substring(code, 1, 2).isin(*T.COUNTRIES))


def valid_points(points: DataFrame, track: str = "track") -> DataFrame:
    """Points with both coordinates, of tracks that have two or more of them; coordinates out of range stop the job."""
    own = points.where("lat IS NOT NULL AND lon IS NOT NULL")
    inside = F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0)
    own = checked(own, inside, F.concat(F.lit("coordinates out of range in track "), F.col(track).cast("string")))
    return own.withColumn("_n", F.count("*").over(Window.partitionBy(track))).where("_n >= 2").drop("_n")


def track_records(tracks: DataFrame, names: DataFrame) -> DataFrame:
    """tracks(track, section, from_key, to_key, length_m, lat, lon, ele) rounded, with the section's suffix and the ends' names, null for ends that aren't places.

    names(place, name): the official names; a broadcast is left to the planner, which knows its size."""
    end = lambda side: names.select(F.col("place").alias(f"{side}_key"), F.col("name").alias(f"{side}_name"))
    out = tracks.join(end("from"), "from_key", "left").join(end("to"), "to_key", "left")
    suffix = F.lower(F.regexp_replace(F.coalesce(F.col("section"), F.lit("")), "[^A-Za-z]", ""))
    return out.select(
        "track", suffix.alias("suffix"), F.round("length_m", 3).alias("length_m"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("ele", 3).alias("ele"),
        "from_name", "to_name",
    )


def official_names(routes: DataFrame, names: DataFrame) -> DataFrame:
    """routes(route, name) with the official name of names(route, official) where there is one."""
    return routes.join(names, "route", "left").withColumn("name", F.coalesce("official", "name")).drop("official")


def required_places(occurrences: DataFrame, places: DataFrame) -> DataFrame:
    """occurrences(occurrence, key) with the place of places(key, place); one without a place stops the job."""
    out = occurrences.join(places, "key", "left")
    return checked(out, F.col("place").isNotNull(), F.concat(F.lit("no place for "), F.col("key").cast("string")))


def sorted_tracks(tracks: DataFrame, order: list[Column]) -> DataFrame:
    """tracks with place, their rank within their route."""
    return tracks.withColumn("place", F.row_number().over(Window.partitionBy("route").orderBy(*order)))


def component_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(component_id, edges): edges(from_key, to_key) with both ends in a component of labels(place, component_id)."""
    end = lambda side: labels.select(F.col("place").alias(f"{side}_key"), F.col("component_id").alias(f"_{side}"))
    both = edges.join(end("from"), "from_key").join(end("to"), "to_key").where("_from = _to")
    return both.groupBy(F.col("_from").alias("component_id")).agg(F.count("*").alias("edges"))


def touching(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with at least one end among places(place)."""
    ids = places.select("place").distinct()
    one = edges.join(ids.withColumnRenamed("place", "from_key"), "from_key", "left_semi")
    two = edges.join(ids.withColumnRenamed("place", "from_key"), "from_key", "left_anti").join(ids.withColumnRenamed("place", "to_key"), "to_key", "left_semi")
    return one.unionByName(two)


def route_records(components: DataFrame, names: DataFrame) -> DataFrame:
    """(route, components, display) of components(route, component, tracks, places, span) and names(route, name).

    display: the name alone where there is no component, else with the span of the one with the most tracks, then places, the first of
    equals, and how many more there are.
    """
    best = components.groupBy("route").agg(F.count("*").alias("components"), F.max_by("span", F.struct("tracks", "places", (-F.col("component")).alias("c"))).alias("span"))
    out = names.join(best, "route", "left").withColumn("components", F.coalesce("components", F.lit(0)))
    whole = F.concat("name", F.lit(" — "), "span")
    more = F.concat(whole, F.lit(" (+"), (F.col("components") - 1).cast("string"), F.lit(" components)"))
    return out.select("route", "components", F.when(F.col("components") == 0, F.col("name")).when(F.col("components") == 1, whole).otherwise(more).alias("display"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(place, neighbours): for each place its outgoing edges(from_key, to_key, display, length_min_m, tracks) as an array, by display in lower case, least length, tracks."""
    entry = F.struct(F.lower("display").alias("k"), "length_min_m", "tracks", "to_key")
    return edges.groupBy(F.col("from_key").alias("place")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["to_key"]).alias("neighbours"))


def shared_routes(pairs: DataFrame, routes: DataFrame) -> DataFrame:
    """pairs(a, b) with the routes(place, routes) that both places have, sorted."""
    side = lambda p: routes.select(F.col("place").alias(p), F.col("routes").alias(f"_{p}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    none = F.array().cast(dict(routes.dtypes)["routes"])
    return out.select("a", "b", F.array_sort(F.array_intersect(F.coalesce("_a", none), F.coalesce("_b", none))).alias("shared"))


def first_of_each(rows: DataFrame, group: str, value: str, order: list[Column]) -> DataFrame:
    """(group, values): the distinct values of a group in the order of their first row."""
    w = Window.partitionBy(group, value).orderBy(*order)
    once = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    w = Window.partitionBy(group).orderBy(*order)
    once = once.withColumn("_at", F.row_number().over(w))
    return once.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))


def examples(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of the whole order, as a report shows them: a top-k, of which each task passes on k rows at most."""
    return rows.orderBy(*order).limit(k)


def split_names(clusters: DataFrame) -> DataFrame:
    """(name, clusters, observations, widest_m): names that several clusters(name, lat, lon, observations, cluster_index) have, and how far the others lie from the first."""
    first = clusters.where("cluster_index = 1").select("name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    out = clusters.join(first, "name").groupBy("name").agg(
        F.count("*").alias("clusters"), F.sum("observations").alias("observations"), F.max(haversine_m("_lat", "_lon", "lat", "lon")).alias("widest_m"),
    )
    return out.where("clusters > 1")


def network_counters(tracks: DataFrame, families: DataFrame, components: DataFrame) -> DataFrame:
    """One row of thirteen counters of tracks(route, from_key, to_key, primary), families (edge_families) and components(place, component_id, places).

    Each is a count over one of these tables; what is joined are one-row totals.
    """
    same = F.col("from_key") == F.col("to_key")
    t = tracks.agg(
        F.count("*").alias("tracks"), F.count_if("primary").alias("primary_tracks"), F.count_if(same).alias("collapsed_tracks"), F.countDistinct("route").alias("routes"),
    )
    pairs = families.groupBy("from_key", "to_key").agg(F.count("*").alias("n"), F.sum("tracks").alias("m")).agg(
        F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("alternative_pairs"), F.sum(F.greatest(F.lit(0), F.col("m") - 1)).alias("parallel_tracks"),
    )
    e = families.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "SHARED").alias("shared_edges"), F.count_if(F.col("kind") == "ALTERNATIVE").alias("alternative_edges"))
    c = components.agg(F.count("*").alias("places"), F.countDistinct("component_id").alias("components"), F.coalesce(F.max("places"), F.lit(0)).alias("largest_component"))
    return t.join(pairs).join(e).join(c)


def place_routes(tracks: DataFrame) -> DataFrame:
    return membership(tracks)


def display_name(raw: Column) -> Column:
    return N.title_words(raw)
