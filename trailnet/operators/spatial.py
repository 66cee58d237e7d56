"""Joins by place: pairs within a radius over grid cells, clusters, nearest tracks with pruning by bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, initial_bearing
from .cells import DEGREE_M, around, cell, row_cells
from .cells import near as near_rows
from .graph import components, stored, unsent


def near_pairs(df: DataFrame, key: str, radius_m: float, same: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """(a, b, distance_m) of every two rows of df(key, lat, lon) with a < b, equal in the columns same, within radius_m.

    Columns in keep come along as a_ and b_. An equi-join on grid cells; the exact distance decides.
    """
    left = df.select(F.col(key).alias("a"), "lat", "lon", *same, *[F.col(c).alias(f"a_{c}") for c in keep])
    right = df.select(F.col(key).alias("b"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), *same, *[F.col(c).alias(f"b_{c}") for c in keep])
    pairs = near_rows(left, right, radius_m, list(same)).where("a < b")
    return pairs.select("a", "b", *same, *[f"a_{c}" for c in keep], *[f"b_{c}" for c in keep], "distance_m").dropDuplicates(["a", "b"])


def single_link_clusters(df: DataFrame, key: str, radius_m: float, same: list[str] = ()) -> DataFrame:
    """(node, component): rows joined by chains of neighbours within radius_m, equal in the columns same; component is the smallest key.

    Rows at one spot are one for the comparison, however many. A row with a null coordinate, or a null in same, is alone.
    """
    where = [*same, "lat", "lon"]
    spots = stored(df.dropna(subset=where).groupBy(*where).agg(F.min(key).alias("_spot")))
    links = near_pairs(spots, "_spot", radius_m, same).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = components(spots.select(F.col("_spot").alias("node")), links)
    at = spots.join(labels, F.col("_spot") == F.col("node")).select(*where, "component")
    return df.select(F.col(key).alias("node"), *where).join(at, where, "left").select("node", F.coalesce("component", "node").alias("component")).distinct()


#: Decimals of a degree to which mean positions are compared: sums of doubles differ beyond them with the order of their rows.
ORDER_DIGITS = 9


def by_position(lat: str, lon: str, first: str) -> list[Column]:
    """Sort keys of clusters: mean latitude, mean longitude, least key."""
    return [F.round(lat, ORDER_DIGITS), F.round(lon, ORDER_DIGITS), F.col(first)]


def cluster_places(df: DataFrame, key: str, name: str, radius_m: float) -> DataFrame:
    """One row per cluster of observations of a name: cluster_index (by mean latitude, mean longitude, least key), cluster_count, centre, observations.

    place_key is the name, with @index where the name has several clusters."""
    clustered = df.join(single_link_clusters(df, key, radius_m, [name]).withColumnRenamed("node", key), key)
    out = clustered.groupBy(name, "component").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("observations"), F.min(key).alias("first"))
    w = Window.partitionBy(name)
    out = out.withColumn("cluster_index", F.row_number().over(w.orderBy(*by_position("lat", "lon", "first")))).withColumn("cluster_count", F.count("*").over(w))
    return out.withColumn("place_key", F.when(F.col("cluster_count") > 1, F.concat(F.col(name), F.lit("@"), F.col("cluster_index").cast("string"))).otherwise(F.col(name)))


def weighted_centroid(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    w = F.greatest(F.lit(1.0), F.col(weight).cast("double"))
    return df.groupBy(*keys).agg((F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"), (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"), F.sum(weight).alias(weight))


def diameters(members: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The largest distance of two members of each group, 0 for one alone. Pairs of a group's spots, each once however many members lie there."""
    spots = stored(members.select(*keys, "lat", "lon").distinct())
    right = unsent(spots.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}))
    far = spots.join(right, keys).where(F.struct("lat", "lon") < F.struct("_lat", "_lon")).groupBy(*keys).agg(F.max(haversine_m("lat", "lon", "_lat", "_lon")).alias("diameter_m"))
    return spots.select(*keys).distinct().join(far, keys, "left").withColumn("diameter_m", F.coalesce("diameter_m", F.lit(0.0)))


def nearest(queries: DataFrame, query: str, places: DataFrame, place: str, radius_m: float) -> DataFrame:
    """(query, place, distance_m) of the nearest place within radius_m of each query, ties by place; queries without one have nulls."""
    left = queries.select(F.col(query).alias("_q"), "lat", "lon")
    pairs = near_rows(left, places.select(F.col(place).alias("_p"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon")), radius_m)
    best = pairs.groupBy("_q").agg(F.min(F.struct("distance_m", "_p")).alias("m"))
    return queries.select(F.col(query).alias("_q")).distinct().join(best, "_q", "left").select(F.col("_q").alias("query"), F.col("m._p").alias("place"), F.col("m.distance_m").alias("distance_m"))


#: Sizes of cells: each level's are LEVEL_STEP times as wide as those of the one before; the last holds the globe.
LEVEL_M, LEVEL_STEP, LEVELS = 50.0, 8.0, 8


def _level_m(level: int) -> float:
    return LEVEL_M * LEVEL_STEP**level


def _level_of(size_m: Column) -> Column:
    """The least level whose cells are as wide as size_m."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log(F.greatest(size_m, F.lit(1e-3)) / LEVEL_M) / F.log(F.lit(LEVEL_STEP))))).cast("int")


def _by_level(level: Column, of) -> Column:
    """of(size of a cell) for each row's level."""
    out = of(_level_m(LEVELS - 1))
    for k in range(LEVELS - 1):
        out = F.when(level == k, of(_level_m(k))).otherwise(out)
    return out


def planar(lat, lon, lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """(t, squared metres) of a point against a segment in a plane whose scale fits the mean latitude; no great circles, for comparing many."""
    lat, lon, lat1, lon1, lat2, lon2 = map(F.col, (lat, lon, lat1, lon1, lat2, lon2))
    metre = F.lit(DEGREE_M)
    wide = F.greatest(F.lit(0.2), F.abs(F.cos(F.radians((lat + lat1 + lat2) / 3)))) * metre
    x, y, px, py = (lon2 - lon1) * wide, (lat2 - lat1) * metre, (lon - lon1) * wide, (lat - lat1) * metre
    square = x * x + y * y
    t = F.when(square > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * x + py * y) / square))).otherwise(F.lit(0.0))
    return t, (px - x * t) * (px - x * t) + (py - y * t) * (py - y * t)


def _best_segment(near: DataFrame) -> DataFrame:
    """The nearest segment of each query among the rows of near, by planar distance; then its point and great-circle distance. Ties by track, then segment."""
    t, square = planar("lat", "lon", "lat1", "lon1", "lat2", "lon2")
    best = near.groupBy("query").agg(F.min(F.struct(square.alias("square"), "track", "segment", t.alias("t"), "lat", "lon", "lat1", "lon1", "lat2", "lon2")).alias("m"))
    at = lambda c: F.col(f"m.{c}1") + (F.col(f"m.{c}2") - F.col(f"m.{c}1")) * F.col("m.t")
    return best.select("query", "m.track", "m.segment", "m.t", haversine_m("m.lat", "m.lon", at("lat"), at("lon")).alias("distance_m"), F.sqrt("m.square").alias("_planar"))


def _bounds(asked: DataFrame, segments: DataFrame, same: list[str]) -> DataFrame:
    """asked with bound_m: how far it is to the nearest of one segment end for each cell around a query, of every level; null where there are none."""
    ends = segments.select(*same, F.explode(F.array(F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))).alias("e")).select(*same, "e.*")

    def at(level: int):
        return lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))

    own = [at(k)(cell(F.col("lat"), F.col("lon"), _level_m(k))) for k in range(LEVELS)]
    cells_of = [F.transform(around(F.col("lat"), F.col("lon"), _level_m(k)), at(k)) for k in range(LEVELS)]
    # Ends are many, those of the smallest cells fewer: the wider levels choose among the latter.
    finest = stored(ends.groupBy(cell(F.col("lat"), F.col("lon"), _level_m(0)).alias("_c"), *same).agg(F.min(F.struct("lat", "lon")).alias("_end"))).select(*same, "_end.*")
    seen = finest.withColumn("_at", F.explode(F.array(*own))).groupBy("_at", *same).agg(F.min(F.struct("lat", "lon")).alias("_end"))
    near = asked.withColumn("_at", F.explode(F.concat(*cells_of))).join(unsent(seen), ["_at", *same])
    near = near.groupBy("_spot").agg(F.min(haversine_m("lat", "lon", "_end.lat", "_end.lon")).alias("bound_m"))
    return asked.join(near, "_spot", "left")


def _covered(size_m: float) -> Column:
    """The cells that the box of a segment covers."""
    low, high = (F.struct(f("lat1", "lat2").alias("lat"), f("lon1", "lon2").alias("lon")) for f in (F.least, F.greatest))
    rows = F.sequence(cell(low["lat"], low["lon"], size_m)["i"], cell(high["lat"], high["lon"], size_m)["i"])
    return F.flatten(F.transform(rows, lambda i: row_cells(i, low["lon"], high["lon"], size_m)))


def nearest_segment(queries: DataFrame, segments: DataFrame, same: list[str] = (), report: dict | None = None) -> DataFrame:
    """(query, track, segment, t, distance_m): the nearest point of any track for each queries(query, lat, lon); nulls where there are no tracks.

    segments: track, segment, lat1, lon1, lat2, lon2; both sides have the columns same, in which they are equal. Queries at one spot are asked once, and of equal segments the first. In a
    first pass each spot meets one segment end for each cell around it, of every level, which bounds how far its nearest segment is. In the second it meets the
    segments whose boxes lie in cells around it: those as large as the bound or larger in cells of their own level, all smaller ones in cells of
    the bound's; of these only the ones whose box is within the bound are compared. A segment that crosses 180 degrees counts as going the other way round. Ties by track, then segment.
    report takes the number of comparisons.
    """
    same = list(same)
    asked = queries.select("query", *same, "lat", "lon").dropDuplicates(["query"]).withColumn("_spot", F.struct(*same, "lat", "lon"))
    line = ["lat1", "lon1", "lat2", "lon2"]
    alike = segments.groupBy(*same, *line).agg(F.min(F.struct("track", "segment")).alias("_s"))
    asked, segments = stored(asked), stored(alike.select("_s.track", "_s.segment", *same, *line))
    spots = asked.select("_spot", *same, "lat", "lon").dropDuplicates(["_spot"])
    spots = stored(_bounds(spots, segments, same).where("bound_m IS NOT NULL").withColumn("_class", _level_of(F.col("bound_m") * 1.01 + 0.01)))
    classes = [r[0] for r in spots.select("_class").distinct().collect()]  # LEVELS at most
    up, across = (F.abs(F.col(f"{c}2") - F.col(f"{c}1")) * DEGREE_M for c in ("lat", "lon"))
    kept = segments.withColumn("_own", _level_of(F.greatest(up, across)))
    own = kept.withColumn("_level", F.col("_own")).withColumn("_kind", F.lit(0))
    below = kept.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in classes]).cast("array<int>"))).where("_level > _own").withColumn("_kind", F.lit(1))
    placed = own.unionByName(below).withColumn("_cell", F.explode(_by_level(F.col("_level"), _covered))).drop("_own")
    looks = F.concat(
        F.transform(F.sequence(F.col("_class"), F.lit(LEVELS - 1)), lambda k: F.struct(F.lit(0).alias("_kind"), k.alias("_level"))), F.array(F.struct(F.lit(1).alias("_kind"), F.col("_class").alias("_level")))
    )
    probes = spots.withColumn("_look", F.explode(looks)).select("_spot", *same, "lat", "lon", "bound_m", "_look.*")
    probes = probes.withColumn("_cell", F.explode(_by_level(F.col("_level"), lambda m: around(F.col("lat"), F.col("lon"), m))))
    near = unsent(probes).join(unsent(placed), ["_kind", "_level", "_cell", *same]).where(_box_m() <= F.col("bound_m") * 1.01 + 0.01)
    if report is not None:
        near = stored(near)
        report["comparisons"], report["spots"] = near.count(), spots.count()
    best = _best_segment(near.withColumn("query", F.col("_spot"))).drop("_planar").withColumnRenamed("query", "_spot")
    return asked.select("query", "_spot").join(best, "_spot", "left").drop("_spot")


def _box_m() -> Column:
    """A lower bound of the metres from lat, lon to the box of lat1, lon1, lat2, lon2, up to a hundredth; 0 near the poles and where bound_m is wide, where a plane says nothing."""
    out = lambda c: F.greatest(F.lit(0.0), F.least(f"{c}1", f"{c}2") - F.col(c), F.col(c) - F.greatest(f"{c}1", f"{c}2"))
    # A degree of longitude is least at the latitude farthest from the equator.
    far = F.greatest(F.abs("lat"), F.abs("lat1"), F.abs("lat2"))
    across = F.least(out("lon"), F.abs(F.lit(360.0) - out("lon")))
    return F.when((F.col("bound_m") > 500_000) | (far > 85), F.lit(0.0)).otherwise(F.hypot(out("lat"), across * F.cos(F.radians(far))) * DEGREE_M * 0.99)


def nearest_on_route(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """nearest_segment among the segments of the query's own route: both have the column route; nulls where the route has no segments."""
    return nearest_segment(queries, segments, ["route"])


def route_bearing(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """(query, bearing, live) for each queries(query, lat, lon, course): its course, if it has one (live), else the bearing of the nearest of segments; null without either."""
    open_ = queries.where("course IS NULL")
    at = nearest_segment(open_, segments).join(segments, ["track", "segment"])
    found = at.select("query", initial_bearing("lat1", "lon1", "lat2", "lon2").alias("_b"))
    return queries.select("query", "course").join(found, "query", "left").select("query", F.coalesce(F.col("course").cast("double"), "_b").alias("bearing"), F.col("course").isNotNull().alias("live"))


def contains(a: Column, b: Column, least: int = 1) -> Column:
    """Whether one of two keys of at least so many characters holds the other."""
    return (F.length(a) >= least) & (F.length(b) >= least) & (F.contains(a, b) | F.contains(b, a))


def alias_pairs(places: DataFrame, key: str, name: str, radius_m: float) -> DataFrame:
    """(a, b, a_name, b_name, distance_m) of places within radius_m whose names differ and one of which holds the other.

    Places of one name at one spot are one for the comparison, however many; its links are then those of each of them.
    """
    own = places.select(F.col(key).alias("_key"), F.col(name).alias("name"), "lat", "lon").dropDuplicates(["_key"])
    spots = stored(own.dropna(subset=["name", "lat", "lon"]).groupBy("name", "lat", "lon").agg(F.min("_key").alias("_spot")))
    side = lambda s, lat, lon: spots.select(F.col("_spot").alias(f"_{s}"), F.col("name").alias(f"_{s}_name"), F.col("lat").alias(lat), F.col("lon").alias(lon))
    pairs = near_rows(side("x", "lat", "lon"), side("y", "to_lat", "to_lon"), radius_m).where(F.col("_x") < F.col("_y")).where((F.col("_x_name") != F.col("_y_name")) & contains(F.col("_x_name"), F.col("_y_name")))
    pairs = stored(pairs.select("_x", "_y", "_x_name", "_y_name", "distance_m"))
    member = lambda s: unsent(members.withColumnsRenamed({"_key": f"_{s}_key", "_spot": f"_{s}"}))
    members = stored(own.join(spots, ["name", "lat", "lon"]).select("_key", "_spot"))
    both = pairs.join(member("x"), "_x").join(member("y"), "_y")
    ahead = F.col("_x_key") < F.col("_y_key")
    pick = lambda a, b, c: F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(c)
    return both.select(F.least("_x_key", "_y_key").alias("a"), F.greatest("_x_key", "_y_key").alias("b"), pick("_x_name", "_y_name", "a_name"), pick("_y_name", "_x_name", "b_name"), "distance_m")


def _held(short: DataFrame, long: DataFrame, least: int) -> DataFrame:
    """(short, long): every name of short(short) of at least so many characters that a name of long(long) holds.

    A name that holds another holds all its runs of letters: they are joined on the short one's rarest among the long ones, and none that has a run which no long one has is.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (least - 1)), lambda i: F.substring(c, i, F.lit(least))))
    within = stored(long.where(F.length("long") >= least).select("long", F.explode(grams(F.col("long"))).alias("g")))
    counts = within.groupBy("g").agg(F.count("*").alias("n"))
    own = unsent(short.where(F.length("short") >= least).select("short", F.explode(grams(F.col("short"))).alias("g"))).join(counts, "g", "left")
    rarest = own.groupBy("short").agg(F.min(F.struct("n", "g")).alias("m"), F.count_if(F.col("n").isNull()).alias("none")).where("none = 0").select("short", F.col("m.g").alias("g"))
    return unsent(rarest).join(within, "g").where(F.contains("long", F.col("short"))).select("short", "long")


def attach_variants(variants: DataFrame, primary: DataFrame, names: DataFrame, least: int = 5) -> DataFrame:
    """Each variants(variant, name, lat, lon, route) to a primary(place, name, lat, lon, routes): of the same name, or else of a name that holds it or that it holds.

    Among alias matches those that share the variant's route come first, if there are any; then the nearest, then the least place. One pass over the primary
    places alone, so the order of variants doesn't matter. names(name) are the distinct names of the primary places: the containment join is between distinct
    names, and only its matches meet places. Variants of one name, spot and route ask once, and places alike in all but their number answer once.
    """
    asked = variants.withColumnsRenamed({"name": "_v", "lat": "_lat", "lon": "_lon", "route": "_route"}).select("variant", "_v", "_lat", "_lon", "_route")
    like = ["_v", "_lat", "_lon", "_route"]
    spots = stored(asked.groupBy(*like).agg(F.min("variant").alias("_spot")))
    own = spots.select("_v").where("_v IS NOT NULL").distinct()
    exact = own.join(names, own["_v"] == names["name"], "left_semi").select("_v", F.col("_v").alias("name"), F.lit(0).alias("tier"))
    rest = stored(own.join(names, own["_v"] == names["name"], "left_anti"))
    holds, held = _held(names.select(F.col("name").alias("short")), rest.select(F.col("_v").alias("long")), least), _held(rest.select(F.col("_v").alias("short")), names.select(F.col("name").alias("long")), least)
    alias = holds.select(F.col("long").alias("_v"), F.col("short").alias("name")).unionByName(held.select(F.col("short").alias("_v"), F.col("long").alias("name"))).select("_v", "name", F.lit(1).alias("tier")).distinct()
    matches = stored(exact.union(alias))
    places = primary.groupBy("name", "lat", "lon", "routes").agg(F.min("place").alias("place"))
    both = unsent(spots.join(matches, "_v")).join(places, "name").withColumn("distance_m", haversine_m("_lat", "_lon", "lat", "lon"))
    both = both.withColumn("_same", F.when((F.col("tier") == 1) & F.array_contains("routes", F.col("_route")), 0).otherwise(1))
    best = stored(both.groupBy("_spot").agg(F.min(F.struct("tier", "_same", "distance_m", "place")).alias("m")))
    alike = [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in like]
    at = asked.alias("a").join(spots.alias("s"), alike, "left").select("a.variant", "s._spot")
    return at.join(best, "_spot", "left").select("variant", F.col("m.place").alias("place"), (F.col("m.tier") == 1).alias("by_alias"), F.col("m.distance_m").alias("distance_m"))
