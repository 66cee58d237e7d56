"""Writers: documents as JSON and GeoJSON, one line per record, by partition of the route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import section_number, section_suffix

#: Sorts after every section number.
NO_SECTION = 1 << 30


def geojson_features(points: DataFrame, properties: list[str], keys=("track",), order=("seq",)) -> DataFrame:
    """(feature) per track of two points or more: a LineString of [lon, lat] in order and the properties (equal in a track's rows)."""
    own = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "lon", "lat"))).alias("pts"), *[F.first(c).alias(c) for c in properties if c not in keys])
    line = F.struct(F.lit("LineString").alias("type"), F.transform("pts", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), line.alias("geometry"))
    return own.where(F.size("pts") >= 2).select(*keys, F.to_json(feature).alias("feature"))


def write_features(features: DataFrame, path: str, by: str | None = None) -> None:
    """One feature per line; with by, a folder for each of its values."""
    if by:
        features.select(by, F.col("feature").alias("value")).write.partitionBy(by).text(path)
    else:
        features.select(F.col("feature").alias("value")).write.text(path)


def write_documents(df: DataFrame, path: str, by: str) -> None:
    """Rows as JSON objects, one per line, in a folder for each value of by."""
    df.select(by, F.to_json(F.struct(*[c for c in df.columns if c != by])).alias("value")).write.partitionBy(by).text(path)


def palette(df: DataFrame, group: str, colors: list[str]) -> DataFrame:
    """df with color: of the group's place among all groups, in turn."""
    ranks = df.select(group).distinct().withColumn("_k", F.row_number().over(Window.orderBy(group)) - 1)
    return df.join(ranks, group).withColumn("color", F.element_at(F.array(*map(F.lit, colors)), (F.col("_k") % len(colors) + 1).cast("int"))).drop("_k")


def tiles(boxes: DataFrame, zooms: range) -> DataFrame:
    """(id, z, x, y, tms_y) of the map tiles that each boxes(id, min_lat, min_lon, max_lat, max_lon) touches."""
    from ..functions.geo import tile_xy, tms_row

    z = boxes.withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    a, b = tile_xy("max_lat", "min_lon", "z"), tile_xy("min_lat", "max_lon", "z")
    z = z.withColumn("_a", a).withColumn("_b", b).withColumn("x", F.explode(F.sequence("_a.x", "_b.x"))).withColumn("y", F.explode(F.sequence("_a.y", "_b.y")))
    return z.select("id", "z", "x", "y", tms_row("y", "z").alias("tms_y"))


def write_manifest(entries: DataFrame, path: str) -> None:
    """entries as JSON, one per line, beside path first and then in its place, so that readers never see half of them."""
    spark, new = entries.sparkSession, f"{path}.tmp"
    entries.write.mode("overwrite").json(new)
    there, fresh = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new))
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(there, True)
    if not fs.rename(fresh, there):
        raise OSError(f"{new} could not be moved to {path}")


def route_documents(tracks: DataFrame, schema: int = 4) -> DataFrame:
    """(route, document): each route of kml.canonical_tracks as JSON, its tracks by section number, suffix and section. A route's tracks make one row."""
    name = F.lower("section")
    order = F.struct(F.coalesce(section_number(F.col("section")), F.lit(NO_SECTION)).alias("n"), F.lower(section_suffix(F.col("section"))).alias("x"), name.alias("s"))
    line = F.transform("points", lambda p: F.array(p["lat"], p["lon"], p["ele"]))
    track = F.struct(F.col("section").alias("section_id"), "from_key", "to_key", "pseudo_from", "pseudo_to", line.alias("coordinates"))
    rows = tracks.groupBy("route").agg(F.min("name").alias("name"), F.array_sort(F.collect_list(F.struct(order.alias("o"), track.alias("t")))).alias("rows"))
    doc = F.struct(F.lit(schema).alias("schema"), F.col("route").alias("route_group_id"), "name", F.transform("rows", lambda r: r["t"]).alias("tracks"))
    return rows.select("route", F.to_json(doc).alias("document"))


def tree_lines(tree: DataFrame) -> DataFrame:
    """(sort_path, line) of route.group_tree's rows: the tree as text, in the order of sort_path."""
    siblings = Window.partitionBy(F.slice("sort_path", 1, F.col("depth")))
    t = tree.withColumn("_last", F.col("sort_path") == F.max("sort_path").over(siblings))
    above = t.where("depth > 1").select("sort_path", F.explode(F.expr("sequence(1, depth - 1)")).alias("k")).withColumn("up", F.slice("sort_path", 1, F.col("k") + 1))
    stems = above.join(t.select(F.col("sort_path").alias("up"), F.when(F.col("_last"), "   ").otherwise("│  ").alias("bar")).distinct(), "up")
    stems = stems.groupBy("sort_path").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("k", "bar"))), lambda x: x["bar"]), "").alias("stem"))
    branch = F.when(F.col("_last"), "└─ ").otherwise("├─ ")
    line = F.concat(F.coalesce("stem", F.lit("")), branch, F.col("place").cast("string"), F.lit("  ("), F.coalesce("caption", F.lit("")), F.when(F.col("cycle"), "; cycle)").otherwise(")"))
    return t.join(stems, "sort_path", "left").select("sort_path", F.when(F.col("depth") == 0, F.col("place").cast("string")).otherwise(line).alias("line"))


def write_tree(tree: DataFrame, path: str) -> None:
    """The lines in parts that follow each other by name; within and across parts they are in order."""
    tree_lines(tree).orderBy("sort_path").select("line").write.mode("overwrite").text(path)
