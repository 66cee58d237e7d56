"""Readers: track files, index pages, route documents, polygons, manifests. All parse with column expressions and no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N

ROUTES_SCHEMA = (
    "routes array<struct<route_group_id:string,name:string,color:string,tracks:array<struct<section_id:string,from_key:string,to_key:string,"
    "pseudo_from:boolean,pseudo_to:boolean,color:string,coordinates:array<array<double>>>>>>"
)


def read_files(spark: SparkSession, root: str, pattern: str = "*.kml") -> DataFrame:
    """(path, content) of every file below root that fits the pattern."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def coordinates(files: DataFrame) -> DataFrame:
    """(path, part, seq, lat, lon, ele) of every point of every <coordinates>: "lon,lat,ele" tokens between white space.

    Tokens without two numbers are skipped; seq counts what is left. ele may be null.
    """
    blocks = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<coordinates>(.*?)</coordinates>"), 1)).alias("part", "block"))
    tokens = blocks.select("path", "part", F.posexplode(F.split(F.trim(F.regexp_replace("block", r"\s+", " ")), " ")).alias("at", "token"))
    n = F.split("token", ",")
    num = lambda k: F.get(n, F.lit(k)).try_cast("double")
    rows = tokens.select("path", "part", "at", num(1).alias("lat"), num(0).alias("lon"), num(2).alias("ele")).where("lat IS NOT NULL AND lon IS NOT NULL")
    # Positions in the file order points; gaps that skipped tokens left are harmless to all operators.
    return rows.select("path", "part", F.col("at").alias("seq"), "lat", "lon", "ele")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def tracks_of(files: DataFrame) -> DataFrame:
    """(path, route_code, section_id, track_id, label, from_raw, to_raw) by the file names GROUP_SECTION_label; all null where a name doesn't fit."""
    name = stem(F.col("path"))
    at = lambda k: F.nullif(F.regexp_extract(name, r"^([A-Za-z]{2}\d{2}[A-Za-z0-9]*)[-_]([0-9]{2}[A-Za-z0-9]*)[-_](.*)$", k), F.lit(""))
    df = files.select("path", at(1).alias("route_code"), at(2).alias("section_id"), at(3).alias("label"))
    ends = N.label_ends(F.col("label"))
    return df.select("path", "route_code", "section_id", F.when(F.col("section_id").isNotNull(), F.concat_ws(":", "route_code", "section_id")).alias("track_id"), "label", ends["from_raw"].alias("from_raw"), ends["to_raw"].alias("to_raw"))


def counters(files: DataFrame) -> DataFrame:
    """(path, coordinates, elevations, valid) of every file: its points, those with an elevation, and whether it has any point."""
    n = coordinates(files).groupBy("path").agg(F.count("*").alias("coordinates"), F.count("ele").alias("elevations"))
    zero = F.lit(0).cast("long")
    out = files.select("path").join(n, "path", "left").select("path", F.coalesce("coordinates", zero).alias("coordinates"), F.coalesce("elevations", zero).alias("elevations"))
    return out.withColumn("valid", F.col("coordinates") > 0)


def required_index(rows: DataFrame) -> DataFrame:
    """index_rows with their route_id (of the track file's name), which no two may share: fails at once where there are no rows, and where two do when it is computed."""
    if rows.isEmpty():
        raise ValueError("The index has no tracks")
    own = rows.withColumn("route_id", N.required_route_id(F.col("page_filename")))
    many = F.count("*").over(Window.partitionBy("route_id")) > 1
    checked = F.when(many, F.raise_error(F.concat(F.lit("Duplicate route id in the index: "), "route_id"))).otherwise(F.col("route_id"))
    return own.withColumn("route_id", checked.cast("string"))


def invalid(files: DataFrame) -> DataFrame:
    """Paths of files without a point."""
    return files.select("path").join(coordinates(files).select("path").distinct(), "path", "left_anti")


def index_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' other columns with (page_filename, download_id) of each table row that names a track file and links to its download."""
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b(.*?)</tr>"), 1)).alias("_row"))
    out = rows.select(*rest, F.regexp_extract("_row", r"(?i)([\w.-]+\.kml)", 1).alias("page_filename"), F.regexp_extract("_row", r'href="[^"]*/(\d+)"', 1).alias("download_id"))
    return out.where("page_filename <> '' AND download_id <> ''")


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' other columns with each href, in order."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), 1)).alias("place", "href"))


def route_tracks(docs: DataFrame) -> DataFrame:
    """One row per track of route documents (ROUTES_SCHEMA): ids, ends (null if pseudo or blank), colours, points (lat, lon, ele).

    Tracks of fewer than two points are dropped, and so routes without any.
    """
    r = docs.select(F.posexplode("routes").alias("route_order", "r"))
    t = r.select("route_order", F.col("r.route_group_id").alias("route"), F.col("r.name").alias("name"), N.normalize_color(F.coalesce("r.color", F.lit(""))).alias("route_color"), F.posexplode("r.tracks").alias("track_order", "t"))
    ok = F.filter("t.coordinates", lambda c: F.size(c) >= 2)
    pts = F.transform(ok, lambda c: F.struct(F.get(c, F.lit(0)).alias("lat"), F.get(c, F.lit(1)).alias("lon"), F.nanvl(F.get(c, F.lit(2)), F.lit(None).cast("double")).alias("ele")))
    key = lambda side: F.when(~F.coalesce(F.col(f"t.pseudo_{side}"), F.lit(False)), N.empty_to_null(F.col(f"t.{side}_key")))
    return t.select("route_order", "route", "name", "route_color", "track_order", F.col("t.section_id").alias("section"), key("from").alias("from_key"), key("to").alias("to_key"), pts.alias("points")).where(F.size("points") >= 2)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    return route_tracks(spark.read.schema(ROUTES_SCHEMA).json(path, multiLine=True))


def polygons(files: DataFrame) -> DataFrame:
    """(path, ring, seq, lon, lat) of polygon files: sections up to END, holes (a name with !) left out, rings of fewer than three points dropped, rings closed."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    point = F.col("line").rlike(r"^[-+0-9.eE]+\s+[-+0-9.eE]+$")
    lines = lines.withColumn("is_point", point).withColumn("ring", F.sum(F.when(~point & (F.col("line") != "END") & (F.col("line") != ""), 1).otherwise(0)).over(w))
    hole = F.max(F.when(~F.col("is_point"), F.col("line").startswith("!")).otherwise(F.lit(False))).over(Window.partitionBy("path", "ring"))
    pts = lines.withColumn("hole", hole).where("is_point AND NOT hole")
    n = F.split("line", r"\s+")
    pts = pts.select("path", "ring", "at", n[0].cast("double").alias("lon"), n[1].cast("double").alias("lat"))
    size = F.count("*").over(Window.partitionBy("path", "ring"))
    pts = pts.withColumn("n", size).where("n >= 3")
    order = Window.partitionBy("path", "ring").orderBy("at")
    pts = pts.withColumn("seq", F.row_number().over(order)).withColumn("first", F.first(F.struct("lon", "lat")).over(order))
    last = pts.where("seq = n AND (lon <> first.lon OR lat <> first.lat)").select("path", "ring", (F.col("n") + 1).cast("int").alias("seq"), F.col("first.lon").alias("lon"), F.col("first.lat").alias("lat"))
    return pts.select("path", "ring", "seq", "lon", "lat").union(last)


def checksums(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def choose_existing(candidates: DataFrame, key: str = "route_id") -> DataFrame:
    """Of candidates(key, path, priority, valid) the first valid path of each key."""
    return candidates.where("valid").groupBy(key).agg(F.min_by("path", F.struct("priority", "path")).alias("path"))


MANIFEST_SCHEMA = (
    "schema_version int, tracks map<string,struct<page_filename:string,download_url:string,download_id:string,route_code:string,route_id:string,local_path:string,"
    "bytes:bigint,coordinates:bigint,elevations:bigint,sha256:string>>"
)


def manifest_tracks(docs: DataFrame) -> DataFrame:
    """One row per entry of manifests (MANIFEST_SCHEMA, and path), with its route_id.

    In schema 2 that is the entry's key; older ones are keyed anew by the name of the page's file, else of the local one. Two entries of one manifest with one id are an error.
    """
    e = docs.select("path", "schema_version", F.explode("tracks").alias("key", "e"))
    name = F.coalesce(N.empty_to_null(F.col("e.page_filename")), F.col("e.local_path"), F.lit(""))
    ident = F.when(F.col("schema_version") == 2, F.col("key")).otherwise(N.required_route_id(F.element_at(F.split(name, "/"), -1)))
    e = e.withColumn("route_id", ident)
    many = F.count("*").over(Window.partitionBy("path", "route_id")) > 1
    checked = F.when(many, F.raise_error(F.concat(F.lit("Duplicate route id in a manifest: "), "route_id"))).otherwise(F.col("route_id"))
    rest = [f"e.{c}" for c in ("page_filename", "download_url", "download_id", "route_code", "local_path", "bytes", "coordinates", "elevations", "sha256")]
    return e.select("path", checked.cast("string").alias("route_id"), *rest)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    return manifest_tracks(docs.select(F.col("_metadata.file_path").alias("path"), "schema_version", "tracks"))


GROUP_SCHEMA = (
    "route_group_id string, name string, official_name string, tracks array<struct<section_id:string,variant_suffix:string,from_key:string,to_key:string,"
    "pseudo_from:boolean,pseudo_to:boolean,coordinates:array<array<double>>>>"
)


def read_groups(spark: SparkSession, root: str, countries=("ES", "PT")) -> DataFrame:
    """(stem, and GROUP_SCHEMA) of the group documents below root whose file names begin with one of countries."""
    docs = spark.read.schema(GROUP_SCHEMA).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    docs = docs.withColumn("stem", stem(F.col("_metadata.file_path")))
    return docs.where(F.substring("stem", 1, 2).isin(*countries))


def canonical_tracks(groups: DataFrame) -> DataFrame:
    """The primary tracks (variant suffix a) of groups(stem, GROUP_SCHEMA) with two points or more, as route, name, section, ends and points (lat, lon, ele).

    Coordinates of fewer than two numbers are skipped; a position off the globe is an error.
    """
    t = groups.select(F.coalesce(N.empty_to_null(F.col("route_group_id")), "stem").alias("route"), "name", "official_name", F.explode("tracks").alias("t"))
    section = F.coalesce("t.section_id", F.lit(""))
    t = t.where(F.coalesce(N.empty_to_null(F.col("t.variant_suffix")), F.substring(section, -1, 1)) == "a")
    given = F.filter(F.coalesce("t.coordinates", F.array().cast("array<array<double>>")), lambda c: F.size(c) >= 2)
    at = lambda c, k: F.get(c, F.lit(k))
    on_globe = lambda c: F.coalesce(at(c, 0).between(-90, 90) & at(c, 1).between(-180, 180), F.lit(False))
    bad = F.raise_error(F.concat_ws("/", F.lit("Invalid coordinate in"), "route", section)).cast("double")
    points = F.transform(given, lambda c: F.struct(F.when(on_globe(c), at(c, 0)).otherwise(bad).alias("lat"), at(c, 1).alias("lon"), F.nanvl(at(c, 2), F.lit(None).cast("double")).alias("ele")))
    end = lambda side: F.coalesce(f"t.{side}_key", F.lit("")).alias(f"{side}_key")
    pseudo = lambda side: F.coalesce(f"t.pseudo_{side}", F.lit(False)).alias(f"pseudo_{side}")
    named = F.coalesce(N.empty_to_null(F.col("name")), N.empty_to_null(F.col("official_name")), "route")
    return t.select("route", named.alias("name"), section.alias("section"), end("from"), end("to"), pseudo("from"), pseudo("to"), points.alias("points")).where(F.size("points") >= 2)
