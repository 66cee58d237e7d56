"""The driver tables as fixes, track points, tracks and places: what the queries of this package work on, and the same in SQL.

Both sides derive geometry from columns by the same arithmetic; every literal is a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, us, lat, lon): positions of users."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", "event_id", micros(F.col("ts")).alias("us"), (F.lit(42.0) + F.col("value") / F.lit(10000.0)).alias("lat"),
        (F.lit(-8.0) - (F.col("event_id") % 97).cast("double") / F.lit(1000.0)).alias("lon"),
    )


FIXES_SQL = """
    SELECT user_id, event_id, epoch_us(ts) AS us, CAST(42 AS DOUBLE) + value / CAST(10000 AS DOUBLE) AS lat,
           CAST(-8 AS DOUBLE) - CAST(event_id % 97 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon FROM events"""


def accel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ms, magnitude_sq): acceleration samples, a second apart in the order of time."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", (F.row_number().over(order) * F.lit(700)).cast("long").alias("ms"), (F.col("value") / F.lit(100.0)).alias("magnitude_sq"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, seq, lat, lon, ele): a track for each supplier; every seventh elevation is missing."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    seq = F.row_number().over(order)
    df = li.withColumn("seq", seq)
    return df.select(
        F.col("l_suppkey").alias("track"), F.col("seq").cast("long").alias("seq"), (F.lit(40.0) + F.col("l_quantity") / F.lit(10000.0)).alias("lat"),
        (F.lit(-3.0) - F.col("l_discount") / F.lit(100.0)).alias("lon"), F.when(F.col("seq") % 7 != 0, F.col("l_extendedprice") / F.lit(100.0)).alias("ele"),
    )


POINTS_SQL = """
    SELECT track, seq, lat, lon, CASE WHEN seq % 7 <> 0 THEN raw_ele END AS ele FROM (
      SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS seq,
             CAST(40 AS DOUBLE) + l_quantity / CAST(10000 AS DOUBLE) AS lat, CAST(-3 AS DOUBLE) - l_discount / CAST(100 AS DOUBLE) AS lon,
             l_extendedprice / CAST(100 AS DOUBLE) AS raw_ele FROM lineitem)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route, track, from_key, to_key, length_m, primary): a track for each order, between sixty places."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("route"), F.col("o_orderkey").alias("track"), (F.col("o_custkey") % 60).alias("from_key"),
        ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 60).alias("to_key"), F.col("o_totalprice").alias("length_m"), (F.col("o_orderkey") % 10 < 8).alias("primary"),
    )


TRACKS_SQL = """
    SELECT o_orderpriority AS route, o_orderkey AS track, o_custkey % 60 AS from_key, (o_custkey * 7 + o_orderkey) % 60 AS to_key,
           o_totalprice AS length_m, o_orderkey % 10 < 8 AS "primary" FROM orders"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, name, lat, lon, primary, route): observations of named places."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), (F.lit(40.0) + F.col("p_size").cast("double") / F.lit(20.0)).alias("lat"),
        (F.lit(-3.0) + (F.col("p_retailprice") % F.lit(100.0)) / F.lit(50.0)).alias("lon"), (F.col("p_partkey") % 4 != 0).alias("primary"), F.col("p_brand").alias("route"),
    )


PLACES_SQL = """
    SELECT p_partkey AS place, p_name AS name, CAST(40 AS DOUBLE) + CAST(p_size AS DOUBLE) / CAST(20 AS DOUBLE) AS lat,
           CAST(-3 AS DOUBLE) + (p_retailprice % CAST(100 AS DOUBLE)) / CAST(50 AS DOUBLE) AS lon, p_partkey % 4 <> 0 AS "primary", p_brand AS route FROM part"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    up, across = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    h = f"{up} * {up} + cos(radians({lat1})) * cos(radians({lat2})) * {across} * {across}"
    return f"(CAST({2 * EARTH_RADIUS_M} AS DOUBLE) * asin(sqrt(CASE WHEN {h} > 1 THEN CAST(1 AS DOUBLE) ELSE {h} END)))"


def rounded(x: Column, digits: int = 3) -> Column:
    """Half up by floor, so that both engines agree at ties."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def rounded_sql(x: str, digits: int = 3) -> str:
    return f"(floor(({x}) * CAST({10**digits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({10**digits} AS DOUBLE))"
