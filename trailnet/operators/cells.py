"""Grid cells on the globe: the cell of a point, and the cells that points within a radius of it may be in.

Rows are a radius high. Each row has as many columns as fit around it at its edge nearer to a pole, so a column is a radius wide at least;
columns go round at 180 degrees, and rows at the poles have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m
from .graph import unsent

DEGREE_M = 3.141592653589793 * EARTH_RADIUS_M / 180
#: Cells are wider than the radius by this factor, for what distances lose to rounding.
_SLACK = 1.000001


def _size(radius_m: float) -> float:
    return radius_m * _SLACK / DEGREE_M


def _row(lat: Column, size: float) -> Column:
    return F.floor((lat + 90.0) / size)


def _columns(row: Column, size: float) -> Column:
    """How many columns a row has."""
    low = row * size - 90.0
    edge = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(low + size)))
    return F.greatest(F.lit(1).cast("long"), F.floor(F.cos(F.radians(edge)) * 360.0 / size))


def cell(lat: Column, lon: Column, radius_m: float) -> Column:
    """struct(i, j): the cell of a point."""
    size = _size(radius_m)
    row = _row(lat, size)
    n = _columns(row, size)
    return F.struct(row.alias("i"), F.least(n - 1, F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n)).alias("j"))


def row_cells(row: Column, low: Column, high: Column, radius_m: float) -> Column:
    """The cells of a row from longitude low to high, both within 180 degrees."""
    n = _columns(row, _size(radius_m))
    first, last = (F.least(n - 1, F.floor((lon + 180.0) / 360.0 * n)) for lon in (low, high))
    return F.transform(F.sequence(first, last), lambda j: F.struct(row.alias("i"), F.pmod(j, n).alias("j")))


def around(lat: Column, lon: Column, radius_m: float) -> Column:
    """The distinct cells that a point within radius_m may be in: nine or a few more, near the poles too."""
    size = _size(radius_m)
    own = _row(lat, size)
    polar = F.abs(lat) + size >= 90.0
    reach = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(size))) / F.cos(F.radians(lat))))) * _SLACK)

    def of_row(row: Column) -> Column:
        n = _columns(row, size)
        low, high = F.floor((lon + 180.0 - reach) / 360.0 * n), F.floor((lon + 180.0 + reach) / 360.0 * n)
        high = F.least(high, low + n - 1)
        return F.transform(F.sequence(low, high), lambda j: F.struct(row.alias("i"), F.pmod(j, n).alias("j")))

    return F.flatten(F.transform(F.array(own - 1, own, own + 1), of_row))


def near(left: DataFrame, right: DataFrame, radius_m: float, same: list[str] = (), name: str = "distance_m") -> DataFrame:
    """Every row of left(lat, lon, ...) with every row of right(to_lat, to_lon, ...) within radius_m, equal in the columns same; name: the distance.

    An equi-join on cells: left is written once for each cell around it, right once. The exact distance decides.
    """
    a = left.withColumn("_cell", F.explode(around(F.col("lat"), F.col("lon"), radius_m)))
    b = right.withColumn("_cell", cell(F.col("to_lat"), F.col("to_lon"), radius_m))
    return unsent(a).join(b, ["_cell", *same]).drop("_cell").withColumn(name, haversine_m("lat", "lon", "to_lat", "to_lon")).where(F.col(name) <= radius_m)
