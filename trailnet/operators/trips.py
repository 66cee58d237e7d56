"""Trip statistics from positions: what counts as movement, sessions, state as of a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

#: Defaults of the rules; all are parameters.
MIN_MOVE_M, MAX_JUMP_M, MAX_GAP_US = 3.0, 250.0, 15 * 60 * 1_000_000


def movements(fixes: DataFrame, min_move_m: float = MIN_MOVE_M, max_jump_m: float = MAX_JUMP_M, max_gap_us: int = MAX_GAP_US, keys=("user_id",), order=("us",)) -> DataFrame:
    """fixes with gap_us and move_m since the fix before, and counts: whether that step is movement.

    The baseline moves on with every fix, counted or not. A step over max_gap_us, or none in time, only sets it anew.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = fixes.withColumn("gap_us", F.col("us") - F.lag("us").over(w))
    df = df.withColumn("move_m", haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"))
    timely = (F.col("gap_us") > 0) & (F.col("gap_us") <= max_gap_us)
    counts = timely & (F.col("move_m") >= min_move_m) & (F.col("move_m") <= max_jump_m)
    return df.withColumn("counts", F.coalesce(counts, F.lit(False)))


def kmh(metres: Column, us: Column) -> Column:
    return F.when(us > 0, metres / (us.cast("double") / 1e6) * 3.6)


def trip_stats(fixes: DataFrame, keys=("user_id",), **rules) -> DataFrame:
    """For each user: fixes, distance, time in movement and in all, and the two speeds."""
    moved = movements(fixes, keys=keys, **rules).groupBy(*keys).agg(
        F.count("*").alias("fixes"), F.coalesce(F.sum(F.when(F.col("counts"), F.col("move_m"))), F.lit(0.0)).alias("distance_m"),
        F.coalesce(F.sum(F.when(F.col("counts"), F.col("gap_us"))), F.lit(0)).alias("moving_us"), (F.max("us") - F.min("us")).alias("total_us"),
    )
    return moved.withColumn("moving_kmh", kmh(F.col("distance_m"), F.col("moving_us"))).withColumn("total_kmh", kmh(F.col("distance_m"), F.col("total_us")))


def sessions(fixes: DataFrame, max_gap_us: int = MAX_GAP_US, keys=("user_id",), **rules) -> DataFrame:
    """The same for each session: stretches of fixes no more than max_gap_us apart."""
    df = movements(fixes, max_gap_us=max_gap_us, keys=keys, **rules)
    w = Window.partitionBy(*keys).orderBy("us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("session", F.sum(F.when(F.col("gap_us") <= max_gap_us, 0).otherwise(1)).over(w))
    return df.groupBy(*keys, "session").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("fixes"),
        F.coalesce(F.sum(F.when(F.col("counts"), F.col("move_m"))), F.lit(0.0)).alias("distance_m"),
    )


def arrival(stats: DataFrame, left_m: Column, now_us: Column, least_kmh: float = 0.4) -> DataFrame:
    """stats with eta_us: now plus the way left at the overall speed, or the moving speed, whichever first reaches least_kmh."""
    v = F.when(F.col("total_kmh") >= least_kmh, F.col("total_kmh")).when(F.col("moving_kmh") >= least_kmh, F.col("moving_kmh"))
    return stats.withColumn("eta_us", (now_us + F.round(left_m / (v / 3.6) * 1e6)).cast("long"))


def hysteresis(df: DataFrame, value: str, on_at_most: float, off_above: float, keys, order, name: str = "active") -> DataFrame:
    """name: true from a value of on_at_most or less until one over off_above; false before the first decisive one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decisive = F.when(F.col(value) <= on_at_most, F.lit(True)).when(F.col(value) > off_above, F.lit(False))
    return df.withColumn(name, F.coalesce(F.last(decisive, ignorenulls=True).over(w), F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """left with the values of the latest row of right at or before its time: both in one stream of time, filled forward.

    One shuffle by keys; rows of right with the same keys and time count in the order of their values."""
    l = left.select("*", *[F.lit(None).cast(t).alias(f"_{c}") for c, t in right.dtypes if c in values], F.lit(1).alias("_side"))  # noqa: E741
    r = right.select(*keys, time, *[F.col(c).alias(f"_{c}") for c in values], F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side", *[f"_{c}" for c in values]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{c}").alias(c) for c in values])), ignorenulls=True).over(w)
    return both.withColumn("_state", filled).where("_side = 1").select(*left.columns, *[F.col(f"_state.{c}").alias(c) for c in values])
