"""Rules with a state that runs along ordered rows, shared by batch folds and streams.

A rule is a function step(state, row) -> (state, output): state is a small tuple (None at first), row and output are dicts. fold() runs it over rows
dealt out by key and sorted within their partition, one row at a time, so a key with a third of all rows needs no memory; the streaming twin
(trailnet.streaming.stateful) keeps the same state between micro-batches.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

#: Mean radius of the earth; motion thresholds on the root mean square, confirmation time.
EARTH_RADIUS_M = 6371008.8
STILL_BELOW, MOVING_ABOVE, CONFIRM_MS, EWMA_KEEP = 1.50, 1.80, 1500, 0.96


def haversine(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    up, across = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    h = up * up + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * across * across
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def thin(spacing_m: float):
    """kept: whether a position is at least spacing_m from the last one kept; the first is kept."""

    def step(state, row):
        here = (row["lat"], row["lon"])
        kept = state is None or haversine(*state, *here) >= spacing_m
        return (here if kept else state), {"kept": kept}

    return step


def ewma(state, row):
    """mean_sq: the running mean of squared magnitudes; a zero mean takes over the next value."""
    m = row["magnitude_sq"]
    r = m if state is None or state[0] == 0 else EWMA_KEEP * state[0] + (1 - EWMA_KEEP) * m
    return (r,), {"mean_sq": r}


def motion(state, row):
    """motion: UNKNOWN, STATIONARY or MOVING; a state is confirmed once its condition has held for CONFIRM_MS. In between the thresholds both timers stop and the state stays."""
    mean, still_at, moving_at, now = state or (0.0, None, None, "UNKNOWN")
    (mean,), _ = ewma((mean,), row)
    rms, ms = math.sqrt(mean), int(row["ms"])
    if rms < STILL_BELOW:
        still_at, moving_at = ms if still_at is None else still_at, None
        if ms - still_at >= CONFIRM_MS:
            now = "STATIONARY"
    elif rms > MOVING_ABOVE:
        moving_at, still_at = ms if moving_at is None else moving_at, None
        if ms - moving_at >= CONFIRM_MS:
            now = "MOVING"
    else:
        still_at = moving_at = None
    return (mean, still_at, moving_at, now), {"motion": now}


def travel(min_move_m: float, max_jump_m: float, max_gap_us: int):
    """distance_m, moving_us: movement so far; the baseline moves on with every position."""

    def step(state, row):
        here = (int(row["us"]), row["lat"], row["lon"])
        if state is None:
            return (*here, 0.0, 0), {"distance_m": 0.0, "moving_us": 0}
        us, lat, lon, distance, moving = state
        gap = here[0] - us
        d = haversine(lat, lon, *here[1:])
        if 0 < gap <= max_gap_us and min_move_m <= d <= max_jump_m:
            distance, moving = distance + d, moving + gap
        return (*here, distance, moving), {"distance_m": distance, "moving_us": moving}

    return step


def in_order(state, row):
    """fresh: whether a row is later than all before it; others are to be dropped."""
    ms = int(row["ms"])
    fresh = state is None or ms > state[0]
    return ((ms,) if fresh else state), {"fresh": fresh}


def throttle(least_ms: int):
    """publish: whether least_ms have passed since the last row published."""

    def step(state, row):
        ms = int(row["ms"])
        go = state is None or ms - state[0] >= least_ms
        return ((ms,) if go else state), {"publish": go}

    return step


def gate(max_accuracy_m: float = 25.0):
    """accepted: of fixes no less accurate than max_accuracy_m (or of unknown accuracy) the first, and later ones while motion is MOVING."""

    def step(state, row):
        acc = row.get("accuracy")
        good = acc is None or acc != acc or acc <= max_accuracy_m
        go = good and (state is None or row.get("motion") == "MOVING")
        return ((1,) if go else state), {"accepted": go}

    return step


def profile_samples(spacing_m: float):
    """emit: the first sample, those at breaks, and those at least spacing_m from the last one emitted."""

    def step(state, row):
        go = state is None or bool(row["break_before"]) or row["along_m"] - state[0] >= spacing_m
        return ((row["along_m"],) if go else state), {"emit": go}

    return step


def selection(state, row):
    """Two taps choose start and end, a third starts anew; a miss (null target) clears both."""
    start, end = state or (None, None)
    t = row["target"]
    if t is None or t != t:
        start = end = None
    elif start is None or end is not None:
        start, end = t, None
    else:
        end = t
    return (start, end), {"start": start, "end": end}


def smooth_bearing(tau_ms: float = 2200.0, deadband_deg: float = 1.25, longest_ms: int = 100):
    """bearing: follows target by the share 1 - exp(-dt / tau_ms) of the shorter turn, dt at most longest_ms; turns within the deadband are passed over."""

    def step(state, row):
        ms, target = int(row["ms"]), row["target"] % 360.0
        if state is None:
            return (ms, target), {"bearing": target}
        then, now = state
        turn = (target - now + 540.0) % 360.0 - 180.0
        if abs(turn) > deadband_deg:
            now = (now + turn * -math.expm1(-max(0, min(longest_ms, ms - then)) / tau_ms)) % 360.0
        return (ms, now), {"bearing": now}

    return step


def fold(df: DataFrame, keys: list[str], order: list[str], step, outputs: str) -> DataFrame:
    """df with the columns of outputs (a schema string), from step over each key's rows in order. Nulls are None to step; a null key is one key like others."""
    added = DataType.fromDDL(outputs)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]
    plain = lambda v: "nan" if v != v else v  # noqa: E731  NaN is one key too

    def run(batches):
        at = state = None
        for batch in batches:
            got = {c: [] for c, _ in kinds}
            for row in batch.to_pylist():
                key = tuple(plain(row[k]) for k in keys)
                if key != at:
                    at, state = key, None
                state, out = step(state, row)
                for c in got:
                    got[c].append(out[c])
            new = [pa.array(got[c], kind) for c, kind in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *got])

    schema = StructType([*df.schema.fields, *added.fields])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
