"""Direction and playback as rules, as folds, and as a stream in micro-batches."""

import math
import random
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from trailnet.functions import geo
from trailnet.operators import folds, navigation as N
from trailnet.streaming.navigator import navigate

SCHEMA = "user_id int, ms long, kind string, lat double, lon double, accuracy double, magnitude_sq double, x double, y double"
STEP = 0.00005  # 5.6 m of latitude


def fix(ms, lat, lon, accuracy=None):
    return {"ms": ms, "kind": N.FIX, "lat": lat, "lon": lon, "accuracy": accuracy, "magnitude_sq": None, "x": None, "y": None}


def shake(ms, m):
    return {"ms": ms, "kind": N.ACCELERATION, "lat": None, "lon": None, "accuracy": None, "magnitude_sq": m, "x": None, "y": None}


def look(ms, degrees, size=1.0):
    r = math.radians(degrees)
    return {"ms": ms, "kind": N.ROTATION, "lat": None, "lon": None, "accuracy": None, "magnitude_sq": None, "x": math.sin(r) * size, "y": math.cos(r) * size}


def go(rows, state=None, step=None):
    step, out = step or N.direction(), []
    for r in rows:
        state, o = step(state, r)
        out.append(o)
    return state, out


def moving(from_ms=0):
    return [shake(from_ms + 100 * i, 9.0) for i in range(40)]


def still(from_ms):
    return [shake(from_ms + 100 * i, 0.0) for i in range(80)]


def test_first_fix_counts_and_others_wait_for_movement():
    state, out = go([fix(0, 42.0, -3.0, 30.0), fix(1, 42.0, -3.0, 25.0), fix(2, 42.1, -3.0), *moving(10), fix(3000, 42.0, -2.9999), fix(3001, None, 1.0)])
    assert [o["accepted"] for o in out][:3] == [False, True, False] and out[-2]["accepted"] and out[-2]["kept"] and not out[-1]["accepted"]
    assert state.motion == "MOVING" and state.history[0] == (42.0, -3.0)


def test_course_needs_its_baseline_and_moving_clears_the_history():
    walk = [fix(3000 + i, 42.0 + STEP * i, -3.0) for i in range(4)]
    state, out = go([fix(0, 42.0, -3.0), *moving(), *walk])
    assert [o["course"] is None for o in out[-4:]] == [True, True, False, False] and out[-1]["course"] == pytest.approx(0.0)
    assert len(state.history) == 4
    rest, _ = go(still(4000), state)
    assert rest.motion == "STATIONARY" and len(rest.history) == 4
    again, _ = go(moving(13000), rest)
    assert again.motion == "MOVING" and again.history == (again.accepted,)


def test_history_is_bounded_and_small_steps_are_not_points():
    walk = [fix(3000 + i, 42.0 + STEP * i, -3.0) for i in range(200)]
    state, _ = go([fix(0, 42.0, -3.0), *moving(), *walk])
    assert len(state.history) == N.HISTORY
    same, out = go([fix(9000 + i, 42.0 + STEP * 199, -3.0) for i in range(5)], state)
    assert same.history == state.history and not any(o["kept"] for o in out) and all(o["accepted"] for o in out)


def test_heading_at_rest_follows_the_camera():
    walk = [fix(3000 + i, 42.0 + STEP * i, -3.0) for i in range(4)]
    state, _ = go([fix(0, 42.0, -3.0), *moving(), look(2900, 80.0), *walk])
    assert state.heading == pytest.approx(0.0) and state.reference == pytest.approx(80.0)
    state, out = go([look(3500, 90.0), *still(4000), look(13000, 60.0), look(13001, 10.0, 0.1), look(13002, 120.0)], state)
    # The yaw when the walker came to rest is the reference; too small a rotation is passed over.
    assert [round(o["heading"], 6) for o in out[-3:]] == [330.0, 330.0, 30.0]


def test_playback_curves():
    row = lambda ms, lat, lon, motion="MOVING", course=None, heading=None: {"ms": ms, "lat": lat, "lon": lon, "motion": motion, "course": course, "heading": heading}
    state, out = None, []
    for r in (row(0, 42.0, -3.0), row(1000, 42.001, -3.0), row(1000, 50.0, 0.0), row(2000, 42.001, -2.999), row(2100, 42.002, -2.999)):
        state, o = N.playback(state, r)
        out.append(o)
    assert out[0]["duration_ms"] is None and out[2]["duration_ms"] is None
    assert out[1] == {"from_lat": 42.0, "from_lon": -3.0, "start_bearing": pytest.approx(0.0), "end_bearing": pytest.approx(0.0), "duration_ms": 820}
    assert out[3]["start_bearing"] == pytest.approx(0.0) and out[3]["end_bearing"] == pytest.approx(90 * 0.72, abs=0.1)
    # The last one begins where the curve of 820 ms has come to after 100, pointing as it does there.
    at = N.curve_at((42.001, -3.0), (42.001, -2.999), out[3]["start_bearing"], out[3]["end_bearing"], 100 / 820)
    assert (out[4]["from_lat"], out[4]["from_lon"]) == pytest.approx(at) and out[4]["duration_ms"] == 420
    state, _ = N.playback(state, row(9000, 42.002, -2.998, "STATIONARY", 90.0, 120.0))
    state, o = N.playback(state, row(20000, 42.003, -2.998, "MOVING", 90.0, 120.0))
    assert o["start_bearing"] == pytest.approx((state.curve[3]) % 360) and state.departure is not None


def test_curves_equal_the_column_functions(spark):
    rng = random.Random(1)
    cases = [(*[rng.uniform(-60, 60) for _ in range(4)], rng.uniform(0, 360), rng.uniform(0, 360), rng.random()) for _ in range(40)]
    df = spark.createDataFrame(cases, "a double, b double, c double, d double, s double, e double, t double")
    for r in df.select("*", geo.hermite("a", "b", "c", "d", "s", "e", "t").alias("p"), geo.hermite_bearing("a", "b", "c", "d", "s", "e", "t").alias("h")).collect():
        assert N.curve_at((r.a, r.b), (r.c, r.d), r.s, r.e, r.t) == pytest.approx((r.p.lat, r.p.lon))
        assert N.curve_bearing((r.a, r.b), (r.c, r.d), r.s, r.e, r.t) == pytest.approx(r.h)


def journey(user):
    rng = random.Random(user)
    rows, ms = [fix(0, 42.0, -3.0)], 100
    for leg in range(3):
        rows += moving(ms)
        ms += 4100
        for i in range(12):
            rows += [fix(ms + 300 * i, 42.0 + STEP * i * (leg + 1), -3.0 + user * STEP * i), look(ms + 300 * i + 50, rng.uniform(0, 360))]
        ms += 4000
        rows += still(ms)
        rows += [look(ms + 8100 + 10 * i, rng.uniform(0, 360)) for i in range(5)]
        ms += 9000
    return [(user, *[r[c] for c in ("ms", "kind", "lat", "lon", "accuracy", "magnitude_sq", "x", "y")]) for r in rows]


@pytest.fixture
def column_families(spark):
    """The state store that transformWithState needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


@contextmanager
def running(df, tmp_path):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        yield q
    finally:
        q.stop()


def read(q, n, seconds=90):
    """Wait until q has read n rows and gone on to a batch after them."""
    until, seen = time.monotonic() + seconds, {}
    while time.monotonic() < until:
        assert q.exception() is None
        seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
        if sum(seen.values()) >= n and not q.lastProgress["numInputRows"]:
            return
        time.sleep(0.2)
    raise AssertionError(f"{sum(seen.values())} of {n} rows")


def test_a_silent_walker_is_forgotten(spark, tmp_path, column_families):
    src = tmp_path / "in"
    put = lambda ms: spark.createDataFrame([(1, *[fix(ms, 42.0, -3.0)[c] for c in ("ms", "kind", "lat", "lon", "accuracy", "magnitude_sq", "x", "y")])], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    put(0)
    stream = spark.readStream.schema(SCHEMA).parquet(str(src))
    with running(navigate(stream, idle_ms=1000).select("ms", "accepted"), tmp_path) as q:
        read(q, 1)
        time.sleep(6)
        put(1)
        read(q, 2)
    # Standing still, a second fix would not count if the first were remembered.
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(0, True), (1, True)]


def test_stream_equals_fold(spark, tmp_path, column_families):
    rows = journey(1) + journey(2)
    whole = spark.createDataFrame(rows, SCHEMA)
    names = ["user_id", "ms", "kind", "accepted", "kept", "motion", "course", "heading"]
    tidy = lambda df: sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()], key=str)
    want = tidy(folds.fold(whole, ["user_id"], ["ms"], N.direction(), N.OUTPUTS))
    assert {w[5] for w in want} == {"UNKNOWN", "MOVING", "STATIONARY"} and sum(w[3] for w in want) > 40
    src, cuts = tmp_path / "in", [-1, 6000, 17000, 30000, 10**9]
    for low, high in zip(cuts, cuts[1:]):
        whole.where((F.col("ms") > low) & (F.col("ms") <= high)).coalesce(1).write.mode("append").parquet(str(src))
    known = spark.createDataFrame([(3, "MOVING", 42.0, -3.0, 45.0)], "user_id int, motion string, lat double, lon double, course double")
    late = spark.createDataFrame([(3, *[fix(90000, 42.0 + STEP / 4, -3.0)[c] for c in ("ms", "kind", "lat", "lon", "accuracy", "magnitude_sq", "x", "y")])], SCHEMA)
    late.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
    with running(navigate(stream, known=known).select(*names), tmp_path) as q:
        read(q, len(rows) + 1)
    got = tidy(spark.read.parquet(str(tmp_path / "out")))
    # Walker 3 was known to be moving by a course: the fix counts at once, and is too near for a point of its own.
    assert [g for g in got if g[0] == 3] == [(3, 90000, N.FIX, True, False, "MOVING", 45.0, 45.0)]
    assert [g for g in got if g[0] != 3] == want
