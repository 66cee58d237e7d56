from pyspark.sql import functions as F

from trailnet.operators import view


def test_course_and_last(spark):
    df = spark.createDataFrame([(1, i, 0.0001 * i, 0.0) for i in range(5)] + [(2, 0, 0.0, 0.0)], "user_id int, us long, lat double, lon double")
    assert {r.user_id: r.course for r in view.course_over(df).collect()} == {1: 0.0, 2: None}
    assert [r.us for r in view.last_positions(df.where("user_id = 1"), 2, ["user_id"], ["us"]).orderBy("us").collect()] == [3, 4]


def test_samples(spark):
    df = spark.createDataFrame([("v", 0, 1.0, 0.0), ("v", 1, 5.0, 1.0), ("v", 2, 5.0, 1.5), ("v", 3, 2.0, 100.0)], "view string, seq int, x double, y double")
    assert view.nearest_sample(df, "y", F.lit(1.25), ["view"], ["seq"]).first().seq == 1
    assert [(r.strip, r.seq) for r in view.rightmost_per_row(df, ["view"]).orderBy("strip").collect()] == [(0, 1), (50, 3)]
    assert [r.break_before for r in view.gap_breaks(df, "y", ["view"]).orderBy("y").collect()] == [True, False, False, True]
    h = spark.createDataFrame([("v", "a", 1, 0.0, 0.0), ("v", "b", 0, 0.0, 0.0), ("v", "c", 0, 90.0, 0.0)], "view string, handle string, priority int, hx double, hy double")
    assert view.pick_handle(h, F.lit(1.0), F.lit(1.0)).first().handle == "b"


def test_sweep(spark):
    ends = [("r", 1, 0, 0.0, 0.0), ("r", 1, 1, 0.0, 0.01), ("r", 2, 0, 0.0, 0.012), ("r", 2, 1, 0.0, 0.02)]
    got = view.topology_sweep(spark.createDataFrame(ends, "route string, track int, side int, lat double, lon double"), (100.0, 500.0)).collect()
    assert {r.threshold_m: r.components for r in got} == {100.0: 2, 500.0: 1}
