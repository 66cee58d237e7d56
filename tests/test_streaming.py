from pyspark.sql import functions as F

from trailnet.operators import folds
from trailnet.streaming import stateful as S

SCHEMA = "user_id int, ms long, magnitude_sq double"


def test_stream_equals_fold(spark, tmp_path):
    rows = [(u, 500 * i, float((i * u) % 7)) for u in (1, 2) for i in range(30)]
    whole = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, folds.fold(whole, ["user_id"], ["ms"], folds.motion, "motion string").select("user_id", "ms", "motion").collect()))
    src, done = tmp_path / "in", tmp_path / "out"
    for k in range(3):
        whole.where(f"ms >= {k * 5000} AND ms < {(k + 1) * 5000}").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
    out = S.stateful(stream, ["user_id"], ["ms"], folds.motion, "motion string").select("user_id", "ms", "motion")
    q = out.writeStream.format("parquet").option("path", str(done)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(done)).collect())) == want


def test_windows_over_event_time(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.range(20).select((F.col("id") % 2).cast("int").alias("user_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    df.union(df.limit(3)).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("user_id int, ts timestamp").parquet(str(src))
    q = S.window_counts(S.dedup_fixes(stream, ["user_id"], "ts"), ["user_id"], "ts", late=None).writeStream.format("memory").queryName("counts").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("counts").agg(F.max("fixes")).first()[0] == 3
