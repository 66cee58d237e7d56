"""What the operators of this package share: reading tables, shared scratch space, connected groups."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or a local one where none is set and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trailnet-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, compression: str = "snappy", arrow_rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stands for the shuffles that led to it, so their files go at once. arrow_rows: rows of a batch that goes to Python meanwhile,
    where rows are wide. The session's settings are put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trailnet-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (ARROW_ROWS, CLEANUP)}
    try:
        spark.conf.set(ARROW_ROWS, str(arrow_rows or before[ARROW_ROWS]))
        spark.conf.set(CLEANUP, "true")
        # A frame keeps the plan it has once been given: this one is planned under the setting.
        df.select("*").write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    written().append(path)
    return spark.read.schema(df.schema).parquet(path)


_OWN = threading.local()


def written() -> list[str]:
    """The tables that this thread has materialized and not discarded, in order."""
    if not hasattr(_OWN, "paths"):
        _OWN.paths = []
    return _OWN.paths


def discard(spark: SparkSession, since: int) -> None:
    """Remove the tables materialized since written() had that length, but for the last: what the last was made from is not read again."""
    paths = written()
    for path in paths[since:-1]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    del paths[since:-1]


def blocks_for(total: int | None, per_block: int, least: int = 1) -> int:
    """How many blocks of about per_block hold total."""
    return max(least, -(-int(total or 0) // per_block))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links(a, b): component is the smallest id reachable.

    Alternates large-star and small-star rounds. Each is one grouped minimum and one join, both on ids, so nothing is
    gathered by component: a star of millions of ids is a minimum per id. Rounds grow with the log of the path length.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.*").where("u <> v").distinct())
        stats = "count(*) AS n", "coalesce(sum(CAST(xxhash64(u, v) AS DECIMAL(20, 0))), 0) AS s"
        if new.selectExpr(*stats).first() == edges.selectExpr(*stats).first():
            return new.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        edges = new
    raise RuntimeError("components did not settle")


BITMAP_WORDS = 1 << 17


def _place(key: Column) -> tuple[Column, Column]:
    """The word and the bit of a key in a bitmap."""
    h = F.xxhash64(key)
    return F.pmod(F.shiftright(h, 6), F.lit(BITMAP_WORDS)).alias("_word"), F.pmod(h, F.lit(64)).cast("int").alias("_bit")


def _bitmap_words(ids: DataFrame) -> DataFrame:
    """(_word, _bits) of those words of ids' (one column) bitmap that are not 0."""
    return ids.select(*_place(F.col(ids.columns[0]))).distinct().groupBy("_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"))


def maybe_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df with a column maybe: false only where key is not in ids (one column); true for some others too.

    A bitmap of BITMAP_WORDS longs, whatever the number of ids, so it is safe to broadcast. It spares rows a shuffle; an
    exact join must follow.
    """
    word, bit = _place(F.col(key))
    out = df.select("*", word, bit).join(F.broadcast(_bitmap_words(ids)), "_word", "left")
    hit = F.coalesce(F.getbit("_bits", "_bit") == 1, F.lit(False))
    return out.select(*[df[c] for c in df.columns], hit.alias("maybe"))


def bitmap(ids: DataFrame) -> Column:
    """The bitmap of maybe_in as one value, an array of all its words: for keys that are made in great numbers and need no join to be looked up."""
    every = ids.sparkSession.range(0, BITMAP_WORDS, 1, 1).join(F.broadcast(_bitmap_words(ids)), F.col("id") == F.col("_word"), "left")
    words = F.array_sort(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(words.alias("w")).select(F.col("w.bits")).scalar()


def maybe(bits: Column, key: Column) -> Column:
    """Whether key may be among the ids of bitmap bits: false only where it is not."""
    word, bit = _place(key)
    return F.getbit(F.get(bits, word.cast("int")), bit) == 1


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is not in ids (one column of distinct values); null is a key like others. Only rows that may be in ids are shuffled."""
    names, kind = df.columns, dict(df.dtypes)[key]
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    own, gone = f"c{names.index(key)}", ids.select(F.col(ids.columns[0]).cast(kind).alias("_gone"))
    split = maybe_in(inner, own, gone)
    open_ = split.where("maybe").join(gone, F.col(own).eqNullSafe(F.col("_gone")), "left_anti")
    return split.where("NOT maybe").unionByName(open_).select(inner.columns).toDF(*names)


#: A key with one row in so many is hot: at most so many keys are.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, found: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """rows with the columns of found, null where found (distinct keys, none null) lacks the row's key; copies and total say how many rows have a key and all do.

    Keys with a row in HOT_SHARE are looked up by a broadcast, of HOT_SHARE rows at most by their definition; all others go by a shuffle, in
    which no key has more rows than that share. Rows that are done, and null keys, are spread over all its tasks.
    """
    more = [c for c in found.columns if c not in (key, copies)]
    hot = F.col(copies) * HOT_SHARE >= F.lit(total)
    kept = F.struct(*more)
    few = found.where(hot).select(F.col(key).alias("_hot_key"), kept.alias("_hot"))
    rest = found.where(~hot).select(F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_salt"), kept.alias("_cold"))
    out = rows.join(F.broadcast(few), F.col(key) == F.col("_hot_key"), "left")
    done = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_salt", F.when(done, F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))).withColumn("_key", F.when(~done, F.col(key)))
    out = out.join(rest, (F.col("_key") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in more])


def in_ranges(df: DataFrame, order: list, parts: int) -> DataFrame:
    """df dealt into parts ranges of order and written, with _part: every row of a part comes before those of the next."""
    return materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
