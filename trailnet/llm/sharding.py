"""Shards with the mixture of the whole: proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked there. Row number r of n has the fraction (r - 1 + p) / n, where p, from 0
to 1, is the source's own phase, so that sources of few rows don't all meet in one place; sorted by this fraction, every stretch of rows holds each source in proportion. The order is cut into shards of equal
row counts, at most one apart.

Ranks are counted without gathering a source or the table in one task: rows fall into bins by their hash (or fraction), which
are even since hashes are; the bins are counted, running sums over these counts give each bin's first rank, and only the
rows of a bin are sorted together.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, materialize


#: Of sources, so many are a small table.
FEW_STRATA = 100_000
#: Steps of a stratum's phase.
PHASES = 1 << 16


def bin_rows(total: int, least: int = 1000) -> int:
    """Rows of a bin: about as many as there are bins, so that neither the rows of a bin nor the counts of all bins are many."""
    return max(least, isqrt(total))


def distributed_rank(df: DataFrame, group: list[str], bins: Column, order: list[Column], name: str) -> DataFrame:
    """df with name: the place of each row, from 1, in its group, ordered by bins and within a bin by order."""
    df = df.withColumn("_bin", bins).repartition(*group, "_bin")  # not by a whole group, as a join before may have left it
    counts = df.groupBy(*group, "_bin").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*group, "_bin", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "_bin").orderBy(*order))
    return df.withColumn("_within", within).join(counts, [*group, "_bin"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_bin", "_before", "_within")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, rows_per_bin: int | None = None) -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text, source).

    size: UTF-8 bytes of text (null: none) plus 1. text_crc32: of the UTF-8 bytes (null: as empty). law is "rows": shard
    sizes are at most one row apart. slot: the place in the shard, from 0. grown_shard is null: under this law one more shard moves
    rows between shards. A null source is a stratum of its own. Ties of the shuffle (rows with one doc_id) are ordered
    by text_crc32 and size; rows equal in all of these are interchangeable. Other columns of docs are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_shuffle"),
    ).withColumn("_stratum", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = materialize(rows)
    total = rows.count()
    rows_per_bin = rows_per_bin or bin_rows(total)
    strata = materialize(rows.groupBy("_stratum").agg(F.count("*").alias("_n")))
    if strata.count() <= FEW_STRATA:
        strata = F.broadcast(strata)
    sized = rows.join(strata, "_stratum")
    order = [F.col("_shuffle"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    # Of 2^32 values of the hash's first half word, as many bins as the stratum needs.
    first = F.conv(F.substring("_shuffle", 1, 8), 16, 10).cast("long")
    bins = F.floor(first * F.ceil(F.col("_n") / rows_per_bin) / F.lit(float(1 << 32))).cast("long")
    ranked = distributed_rank(sized, ["_stratum", "_n"], bins, order, "_rank")
    # As a whole number of 2^-40ths, rounded down: ties go on to the stratum.
    phase = F.pmod(F.crc32(F.concat("_stratum", F.lit(f"/{seed}"))), F.lit(PHASES))
    ranked = ranked.withColumn("_phase", phase).withColumn("_fraction", F.expr(f"CAST(((_rank - 1) * {PHASES} + _phase) * CAST({(1 << 40) // PHASES} AS DECIMAL(20, 0)) / _n AS BIGINT)")).drop("_phase")
    parts = blocks_for(total, rows_per_bin)
    placed = distributed_rank(ranked.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_fraction") * F.lit(parts) / F.lit(float(1 << 40))).cast("long"), [F.col("_fraction"), F.col("_stratum"), *order], "_place")
    # Shard k has the places from floor(k * total / shards) on.
    place = F.col("_place") - 1
    shard = F.expr(f"CAST((_place * {shards} - 1) DIV {max(total, 1)} AS INT)")
    first_of = F.floor(F.col("shard") * F.lit(total) / F.lit(shards)).cast("long")
    out = placed.withColumn("shard", shard).withColumn("slot", place - first_of)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, rows_per_bin: int | None = None) -> None:
    """Write docs under path, one folder per shard, the rows of a file in the order of their slots. Rows with one doc_id go where the first goes."""
    where = interleave(docs, shards, seed, rows_per_bin).groupBy("doc_id").agg(F.min_by("shard", "slot").alias("shard"), F.min("slot").alias("slot"))
    total = where.count()
    parts = blocks_for(total, rows_per_bin or bin_rows(total))
    placed = docs.join(where.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id"))).drop("_id")
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
