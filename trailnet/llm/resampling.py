"""Rows that look like a target: importance resampling by hashed word runs.

Identical texts are one row: texts are grouped whole, features are counted and weighed once for each, and what a text adds to the counts of the
corpus is multiplied by its copies. A bucket's gain is the log of the ratio of its smoothed shares in the target and in the corpus, in
thousandths; a text's weight is the sum of gains over its features. Weights are then joined back to every document, which adds noise of its own
(a Gumbel draw from its id), so that the highest scores are a draw without replacement in proportion to the weights.

A text's features are kept as gaps between its buckets and how often each occurs. Totals are at most `buckets` numbers on the driver; texts
with very many copies are joined by a broadcast of bounded size (common.spread_join); ranks are counted in ranges of scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, in_ranges, materialize, spread_join

BUCKETS = 10_000
RUN = 3
SEED = 42
LEAST_WORDS = 20
#: Rows of a range of scores, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 20_000, 10_000
#: Texts in a batch that goes to Python, and that are laid out there at once.
BATCH = 256

#: Bytes of words stay, A to Z as a to z; all others part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def hashed_runs(words: list[bytes], run: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to run words: the checksum of a longer run goes on from that of the run one shorter."""
    spaced, sums, out = [b" " + w for w in words], list(map(crc32, words)), []
    for k in range(1, run + 1):
        out.append(np.fromiter(sums, np.uint32, len(sums)))
        sums = list(map(crc32, spaced[k:], sums))
    return (np.concatenate(out) % buckets).astype(np.int64)


def _counted(df: DataFrame, run: int, buckets: int) -> DataFrame:
    """(key, copies, n_words, n_features, gaps, times) for each different text of df(text)."""
    texts = df.where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = hashed_runs(words, run, buckets)
                at, times = np.unique(found, return_counts=True)
                rows.append((len(words), len(found), np.diff(at, prepend=0).astype(np.int32), times.astype(np.int32)))
            n_words, n_features, gaps, times = zip(*rows, strict=True) if rows else ([], [], [], [])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("copies"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(gaps, ints), pa.array(times, ints)],
                ["key", "copies", "n_words", "n_features", "gaps", "times"],
            )

    schema = "key binary, copies long, n_words long, n_features long, gaps array<int>, times array<int>"
    return materialize(texts.mapInArrow(count, schema), "zstd", BATCH)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of batches, BATCH at a time: laid out feature by feature a text takes many times its row."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, times) of all features of a batch's texts."""
    gaps, times = batch.column("gaps"), batch.column("times")
    sizes = np.diff(np.asarray(gaps.offsets))
    row = np.repeat(np.arange(batch.num_rows), sizes)
    run = np.cumsum(np.asarray(gaps.flatten()), dtype=np.int64)
    before = np.concatenate(([0], run))[np.cumsum(sizes) - sizes]
    return row, run - before[row], np.asarray(times.flatten()).astype(np.int64)


def _totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, copies counted: a task sums its texts, and only sums leave it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in _pieces(batches):
            row, at, times = _flat(batch)
            np.add.at(own, at, times * np.asarray(batch.column("copies"))[row])
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in counted.select("copies", "gaps", "times").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    buckets, t_all, s_all = len(target), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + buckets) / ((int(s) + 1) * (t_all + buckets)))) for t, s in zip(target, corpus, strict=True)], np.int64)


def _weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, at, times = _flat(batch)
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row, gain[at] * times)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), batch.column("n_words"), batch.column("n_features"), pa.array(sums)], ["key", "copies", "n_words", "n_features", "weight"])

    return counted.mapInArrow(weigh, "key binary, copies long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) for every row of docs(doc_id, text): which of them to draw to look like target(text).

    Words are runs of a to z (A to Z lower-cased), 0 to 9 and characters beyond ASCII; features are runs of 1 to run words joined by a space, in
    buckets by their CRC-32. Of the N rows with least_words words the floor(share * N) highest scores have a rank, from 1, ties to the smaller doc_id
    (null last; rows equal in both are interchangeable); for all others it is null. Null and empty texts have no features and weight 0. The noise of
    a null doc_id is that of the empty string. Repeated rows are rows of their own. Without target rows all gains are those of an empty target. Other
    columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = _counted(own.select("text"), run, buckets)
    wanted = _counted(target.select(F.col("text").cast("string").alias("text")), run, buckets)
    weights = materialize(_weighed(counted, gains(_totals(wanted, buckets), _totals(counted, buckets))))
    total = int(weights.agg(F.sum("copies")).first()[0] or 0)
    rows = own.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    joined = spread_join(rows, weights, "key", "copies", total)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    none = F.lit(0).cast("long")
    weight, n_words = F.coalesce("weight", none), F.coalesce("n_words", none)
    scored = materialize(joined.select("doc_id", F.coalesce("n_features", none).alias("n_features"), weight.alias("weight"), (weight + noise).alias("score"), n_words.alias("n_words"), (n_words >= least_words).alias("_open")))
    n_rows, n_open = scored.agg(F.count("*"), F.count_if("_open")).first()
    draw = share[0] * n_open // share[1]
    order = [F.col("_open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = in_ranges(scored.withColumn("_tie", F.monotonically_increasing_id()), [*order, "_tie"], min(MOST_RANGES, blocks_for(n_rows, range_rows)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), none)
    sizes = sizes.select("_part", before.alias("_before")).where(F.col("_before") < draw)  # at most MOST_RANGES rows
    upper, lower = (ranged.join(F.broadcast(sizes), "_part", how) for how in ("inner", "left_anti"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part", "_before").orderBy(*order))
    rank = F.when(F.col("_open") & (F.col("_place") <= draw), F.col("_place")).cast("long")
    names = "doc_id", "n_features", "weight", "score"
    upper = upper.withColumn("_place", place).select(*names, rank.alias("rank"), "n_words")
    return upper.unionByName(lower.select(*names, F.lit(None).cast("long").alias("rank"), "n_words"))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that resample ranks, with all their columns; rows of one doc_id go where the first goes."""
    ids = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
_BYTES = "list_transform(range(strlen({x})), lambda i: CAST(position(substr(hex({x}), 2 * i + 1, 1) IN '0123456789ABCDEF') * 16 + position(substr(hex({x}), 2 * i + 2, 1) IN '0123456789ABCDEF') - 17 AS BIGINT))"

ORACLE = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS tab),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
worded AS (
  SELECT row_number() OVER () AS r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT r, side, unnest(flatten([
    list_transform(range(1, len(w) + 1), lambda i: w[i]), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS f FROM worded),
counted AS (SELECT r, side, f, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (SELECT f, {_BYTES.format(x="f")} AS b FROM (SELECT DISTINCT f FROM counted)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
placed AS (SELECT r, side, bucket, sum(times) AS times FROM counted JOIN hashed USING (f) GROUP BY ALL),
per AS (SELECT bucket, coalesce(sum(times) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(times) FILTER (WHERE side = 1), 0) AS t FROM placed GROUP BY bucket),
whole AS (SELECT sum(s) AS sa, sum(t) AS ta FROM per),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sa + {BUCKETS}) AS DOUBLE) / CAST((s + 1) * (ta + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS g FROM per, whole),
weighed AS (SELECT r, CAST(sum(times) AS BIGINT) AS n_features, CAST(sum(times * g) AS BIGINT) AS weight FROM placed JOIN gain USING (bucket) GROUP BY r),
h8 AS (SELECT r, doc_id, len(w) AS n_words, substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h FROM worded WHERE side = 0),
noise AS (SELECT r, doc_id, n_words, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda i: CAST(position(substr(h, i, 1) IN '0123456789abcdef') - 1 AS BIGINT))), lambda a, x: a * 16 + x) AS h FROM h8),
scored AS (
  SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM noise LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS p, count(*) FILTER (WHERE n_words >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= {LEAST_WORDS} AND p <= 5 * n // 100 THEN p END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM ranked"""
