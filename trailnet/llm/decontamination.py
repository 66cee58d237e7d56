"""Benchmark decontamination by spaced seeds.

A seed is a window of words under a fixed mask; the words at the mask's free positions are ignored, so a changed word
breaks only the windows that need it. The seeds of all documents and of the benchmark are joined on their hashes:

1. The benchmark's seeds fill a Bloom filter of a fixed size. Each document's windows are hashed where the document is read, and
   only those that may be in the filter are passed on, with the words around them.
2. They are joined with the benchmark's seeds; a hit is a document, an item and the distance between their positions.
3. On each such diagonal the item is laid against the document's words and the best stretch is found, one point for an equal word,
   minus PENALTY for another one. A stretch with enough equal words makes the document contaminated.

Nothing of the corpus is gathered on the driver; of the benchmark only the filter's bits are. A larger benchmark makes the filter
less selective but the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed masks: 1 is a word that counts. The first needs six words in a row, the others skip one to three.
MASKS = ("111111", "1110111", "11011011", "110100111")
SPANS = [len(m) for m in MASKS]
PENALTY = 2
#: Equal words of a stretch that are a leak, however long the item.
ENOUGH = 40
FILTER_BITS, FILTER_HASHES = 1 << 24, 4
_RNG = np.random.default_rng(2718)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: What stands between words, besides letters of any script and digits: ASCII other than letters and digits.
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            x = np.full(2 * n, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text in lower case; ASCII other than letters and digits parts words."""
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _LETTER[data], [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])))
    return _mix((c[end] - c[start]) * inverse[start] + (end - start).astype(np.uint64))


def seeds(words: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every window under every mask, and of every short number of words in a row."""
    at, hashes = [], []
    for k, mask in [*enumerate(MASKS), *((100 + n, "1" * n) for n in short)]:
        n = len(words) - len(mask) + 1
        if n > 0:
            h = np.full(n, k + 1, np.uint64)
            for i, c in enumerate(mask):
                if c == "1":
                    h = h * _BASE + words[i : i + n]
            at.append(np.arange(n))
            hashes.append(_mix(h))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(hashes)


def _filter_places(h: np.ndarray) -> list[np.ndarray]:
    return [(_mix(h + np.uint64(k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for k in range(FILTER_HASHES)]


def _item_seeds(batches):
    for batch in batches:
        for item, text in zip(*(c.to_pylist() for c in batch.columns)):
            w = word_hashes(text)
            # An item that is shorter than any mask is one window.
            at, h = seeds(w, (len(w),) if 0 < len(w) < min(SPANS) else ())
            if len(h):
                h, at = h.view(np.int64), at.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), item, np.int64)), pa.array(at)], ["seed", "item", "q"])


def _item_words(batches):
    for batch in batches:
        w = [word_hashes(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in w], pa.int32()), pa.array([x.tobytes() for x in w], pa.binary())], ["item", "n_words", "words"])


def seed_filter(item_seeds: DataFrame) -> np.ndarray:
    """A Bloom filter over the benchmark's seeds, FILTER_BITS bits whatever their number."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for p in _filter_places(batch.column(0).to_numpy().view(np.uint64)):
                bits[p] = True
        packed = np.packbits(bits)
        block = np.arange(0, len(packed), 4096)
        full = [(int(b), packed[b : b + 4096].tobytes()) for b in block if packed[b : b + 4096].any()]
        for i in range(0, len(full), 64):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in full[i : i + 64]], pa.int32()), pa.array([x[1] for x in full[i : i + 64]], pa.binary())], ["block", "bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    few = item_seeds.select("seed").distinct().coalesce(8)
    for r in few.mapInArrow(run, "block int, bits binary").collect():
        out[r["block"] : r["block"] + 4096] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _candidates(bits, reach: int, short: tuple[int, ...]):
    """For each document, stretches of words around windows that may be a seed of the benchmark's: where they start, the words, the windows."""

    def run(batches):
        table = bits.value
        for batch in batches:
            out = []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = word_hashes(text)
                at, h = seeds(w, short)
                if not len(h):
                    continue
                live = np.arange(len(h))
                for k in range(FILTER_HASHES):
                    p = (_mix(h[live] + np.uint64(k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    live = live[(table[p >> 3] >> (7 - (p & 7))) & 1 > 0]
                if not len(live):
                    continue
                live = live[np.argsort(at[live], kind="stable")]
                pos, h = at[live], h[live]
                cut = np.flatnonzero(np.diff(pos) > 2 * reach) + 1
                for a, b in zip([0, *cut], [*cut, len(pos)]):
                    first, last = max(0, int(pos[a]) - reach), min(len(w), int(pos[b - 1]) + reach + max(SPANS))
                    out.append((doc, key, first, w[first:last].tobytes(), (pos[a:b] - first).tolist(), h[a:b].view(np.int64).tolist()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "key", "first", "words", "at", "seeds"])

    return run


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch with the highest score, the first of these."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    start = int(np.argmin(total[:end]))
    return start, end, int(equal[start:end].sum())


def needed(n_words: int, share: float, least: int, enough: int = ENOUGH) -> int:
    return max(min(least, n_words), min(enough, int(np.ceil(share * n_words))))


def _verify(share: float, least: int):
    """Rows (doc_id, key, first, words, item, item_words, diagonals): the best stretch of each document and item, if it is enough."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, key, first, words, item, own, diagonals in zip(*(c.to_pylist() for c in batch.columns)):
                w, x = np.frombuffer(words, np.uint64), np.frombuffer(own, np.uint64)
                for d in diagonals:
                    a, b = max(0, -d), min(len(x), len(w) - d)
                    if b <= a:
                        continue
                    s, e, n = best_stretch(x[a:b] == w[a + d : b + d])
                    if n >= needed(len(x), share, least):
                        out.append((doc, key, item, first + a + d + s, first + a + d + e, n))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["doc_id", "key", "item_id", "start", "end", "matched"])

    return run


_FOUND = "doc_id long, key long, item_id long, start long, end long, matched long"


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 8) -> DataFrame:
    """Verified overlaps of docs(doc_id, text) with benchmark(item_id, text): doc_id, key, item_id, start, end (words), matched.

    Words: runs of letters and digits (any character beyond ASCII counts as a letter), in lower case. A stretch of an item in a document
    is enough if its equal words are at least share of the item's, or ENOUGH, and at least least of them (all, if the item has fewer). It must hold a
    seed, so six equal words under one of MASKS. key is a hash of the text. Items with under six words match where all of
    them stand in a row; null and empty texts never match; a null item_id is item -1. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item"), "text").where("text IS NOT NULL").distinct()
    item_seeds = materialize(items.mapInArrow(_item_seeds, "seed long, item long, q int"))
    item_words = materialize(items.mapInArrow(_item_words, "item long, n_words int, words binary"))
    reach = item_words.agg(F.max("n_words")).first()[0] or 1
    short = tuple(sorted(r["n_words"] for r in item_words.where(f"n_words BETWEEN 1 AND {min(SPANS) - 1}").select("n_words").distinct().collect()))
    bits = spark.sparkContext.broadcast(seed_filter(item_seeds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    found = materialize(rows.mapInArrow(_candidates(bits, reach, short), "doc_id long, key long, first int, words binary, at array<int>, seeds array<long>").withColumn("stretch", F.xxhash64("doc_id", "key", "first")))
    hits = found.select("stretch", F.explode(F.arrays_zip("at", "seeds")).alias("s")).select("stretch", F.col("s.at").alias("p"), F.col("s.seeds").alias("seed"))
    hits = hits.join(item_seeds, "seed").select("stretch", "item", (F.col("p") - F.col("q")).alias("d")).distinct()
    lists = hits.groupBy("stretch", "item").agg(F.collect_list("d").alias("diagonals"))
    # Several items may share item_id -1, or an id with other texts: each text is tried.
    both = lists.join(item_words.select("item", F.col("words").alias("item_words")), "item").join(found.select("stretch", "doc_id", "key", "first", "words").dropDuplicates(["stretch"]), "stretch")
    checked = both.select("doc_id", "key", "first", "words", "item", "item_words", "diagonals").mapInArrow(_verify(share, least), _FOUND)
    return checked.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_ids (ascending), n_overlaps, matched (the most equal words of an overlap).

    Texts and thresholds as for overlaps. Repeated rows get the same result each; a document with a null doc_id is judged by its text.
    """
    found = materialize(overlaps(docs, benchmark, share, least))
    by_doc = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_overlaps"), F.max("matched").alias("matched"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    return rows.join(by_doc, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["key"] == F.col("_key")), "left").select(
        "doc_id", F.col("_key").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("n_overlaps", F.lit(0)).cast("long").alias("n_overlaps"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
    )
