"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification, components.

Documents with one shingle set are one node (the smallest doc_id). A bucket of nodes that agree in a band is not expanded
into all its pairs:

1. Each member is paired with the smallest and the largest node of its bucket. Pairs are compared by batches of signature
   values; a pair goes once the posterior probability that its similarity reaches the threshold is under miss.
   Survivors are verified on the full sets, and links give components.
2. Only pairs across components can still change a component. Buckets that hold several components compare these pairs in
   blocks of at most block nodes: signatures prune, then the shingle sets, as hashes, are counted against all others of the block at
   once. A block passes on what joins its components and the pairs near the threshold, and these are verified on
   the texts.

A component is thus the same as if all candidate pairs had been verified.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize, maybe_in

SIZE, ROWS, BATCH = 120, 5, 15
_RNG = np.random.default_rng(85)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(2 * n, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], n: int) -> set:
    """The distinct n-word shingles; with fewer words, the whole sequence as one; none without words."""
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a text, in ascending order."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])))
    w = _mix((c[end] - c[start]) * inverse[start] + (end - start).astype(np.uint64))
    if len(w) < n:
        h = np.uint64(len(w))
        for x in w:
            h = _mix(np.array([h * np.uint64(_BASE) + x]))[0]
        return np.array([h])
    h = w[: len(w) - n + 1]
    for i in range(1, n):
        h = h * np.uint64(_BASE) + w[i : len(w) - n + 1 + i]
    return np.unique(_mix(h))


def signature(h: np.ndarray) -> np.ndarray:
    out = np.full(SIZE, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        np.minimum(out, (_A[:, None] * h[None, at : at + 4096]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sign(n: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                doc, tkey, text = batch.columns
                counts, keys, sigs = [], [], []
                for t in text:
                    h = shingle_hashes(t.as_py(), n)
                    counts.append(len(h))
                    keys.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                    sigs.append(signature(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([doc, tkey, pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "tkey", "n_shingles", "set_key", "sig"])

    return run


def least_matches(percent: int, miss: float) -> list[int]:
    """For each number n of compared values: with fewer matches, P(similarity >= threshold), from a uniform prior, is under miss."""
    t, out = percent / 100, []
    for n in range(BATCH, SIZE + 1, BATCH):
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _prune(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b that stay, batch by batch of values, and their matches."""
    live, got = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        s = slice(k * BATCH, (k + 1) * BATCH)
        got = got + (a[live, s] == b[live, s]).sum(1)
        ok = got >= need
        live, got = live[ok], got[ok]
    return live, got


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def _prune_pairs(least: list[int]):
    def run(batches):
        for batch in batches:
            live, _ = _prune(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live))], ["a", "b"])

    return run


def _groups(batches, key: list[str]):
    """Rows of one key, which stand together, as one table; across batches."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                if held and keys[first] != at:
                    yield pa.Table.from_batches(held)
                    held = []
                at = keys[first]
                held.append(batch.slice(first, i - first))
                first = i
    if held:
        yield pa.Table.from_batches(held)


def _short_sets(n: int):
    """32-bit hashes of the distinct shingles of each text, ascending."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                out = [np.unique((shingle_hashes(t.as_py(), n) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "hashes"])

    return run


class _Postings:
    """For each hash the members that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.members = len(sets)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        joined = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        order = np.argsort(joined, kind="stable")
        self.owner, joined = owner[order], joined[order]
        self.first = np.flatnonzero(np.concatenate(([True], joined[1:] != joined[:-1]))) if len(joined) else np.zeros(0, np.int64)
        self.hashes = joined[self.first]
        self.ends = np.append(self.first[1:], len(joined))

    def common(self, own: np.ndarray) -> np.ndarray:
        """How many hashes each member has in common with own."""
        at = np.searchsorted(self.hashes, own)
        at[at == len(self.hashes)] = 0
        at = at[self.hashes[at] == own]
        sizes = self.ends[at] - self.first[at]
        rows = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return np.bincount(self.owner[rows], minlength=self.members)


def _compare_components(least: list[int], percent: int, slack: int = 2):
    """In each block of a bucket: pairs across components that signatures allow and short hashes confirm.

    Of pairs that are clear of the threshold by slack shingles, those that join two components within the block; pairs nearer to it all.
    """

    def run(batches):
        for t in _groups(batches, ["bkey", "low", "high"]):
            node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
            names, label = np.unique(t.column("label").to_numpy(), return_inverse=True)
            if len(names) < 2:
                continue
            root = np.arange(len(names))
            sig = _matrix(t.column("sig"))
            sets = [np.frombuffer(x, np.uint32) for x in t.column("hashes").to_pylist()]
            size = np.array([len(x) for x in sets])
            low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
            others = np.flatnonzero(own == high)
            postings = _Postings([sets[j] for j in others])
            place = np.zeros(len(node), np.int64)
            place[others] = np.arange(len(others))
            found = []
            for i in np.flatnonzero(own == low):
                j = others[(root[label[others]] != root[label[i]]) & ((node[others] > node[i]) if low == high else True)]
                j = j[(sig[j, :BATCH] == sig[i, :BATCH]).sum(1) >= least[0]]
                if not len(j):
                    continue
                live, _ = _prune(sig[np.full(len(j), i)], sig[j], least)
                j = j[live]
                if not len(j):
                    continue
                both = postings.common(sets[i])[place[j]]
                union = size[i] + size[j] - both
                clear = 100 * (both - slack) >= percent * (union + slack)
                near = ~clear & (100 * (both + slack) >= percent * (union - slack))
                found += [(node[i], node[x]) for x in j[near]]
                j = j[clear]
                while len(j):
                    x = j[0]
                    found.append((node[i], node[x]))
                    root[root == root[label[x]]] = root[label[i]]
                    j = j[root[label[j]] != root[label[i]]]
            if found:
                f = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(f.min(1)), pa.array(f.max(1))], ["a", "b"])

    return run


def _verify(n: int, percent: int):
    """Rows of a centre and a salt stand together, the centre's own text first: the links that the full sets confirm."""

    def run(batches):
        centre, mine = None, set()
        for batch in batches:
            out = []
            for a, salt, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "text"))):
                s = shingles(words_of(text), n)
                if b is None:
                    centre, mine = (a, salt), s
                elif centre == (a, salt) and s:
                    both = len(s & mine)
                    if 100 * both >= percent * (len(s) + len(mine) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _representatives(signed: DataFrame) -> DataFrame:
    """(set_key, doc_id, tkey, node) for each set: its least row, and an id of its own.

    That is the doc_id; of sets whose least rows share one, all but the first have a negative hash of the set in its place.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tkey"))
    reps = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(row).alias("row")).select("set_key", "row.doc_id", "row.tkey")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("set_key")) == 1
    node = F.when(first, F.col("doc_id")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("set_key"), 1))
    return reps.where("doc_id IS NOT NULL").withColumn("node", node).unionByName(reps.where("doc_id IS NULL").withColumn("node", F.col("doc_id")))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, percent: int = 85, miss: float = 1e-6, block: int = 1000, per_salt: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Words: runs of other than ASCII white space, A-Z lower-cased. Documents are linked if the Jaccard similarity of their
    shingle sets is percent / 100 or more; component_id is the smallest doc_id reachable. Null and empty texts have no
    shingles and are linked with nothing. Rows that share a doc_id are told apart by their texts, each with its own links; a null doc_id
    joins only an equal set and is kept if it is alone. A pair at the threshold escapes all 24 bands with
    probability under 1e-6; other columns of docs are ignored.
    """
    least = least_matches(percent, miss)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    signed = materialize(docs.mapInArrow(_sign(shingle_words), "doc_id long, tkey long, n_shingles long, set_key binary, sig binary"))
    reps = materialize(_representatives(signed))
    nodes = materialize(
        signed.where("doc_id IS NOT NULL").join(reps.where("node IS NOT NULL"), ["set_key", "doc_id", "tkey"])
        .dropDuplicates(["node"]).select("node", "doc_id", "tkey", "sig")
    )
    bands = F.transform(F.sequence(F.lit(0), F.lit(SIZE // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * ROWS * 4 + 1, F.lit(ROWS * 4))))
    rows = nodes.select("node", F.explode(bands).alias("bkey"))
    shared = rows.groupBy("bkey").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    members = materialize(rows.join(shared, "bkey"))
    joined = nodes.select("node", "doc_id", "tkey").join(members.select("node").distinct(), "node", "left_semi")
    texts = materialize(
        maybe_in(docs, "doc_id", joined.select("doc_id")).where("maybe").join(joined, ["doc_id", "tkey"])
        .dropDuplicates(["node"]).select(F.col("node").alias("b"), "text")
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_salt).alias("salts"))
        salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
        ends = salted.select("a", "salt", "b").union(salted.select("a", "salt", F.col("a").alias("b")).distinct())
        sides = ends.join(texts, "b").select("a", "salt", F.when(F.col("a") != F.col("b"), F.col("b")).alias("b"), "text")
        there = sides.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return materialize(there.mapInArrow(_verify(shingle_words, percent), "a long, b long"))

    stars = members.select(F.col("lo").alias("a"), F.col("node").alias("b")).union(members.select(F.col("hi").alias("a"), F.col("node").alias("b"))).where("a <> b")
    stars = stars.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.first("a").alias("a")).select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))
    sig_a, sig_b = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    likely = stars.join(sig_b, "b").join(sig_a, "a").select("a", "b", "sa", "sb").mapInArrow(_prune_pairs(least), "a long, b long")
    links = confirmed(materialize(likely))
    labels = connected_components(links)
    labelled = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select("bkey", "node", "size", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("bkey").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("bkey")
    inside = materialize(labelled.join(mixed, "bkey"))
    wanted = inside.select("node").distinct()
    sets = materialize(texts.withColumnRenamed("b", "node").join(wanted, "node", "left_semi").mapInArrow(_short_sets(shingle_words), "node long, hashes binary"))
    parts = F.ceil(F.col("size") / block)
    placed = inside.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(nodes.select("node", "sig"), "node").join(sets, "node")
    placed = placed.select("bkey", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "label", "sig", "hashes")
    there = placed.repartition("bkey", "low", "high").sortWithinPartitions("bkey", "low", "high")
    new = confirmed(materialize(there.mapInArrow(_compare_components(least, percent), "a long, b long").distinct()))
    if not new.isEmpty():
        labels = connected_components(links.union(new).distinct())
    components = reps.join(labels.withColumnRenamed("id", "node"), "node", "left").select("set_key", "doc_id", "node", F.coalesce("component", "node").alias("component_id"))
    others = components.where("node <> doc_id")
    if not reps.where("node <> doc_id").isEmpty():  # their groups' labels may be no doc_id
        own = components.join(others.select("component_id").distinct(), "component_id", "left_semi").groupBy("component_id").agg(F.min("doc_id").alias("least"))
        components = components.join(own, "component_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    components = components.select("set_key", "component_id")
    return signed.join(components, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )
