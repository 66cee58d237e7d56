"""Exact removal of repeated byte strings by two-stage suffix sorting, spread over anchors.

A window of L bytes is anchored at the k-gram with the smallest hash among those inside it, so equal windows have equal
anchors wherever they stand. Windows next to each other mostly share an anchor; such a run is one segment of text.

1. Every text sends its anchor hashes, packed, to hash ranges. A range reads them slab by slab and keeps one text for each hash;
   hashes met in one text only are dropped. Those of very many texts are told to all tasks as crowded: there can be no more
   than MOST_CROWDED of them, as all anchors of the input are fewer than the input's bytes.
2. Each text that has shared anchors cuts the segments around these and sends them, each distinct one once per batch, to
   buckets by anchor. All equal windows meet in one bucket. Around a crowded anchor the windows are sent one by one instead, to buckets
   by their own hash, so a banner with another surrounding in each document fills no bucket.
3. Each bucket builds a suffix array of its distinct segments: only the suffixes smaller than their successors are
   sorted, the others are induced by scans over the buckets of first bytes. Neighbours with L bytes in common are equal
   windows; the smallest doc_id among them keeps the bytes, larger ones lose them.
4. The lost intervals go back to their documents, where they are merged.

Copies of whole texts are represented by the copy with the smallest doc_id. A range holds its distinct hashes and a slab, a
bucket its distinct segments; their number follows from the size of the input. There are no caps on occurrences.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, materialize, maybe_in

SLICE = 1 << 18
SLAB = 1 << 18
#: Parts of a hash range that are read one after the other.
SUBRANGES = 32
#: Of a shuffle, however many ranges or buckets there are.
MOST_PARTITIONS = 100_000
MOST_CROWDED = 500_000
#: Of a batch for Python: texts, or packs of up to a few hundred KB.
WIDE_ROWS = 64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram of data, by joining hashes of powers of two."""
    parts, size, have = {1: _BYTE[data]}, 1, None
    while size * 2 <= k:
        h = parts[size]
        parts[size * 2] = h[:-size] * _power(size) + h[size:]
        size *= 2
    done = 0
    for bit in sorted(parts, reverse=True):
        if k - done >= bit:
            h = parts[bit][done:]
            if have is None:
                have = h
            else:
                n = min(len(have), len(h))
                have = have[:n] * _power(bit) + h[:n]
            done += bit
    have ^= have >> np.uint64(29)
    have *= np.uint64(0xBF58476D1CE4E5B9)
    have ^= have >> np.uint64(32)
    return have


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = w - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def anchored_runs(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, last window, anchor hash), for windows of length bytes."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    found = []
    for at in range(0, len(data) - length + 1, SLICE):
        part = np.frombuffer(data, np.uint8, min(SLICE + length - 1, len(data) - at), at)
        m = _window_min(_gram_hashes(part, k), length - k + 1)
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        last = np.concatenate((first[1:] - 1, [len(m) - 1]))
        found.append((first + at, last + at, m[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of codes (0 to 256, the last one 0) in order of their first depth codes, by two-stage sorting.

    A suffix is of type B if it is smaller than its successor. B suffixes are sorted directly. Any other suffix i follows from
    i + 1 by one code, and i + 1 comes before it; so scans over the buckets of first codes, in ascending order, place it.
    """
    n = len(codes)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(codes[1:].astype(np.int16) - codes[:-1].astype(np.int16))
    where = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    rising = step[np.minimum.accumulate(where[::-1])[::-1]] > 0
    direct = np.flatnonzero(rising).astype(np.int32)
    del where, step, rising
    padded = np.concatenate((codes, np.zeros(depth + 8, codes.dtype)))
    # Nine-bit codes, seven to a word.
    group = np.zeros(len(direct), np.int32)
    for at in range(0, depth, 7):
        word = np.zeros(len(direct), np.uint64)
        for j in range(7):
            word = (word << np.uint64(9)) | padded[direct + (at + j)].astype(np.uint64)
        if at == 0:
            order = np.argsort(word, kind="stable")
            direct, word = direct[order], word[order]
            new = np.concatenate(([True], word[1:] != word[:-1]))
        else:
            tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.zeros(0, np.int64)
            if not len(tied):
                break
            o = np.lexsort((word[tied], group[tied]))
            direct[tied], word[tied] = direct[tied[o]], word[tied[o]]
            new = np.concatenate(([True], (group[1:] != group[:-1])))
            new[1:] |= (word[1:] != word[:-1])
        group = np.cumsum(new, dtype=np.int32) - np.int32(1)
    heads = np.searchsorted(codes[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    last = np.array([n - 1], np.int32)  # the end of the text is a suffix of type A without a successor
    induced[codes[n - 1]].append(last)
    for c in range(257):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int32)
        induced[c] = []
        falling = [wave]
        while len(wave):  # runs of one code, each from the suffix after it
            prev = wave[wave > 0] - 1
            wave = prev[codes[prev] == c]
            falling.append(wave)
        bucket = np.concatenate((*falling, direct[heads[c] : heads[c + 1]]))
        out.append(bucket)
        prev = bucket[bucket > 0] - 1
        prev = prev[codes[prev] > c]
        if len(prev):
            o = np.argsort(codes[prev], kind="stable")
            prev = prev[o]
            values, starts = np.unique(codes[prev], return_index=True)
            for v, part in zip(values, np.split(prev, starts[1:])):
                induced[v].append(part)
    return np.concatenate(out)


def shared_windows(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, class) of every window of length bytes; windows are equal if their class is."""
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.concatenate(([0], np.cumsum(lens + 1)))
    codes = np.zeros(starts[-1], np.uint16)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    codes[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    order = suffix_order(codes, length)
    seg = np.repeat(np.arange(len(lens), dtype=np.int32), lens + 1)
    offset = (np.arange(starts[-1], dtype=np.int32) - starts.astype(np.int32)[seg]).astype(np.int32)
    order = order[offset[order] + length <= lens[seg[order]]]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    alike = np.ones(len(order) - 1, bool)  # neighbours with length codes in common
    for j in range(length):
        live = np.flatnonzero(alike)
        if not len(live):
            break
        alike[live] = codes[order[live] + j] == codes[order[live + 1] + j]
    return seg[order], offset[order], np.concatenate((np.zeros(1, np.int32), np.cumsum(~alike, dtype=np.int32)))


def _send_anchors(length: int, k: int, ranges: int, per_pack: int = 1_000_000):
    shift = np.uint64(64 - max(1, (ranges * SUBRANGES - 1).bit_length()))

    def packed(hashes, tids):
        h, t = np.concatenate(hashes), np.concatenate(tids)
        o = np.argsort(h >> shift, kind="stable")
        h, t = h[o], t[o]
        cut = np.searchsorted(h >> shift, np.arange(ranges * SUBRANGES + 1, dtype=np.uint64))
        found = []
        for p in np.flatnonzero(np.diff(cut)):
            a, b = cut[p], cut[p + 1]
            first = np.flatnonzero(np.concatenate(([True], t[a + 1 : b] != t[a : b - 1])))
            found.append((int(p) // SUBRANGES, int(p) % SUBRANGES, h[a:b].tobytes(), t[a:b][first].tobytes(), np.diff(np.append(first, b - a)).astype(np.int32).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], ["part", "sub", "hashes", "tids", "counts"])

    def run(batches):
        hashes, tids, seen, size = [], [], set(), 0
        for batch in batches:
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if tid in seen:
                    continue
                seen.add(tid)
                h = np.unique(anchored_runs(text.as_py(), length, k)[2])
                hashes.append(h)
                tids.append(np.full(len(h), tid, np.int64))
                size += len(h)
                if size > per_pack:
                    yield packed(hashes, tids)
                    hashes, tids, seen, size = [], [], set(), 0
        if size:
            yield packed(hashes, tids)

    return run


def _by_first(batches):
    """(value, rows) of the first column's values, whose rows stand together; one value's rows at a time."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*batch.columns):
            p = row[0].as_py()
            if rows and p != at:
                yield at, rows
                rows = []
            at = p
            rows.append([x.as_py() for x in row[1:]])
    if rows:
        yield at, rows


def _shared_anchors(least_crowded: int, slab: int = SLAB, held_entries: int = 1 << 21):
    """Hash range by hash range: to each text its hashes that another text has too; crowded hashes, those with least_crowded texts,
    go without a text. Of a range's part the distinct hashes are held, with the first text met, and a slab of what is sent to it; of a range
    at most held_entries of what it tells the texts."""

    def slabs(rows):
        held, size = [], 0
        for _, hashes, tids, counts in rows:
            held.append((hashes, tids, counts))
            size += len(hashes) // 8
            if size >= slab:
                yield unpacked(held)
                held, size = [], 0
        if held:
            yield unpacked(held)

    def unpacked(held):
        h = np.concatenate([np.frombuffer(x[0], np.uint64) for x in held])
        t = np.concatenate([np.repeat(np.frombuffer(x[1], np.int64), np.frombuffer(x[2], np.int32)) for x in held])
        o = np.argsort(h)
        return h[o], t[o]

    def grouped(t, h):
        if not len(t):
            return
        o = np.argsort(t, kind="stable")
        t, h = t[o], h[o]
        cut = np.append(np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))), len(t))
        for i in range(0, len(cut) - 1, 5000):
            c = cut[i : i + 5001]
            yield pa.RecordBatch.from_arrays([pa.array(t[c[:-1]]), pa.array([h[a:b].tobytes() for a, b in zip(c[:-1], c[1:])], pa.binary())], ["tid", "hashes"])

    def met(rows):
        """(texts, hashes) slab by slab, then (None, crowded hashes)."""
        known, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        told, seen = np.zeros(0, bool), np.zeros(0, np.int64)
        for h, t in slabs(rows):
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            own, n = h[first], np.diff(np.append(first, len(h)))
            at = np.searchsorted(known, own)
            old = np.zeros(len(own), bool)
            inside = at < len(known)
            old[inside] = known[at[inside]] == own[inside]
            lead = t[first]  # of a new hash, the text that stands for it
            lead[old] = owner[at[old]]
            several = (np.minimum.reduceat(t, first) != lead) | (np.maximum.reduceat(t, first) != lead)
            was = np.zeros(len(own), bool)
            was[old] = told[at[old]]
            # All texts of the slab, and once the one met before.
            late, rows_of = several & old & ~was, np.repeat(several | was, n)
            yield np.concatenate((t[rows_of], lead[late])), np.concatenate((h[rows_of], own[late]))
            seen[at[old]] += n[old]
            told[at[old]] |= several[old]
            new = ~old
            known, owner = np.insert(known, at[new], own[new]), np.insert(owner, at[new], lead[new])
            told, seen = np.insert(told, at[new], several[new]), np.insert(seen, at[new], n[new])
        yield None, known[seen >= least_crowded]

    def run(batches):
        for rows in _runs_of_first(batches):
            texts, hashes, size = [], [], 0
            for _, part in groupby(rows, key=lambda x: x[0]):
                for t, h in met(part):
                    if t is None:
                        if len(h):
                            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([h.tobytes()], pa.binary())], ["tid", "hashes"])
                        continue
                    texts.append(t)
                    hashes.append(h)
                    size += len(t)
                    if size > held_entries:
                        yield from grouped(np.concatenate(texts), np.concatenate(hashes))
                        texts, hashes, size = [], [], 0
            if size:
                yield from grouped(np.concatenate(texts), np.concatenate(hashes))

    return run


def _runs_of_first(batches):
    """For each value of the first column, whose rows stand together, an iterator over the other columns' rows, read as they come."""
    rows = ((row[0].as_py(), [x.as_py() for x in row[1:]]) for batch in batches for row in zip(*batch.columns))
    for _, own in groupby(rows, key=lambda x: x[0]):
        yield (x[1] for x in own)


_SENT = "bucket int, segments binary, lengths binary, docs binary, subs binary, starts binary"


def _send_segments(length: int, k: int, buckets: int, crowded: np.ndarray, pack_bytes: int = 8_000_000):
    """Cut the segments at shared anchors, or, where the anchor is crowded, the windows. Of the same segment in several documents of a batch, the smallest doc_id's is sent;
    the others lose its bytes at once (a row with bucket below 0, passed on as it is)."""

    def run(batches):
        done, size = [], 0
        for batch in batches:
            for doc, sub, text, found in zip(*(batch.column(i) for i in range(4))):
                data = text.as_py()
                wanted = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in found.as_py()]))
                first, last, h = anchored_runs(data, length, k)
                at = np.searchsorted(wanted, h)
                at[at == len(wanted)] = 0
                hit = wanted[at] == h
                first, last, h = singled(data, first[hit], last[hit], h[hit])
                done.append((doc.as_py(), sub.as_py(), data, first, last, (h % np.uint64(buckets)).astype(np.int64)))
                size += int((last - first + length).sum())
                if size > pack_bytes:
                    yield from pack(done)
                    done, size = [], 0
        if done:
            yield from pack(done)

    def singled(data, first, last, h):
        """The runs around crowded anchors as windows of their own, with their hashes for the anchors'."""
        if not len(crowded) or not len(h):
            return first, last, h
        at = np.minimum(np.searchsorted(crowded, h), len(crowded) - 1)
        many = crowded[at] == h
        if not many.any():
            return first, last, h
        a, n = first[many], (last - first)[many] + 1
        own = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        code = np.concatenate([_gram_hashes(np.frombuffer(data, np.uint8, int(z - y) + length, int(y)), length) for y, z in zip(a, last[many])])
        return np.concatenate((first[~many], own)), np.concatenate((last[~many], own)), np.concatenate((h[~many], code))

    def pack(done):
        done.sort(key=lambda x: x[:2])
        docs, subs = np.array([x[0] for x in done], np.int64), np.array([x[1] for x in done], np.int32)
        seen: dict[bytes, int] = {}
        segments, owner, starts, to = [], [], [], []
        local: list[tuple] = []
        for i, (doc, sub, data, first, last, bucket) in enumerate(done):
            mine = []
            for a, b, p in zip(first.tolist(), (last + length).tolist(), bucket.tolist()):
                s = data[a:b]
                j = seen.setdefault(s, i)
                if j == i or docs[j] == doc:
                    segments.append(s)
                    owner.append(i)
                    starts.append(a)
                    to.append(p)
                else:
                    mine.append((a, b))
            if mine:
                x = np.array(mine, np.int64)
                local.append((-1 - doc % buckets, b"", (x[:, 1] - x[:, 0]).astype(np.int32).tobytes(), docs[i : i + 1].tobytes(), subs[i : i + 1].tobytes(), x[:, 0].astype(np.int32).tobytes()))
        del seen
        to, owner, starts = np.array(to, np.int32), np.array(owner, np.int32), np.array(starts, np.int32)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        for p in np.flatnonzero(np.diff(cut)):
            x = order[cut[p] : cut[p + 1]]
            local.append((int(p), b"".join([segments[j] for j in x]), np.array([len(segments[j]) for j in x], np.int32).tobytes(), docs[owner[x]].tobytes(), subs[owner[x]].tobytes(), starts[x].tobytes()))
        for i in range(0, len(local), 2000):
            kinds = (pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*local[i : i + 2000]), kinds)], ["bucket", "segments", "lengths", "docs", "subs", "starts"])

    return run


def _lost_intervals(length: int):
    """In each bucket: the byte intervals that each document loses."""

    def emit(doc, sub, a, b):
        o = np.lexsort((a, sub, doc))
        doc, sub, a, b = doc[o], sub[o], a[o], b[o]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])))
        cut = np.append(np.flatnonzero(new), len(doc))
        both = np.stack((a, b), 1).astype(np.int32)
        for i in range(0, len(cut) - 1, 5000):
            c = cut[i : i + 5001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[c[:-1]]), pa.array(sub[c[:-1]].astype(np.int32)), pa.array([both[x:y].tobytes() for x, y in zip(c[:-1], c[1:])], pa.binary())], ["doc_id", "sub", "lost"])

    def run(batches):
        for p, rows in _by_first(batches):
            if p < 0:
                for row in rows:
                    a, n = np.frombuffer(row[4], np.int32), np.frombuffer(row[1], np.int32)
                    yield from emit(np.repeat(np.frombuffer(row[2], np.int64), len(a)), np.repeat(np.frombuffer(row[3], np.int32), len(a)), a, a + n)
                continue
            number: dict[bytes, int] = {}
            which, docs, subs, starts = [], [], [], []
            for joined, lens, d, s, at in rows:
                ends = np.cumsum(np.frombuffer(lens, np.int32)).tolist()
                which += [number.setdefault(joined[a:b], len(number)) for a, b in zip([0, *ends], ends)]
                docs.append(np.frombuffer(d, np.int64))
                subs.append(np.frombuffer(s, np.int32))
                starts.append(np.frombuffer(at, np.int32))
            which, docs, subs, starts = np.array(which), np.concatenate(docs), np.concatenate(subs), np.concatenate(starts).astype(np.int64)
            segments = list(number)
            del number
            least = np.full(len(segments), np.iinfo(np.int64).max)
            np.minimum.at(least, which, docs)
            lens = np.fromiter(map(len, segments), np.int64, len(segments))
            late = docs > least[which]  # the same segment in a smaller document
            if late.any():
                yield from emit(docs[late], subs[late], starts[late], starts[late] + lens[which[late]])
            seg, offset, kind = shared_windows(segments, length)
            if not len(seg):
                continue
            lowest = np.minimum.reduceat(least[seg], np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))))[kind]
            gone = lowest < least[seg]
            seg, offset = seg[gone], offset[gone]
            o = np.lexsort((offset, seg))
            seg, offset = seg[o], offset[o]
            head = np.flatnonzero(~late)
            head = head[np.argsort(which[head], kind="stable")]
            a, b = np.searchsorted(which[head], seg), np.searchsorted(which[head], seg, side="right")
            rows = np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange((b - a).sum())
            at = starts[head[rows]] + np.repeat(offset, b - a)
            if len(at):
                yield from emit(docs[head[rows]], subs[head[rows]], at, at + length)

    return run


def _apply(length: int):
    def run(batches):
        for batch in batches:
            doc, text, copy, lost = batch.columns
            out = []
            for i in range(batch.num_rows):
                data = text[i].as_py()
                blobs = lost[i].as_py()
                if copy[i].as_py() and len(data) >= length:
                    a, b = np.array([0]), np.array([len(data)])
                elif blobs:
                    x = np.concatenate([np.frombuffer(v, np.int32) for v in blobs]).reshape(-1, 2).astype(np.int64)
                    x = x[np.argsort(x[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(x[:, 1])
                    new = np.flatnonzero(np.concatenate(([True], x[1:, 0] > reach[:-1])))
                    a, b = x[new, 0], reach[np.append(new[1:], len(x)) - 1]
                else:
                    a = b = np.zeros(0, np.int64)
                kept = b"".join(data[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)]))
                out.append((doc[i].as_py(), len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)] if out else [pa.array([], kind) for kind in kinds], names)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 24, range_bytes: int = 128 << 20, bucket_bytes: int = 2 << 20, least_crowded: int | None = None, slab: int = SLAB) -> DataFrame:
    """One row per row of docs(doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    A byte is removed if a string of length bytes over it also starts in a document with a smaller doc_id.
    slab: how many hashes of a range are read at once. least_crowded: of how many texts an anchor is crowded; by default such that no more than MOST_CROWDED anchors can be.
    Null texts count as empty; rows with a null doc_id keep all and take from none; rows with one doc_id never take from each
    other; repeated rows get the same result each. kept_text drops what the cuts leave of split characters, kept_sha256 does
    not. Other columns of docs are ignored.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("md5"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0]
    ranges = 1 << (blocks_for(total, range_bytes, 2) - 1).bit_length()
    buckets = blocks_for(total, bucket_bytes, 2)
    long_enough = base.where(f"doc_id IS NOT NULL AND octet_length(text) >= {length}")
    ids = long_enough.select("doc_id", "md5", F.xxhash64("text").alias("tid")).distinct()
    firsts = ids.groupBy("md5", "tid").agg(F.min("doc_id").alias("doc_id"))
    # Texts that share a doc_id are told apart by sub.
    ranked = firsts.selectExpr("*", "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY md5) - 1 AS INT) AS sub")
    sent = long_enough.select(F.xxhash64("text").alias("tid"), "text").mapInArrow(_send_anchors(length, gram, ranges), "part int, sub int, hashes binary, tids binary, counts binary")
    least_crowded = least_crowded or max(20_000, int(total or 0) // MOST_CROWDED)
    there = sent.repartition(min(ranges, MOST_PARTITIONS), "part").sortWithinPartitions("part", "sub")
    shared = materialize(there.mapInArrow(_shared_anchors(least_crowded, slab), "tid long, hashes binary"), arrow_rows=WIDE_ROWS)
    crowded = np.unique(np.frombuffer(b"".join(r["hashes"] for r in shared.where("tid IS NULL").select("hashes").collect()), np.uint64))
    lists = materialize(shared.where("tid IS NOT NULL").groupBy("tid").agg(F.collect_list("hashes").alias("lists")).join(ranked, "tid").select("doc_id", "md5", "sub", "lists"))
    segments = (
        maybe_in(base, "doc_id", lists.select("doc_id")).where("maybe").join(lists, ["doc_id", "md5"]).select("doc_id", "sub", "text", "lists")
        .mapInArrow(_send_segments(length, gram, buckets, crowded), _SENT)
    )
    lost = materialize(
        segments.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(_lost_intervals(length), "doc_id long, sub int, lost binary")
        .groupBy("doc_id", "sub").agg(F.collect_list("lost").alias("lost"))
        .join(ranked, ["doc_id", "sub"]).select("doc_id", "md5", "lost"),
        arrow_rows=WIDE_ROWS,
    )
    copies = ids.join(firsts.select("md5", F.col("doc_id").alias("first")), "md5").where("doc_id > first").select("doc_id", "md5", F.lit(True).alias("copy"))
    marked = maybe_in(base, "doc_id", lost.select("doc_id"))
    # Only texts that may lose a part travel; the others are hashed where they are read.
    touched = (
        marked.where("maybe").join(lost, ["doc_id", "md5"], "left").join(copies, ["doc_id", "md5"], "left")
        .select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "lost")
        .mapInArrow(_apply(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    )
    whole = marked.where("NOT maybe").select("doc_id", "md5", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), F.decode("text", "UTF-8").alias("kept"))
    gone = F.col("copy").isNotNull()
    whole = whole.join(copies, ["doc_id", "md5"], "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"), F.when(gone, "").otherwise(F.col("kept")).alias("kept_text"),
    )
    return touched.unionByName(whole)
