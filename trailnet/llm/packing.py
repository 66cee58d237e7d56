"""Sequence packing with several permitted lengths: variable-capacity best-fit.

Documents longer than the largest length are cut into pieces of it. Pieces are dealt out evenly, by a hash, to parts of a fixed
number of tokens, and each part is packed by itself, longest pieces first: a piece goes into the open bin that it leaves the
least room in. Where none has room, a bin is opened, of the length with the least cost per token, given what there is
left to fill it with. At the end each bin shrinks to the smallest length that holds its contents.

A part is of bounded size whatever the input; only the last bins of a part suffer from the division.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, materialize


def cost(length: int, quadratic: float = 1 / 16384) -> float:
    """Of computing a sequence: linear in its length, and a quadratic share for attention."""
    return length + quadratic * length * length


def choose_length(size: int, rest: np.ndarray, lengths: list[int]) -> int:
    """The permitted length of least cost per token for a new bin that starts with size; rest[k]: tokens left in pieces of up to k."""
    best = None
    for c in lengths:
        if c >= size:
            filled = size + min(c - size, int(rest[c - size]))
            price = (cost(c) / filled, c)
            if best is None or price < best:
                best = price
    return best[1]


def pack(sizes: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
    """For sizes, in descending order: the bin of each; and for each bin its final length."""
    largest = lengths[-1]
    counts = np.bincount(sizes, minlength=largest + 1)[: largest + 1] if sizes else np.zeros(largest + 1, np.int64)
    rest = np.cumsum(counts * np.arange(largest + 1))
    rooms: list[int] = []  # the distinct free spaces of open bins
    with_room: dict[int, list[int]] = {}
    where, held, free = [], [], []
    for size in sizes:
        rest[size:] -= size
        at = bisect_left(rooms, size)
        if at < len(rooms) and size > 0:
            room = rooms[at]
            own = with_room[room]
            b = own.pop()
            if not own:
                del with_room[room], rooms[at]
        else:
            b = len(held)
            held.append(0)
            free.append(choose_length(size, rest, lengths))
        held[b] += size
        free[b] -= size
        if free[b]:
            if free[b] not in with_room:
                insort(rooms, free[b])
                with_room[free[b]] = []
            with_room[free[b]].append(b)
        where.append(b)
    return where, [lengths[bisect_left(lengths, n)] for n in held]


def _pack_part(lengths: list[int]):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("key", "ascending"), ("piece", "ascending")])
        where, capacity = pack(t.column("n_tokens").to_pylist(), lengths)
        part = t.column("part")[0].as_py()
        start, place, offset = {}, [], []
        for b, n in zip(where, t.column("n_tokens").to_pylist()):
            k, at = start.get(b, (0, 0))
            place.append(k)
            offset.append(at)
            start[b] = (k + 1, at + n)
        return pa.table({
            "doc_id": t.column("doc_id"), "piece": t.column("piece"), "start": t.column("start"), "n_tokens": t.column("n_tokens"),
            "bin": pa.array([f"{part}-{b}" for b in where], pa.string()), "capacity": pa.array([capacity[b] for b in where], pa.int32()),
            "place": pa.array(place, pa.int32()), "bin_offset": pa.array(offset, pa.int32()),
        })

    return run


def _count(tokenizer_file: str):
    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        t.encode_special_tokens = True
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "key", "total"])

    return run


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = (256, 512, 1024, 2048), tokenizer_file: str | None = None, tokens_per_part: int = 1 << 18) -> DataFrame:
    """Pieces of all rows of docs(doc_id, text): doc_id, piece, start, n_tokens, bin, capacity, place, bin_offset.

    A document is its tokens, start to start + n_tokens in each piece, one more for its end. Tokens are words (runs of other than
    white space), or the tokenizer file's. Null and empty texts are the end alone. bin names a bin of the whole result and capacity
    its length; place and bin_offset say where in the bin a piece stands. Ties are ordered by doc_id and a hash of the text;
    repeated rows are packed each. Other columns of docs are ignored.
    """
    lengths = sorted(set(lengths))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    if tokenizer_file is None:
        sized = base.select("doc_id", "key", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("total"))
    else:
        sized = base.mapInArrow(_count(tokenizer_file), "doc_id long, key long, total long")
    sized = materialize(sized.withColumn("total", F.col("total") + 1))
    parts = blocks_for(sized.agg(F.sum("total")).first()[0], tokens_per_part)
    largest = lengths[-1]
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / largest).cast("long"))))
    pieces = pieces.select(
        "doc_id", "key", F.col("piece").cast("int").alias("piece"), (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece") * largest).cast("int").alias("n_tokens"),
    )
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "key"), F.lit(parts)))
    return pieces.groupBy("part").applyInArrow(_pack_part(lengths), "doc_id long, piece int, start long, n_tokens int, bin string, capacity int, place int, bin_offset int")
