import random
from collections import defaultdict

import pytest

from trailnet.llm import packing


def naive(sizes, lengths):
    """The same rule, looking at every bin each time."""
    bins, where = [], []
    for i, size in enumerate(sizes):
        fits = [(b["cap"] - b["held"], k) for k, b in enumerate(bins) if b["cap"] - b["held"] >= size]
        if fits:
            room = min(fits)[0]
            k = max((bins[k]["at"], k) for r, k in fits if r == room)[1]
        else:
            later = sizes[i + 1 :]
            price = lambda c: (packing.cost(c) / (size + min(c - size, sum(x for x in later if x <= c - size))), c)
            bins.append({"cap": min((c for c in lengths if c >= size), key=price), "held": 0, "at": 0})
            k = len(bins) - 1
        bins[k]["held"] += size
        bins[k]["at"] = i + 1
        where.append(k)
    return where, [min(c for c in lengths if c >= b["held"]) for b in bins]


@pytest.mark.parametrize("seed", range(8))
def test_pack_is_best_fit(seed):
    r = random.Random(seed)
    lengths = [16, 32, 64, 128]
    sizes = sorted((r.choice([r.randint(1, 20), r.randint(1, 128)]) for _ in range(300)), reverse=True)
    assert packing.pack(sizes, lengths) == naive(sizes, lengths)


def test_bins_hold_every_piece_once(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 3, 40, 90, 700])))) for i in range(200)] + [(None, "a b"), (5, None), (5, None), (6, " \n")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, bin int")
    got = packing.pack_documents(df, (64, 128, 256), tokens_per_part=3000).collect()
    bins, docs = defaultdict(list), defaultdict(int)
    for p in got:
        bins[p.bin, p.capacity].append(p)
        docs[p.doc_id] += p.n_tokens
    want = defaultdict(int)
    for d, t in rows:
        want[d] += len((t or "").split()) + 1
    assert docs == want and len({b for b, _ in bins}) == len(bins)
    for (_, cap), own in bins.items():
        own.sort(key=lambda p: p.place)
        held = sum(p.n_tokens for p in own)
        assert [p.place for p in own] == list(range(len(own))) and held <= cap and cap == min(c for c in (64, 128, 256) if c >= held)
        assert [p.bin_offset for p in own] == [sum(q.n_tokens for q in own[:k]) for k in range(len(own))]
    assert sum(want.values()) / sum(c for _, c in bins) > 0.85


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
