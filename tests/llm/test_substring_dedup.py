import hashlib
import random

import numpy as np

from trailnet.llm import substring_dedup as sd


def brute(rows, length):
    starts = {}
    for doc, text in rows:
        if doc is not None:
            b = (text or "").encode()
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                starts[w] = min(starts.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        if doc is not None:
            for i in range(len(b) - length + 1):
                if starts[b[i : i + length]] < doc:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "ab", "è", "xyz", "tion", "aaaa", "q"]
    shared = [" ".join(r.choice(words) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        if r.random() < 0.6:
            s = r.choice(shared)
            a = r.randint(0, len(s))
            t = t[: len(t) // 2] + s[a : a + r.randint(20, 120)] + t[len(t) // 2 :]
        rows.append((i, t))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, ""), (None, shared[0]), (5, rows[7][1] + shared[1]), (n + 4, "a" * 300), (n + 5, "a" * 200 + "b"), (2, rows[2][1])]
    r.shuffle(rows)
    return rows


def test_suffix_order_is_sorted():
    r = np.random.default_rng(1)
    codes = np.append(r.integers(0, 4, 3000), 0).astype(np.uint16)
    order = sd.suffix_order(codes, 60)
    assert sorted(order.tolist()) == list(range(len(codes)))
    key = [tuple(np.append(codes[i : i + 40], -1).tolist()) for i in order]
    assert key == sorted(key)


def test_matches_brute_force(spark):
    rows = corpus(7, 150)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, md5 string")
    got = sd.remove_repeats(df, bucket_bytes=4000, range_bytes=8000).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 50)


def test_crowded_anchors_match_brute_force(spark):
    rows = corpus(8, 150)
    r = random.Random(9)
    banner = "this banner stands in every document of the table, whatever is around it"
    rows += [(1000 + i, f"{r.random()} {banner[r.randint(0, 3):]} {r.random()}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.remove_repeats(df, bucket_bytes=4000, range_bytes=8000, least_crowded=5, slab=100).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 50)


def test_very_long_text_and_repeated_rows(spark):
    r = random.Random(10)
    long = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, long[1000:3000]), (2, long[1000:3000]), (3, "x" * 49), (4, "x" * 49)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (400_000, 0, 0), 2: (2000, 2000, 1), 3: (49, 0, 0), 4: (49, 0, 0)}


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
