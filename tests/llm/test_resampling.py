import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trailnet.llm import resampling

FOLD = {c: c + 32 for c in range(65, 91)}


def runs_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, share=(5, 100), least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs_of(text)[1]))
    for text in target:
        t.update(map(bucket, runs_of(text)[1]))
    sa, ta = sum(s.values()), sum(t.values())
    rows = []
    for d, text in docs:
        n, fs = runs_of(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (sa + 10000) / ((s[b] + 1) * (ta + 10000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: share[0] * len(able) // share[1]]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def corpus():
    words = "red green Blue élan 42 stone river under over the a x-ray no_one".split()
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(1300)]
    docs += [(2000 + i, "one hot text, copied: " + "stone river " * 12) for i in range(700)]
    docs += [(None, None), (None, ""), (3, None), (None, "stone river " * 15), (9000, "river stone " * 4000), (9001, "x" * 5000 + " y"), (9002, "\n\t --"), (7, docs[7][1]), (7, docs[7][1])]
    return docs, ["stone river under the red", "élan 42", None, "", "stone river under the red"]


@pytest.mark.parametrize("range_rows", [100, 20_000])
def test_matches_brute_force(spark, range_rows):
    docs, target = corpus()
    df = spark.createDataFrame([(d, t, 1.0, "k") for d, t in docs], "doc_id long, text string, weight double, key string").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), range_rows=range_rows)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    want = brute(docs, target)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 60


def test_checksums_go_on():
    words = [b"a", "é".encode(), b"long" * 50]
    assert list(resampling.hashed_runs(words, 3, 10000)) == [zlib.crc32(b" ".join(words[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(4 - k)]
    assert resampling.hashed_runs([], 3, 10000).size == 0 and resampling.hashed_runs([b"a"], 3, 10000).size == 1


def test_empty_tables_and_ties(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    text = "stone river " * 10
    tied = spark.createDataFrame([(5, text)] * 40, "doc_id long, text string")
    got = [r["rank"] for r in resampling.resample(tied, none).collect()]
    assert sorted(filter(None, got)) == [1, 2] and len(got) == 40
    assert resampling.drawn(tied.withColumn("rank", tied.doc_id), none).count() == 40


def test_a_target_is_drawn(spark):
    plain, wanted = "over and under the green hill " * 6, "quark gluon boson lepton hadron " * 6
    rows = [(i, wanted if i % 20 == 0 else plain) for i in range(400)]
    got = resampling.drawn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(wanted,)], "text string"))
    assert {r.doc_id % 20 for r in got.collect()} == {0} and got.count() == 20
