import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from trailnet.llm import sharding


def brute(rows, shards, seed):
    by = defaultdict(list)
    for d, t, s in rows:
        data = (t or "").encode()
        by["" if s is None else "=" + s].append((hashlib.md5(f"{seed}/{'' if d is None else d}".encode()).hexdigest(), d if d is not None else float("-inf"), zlib.crc32(data), len(data) + 1, d))
    order = []
    for s, own in by.items():
        phase = Fraction(zlib.crc32(f"{s}/{seed}".encode()) % 65536, 65536)
        for r, x in enumerate(sorted(own)):
            order.append((int((r + phase) / len(own) * 2**40), s, x))
    order.sort()
    n, out = len(order), []
    starts = [k * n // shards for k in range(shards + 1)]
    for p, (_, _, x) in enumerate(order):
        k = max(k for k in range(shards) if starts[k] <= p and starts[k] < starts[k + 1])
        out.append((x[4], x[3], x[2], k, p - starts[k]))
    return sorted(out, key=str)


def corpus():
    rows = [(i, f"text {i % 50} é" * (i % 7), "hot" if i % 3 else f"s{i % 4}") for i in range(500)]
    return rows + [(None, None, None), (7, "again", "hot"), (7, "again", "hot"), (501, "", None)]


@pytest.mark.parametrize(("shards", "per_bin"), [(8, 10), (3, None), (1, 40)])
def test_matches_brute_force(spark, shards, per_bin):
    rows = corpus()
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, shard int")
    got = sharding.interleave(df, shards, 42, per_bin).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=str) == brute(rows, shards, 42)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    mix = Counter((r.shard, r.source) for r in got)
    for source, n in Counter(r[2] for r in rows).items():
        assert all(abs(mix[k, source] - n / shards) <= 2 for k in range(shards))


def test_fewer_rows_than_shards_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, source string")
    assert sorted((r.shard, r.slot) for r in sharding.interleave(df).collect()) == [(3, 0), (7, 0)]
    assert sharding.interleave(df.limit(0)).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "source").collect()), key=str) == sorted(corpus(), key=str)


def test_sources_of_one_row_spread(spark):
    rows = [(i, "t", f"own{i}" if i % 2 else "hot") for i in range(400)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8, 42, 20).collect()
    share = Counter(r.shard for r in got if r.source != "hot")
    assert all(10 <= share[k] <= 40 for k in range(8))
