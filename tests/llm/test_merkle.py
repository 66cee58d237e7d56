import hashlib
import zlib
from collections import defaultdict

import pytest

from trailnet.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, leaf int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def climb(tree, place, start, fanout):
    """(siblings in order, root that start gives)."""
    own, value = [], start
    for level in tree[:-1]:
        first = place // fanout * fanout
        run = level[first : first + fanout]
        left, right = run[: place - first], run[place - first + 1 :]
        own += left + right
        value, place = h("".join([*left, value, *right])), place // fanout
    return own, value


def brute(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {k: sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    trees = {k: levels([leaf(r) for r in ordered[k]], fanout) for k in langs}
    top = levels([trees[k][-1][0] for k in langs], fanout)
    root, out = top[-1][0], []
    for at, k in enumerate(langs):
        for i, r in enumerate(ordered[k]):
            told = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                told[3] += 1
            low, sub = climb(trees[k], i, leaf(told), fanout)
            high, folded = climb(top, at, sub, fanout)
            out.append((r[0], leaf(r), trees[k][-1][0], root, h("".join(low + high)), folded, folded == root))
    return sorted(out, key=str)


def corpus():
    rows = [(i * 3, f"s{i % 5}", "en" if i % 3 else ("de", "é", "", None)[i // 3 % 4], i, f"text {i} é" * (i % 4), "p", 1) for i in range(180)]
    rows += [(None, None, None, None, None, None, None), (7, "a", "one", 3, "a lone leaf", None, 0), (2**60 + 1, "s", "en", None, "large", None, 0)]
    rows += [(3, "s", "en", 1, "other", None, 0)] + [(9, "s", "en", 1, "same", None, 0)] * 30
    return rows


@pytest.mark.parametrize(("fanout", "run_rows", "region"), [(2, 7, 1), (2, 50, 10), (3, 9, 2), (2, None, 10)])
def test_matches_brute_force(spark, fanout, run_rows, region):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.verify(merkle.manifest(df, fanout, run_rows, region))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:5] for r in rows], fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_small_tables(spark, n):
    rows = [(i, "s", "en", 1, "t", None, None) for i in range(n)]
    got = merkle.verify(merkle.manifest(spark.createDataFrame(rows, SCHEMA), run_rows=2, region_levels=1)).collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:5] for r in rows], 2)


def test_empty_table(spark):
    assert merkle.verify(merkle.manifest(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 16, 33])
@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_of_any_cut_give_one_root(n, fanout):
    leaves = [h(str(i)) for i in range(n)]
    root = levels(leaves, fanout)[-1][0]
    for cut in range(n + 1):
        peaks = []
        for part in (range(cut), range(cut, n)):
            run = merkle.Range(n, fanout)
            for i in part:
                run.push(0, i, leaves[i])
            peaks += [(*at, run.nodes[at]) for at in run.stack]
        whole = merkle.Range(n, fanout)
        for p in sorted(peaks, key=lambda p: p[1] * fanout ** p[0]):
            whole.push(*p)
        assert [whole.nodes[at] for at in whole.stack] == [root]


def test_a_changed_row_is_found(spark):
    rows = [(i, "s", "en", 5, f"t{i}", None, None) for i in range(40)]
    got = {r.doc_id: r.verified for r in merkle.verify(merkle.manifest(spark.createDataFrame(rows, SCHEMA), run_rows=8)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(40)} and len(set(got.values())) == 2
