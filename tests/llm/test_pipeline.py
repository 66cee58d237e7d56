import random

import corpus_pipeline as cp
import test_decontamination
import test_line_dedup
from trailnet.llm import decontamination as dc
from trailnet.llm import minhash_dedup as md

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", len(t or "")) for d, t in rows], SCHEMA)


def test_stages_and_columns(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]
    r = random.Random(5)
    words = {"en": ["the", "house", "which", "green", "thing"], "de": ["das", "haus", "welche", "gruen", "ding"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(60)), k, "s", 0) for i in range(60) for k in (("en", "de")[i % 2],)]
    rows += [(100, "12 34 ??", None, None, 8), (101, None, "en", None, None), (None, " ".join(words["en"] * 9), None, "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[4][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    told = cp.language(spark, docs, str(tmp_path))
    assert {x.doc_id for x in docs.collect()} - {x.doc_id for x in told.collect()} == {100, 101}
    out = cp.run(spark, str(tmp_path))
    assert {x.doc_id for x in out.collect()} == {x.doc_id for x in told.collect()} - {4} and "capacity" in out.columns


def test_lines_against_brute_force(spark):
    rows = [(d, t) for d, t in test_line_dedup.corpus(7)]
    want = {d for d, t in rows if d in (200, 201, 202)}
    out = cp.lines(spark, frame(spark, rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    import hashlib

    left = {b[0]: b[5] for b in test_line_dedup.brute(rows, None)}
    got = {x.doc_id: x for x in out.collect()}
    assert want <= set(got)
    for d, t in rows:
        if d in got:
            assert hashlib.sha256((got[d].text or "").encode()).hexdigest() == left[d] and got[d].n_chars == len(got[d].text or "")
    empty = {hashlib.sha256(("\n" * k).encode()).hexdigest() for k in range(9)}
    assert all(left[d] in empty for d, t in rows if d not in got)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for g in range(15):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(30, 120))]
        for _ in range(r.choice([1, 2, 6])):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = f"x{r.randint(0, 99)}"
            rows.append((len(rows), " ".join(t)))
    sets = [md.shingles(md.words_of(t), 5) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert sorted(x.doc_id for x in cp.near_dedup(spark, frame(spark, rows), "").collect()) == [i for i in range(len(rows)) if root(i) == i]


def test_benchmark_against_brute_force(spark, tmp_path):
    docs, items = test_decontamination.corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = {t for (_, t), (_, hit, _) in zip(sorted(docs, key=lambda x: str((x[0],))), sorted(test_decontamination.brute(docs, items, 0.5, 8), key=lambda x: str((x[0],)))) if hit}
    got = cp.benchmark(spark, frame(spark, docs), str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(((d, t) for d, t in docs if t not in bad), key=str)
    assert dc.MASKS[0] == "111111"


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = ", ".join(f"{c} int" for c in ("maybe", "_word", "_bits", "key", "place", "h", "line", "c0", "_gone", "sig", "score", "kept"))
    none = spark.createDataFrame([], f"{SCHEMA}, {odd}")
    words = ["the house which is green stands there and nobody lives in it any more since long ago", "der hund und die katze sind nicht in dem haus sondern im garten bei den alten baeumen"]
    rows = [(i, f"{words[i % 2]} {i} {i * 7}", ("en", "de")[i % 2], "s", 1, *range(12)) for i in range(40)] + [(None, None, None, None, None, *range(12)), (3, words[1] * 4000, "de", "s", 1, *range(12))]
    some = spark.createDataFrame(rows, none.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, some, str(tmp_path))
        assert out.columns == some.columns and 0 < out.count() <= len(rows)
    assert cp.STAGES[-1][1](spark, some, str(tmp_path)).count() >= len(rows)
