import numpy as np

from trailnet.llm import toxicity as tx


def model(spark, words):
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(50)], "doc_id long, text string")
    return tx.char_model(tx.count_trigrams(docs))


def test_decodes_leet_spacing_and_repetition(spark):
    m = model(spark, ["idiot", "stupid", "the", "clown", "of", "and", "loser", "moon"])
    for seen, meant in (("1d10t", "idiot"), ("id1ot", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("cl0wwwn", "clown"), ("the", "the"), ("Loser!", "loser"), ("moon", "moon"), ("2021", "2021")):
        assert tx.restore(seen, m).strip("!") == meant, seen
    assert [tx.decode(r, m) for r in tx.spaced_runs("so i d i o t a b".split())] == ["idiotab"]
    assert [tx.decode(r, m) for r in tx.spaced_runs("so i d i o t ab".split())] == ["idiot"]


def test_viterbi_is_the_best_path(spark):
    m = model(spark, ["slit", "list", "so", "its"])
    import itertools

    def best(token):
        choices = [[(x, tx.REPLACE) for x in tx.LEET.get(c, "")] + ([(c, 0.0)] if c.isalpha() else []) for c in token]
        def value(path):
            a = b = 0
            total = 0.0
            for x, cost in path:
                k = tx._kind(x)
                total += cost + m[a, b, k]
                a, b = b, k
            return total + m[a, b, 0]
        return max("".join(x for x, _ in p) if False else (value(p), "".join(x for x, _ in p)) for p in itertools.product(*choices))[1]

    for token in ("5l17", "l15t", "17s", "50"):
        digits = tx.decode(token, m)
        if len(digits) == len(token):
            assert digits == best(token)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = tx.rate(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93
    assert got[got.toxic == 1].predicted.mean() > 0.6


def test_edge_rows(spark):
    rows = [(i, "you idiot" if i % 2 else "the end", 1) for i in range(200)] + [(500, None, 1), (501, "", 1), (None, "1d10t", 1), (502, "a " * 5000, 1), (503, "x" * 5000 + "1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(200)] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in tx.rate(docs, labels).collect()}
    assert len(got) == len(rows) and got[None].predicted == 1 and got[500].predicted == 0 and got[501].score == got[500].score
    assert got[1].predicted == 1 and got[2].predicted == 0
    none = spark.createDataFrame([], docs.schema)
    assert tx.rate(none, labels).count() == 0
    assert np.isfinite([r.score for r in tx.rate(docs, spark.createDataFrame([], labels.schema)).collect()]).all()
