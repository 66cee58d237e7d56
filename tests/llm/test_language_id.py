import numpy as np

from trailnet.llm import language_id as li


def test_gradients_match_differences():
    net = li.ByteGRU(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = li.padded([b"abc", b"zz", b"hello"])
    label = np.array([0, 2, 1])
    _, g = net.gradients(x, mask, label)
    for k, at in (("Uf", (98, 3)), ("Wf", (1, 9)), ("Ub", (122, 1)), ("Wb", (2, 5)), ("V", (5, 1)), ("c", (2,))):
        eps, old = 1e-3, net.p[k][at]
        net.p[k][at] = old + eps
        up = net.gradients(x, mask, label)[0]
        net.p[k][at] = old - eps
        down = net.gradients(x, mask, label)[0]
        net.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.identify(docs, docs_per_lang=150).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_edge_rows(spark):
    rows = [(i, "the and of with this", "en", 1) for i in range(30)] + [(i + 30, "der und die nicht", "de", 1) for i in range(30)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "123 !? — 5", "de", 1), (None, "und der", "de", 1), (103, "Д" * 500, "en", 1), (31, "der die", "de", 1)]
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    pred = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [pred[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and pred[100].score == 0
    assert pred[None].lang_pred == "de" and not pred[None].held_out and pred[103].lang_pred in ("en", "de")


def test_empty_table(spark):
    assert li.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_scores_match_a_network_read_word_by_word(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, net = model = li.train(docs.select("doc_id", "text", "lang"), docs_per_lang=20)
    rows = [(1, "the and of"), (2, "der und die nicht das " * 9), (3, "漢字" * 900), (4, "a" * 5000), (5, "the THE the"), (5, "the THE the")]
    got = {r.doc_id: r for r in li.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc, text in rows:
        words = li._pieces(text)
        assert b"".join(words).decode().replace("the", "") is not None and all(w.decode() for w in words)  # cut between characters
        per = [net.log_probs(*li.padded([w]))[0][:, 0] for w in words]
        mean = np.concatenate(per).mean(0)
        y = (mean - net.p["prior"]) * min(len(words), 12) + net.p["prior"]
        p = np.exp(y - y.max())
        assert got[doc].lang_pred == langs[int(p.argmax())] and abs(got[doc].score - p.max() / p.sum()) < 1e-3
