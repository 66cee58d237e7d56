"""Language identification by a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

The network reads the bytes of a word in both directions, and gives every byte position a probability for each language. A
document pools the log probabilities of all its positions, each with the same weight. Words repeat, so a task labels the positions of each
distinct word once and keeps their sum, in a table of bounded size. What has no spaces for PIECE bytes is read in such pieces, cut
between characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1024
#: Positions that the network reads at once.
AT_ONCE = 4096 * 24
#: Of all documents, the finest share that a sample can have.
SHARES = 1 << 60
#: Letters A-Z in lower case, other ASCII as spaces, the rest as it is.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: str) -> list[bytes]:
    words = text.encode().translate(_CLEAN).split()
    if any(len(w) > PIECE for w in words):
        words = [p for w in words for p in _cut(w)]
    return words


def _cut(word: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(word):
        end = at + PIECE
        while end < len(word) and end > at + PIECE - 4 and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return out


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class ByteGRU:
    """Two GRUs, one in each direction, and a softmax at every position."""

    def __init__(self, classes: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        h3 = 3 * hidden
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["U" + d] = r.normal(0, 0.3, (256, h3)).astype(np.float32)
            self.p["W" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, h3)).astype(np.float32)
        self.p["V"] = r.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)

    def _scan(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        n, steps = x.shape
        h = np.zeros((n, self.hidden), np.float32)
        out, kept, k = np.zeros((steps, n, self.hidden), np.float32), [], self.hidden
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = self.p["U" + d][x[:, t]], h @ self.p["W" + d]
            zr = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            cand = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
            m = mask[:, t, None]
            if keep:
                kept.append((t, h, z, r, cand, g[:, 2 * k :], m))
            h = np.where(m, cand + z * (h - cand), h)
            out[t] = h
        return out, kept

    def log_probs(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, kf = self._scan("f", x, mask, keep)
        b, kb = self._scan("b", x, mask, keep)
        both = np.concatenate((f, b), 2)
        y = both @ self.p["V"] + self.p["c"]
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True)), both, {"f": kf, "b": kb}

    def gradients(self, x, mask, label):
        """Loss and gradients of the mean cross entropy over all positions."""
        logp, both, kept = self.log_probs(x, mask, True)
        w = mask.T.astype(np.float32) / mask.sum()
        rows = np.arange(len(label))
        loss = -float((logp[:, rows, label] * w).sum())
        dy = np.exp(logp)
        dy[:, rows, label] -= 1
        dy *= w[:, :, None]
        k, flat = self.hidden, dy.reshape(-1, dy.shape[2])
        g = {"V": both.reshape(-1, 2 * k).T @ flat, "c": flat.sum(0)}
        dboth = dy @ self.p["V"].T
        for d, part in (("f", dboth[:, :, :k]), ("b", dboth[:, :, k:])):
            gu, gw, w_t = np.zeros_like(self.p["U" + d]), np.zeros_like(self.p["W" + d]), self.p["W" + d].T
            dh = np.zeros((len(label), k), np.float32)
            for t, h, z, r, cand, gn, m in reversed(kept[d]):
                dh = dh + part[t]
                live = dh * m
                dcand = live * (1 - z) * (1 - cand * cand)
                dz, dr = live * (h - cand) * z * (1 - z), dcand * gn * r * (1 - r)
                dg = np.concatenate((dz, dr, dcand * r), 1)
                np.add.at(gu, x[:, t], np.concatenate((dz, dr, dcand), 1))
                gw += h.T @ dg
                dh = dh * ~m + live * z + dg @ w_t
            g["U" + d], g["W" + d] = gu, gw
        return loss, g

    def fit(self, words: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        lens, step, total = np.array([len(w) for w in words]), 0, epochs * -(-len(words) // batch)
        for _ in range(epochs):
            order = r.permutation(len(words))
            order = order[np.argsort(lens[order], kind="stable")]  # batches of words of like length
            for at in r.permutation(np.arange(0, len(words), batch)):
                own = order[at : at + batch]
                x, mask = padded([words[i] for i in own])
                _, g = self.gradients(x, mask, labels[own])
                step += 1
                lr = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] * g[k] - v[k])
                    self.p[k] -= (lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum over its positions of their log probabilities, and the number of these."""
        out = np.zeros((len(words), len(self.p["c"]) + 1), np.float32)
        out[:, -1] = lens = np.array([len(w) for w in words])
        order = np.argsort(lens, kind="stable")
        at = 0
        while at < len(words):
            end = min(at + 4096, len(words))
            end = at + max(1, min(end - at, AT_ONCE // int(lens[order[end - 1]])))
            own = order[at:end]
            x, mask = padded([words[i] for i in own])
            logp = self.log_probs(x, mask)[0]
            out[own, :-1] = (logp * mask.T[:, :, None]).sum(0)
            at = end
        return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(w) for w in words])
    width = lens.max()
    x = np.frombuffer(b"".join(w.ljust(width, b" ") for w in words), np.uint8).reshape(-1, width)
    return x, np.arange(width) < lens[:, None]


def _draw_words(n: int):
    """Of each sampled document, at most n words drawn from its whole text."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = _pieces(text or "")
                r = np.random.default_rng([doc & 0xFFFFFFFF, len(words)])
                out.append([words[i] for i in r.permutation(len(words))[:n]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.binary()))], ["doc_id", "words"])

    return run


def train(labelled: DataFrame, docs_per_lang: int = 600, words_per_doc: int = 50, most_docs: int = 60_000, hidden: int = 16) -> tuple[list[str], ByteGRU] | None:
    """Fit on a bounded sample of labelled(doc_id, text, lang): of every language about docs_per_lang documents, fewer where that
    would be more than most_docs in all, chosen by a hash of doc_id, and words_per_doc words of each. None if nothing is labelled."""
    labelled = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    each = max(1, min(docs_per_lang, most_docs // len(counts)))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(SHARES, SHARES * each // r["count"])) for r in counts], "lang string, share long")
    drawn = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SHARES)) < F.col("share"))
    sample = drawn.select("doc_id", "text").mapInArrow(_draw_words(words_per_doc), "doc_id long, words array<binary>")
    by_doc = {r["doc_id"]: r["lang"] for r in drawn.select("doc_id", "lang").collect()}
    words, labels = [], []
    for r in sorted(sample.collect(), key=lambda r: r["doc_id"]):
        words += map(bytes, r["words"])
        labels += [langs.index(by_doc[r["doc_id"]])] * len(r["words"])
    if not words:
        return None
    net = ByteGRU(len(langs), hidden)
    labels = np.array(labels)
    weight = np.bincount(labels, minlength=len(langs)) / len(labels)
    net.fit(words, labels)
    net.p["prior"] = np.log(weight + 1e-3).astype(np.float32)
    return langs, net


def _predict(langs: list[str], net: ByteGRU, confident: int = 12, cache_words: int = 400_000):
    def run(batches):
        number: dict[bytes, int] = {}
        scores = np.zeros((0, len(langs) + 1), np.float32)
        for batch in batches:
            doc, text = batch.columns
            pred, score = [], []
            group, size = [], 0
            texts = text.to_pylist()
            for i, t in enumerate(texts):
                words = _pieces(t) if t and (any(97 <= (ord(c) | 32) <= 122 for c in t[:200]) or _has_letter(t)) else []
                group.append(words)
                size += len(words)
                if size > 500_000 or i == len(texts) - 1:
                    new = set().union(*group).difference(number)
                    if len(number) + len(new) > cache_words:
                        number, scores, new = {}, scores[:0], set().union(*group)
                    if new:
                        new = sorted(new)
                        number.update(zip(new, range(len(number), len(number) + len(new))))
                        scores = np.concatenate((scores, net.word_scores(new)))
                    for words in group:
                        if not words:
                            pred.append("und")
                            score.append(0.0)
                            continue
                        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                        own = scores[at].sum(0, dtype=np.float64)
                        y = (own[:-1] / own[-1] - net.p["prior"]) * min(len(words), confident) + net.p["prior"]
                        y = np.exp(y - y.max())
                        k = int(y.argmax())
                        pred.append(langs[k])
                        score.append(float(y[k] / y.sum()))
                    group, size = [], 0
            yield pa.RecordBatch.from_arrays([doc, pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], ByteGRU] | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text): und and 0 where the text is null or has no letter, or
    where there is no model. Other columns of docs are never read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.mapInArrow(_predict(*model), "doc_id long, lang_pred string, score double")


def told(docs: DataFrame, model: tuple[list[str], ByteGRU] | None, least: float = 0.5) -> DataFrame:
    """The rows of docs(text), with all their columns, whose language the model tells with a probability of least or more; none without a model.

    The verdict is made where the row is read, and the row goes on from there."""
    if model is None:
        return docs.limit(0)
    place = docs.columns.index("text")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def texts():
            for batch in batches:
                held.append(batch)
                yield pa.RecordBatch.from_arrays([batch.column(place), batch.column(place)], ["doc_id", "text"])

        for out in _predict(*model)(texts()):
            _, pred, score = out.columns
            yield held.pop(0).filter(pc.and_(pc.not_equal(pred, "und"), pc.greater_equal(score, least)))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(4)) == 2


def learned(docs: DataFrame, **bounds) -> tuple[list[str], ByteGRU] | None:
    """The model of docs(doc_id, text, lang), from what is not held out."""
    return train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out()), **bounds)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Train on the documents with a language that are not held out, and predict all. A null doc_id is never held out."""
    out = predict(docs, learned(docs, **bounds))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
