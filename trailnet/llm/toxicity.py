"""Toxicity scores over text restored from disguises: leetspeak, spacing between letters, repeated letters.

1. A character language model (trigrams) is counted over all texts.
2. Tokens that look disguised, and runs of single characters, become lattices: each observed character stands for
   letters it may have replaced, for nothing (a separator), or for the letter before it (a repetition). Viterbi decoding
   under the language model and the channel's costs finds the likeliest letters. Other tokens stay as they are.
3. Restored words and their beginnings are weighed by how they divide a bounded sample of labelled documents; a
   logistic model over a document's strongest weights gives the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: What a character may stand for besides itself.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = set(".-_*~'·/\\:,;+|")
EDGE = ".,;:?\"'()[]{}<>…«»“”"
#: Runs of signs before or after a word, which stand for no letter of it.
_SIGNS = re.compile(r"^[&%#*]+|(?:[&%#*!]|\$(?=\$\$)|(?<=\$)\$(?=\$)|(?<=\$\$)\$)+$")
CLASSES = 28  # 0: a word's edge, 1 to 26: a to z, 27: any other letter
REPEAT, SEPARATE, REPLACE, DROP = -1.5, -0.5, -0.7, -9.0
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_NOISY = re.compile(r"(?=.*[^\W\d_])(?:.*[\d@$!|+€£¡*~_\-.·/\\].*|.*(.)\1\1.*)", re.S)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the texts' letters over the whole table; the result has CLASSES ** 3 cells, whatever the input."""

    def run(batches):
        for batch in batches:
            n = np.zeros(CLASSES**3, np.int64)
            for t in batch.column(0):
                c = _CLASS[np.frombuffer(b"  " + (t.as_py() or "").encode() + b"  ", np.uint8)]
                np.add.at(n, (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], 1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["gram", "n"])

    counted = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES**3, np.int64)
    for r in counted.collect():
        out[r["gram"]] = r["n"]
    return out.reshape((CLASSES,) * 3)


def char_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams smoothed by bigrams and these by letters."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(0) + 20 * one
    two /= two.sum(1, keepdims=True)
    three = counts + 20 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def _kind(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a lower-case token: Viterbi over states of the last two letters, whatever the token's length.

    A path is a chain of its letters, last one first, that paths share as far as they are one.
    """
    beam: dict[tuple, tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for c in token:
        new: dict[tuple, tuple[float, tuple | None]] = {}
        ways = [(c, 0.0)] if c.isalpha() else []
        ways += [(x, REPLACE) for x in LEET.get(c, "")]
        drop = SEPARATE if c in SEPARATORS else None if c.isalpha() else DROP
        for (a, b, last), (score, path) in beam.items():
            for x, cost in ways:
                k = _kind(x)
                key, s = (b, k, x), score + cost + float(model[a, b, k])
                if key not in new or s > new[key][0]:
                    new[key] = (s, (path, x))
                if x == last:
                    key, s = (a, b, last), score + cost + REPEAT
                    if key not in new or s > new[key][0]:
                        new[key] = (s, path)
            if drop is not None:
                key, s = (a, b, last), score + drop
                if key not in new or s > new[key][0]:
                    new[key] = (s, path)
        beam = new
    _, path = max(((s + float(model[a, b, 0]), path) for (a, b, _), (s, path) in beam.items()), key=lambda x: x[0], default=(0.0, None))
    letters = []
    while path:
        path, x = path
        letters.append(x)
    return "".join(reversed(letters)) or token


def restore(token: str, model: np.ndarray) -> str:
    """A token in lower case without punctuation at its edges, decoded if it looks disguised."""
    t = _SIGNS.sub("", token.lower().strip(EDGE)).strip(EDGE)
    return decode(t, model) if _NOISY.match(t) else t


def spaced_runs(tokens: list[str]) -> list[str]:
    """Single characters in a row, three or more, as one token each."""
    out, run = [], []
    for t in [*tokens, ""]:
        if len(t) == 1:
            run.append(t)
        else:
            if len(run) > 2:
                out.append("".join(run).lower())
            run = []
    return out


class Restorer:
    """Restored forms of tokens, each distinct one worked out once; the table is emptied at a bound."""

    def __init__(self, model: np.ndarray, value, bound: int = 400_000):
        self.model, self.value, self.bound, self.known = model, value, bound, {}

    def __call__(self, text: str | None) -> list:
        """value(word) of the distinct restored words of a text."""
        tokens = (text or "").split()
        known = self.known
        if len(known) > self.bound:
            known.clear()
        words = set(tokens)
        for t in words:
            if t in known:
                continue
            known[t] = self.value(restore(t, self.model))
        out = [known[t] for t in words]
        if sum(len(t) == 1 for t in words) and sum(len(t) == 1 for t in tokens) > 2:
            out += [self.value(decode(r, self.model)) for r in set(spaced_runs(tokens))]
        return out


def features(word: str) -> list[str]:
    """A word and its beginnings of four and five letters."""
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5) if len(word) > k)] if len(word) > 2 else []


def _count_features(model: np.ndarray):
    def run(batches):
        for batch in batches:
            n: dict[int, Counter] = {0: Counter(), 1: Counter()}
            read = Restorer(model, features)
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                n[label].update({f for fs in read(text) for f in fs})
            found = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([n[1][f] for f in found], pa.int64()), pa.array([n[0][f] for f in found], pa.int64())], ["feature", "pos", "neg"])

    return run


class Scorer:
    """Weights of features, and a logistic model over a document's strongest ones."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        self.model, self.weights = model, weights
        self.coef = np.array([-4.0, 1.0, 0.5, 0.0])

    def best(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def signs(self, texts: list[str | None], read: Restorer) -> np.ndarray:
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        for i, t in enumerate(texts):
            top = sorted((w for w in read(t) if w > 0), reverse=True)[:3]
            out[i, 1] = top[0] if top else 0
            out[i, 2] = sum(top[1:])
            out[i, 3] = 0 if top else 1
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, strength: float = 0.05, rounds: int = 30) -> None:
        """Newton's method, with a small pull towards the starting coefficients."""
        start = self.coef.copy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))
            grad = x.T @ (p - y) + strength * (self.coef - start)
            hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(4)
            self.coef = self.coef - np.linalg.solve(hess, grad)


#: Of all documents, the finest share that a sample can have.
SHARES = 1 << 60


def weigh(pos: float, neg: float, all_pos: int, all_neg: int, least_g: float) -> float:
    """Log odds of a feature that pos of all_pos toxic and neg of all_neg clean documents have, less its standard error; 0
    where it doesn't point to toxic documents or the likelihood ratio statistic is under least_g."""
    if pos <= 0 or neg < 0 or all_pos <= 0 or all_neg <= 0 or pos * all_neg <= neg * all_pos:
        return 0.0
    share = (pos + neg) / (all_pos + all_neg)
    cells = ((pos, all_pos * share), (neg, all_neg * share), (all_pos - pos, all_pos * (1 - share)), (all_neg - neg, all_neg * (1 - share)))
    if 2 * sum(n * np.log(n / e) for n, e in cells if n > 0 and e > 0) < least_g:
        return 0.0
    odds = np.log((pos + 0.5) / (all_pos + 1)) - np.log((neg + 0.5) / (all_neg + 1))
    return max(0.0, float(odds - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))))


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, toxic_docs: int = 4000, clean_docs: int = 8000, max_features: int = 20_000, least_g: float = 10.0) -> Scorer:
    """Fit on about toxic_docs and clean_docs of docs(doc_id, text) that labels(doc_id, toxic) has as such, chosen by a hash of doc_id. At most
    max_features features, those most documents of the sample divide by, are kept. The logistic model is fitted on the same sample, each
    document with weights that leave it out."""
    model = char_model(counts)
    labels = labels.where("toxic IN (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for k, most in ((0, clean_docs), (1, toxic_docs)):
        share = F.when(F.col("toxic") == k, min(SHARES, SHARES * most // n.get(k, 1))).otherwise(share)
    # About as many as are asked for, of however many there are: their ids can go to the texts.
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(SHARES)) < share).select("doc_id", "toxic")
    sample = materialize(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Scorer(model, {})
    counted = sample.mapInArrow(_count_features(model), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lead = F.col("pos") / pos - F.col("neg") / neg
    kept = counted.where(f"pos >= 3 AND pos * {neg} > 3 * neg * {pos}").orderBy(F.desc(lead), "feature").limit(max_features).collect()

    def weights(p: int, q: int) -> dict[str, float]:
        found = ((r["feature"], weigh(r["pos"] - p, r["neg"] - q, pos - p, neg - q, least_g)) for r in kept)
        return {f: w for f, w in found if w}

    scorer = Scorer(model, weights(0, 0))
    without = {1: Scorer(model, weights(1, 0)), 0: Scorer(model, weights(0, 1))}

    def run(batches):
        for batch in batches:
            for k, own in without.items():
                texts = [t for t, y in zip(*(c.to_pylist() for c in batch.columns)) if y == k]
                x = own.signs(texts, Restorer(model, own.best))
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array([k] * len(x), pa.int32())], ["x", "toxic"])

    rows = sample.mapInArrow(run, "x array<double>, toxic int").collect()
    scorer.fit(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs(doc_id, text); null and empty texts score as a text without signs."""

    def run(batches):
        read = Restorer(scorer.model, scorer.best)
        for batch in batches:
            x = scorer.signs(batch.column(1).to_pylist(), read)
            s = 1 / (1 + np.exp(-np.clip(x @ scorer.coef, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(5)) == 0


def rate(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Learn from labels(doc_id, toxic) outside the held-out fold, and score every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = score(docs, train(docs, known, count_trigrams(docs), **bounds))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
