"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and word prefixes, fitted on a bounded sample of labelled rows. In labelled
sentences that hold an identity term the term is swapped for the others of its group, and squared differences of the two
scores are added to the loss (counterfactual logit pairing), so a group's mention alone does not move a score.
"""

from __future__ import annotations

import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Rows the model is fitted on at most: labelled, not held out, least by a hash of their id. All features of those that tell
#: the labels apart, and all swaps in them, are used.
MOST_ROWS = 8192
SPACE = 1 << 22
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

# Identity terms, by group; swaps stay within a group.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "african", "latino", "hispanic", "european", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("deaf", "blind", "disabled", "elderly", "old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(word: str) -> tuple[int, ...]:
    """Feature numbers of a lower-case word: itself and its prefixes."""
    return tuple(xxhash.xxh32_intdigest(x) % SPACE for x in ("w" + word, *("p" + word[:k] for k in PREFIXES if len(word) > k)))


class Features(dict):
    """Word to its features that the model holds, remembered while memory is bounded."""

    def __init__(self, place: dict[int, int] | None):
        super().__init__()
        self.place = place

    def __missing__(self, word: str):
        if len(self) > 100_000:
            self.clear()
        own = features_of(word)
        self[word] = own = own if self.place is None else tuple(self.place[x] for x in own if x in self.place)
        return own

    def of(self, words) -> set[int]:
        out: set[int] = set()
        for word in words:
            if own := self[word]:
                out.update(own)
        return out


def words_in(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def swaps_in(text: str | None, groups=IDENTITY):
    """(words of a sentence, the same with an identity term swapped for each other of its group)."""
    others = {t: [u for u in g if u != t] for g in groups for t in g}
    low = (text or "").lower()
    if not any(t in low for t in others):
        return
    for sentence in SENTENCE.findall(low):
        words = WORD.findall(sentence)
        for t in OrderedDict.fromkeys(w for w in words if w in others):
            for u in others[t]:
                yield words, [u if w == t else w for w in words]


def fit(rows: list[tuple[float, list[int]]], pairs: list[tuple[list[int], list[int]]], n: int, strength: float = 1.0, l2: float = 3e-6, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias. ``pairs``: features that a swap adds and takes away. Full-batch Adam from zero: the same data, the same model."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
        return np.zeros(n), float(np.log(p / (1 - p)))
    flat = np.array([f for r in rows for f in r[1]], np.int64)
    own = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    pf = np.array([f for a, b in pairs for f in (*a, *b)], np.int64)
    ps = np.array([s for a, b in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    po = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    weight = np.where(y > 0, min(4.0, (len(y) - y.sum()) / y.sum()), 1.0)
    weight /= weight.sum()
    x, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    x[n] = np.log(y.mean() / (1 - y.mean()))
    for t in range(1, steps + 1):
        s = np.bincount(own, weights=x[flat], minlength=len(y)) + x[n]
        g = (1 / (1 + np.exp(-np.clip(s, -60, 60))) - y) * weight
        grad = np.append(np.bincount(flat, weights=g[own], minlength=n) + l2 * x[:n], g.sum())
        if len(pairs):
            gap = np.bincount(po, weights=x[pf] * ps, minlength=len(pairs)) * (2 * strength / len(pairs))
            grad[:n] += np.bincount(pf, weights=gap[po] * ps, minlength=n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x[:n], float(x[n])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, strength: float = 1.0) -> tuple[list[int], np.ndarray, float]:
    """Feature numbers, weights and bias, from labelled rows that aren't held out."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(MOST_ROWS).select(F.col("doc_id").alias("_id"), "y")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("y", "text")  # MOST_ROWS rows of two numbers

    def seen(batches):
        held = Features(None)
        for part in rows_of(batches, 64):
            own = [list(held.of(set(words_in(t)))) for t in part.column(1).to_pylist()]
            sizes = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(part.column(0).to_pylist(), float), sizes)), pa.array([f for x in own for f in x], pa.int64())], names=["y", "feature"])

    counted = texts.mapInArrow(seen, "y double, feature bigint").groupBy("feature").agg(F.sum("y").alias("c1"), F.count(F.lit(1)).alias("c"))
    n, n1 = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(MOST_ROWS).agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    c1, c0 = F.col("c1") + 0.5, F.col("c") - F.col("c1") + 0.5
    odds = F.log((c1 / F.lit(n1 + 1.0)) / (c0 / F.lit(n - n1 + 1.0)))
    kept = counted.filter("c >= 3").withColumn("z", F.round(F.abs(odds) / F.sqrt(1 / c1 + 1 / c0), 9)).filter("z >= 2.5").orderBy("feature")
    numbers = [r[0] for r in kept.select("feature").collect()]  # at most the features of MOST_ROWS texts
    place = {f: k for k, f in enumerate(numbers)}
    schema = pa.schema([("y", pa.float64()), ("own", pa.list_(pa.int64())), ("plus", pa.list_(pa.list_(pa.int64()))), ("minus", pa.list_(pa.list_(pa.int64())))])

    def shown(batches):
        held = Features(place)
        for part in rows_of(batches, 256):
            own, plus, minus = [], [], []
            for text in part.column(1).to_pylist():
                own.append(sorted(held.of(set(words_in(text)))))
                up, down = [], []
                for a, b in swaps_in(text):
                    fa, fb = held.of(a), held.of(b)
                    if fa != fb:
                        up.append(sorted(fb - fa))
                        down.append(sorted(fa - fb))
                plus.append(up)
                minus.append(down)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip((own, plus, minus), list(schema)[1:]))], schema=schema)

    got = sorted(tuple(r) for r in texts.mapInArrow(shown, "y double, own array<bigint>, plus array<array<bigint>>, minus array<array<bigint>>").collect())  # at most MOST_ROWS rows
    pairs = [(a, b) for r in got for a, b in zip(r[2], r[3])]
    weights, bias = fit([(r[0], r[1]) for r in got], pairs, len(numbers), strength)
    return numbers, weights, bias


def score(docs: DataFrame, model: tuple[list[int], np.ndarray, float]) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; only the text is an input of the score."""
    numbers, weights, bias = model
    place = {f: k for k, f in enumerate(numbers)}
    sent = docs.sparkSession.sparkContext.broadcast((place, weights, bias))  # at most the features of MOST_ROWS texts

    def run(batches):
        place, weights, bias = sent.value
        held = Features(place)
        for part in rows_of(batches):
            raw = np.array([bias + sum(weights[k] for k in sorted(held.of(set(words_in(t))))) for t in part.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(raw, -60, 60))))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scored(docs: DataFrame, labels: DataFrame, strength: float = 1.0) -> DataFrame:
    """Fit on ``labels(doc_id, toxic)`` and score every text of ``docs``.

    Null and empty texts get the bias's score. Without labels, or with one label only, every row gets the (clipped) prior.
    Several labels of an id: the highest counts. Rows that repeat are scored alike, texts of any length by all their words. An
    empty table gives no rows; other columns are ignored; a null id is not held out and never trains.
    """
    return score(docs, train(docs, labels, strength))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that the model does not reject.

    Null and empty texts have the bias's score and texts of any length that of all their words; rows with a null id and rows
    that repeat are judged by their text alone. Without labels of both kinds nothing is rejected. An empty table stays empty.
    """
    numbers, weights, bias = train(docs, labels)
    place = {f: k for k, f in enumerate(numbers)}
    sent = docs.sparkSession.sparkContext.broadcast((place, weights, bias))
    at = docs.columns.index("text")

    def run(batches):
        place, weights, bias = sent.value
        held, limit = Features(place), np.log(THRESHOLD / (1 - THRESHOLD))
        for part in rows_of(batches):
            stay = [bias + sum(weights[k] for k in sorted(held.of(set(words_in(t))))) < limit for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
