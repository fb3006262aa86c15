"""Toxicity by compression distance: windows are compressed with a dictionary of toxic and one of ordinary text.

Two zstandard dictionaries are trained. The ordinary one comes from windows of ordinary texts. The toxic one comes
from the windows of toxic texts that hold a byte sequence much more common there: seen in at least so many toxic
texts, after as many different windows (so that copies of one text don't count), at `LEAST_RATIO` times the rate of
ordinary texts. How many is no fixed number: it is `LEAST_SHARE` of the texts (`MANY_TEXTS` at least) or that halved
again and again, down to one text and last to all windows of toxic texts, as long as that lowers the loss on texts kept
out of training (each third once). A window is one word in lower case, with blanks around it: the
compressor looks for no match in the last bytes of its input, so each window is padded.

The distance of a window is its compressed length with the ordinary dictionary less that with the toxic one. A
window counts as a hit above a threshold, and a document is judged by its hits, their share and its largest
distances. Threshold and weights are calibrated on distances by dictionaries made of the other two thirds of the
training texts; the dictionaries that are kept are then made of all of them.

Training takes at most `MOST_LABELLED` documents of each class, those with the smallest hash of their id among the
rows outside fold 1, and of these, in this order, whole texts of at most `MOST_BYTES` characters together: a text that
finds no room is passed over, later ones that fit are taken. The ordinary dictionary is trained on every n-th of its
windows, about `ORDINARY_WINDOWS`. Without labels of both classes the score is the smoothed share of label 1. A null or empty text
has no window and gets the score of no hits. Equal texts get equal scores; no other column is read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import byte_words, fit_logistic, fold, ready, sigmoid, training_sample

MOST_LABELLED = 1500
# characters of training text of a class, whole texts only
MOST_BYTES = 48_000_000
GRAM = 6
LEAST_SHARE, MANY_TEXTS, LEAST_RATIO = 0.02, 8, 5.0
TOXIC_BYTES, ORDINARY_BYTES = 2048, 32768
ORDINARY_WINDOWS = 100_000
LEVEL = 3
TAIL = b" " + b"\0" * 16
THRESHOLDS = (0, 1, 2, 3)


def windows(text: str | None) -> list[bytes]:
    return byte_words(text.lower()) if text else []


def grams(word: bytes) -> list[bytes]:
    w = b" " + word + b" "
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


class Distance:
    """Compressed length with the ordinary dictionary less that with the toxic one; remembers windows."""

    def __init__(self, toxic: bytes, ordinary: bytes, most: int = 200_000):
        self._toxic, self._ordinary = self._with(toxic), self._with(ordinary)
        self._known, self._most = {}, most

    @staticmethod
    def _with(dictionary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=params).compress

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > self._most:
            known.clear()
        for w in [w for w in set(words) if w not in known]:
            padded = b" " + w + TAIL
            known[w] = len(self._ordinary(padded)) - len(self._toxic(padded))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


@dataclass(frozen=True)
class Detector:
    toxic: bytes
    ordinary: bytes
    threshold: float
    weights: tuple[float, ...]

    def score(self, distance: Distance | None, words: list[bytes]) -> float:
        if distance is None:
            return self.weights[-1]
        return float(sigmoid(np.append(document(distance.of(words), self.threshold), 1.0) @ np.array(self.weights)))

    def distance(self) -> Distance | None:
        return Distance(self.toxic, self.ordinary) if self.toxic else None


def document(distances: np.ndarray, threshold: float) -> np.ndarray:
    """What a document is judged by."""
    if not len(distances):
        return np.zeros(5)
    over = distances > threshold
    hits = over.sum()
    top = np.sort(distances)[-5:]
    return np.array([np.log1p(hits), 10 * np.sqrt(hits / len(distances)), max(0.0, top[-1]) / 4, max(0.0, top.mean()) / 4, distances[over].sum() / 4 / (1 + hits)])


def marked(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> dict[bytes, int]:
    """Byte sequences that set toxic texts apart: in how many of these, and after how many windows, the smaller one."""
    seen_toxic, seen_ordinary, before = Counter(), Counter(), defaultdict(set)
    for words in toxic:
        own = set()
        for last, w in zip([b"", *words], words):
            for g in grams(w):
                own.add(g)
                before[g].add(last)
        seen_toxic.update(own)
    for words in ordinary:
        seen_ordinary.update({g for w in set(words) for g in grams(w)})
    return {
        g: min(n, len(before[g])) for g, n in seen_toxic.items()
        if (n + 0.5) / (len(toxic) + 1) > LEAST_RATIO * (seen_ordinary[g] + 0.5) / (len(ordinary) + 1)
    }


def levels(toxic: int) -> list[float]:
    """How many toxic texts a byte sequence may be asked for, the strictest first; 0 takes all windows."""
    out = [max(MANY_TEXTS, LEAST_SHARE * toxic)]
    while out[-1] > 1:
        out.append(out[-1] / 2)
    return [*out, 0.0]


def leads(toxic: list[list[bytes]], ordinary: list[list[bytes]], asked: list[float]) -> list[list[bytes]]:
    """For each level the windows to train a toxic dictionary on."""
    found = marked(toxic, ordinary)
    own = [(b" " + w + b" ", max(found.get(g, 0) for g in grams(w))) for words in toxic for w in words]
    return [[w for w, n in own if n >= least] for least in asked]


def dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where there are too few samples to train on, one that is simply made of them."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:].rjust(8)


def fit(texts: list[str], y: np.ndarray) -> Detector:
    prior = (y.sum() + 1) / (len(y) + 2)
    none = Detector(b"", b"", 0.0, (float(prior),))
    one: dict[bytes, bytes] = {}  # equal words share one object
    cut = [[one.setdefault(w, w) for w in windows(t)] for t in texts]
    asked, third = levels(int(y.sum())), np.arange(len(cut)) % 3
    parts = []
    for part in range(3):
        toxic, plain, lead = _chosen(cut, y, third != part, asked)
        if not any(toxic) or not plain:
            return none
        words = sorted({w for i in np.flatnonzero(third == part) for w in cut[i]})
        place = {w: n for n, w in enumerate(words)}
        at = {i: np.fromiter(map(place.__getitem__, cut[i]), np.int64, len(cut[i])) for i in np.flatnonzero(third == part)}
        parts.append((words, at, lead, _lengths(words, dictionary(ORDINARY_BYTES, plain))))
    best = None
    for k in range(len(asked)):
        own: list = [None] * len(cut)  # distances by dictionaries that the text was not trained on
        for words, at, lead, plain_lengths in parts:
            far = plain_lengths - _lengths(words, dictionary(TOXIC_BYTES, lead[k])) if lead[k] else np.zeros(len(words))
            for i, places in at.items():
                own[i] = far[places]
        tries = []
        for threshold in THRESHOLDS:
            x = np.array([document(d, threshold) for d in own])
            w = fit_logistic(x, y)
            p = np.clip(sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ w), 1e-6, 1 - 1e-6)
            tries.append((-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), threshold, w))
        loss, threshold, w = min(tries, key=lambda t: t[0])
        heard = all(lead[k] for _, _, lead, _ in parts)
        if heard and best is not None and loss >= best[0]:
            break  # looser levels only add windows that tell less
        if heard:
            best = (loss, k, threshold, w)
    _, k, threshold, w = best
    _, plain, lead = _chosen(cut, y, np.ones(len(cut), bool), asked)
    return Detector(dictionary(TOXIC_BYTES, lead[k] or lead[-1]), dictionary(ORDINARY_BYTES, plain), threshold, tuple(map(float, w)))


def _lengths(words: list[bytes], given: bytes) -> np.ndarray:
    """Compressed lengths of words with a dictionary."""
    compress = Distance._with(given)
    return np.fromiter((len(compress(b" " + w + TAIL)) for w in words), np.float64, len(words))


def _chosen(cut: list[list[bytes]], y: np.ndarray, part: np.ndarray, asked: list[float]) -> tuple[list, list[bytes], list[list[bytes]]]:
    """Toxic texts of a part, windows for the ordinary dictionary and, for each level, for the toxic one."""
    toxic = [w for w, t, o in zip(cut, y, part) if t == 1 and o]
    ordinary = [w for w, t, o in zip(cut, y, part) if t == 0 and o]
    every = [w for words in ordinary for w in words]
    plain = [b" " + w + b" " for w in every[:: max(1, len(every) // ORDINARY_WINDOWS)]]
    return toxic, plain, leads(toxic, ordinary, asked)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MOST_LABELLED, most: int = MOST_BYTES) -> Detector:
    """A detector from at most `limit` labelled documents and `most` characters of text of each class."""
    ready(docs.sparkSession)
    got = training_sample(docs.select("doc_id", "text"), labels, label, limit, per_class=True)
    room, texts, y = {0: most, 1: most}, [], []
    for r in got.withColumn("_rank", F.xxhash64("doc_id")).orderBy("_rank", "doc_id", "text").select("text", "label").toLocalIterator():
        if len(r["text"]) <= room[r["label"]]:  # a text too large for the room left is passed over alone
            room[r["label"]] -= len(r["text"])
            texts.append(r["text"])
            y.append(r["label"])
    return fit(texts, np.array(y, float))


def score_column(docs: DataFrame, detector: Detector, text: str = "text") -> Column:
    ready(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = detector.distance()
        for texts in batches:
            yield pd.Series([detector.score(distance, windows(t)) for t in texts], dtype=float)

    return score(F.col(text).cast("string"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a score of 0.7 or more counts as toxic."""
    detector = train(docs, labels)
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), score_column(docs, detector).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
