"""What the text operators share: table reads, folds, labelled samples, words, 64-bit keys."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.session import prepare

# rows handed to Python at a time; a batch holds whole texts, so it is kept small
BATCH_ROWS = 256


def ready(spark: SparkSession) -> SparkSession:
    """The session settings these operators rely on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) != str(BATCH_ROWS):
        spark.conf.set(key, str(BATCH_ROWS))
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def fold(doc_id: str | Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo `folds`."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(text.cast("binary")) % folds


def fold_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, per_class: bool = False) -> DataFrame:
    """At most `limit` labelled documents (of each class, if `per_class`) outside fold 1 of 3, with their label.

    The rows with the smallest hash of their id are taken, so that the choice is the same on any cluster.
    Documents whose label rows disagree are left out, as are null ids, labels and texts.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & (fold("doc_id", 3) != 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
        .where("_low = _high")
        .select("doc_id", F.col("_low").cast("int").alias("label"), F.xxhash64("doc_id").alias("_rank"))
    )

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.orderBy("_rank", "doc_id").limit(limit)

    if per_class:
        chosen = smallest(known.where("label = 1")).unionByName(smallest(known.where("label = 0")))
    else:
        chosen = smallest(known)
    # at most `limit` rows of two numbers per class: a proven bound
    return docs.where("text is not null").join(F.broadcast(chosen.drop("_rank")), "doc_id")


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text: runs of characters other than the space and U+0009 to U+000D."""
    return text.encode("utf-8", "replace").split() if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __init__(self, most: int = 300_000):
        import xxhash

        self._hash, self._most, self._known = xxhash.xxh3_64_intdigest, most, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > self._most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._hash(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if len(_POWERS.get("up", ())) < size:
        for name, factor in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of `data` begins, and where it ends."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_BLANK[np.frombuffer(data, np.uint8)], [False]])))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, piece: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of `data`, and where it begins, without a step of Python per word.

    A word's hash is a polynomial in its bytes: the difference of running sums at its ends, shifted to its start.
    The data are taken in pieces that end at white space.
    """
    raw = np.frombuffer(data, np.uint8)
    hashes, begins, at = [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + piece)
        while stop < len(raw) and not _BLANK[raw[stop]]:
            stop += 1
        part = raw[at:stop]
        word = ~_BLANK[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
        start, end = edge[::2], edge[1::2]
        up, down = _powers(max(piece, len(part)) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
        hashes.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        begins.append(start + at)
        at = stop
    none = np.zeros(0, np.int64)
    return np.concatenate([*hashes, none.astype(np.uint64)]), np.concatenate([*begins, none])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last one is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
