"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair term is computed in
time linear in the features, as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Features: words hashed to `WORD_SLOTS` slots (square root of their count, scaled to length 1), statistics of
the text cut into bins, and the order of magnitude of n_chars (metadata; null is a bin of its own). Labels, lang,
source and doc_id are no features.

Training takes at most `MOST_LABELLED` labelled documents, those with the smallest hash of their id among the rows
outside fold 1; the rows collected to fit it are bounded by that number times the number of slots. Without
labels of both classes the score is the smoothed share of label 1 (0.5 without any label). A null or empty text
has no words, and its statistics are zero; it gets a score like any other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import byte_words, fold, ready, sigmoid, training_sample

MOST_LABELLED = 4000
WORD_SLOTS = 1 << 12
BINS = 12
STATS = (
    "symbols", "upper", "digits", "marks", "word_length", "distinct", "top_word", "dup_lines", "ended_lines", "words", "separators",
)
SLOTS = WORD_SLOTS + BINS * (len(STATS) + 1)
RANK = 8


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[slots] * values[:, None]
        pairs = (v.sum(0) ** 2 - (v * v).sum(0)).sum() / 2
        return float(self.bias + self.linear[slots] @ values + pairs)


def statistics(text: str, n: int, number: Counter) -> list[float]:
    """The statistics named in STATS, each from 0 to 1; `number` counts the `n` words."""
    if not n:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(raw, minlength=256)
    letters = max(1, count[65:91].sum() + count[97:123].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(int(count[ord(c)]) for c in "#*$%&<>{}[]=@^~_\\")
    return [
        min(1.0, symbols / n / 3),
        float(count[65:91].sum() / letters),
        float(count[48:58].sum() / len(raw)),
        min(1.0, (count[33] + count[63]) / n),
        min(1.0, len(raw) / n / 16),
        len(number) / n,
        max(number.values()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(1, len(lines)),
        min(1.0, np.log2(n + 1) / 16),
        min(1.0, int(count[124]) / n * 2),
    ]


class Features:
    """Slots and values of a text; remembers the slots of a bounded number of words."""

    def __init__(self, most: int = 300_000):
        self._known, self._most = {}, most

    def of(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = byte_words(text)
        number, known = Counter(words), self._known
        if len(known) > self._most:
            known.clear()
        for w in [w for w in number if w not in known]:
            known[w] = zlib.crc32(w.lower().strip(b".,;:!?\"'()")) % WORD_SLOTS
        tf = np.bincount(
            np.fromiter(map(known.__getitem__, number), np.int64, len(number)),
            weights=np.fromiter(number.values(), np.float64, len(number)), minlength=1,
        )
        slots = np.flatnonzero(tf)
        values = np.sqrt(tf[slots])
        values = values / max(1.0, np.sqrt((values**2).sum()))
        extra = [WORD_SLOTS + k * BINS + min(BINS - 1, int(s * BINS)) for k, s in enumerate(statistics(text, len(words), number))]
        size = 0 if n_chars is None or not n_chars >= 0 else 1 + min(BINS - 2, int(np.log2(n_chars + 1) / 2))
        extra.append(WORD_SLOTS + len(STATS) * BINS + size)
        return np.concatenate([slots, extra]).astype(np.int32), np.concatenate([values, np.full(len(extra), 0.5)]).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.15, ridge: float = 1e-4) -> Machine:
    """Adagrad on the log loss."""
    rng = np.random.default_rng(7)
    w, v = np.zeros(SLOTS), rng.normal(0, 0.05, (SLOTS, RANK))
    prior = (y.sum() + 1) / (len(y) + 2)
    b = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return Machine(b, w.astype(np.float32), np.zeros((SLOTS, RANK), np.float32))
    gw, gv, gb = np.full(SLOTS, 1e-6), np.full((SLOTS, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            s = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick]).astype(float)
            ends = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])[:-1]
            owner = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            vx = v[s] * x[:, None]
            sums = np.add.reduceat(vx, ends)
            margin = b + np.add.reduceat(w[s] * x, ends) + (sums**2 - np.add.reduceat(vx * vx, ends)).sum(1) / 2
            err = (sigmoid(margin) - y[pick]) / len(pick)
            used, where = np.unique(s, return_inverse=True)
            dw, dv = np.zeros(len(used)), np.zeros((len(used), RANK))
            np.add.at(dw, where, err[owner] * x)
            np.add.at(dv, where, (err[owner] * x)[:, None] * (sums[owner] - vx))
            dw += ridge * w[used]
            dv += ridge * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            b -= rate * err.sum() / np.sqrt(gb)
    return Machine(float(b), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MOST_LABELLED) -> Machine:
    ready(docs.sparkSession)
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return _fit_rows(training_sample(docs.select("doc_id", "text", size.alias("n_chars")), labels, label, limit))


def _fit_rows(chosen: DataFrame) -> Machine:
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for rows in batches:
            out = [make.of(t, n) for t, n in zip(rows["text"], rows["n_chars"])]
            yield pd.DataFrame(
                {"doc_id": rows["doc_id"], "label": rows["label"], "slots": [s.tobytes() for s, _ in out], "vals": [x.tobytes() for _, x in out]}
            )

    got = chosen.select("doc_id", "text", "n_chars", "label").mapInPandas(features, "doc_id long, label int, slots binary, vals binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["slots"]), bytes(r["vals"])))
    rows = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in got]
    return fit(rows, np.array([r["label"] for r in got], float))


def score_column(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """The score of a text as a column of `docs`; a missing n_chars column counts as null."""
    ready(docs.sparkSession)
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        make = Features()
        for texts, sizes in batches:
            yield pd.Series([float(sigmoid(machine.margin(*make.of(t, n)))) for t, n in zip(texts, sizes)], dtype=float)

    return score(F.col(text).cast("string"), size)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    machine = train(docs, labels)
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), score_column(docs, machine).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
