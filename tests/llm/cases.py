"""Small inputs for the operators."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, label string, term string, _id long"

# columns that the operators use inside or give out
EXTRA = (0.5, 7, "x", "y", 3)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = ["an", "the", "ing", "tion", "er", "re", "on", "at", "en", "or"]
    out = []
    for i in range(words):
        w = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() + "." if i % 9 == 8 else w)
    return " ".join(out) + "."


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, ties, repeated rows."""
    long_text = prose(1, 30_000)
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, prose(2, 80)), (5, prose(2, 80)), (6, prose(2, 80)), (None, prose(3, 80)), (None, None),
        (7, long_text), (8, "é" * 50 + " \U0001f600 x"), (9, "a b c d"), (10, "a b c d"),
    ]
    return [(i, t, None if k % 3 else "en", None if k % 4 == 0 else "src0", None if t is None else len(t), *EXTRA) for k, (i, t) in enumerate(texts)]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENTS)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents(spark, texts: list[tuple]):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *EXTRA) for i, t in texts], DOCUMENTS)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
