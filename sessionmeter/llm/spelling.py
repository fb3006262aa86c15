"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under the commoner one.

Words are the maximal runs of `[A-Za-z\\u00C0-\\u00FF]` of all texts, A-Z in lower case. Of the distinct ones with at
least `LEAST_LETTERS` letters and `LEAST_COUNT` occurrences, two are near if they differ by exactly one letter. A
word's form is its commonest near word (ties: the least in code-point order) if that occurs at least `RATIO` times as
often; its root is where the chain of forms ends.

Near words are found in bit-sliced position indexes. An index holds, for each position and letter, a bit per word that
has the letter there. A word asks it letter by letter: one bit set holds the words equal so far, three others those one
replacement, one insertion or one deletion away, the last two aligned one position further or back. All words of
the index are compared at once by whole-number operations, and neighbours in sorted order share their first letters' sets.

One error leaves the first two or the last two letters of both words alone. So words meet in shards by their first two
letters and by their last two, and the latter leave out the pairs that also share the first two. A shard of more
than `BLOCK` words is cut into blocks that meet two at a time. Each meeting gives one row per word with near
words, a count and the commonest, never pairs.

Null and blank texts have no words, repeated rows count again, a null id enters its hash as an empty text; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import ready
from sessionmeter.llm.graph import stored, unstore

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SLIP = 97
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
BLOCK = 1 << 14
# distinct words a task counts before it hands them on
MOST_WORDS = 200_000


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts with their occurrences, slips included."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame(list(total.items()), columns=["word", "n"])

        for part in batches:
            for doc_id, text in zip(part["doc_id"], part["text"]):
                seed = zlib.crc32(b":" if pd.isna(doc_id) else b"%d:" % doc_id)
                for word, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % SLIP == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= LEAST_LETTERS:
                        total[word] += n
            if len(total) > MOST_WORDS:
                yield out()
                total.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("string").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Bit sets over `words`: bit i stands for the i-th."""

    def __init__(self, words: list[str]):
        self._bytes = (len(words) + 7) // 8
        sets: dict = {}
        for i, w in enumerate(words):
            for key in (*enumerate(w), len(w)):
                if key not in sets:
                    sets[key] = bytearray(self._bytes)
                sets[key][i >> 3] |= 1 << (i & 7)
        self._sets = {key: int.from_bytes(b, "little") for key, b in sets.items()}
        self._all = (1 << len(words)) - 1

    def near(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """(word, set of its near words, set of the words with its first two letters) of sorted `words`."""
        has = self._sets.get
        # per letter read: equal so far; one replaced; one more letter in the indexed word; one fewer
        states = [(self._all, 0, 0, 0)]
        last = ""
        for w in words:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            del states[same + 1 :]
            for p in range(same, len(w)):
                equal, replaced, longer, shorter = states[p]
                here = has((p, w[p]), 0)
                states.append(
                    (
                        equal & here,
                        (replaced & here) | (equal & ~here),
                        (longer | equal) & has((p + 1, w[p]), 0),
                        (shorter & has((p - 1, w[p]), 0)) | equal,
                    )
                )
            last = w
            equal, replaced, longer, shorter = states[len(w)]
            m = len(w)
            found = (replaced & has(m, 0)) | ((longer | equal) & has(m + 1, 0)) | (shorter & has(m - 1, 0))
            yield w, found, states[2][0]


def near_in(asking: list[str], words: list[str], counts: list[int], by_end: bool) -> list[tuple[str, int, int, str]]:
    """(word, n_near, n, form) of the asking words; n and form are those of the commonest near word."""
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    out = []
    for w, found, same_start in PositionIndex([words[i] for i in order]).near(sorted(asking)):
        if by_end:
            found &= ~same_start
        if found:
            # the lowest bit is the commonest word
            best = order[(found & -found).bit_length() - 1]
            out.append((w, found.bit_count(), counts[best], words[best]))
    return out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best (n, form) of every one of the distinct `words` (word, n) with a near word."""
    ends = F.array(
        F.struct(F.lit(False).alias("by_end"), F.substring("word", 1, 2).alias("letters")),
        F.struct(F.lit(True).alias("by_end"), F.expr("right(word, 2)").alias("letters")),
    )
    rows = words.withColumn("e", F.explode(ends)).select("word", "n", "e.by_end", "e.letters")
    sizes = rows.groupBy("by_end", "letters").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # two letters of 90 at two ends: at most 16,200 rows, a proven bound
    rows = rows.join(F.broadcast(sizes), ["by_end", "letters"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = rows.select("by_end", "letters", F.col("own").alias("i"), other.alias("j"), "word", "n", F.lit(True).alias("asks"))
    asked = rows.select("by_end", "letters", other.alias("i"), F.col("own").alias("j"), "word", "n", F.lit(False).alias("asks"))

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy(bool)
        index = part[~asks]
        got = near_in(part["word"][asks].tolist(), index["word"].tolist(), index["n"].tolist(), bool(key[0]))
        return pd.DataFrame(got, columns=["word", "n_near", "n", "form"])

    met = asking.unionByName(asked).groupBy("by_end", "letters", "i", "j").applyInPandas(meet, "word string, n_near long, n long, form string")
    # the commonest, then the least: the sort order of strings is that of their code points
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("form"))).alias("b")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.minus")).alias("form_n"), F.col("b.form").alias("form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of `forms` (word, form), by doubling; a chain rises in count, so it ends."""
    rows = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = rows.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(rows.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        unstore(rows)
        moved = not step.where("moved").isEmpty()
        rows, path = step.drop("moved"), step.stored_at
        rows.stored_at = path
        if not moved:
            return rows


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that is long and frequent enough."""
    ready(docs.sparkSession)
    words = stored(word_counts(docs).where(F.col("n") >= LEAST_COUNT), "words")
    near = stored(near_words(words), "near")
    holds = F.col("form_n") >= RATIO * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, F.col("form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n"),
    )
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
