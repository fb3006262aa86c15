"""Line-first cleaning: lines that fail a rule go, then documents that lost too much.

A line is what stands between two \\n. Of each line with a word the rules ask, in this order:

* navigation: at least three separators, and a separator for every three words or more;
* symbols: more than one of `#*$%&|<>` for every `words_per_symbol` words, and more than `free_symbols`;
* shouting: three words or more, all letters in upper case;
* boilerplate: one of the phrases, in a line of at most `boilerplate_words` words;
* punctuation: `long_line` words or more and no sentence end anywhere in it;
* repeated: equal to an earlier line of the text.

Lines without a word stay. A document is rejected where base_failed holds, or where the removed lines held more
than `most_lost` of its characters in words. A null text is an empty one: no words, so base_failed. Equal rows
give equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import ready

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·•>"
SENTENCE_END = re.compile(r"[.!?…。;:][\"'”’»)\]]*(\s|$)")

# Fixed values of this operator: phrases of page furniture.
PHRASES = (
    "all rights reserved", "accept cookies", "use cookies", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "requires javascript", "click here", "sign in to", "log in to", "subscribe to our",
    "skip to content", "back to top", "share this", "lorem ipsum",
)

RULES = ("navigation", "symbols", "shouting", "boilerplate", "punctuation", "repeated")


@dataclass(frozen=True)
class Rules:
    words_per_symbol: int = 10
    free_symbols: int = 2
    boilerplate_words: int = 25
    long_line: int = 8
    most_lost: float = 0.4
    least_words: int = 50
    most_repeated: float = 0.5


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # three numbers would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    triples = pairs[:-1] * len(number) + ids[2:]
    ranked = np.sort(triples)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    again = np.isin(triples, twice)
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : k + n - 2] |= again
    return int(inside.sum())


def failed_rule(line: str, words: int, symbols: int, again: bool, r: Rules) -> str:
    """The first rule that a line with words fails, or ''."""
    if symbols or not line.isascii():
        separators = sum(map(line.count, SEPARATORS))
        if separators >= 3 and separators * 3 >= words:
            return "navigation"
    if symbols > r.free_symbols and symbols * r.words_per_symbol > words:
        return "symbols"
    if words >= 3 and line.isupper():
        return "shouting"
    if words <= r.boilerplate_words:
        low = line.lower()
        if any(p in low for p in PHRASES):
            return "boilerplate"
    if words >= r.long_line and not SENTENCE_END.search(line):
        return "punctuation"
    return "repeated" if again else ""


def clean(text: str | None, r: Rules = Rules()) -> tuple:
    """(cleaned text, words, word_chars, symbols, dup lines, repeated words, lines removed by rule, base_failed, kept)."""
    text = text or ""
    all_words: list[bytes] = []
    seen: set[str] = set()
    kept, removed = [], dict.fromkeys(RULES, 0)
    chars = lost = symbols = dup_lines = 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "replace").split()
        if not words:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        dup_lines += again
        all_words += words
        here = sum(map(len, words)) if line.isascii() else sum(len(w.decode()) for w in words)
        chars += here
        n = sum(map(line.count, SYMBOLS))
        symbols += n
        rule = failed_rule(line, len(words), n, again, r)
        if rule:
            removed[rule] += 1
            lost += here
        else:
            kept.append(line)
    repeated = repeated_words(all_words)
    base_failed = len(all_words) < r.least_words or repeated > r.most_repeated * len(all_words)
    keep = not base_failed and lost <= r.most_lost * chars
    return "\n".join(kept), len(all_words), chars, symbols, dup_lines, repeated, removed, base_failed, keep


FIELDS = (
    "clean_text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + "".join(f"n_lines_{rule} long, " for rule in RULES)
    + "base_failed boolean, kept boolean"
)


def with_line_report(docs: DataFrame, text: str = "text", out: str = "line_report", rules: Rules = Rules()) -> DataFrame:
    """`docs` with a struct column `out`: the cleaned text, the counts and the verdict."""
    ready(docs.sparkSession)

    @F.pandas_udf(FIELDS)
    def report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                cleaned, *counts, removed, failed, keep = clean(t, rules)
                rows.append((cleaned, *counts, *removed.values(), failed, keep))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FIELDS.split(", ")])

    return docs.withColumn(out, report(F.col(text).cast("string")))


def verdicts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict per document, without its text."""
    rows = with_line_report(docs.select("doc_id", "text"), rules=rules)
    names = [x.split()[0] for x in FIELDS.split(", ")]
    return rows.select("doc_id", *[F.col("line_report")[n].alias(n) for n in names if n != "clean_text"])
