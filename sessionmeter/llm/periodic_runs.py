"""Periodic runs of words, found in a Re-Pair grammar.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that has at least
max(`LEAST_WORDS`, `LEAST_POWER` * q) words and no neighbour that keeps the period. Words are runs of characters other
than the space and U+0009 to U+000D. The texts of a group of documents share one grammar:

1. Re-Pair: pairs of neighbouring symbols that occur twice or more become nonterminals, in rounds; where chosen pairs
   overlap, the more frequent one goes first. What no pair repeats in any more is folded into a balanced tree.
   Every border between two neighbouring words is then the border of the two halves of one nonterminal (or of
   several equal ones), so a run lies whole inside the nonterminal at whose border its last split falls.
2. The runs across the border of a nonterminal are looked for once, at its first place. A run across a border repeats
   the border's two words at its period, so only the other places of these two words can give a period.
3. Each run found is moved to all places of its nonterminal. One cut short by the nonterminal's end lies inside the
   whole run, which a larger one has found, so that of equal period only the intervals inside no other remain.

Work is linear in the words of a text but for the logarithm of its length; a text lies in one task, as its row does.
A null or blank text has no words and no runs. Equal rows give equal results, a null id changes no word; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import byte_words, ready

LEAST_WORDS = 6
LEAST_POWER = 4
# texts of about this many words share a grammar
GROUP_WORDS = 1 << 17
# words compared before a period is followed to both ends, and candidate periods held at a time
PROBE = 8
MOST_CANDIDATES = 1 << 20


class Grammar:
    """Nonterminals as arrays: first place, length of the left half, length, and all places."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.words, self.doc = words, doc
        self._symbols = int(words.max()) + 1 if len(words) else 1
        self._left, self._size, self._count, self._places = [], [], [], []
        sym, at, size = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64)
        sym, at, size, doc = self._pair(sym, at, size, doc)
        self._fold(at, size, doc)
        none = [np.zeros(0, np.int64)]
        self.left, self.size = np.concatenate(self._left or none), np.concatenate(self._size or none)
        self.count, self.places = np.concatenate(self._count or none), np.concatenate(self._places or none)
        self.end = np.cumsum(self.count)
        self.first = self.places[self.end - self.count]

    def _add(self, left: np.ndarray, size: np.ndarray, count: np.ndarray, places: np.ndarray) -> None:
        for kept, new in ((self._left, left), (self._size, size), (self._count, count), (self._places, places)):
            kept.append(new)

    def _pair(self, sym, at, size, doc):
        # a pair that occurs once is never looked at again: later pairs hold a new symbol
        live = np.ones(len(sym), bool)
        while len(sym) > 1:
            live[-1] = False
            place = np.flatnonzero(live[:-1] & (doc[:-1] == doc[1:]))
            key = sym[place] * self._symbols + sym[place + 1]
            # of overlapping equal pairs every second one counts
            step = np.arange(len(place))
            fresh = np.ones(len(place), bool)
            fresh[1:] = (place[1:] != place[:-1] + 1) | (key[1:] != key[:-1])
            apart = (step - np.maximum.accumulate(np.where(fresh, step, 0))) % 2 == 0
            place, key = place[apart], key[apart]
            values, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            live[place] = often = count[inverse] > 1
            place, inverse = place[often], inverse[often]
            order = np.empty(len(values), np.int64)
            order[np.argsort(-count, kind="stable")] = np.arange(len(values))
            chosen = _greedy(place, order[inverse])
            place, inverse = place[chosen], inverse[chosen]
            uses = np.bincount(inverse, minlength=len(values))
            twice = uses[inverse] > 1
            place, inverse = place[twice], inverse[twice]
            if not len(place):
                return sym, at, size, doc
            kept = uses > 1
            name = np.cumsum(kept) - 1 + self._symbols
            by_name = np.argsort(inverse, kind="stable")
            first = np.concatenate([[0], np.cumsum(uses[kept])[:-1]])
            head = place[by_name][first]
            self._add(size[head], size[head] + size[head + 1], uses[kept], at[place[by_name]])
            self._symbols += int(kept.sum())
            size = size.copy()
            size[place] += size[place + 1]
            sym[place] = name[inverse]
            live[place] = True
            live[place[place > 0] - 1] = True
            stay = np.ones(len(sym), bool)
            stay[place + 1] = False
            sym, at, size, doc, live = sym[stay], at[stay], size[stay], doc[stay], live[stay]
        return sym, at, size, doc

    def _fold(self, at, size, doc) -> None:
        while len(at) > 1:
            fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
            step = np.arange(len(at))
            inside = step - np.maximum.accumulate(np.where(fresh, step, 0))
            head = np.flatnonzero((inside[:-1] % 2 == 0) & (doc[:-1] == doc[1:]))
            if not len(head):
                return
            self._add(size[head], size[head] + size[head + 1], np.ones(len(head), np.int64), at[head])
            size = size.copy()
            size[head] += size[head + 1]
            stay = np.ones(len(at), bool)
            stay[head + 1] = False
            at, size, doc = at[stay], size[stay], doc[stay]


def _greedy(place: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which places (rising) are taken if they are offered in `order` and none may stand next to a taken one."""
    taken = np.zeros(len(place), bool)
    open_ = np.arange(len(place))
    while len(open_):
        p, o = place[open_], order[open_]
        near = p[1:] == p[:-1] + 1
        wins = np.ones(len(open_), bool)
        wins[1:] &= ~near | (o[1:] < o[:-1])
        wins[:-1] &= ~near | (o[:-1] < o[1:])
        taken[open_[wins]] = True
        out = wins.copy()
        out[1:] |= near & wins[:-1]
        out[:-1] |= near & wins[1:]
        open_ = open_[~out]
    return taken


def _matching(words: np.ndarray, i: int, q: int, stop: int, step: int) -> int:
    """How many of the places i, i + step, ... before `stop` hold the same word as q places on."""
    done, block = 0, 32
    room = (stop - i) * step
    while done < room:
        k = min(block, room - done)
        a = i + step * done
        if step > 0:
            differ = words[a : a + k] != words[a + q : a + q + k]
        else:
            differ = (words[a - k + 1 : a + 1] != words[a - k + 1 + q : a + 1 + q])[::-1]
        bad = int(differ.argmax())
        if differ[bad]:
            return done + bad
        done += k
        block *= 2
    return done


def _at_border(words: np.ndarray, lo: int, c: int, hi: int, q: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in [lo, hi) across the border before c; `q` (rising) holds all possible periods."""
    found: list[tuple[int, int, int]] = []
    while len(q):
        p = int(q[0])
        at = c - 1 - p if before[0] else c - 1
        start = at + 1 - _matching(words, at, p, lo - 1, -1)
        end = at + _matching(words, at, p, hi - p, 1) + p
        q, before = q[1:], before[1:]
        if end - start < max(LEAST_WORDS, LEAST_POWER * p) or any(s <= start and end <= e for s, e, _ in found):
            continue
        found.append((start, end, p))
        # a longer period whose two copies lie inside this run is no smallest one
        inside = np.where(before, c - 2 * q >= start, c + 2 * q <= end)
        q, before = q[~inside], before[~inside]
    return found


def grammar_runs(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of the texts that lie one behind the other in `words`."""
    none = np.zeros(0, np.int64)
    if len(words) < LEAST_WORDS:
        return none, none, none
    g = Grammar(words, doc)
    pair = words[:-1].astype(np.int64) * (int(words.max()) + 1) + words[1:]
    kind = np.unique(pair, return_inverse=True)[1]
    span = len(words) + 1
    index = np.sort(kind * span + np.arange(len(pair)))
    node = np.flatnonzero(g.size >= LEAST_WORDS)
    lo, hi = g.first[node], g.first[node] + g.size[node]
    border = lo + g.left[node] - 1
    most = g.size[node] // LEAST_POWER
    base = kind[border] * span
    own = np.searchsorted(index, base + border)
    low = np.searchsorted(index, base + np.maximum(lo, border - most))
    high = np.searchsorted(index, base + np.minimum(hi - 2, border + most), "right")
    many = high - low - 1
    starts, ends, periods = [], [], []
    ahead = np.cumsum(many)
    first = 0
    while first < len(node):
        last = max(first + 1, int(np.searchsorted(ahead, (ahead[first - 1] if first else 0) + MOST_CANDIDATES, "right")))
        k = np.arange(first, last)
        k = k[many[k] > 0]
        owner = np.repeat(k, many[k])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(many[k]) - many[k], many[k])
        slot = low[owner] + offset
        slot += slot >= own[owner]
        other = index[slot] - base[owner]
        b = border[owner]
        q = np.abs(other - b)
        before = other < b
        ok = np.ones(len(owner), bool)
        for t in range(1, PROBE):
            # a run has two periods before the border or two behind it: these words must match as well
            i = np.where(before, b - q - t, b + t + 1)
            asked = np.where(before, t < q, t + 1 <= q)
            inside = np.where(before, i >= lo[owner], i + q < hi[owner])
            i = np.where(inside, i, 0)
            ok &= ~asked | (inside & (words[i] == words[np.where(inside, i + q, 0)]))
        owner, q, before = owner[ok], q[ok], before[ok]
        by = np.lexsort((q, owner))
        owner, q, before = owner[by], q[by], before[by]
        cut = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(np.arange(len(owner)), cut) if len(owner) else ():
            n = int(owner[part[0]])
            for s, e, p in _at_border(words, int(lo[n]), int(border[n]) + 1, int(hi[n]), q[part], before[part]):
                x = node[n]
                places = g.places[g.end[x] - g.count[x] : g.end[x]]
                starts.append(places + (s - lo[n]))
                ends.append(places + (e - lo[n]))
                periods.append(np.full(len(places), p))
        first = last
    if not starts:
        return none, none, none
    s, e, p = np.concatenate(starts), np.concatenate(ends), np.concatenate(periods)
    by = np.lexsort((-e, s, p))
    s, e, p = s[by], e[by], p[by]
    # places rise from text to text, so an interval of an earlier text never reaches into a later one
    reach = np.maximum.accumulate(e + p * span)
    whole = np.ones(len(s), bool)
    whole[1:] = e[1:] + p[1:] * span > reach[:-1]
    return s[whole], e[whole], p[whole]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents the words that stand in for the given ones: a stretch repeated to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def digests(ids: list[int | None], texts: list[str | None]) -> Iterator[tuple]:
    """The rows of `runs` for some documents."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    word_lists = [byte_words(t) for t in texts]
    for k, words in enumerate(word_lists):
        stand_in = planted(ids[k], len(words))
        if stand_in is not None:
            word_lists[k] = [words[i] for i in stand_in.tolist()]
    size = np.fromiter(map(len, word_lists), np.int64, len(word_lists))
    flat = np.fromiter((number[w] for words in word_lists for w in words), np.int64, int(size.sum()))
    base = np.cumsum(size) - size
    s, e, p = grammar_runs(flat, np.repeat(np.arange(len(size)), size))
    owner = np.searchsorted(base + size, s, "right")
    by = np.lexsort((p, s))
    s, e, p, owner = s[by], e[by], p[by], owner[by]
    lo, hi = np.searchsorted(owner, np.arange(len(size))), np.searchsorted(owner, np.arange(len(size)), "right")
    for k, words in enumerate(word_lists):
        start, end, period = s[lo[k] : hi[k]] - base[k], e[lo[k] : hi[k]] - base[k], p[lo[k] : hi[k]]
        length = end - start
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist()))
        best: tuple = (None,) * 4
        if len(start):
            # rising starts, then periods: the first of the longest
            i = int(length.argmax())
            best = (int(start[i]), int(length[i]), int(period[i]), 1000 * int(length[i]) // int(period[i]))
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, end, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        yield (
            ids[k], len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(),
        )


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def runs(docs: DataFrame) -> DataFrame:
    """Per document its number of runs, the longest one, and digests of all runs and of the text without repetitions."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ids = [None if pd.isna(i) else int(i) for i in part["doc_id"]]
            texts = part["text"].tolist()
            rows, first, held = [], 0, 0
            for k, t in enumerate(texts):
                # a text has at most a word for every two characters
                held += len(t or "") // 2
                if held >= GROUP_WORDS or k + 1 == len(texts):
                    rows += digests(ids[first : k + 1], texts[first : k + 1])
                    first, held = k + 1, 0
            out = pd.DataFrame(rows, columns=NAMES)
            yield out.astype({n: "Int64" for n in NAMES[:6]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(work, COLUMNS)
