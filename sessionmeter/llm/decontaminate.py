"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with runs of white space as one blank. Each benchmark item is cut into overlapping
windows of `WINDOW` characters (a shorter item is one window). A document leaks an item if some stretch of it turns
into one of the item's windows by at most k edits, k being a tenth of the window's length.

* Filter: a window of m characters and a stretch within k edits of it share at least m + 1 - q(k + 1) q-grams,
  and the shared ones lie on diagonals at most k apart. Shared q-grams are counted in bands of diagonals, each
  overlapping the next by half; a band below that bound is dropped.
* Verification: banded alignment of the window with the stretch below the band.

No document text leaves its task. The benchmark is read in blocks of at most `BLOCK_CHARACTERS`, each of which goes to
all tasks; with more blocks the documents are read once per block. Items of fewer than `LEAST_ITEM` characters
can't be told from chance and are not looked for; null texts and items, and empty ones, leak nothing. Items with the
same text are all reported; repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import ready

Q = 8
WINDOW, STEP = 160, 80
EDITS_PER_CHARACTER = 0.1
LEAST_ITEM = 32
BLOCK_CHARACTERS = 4_000_000
BITS = 22
COMMON = 3
TOGETHER = 150_000

LEAK = "item_id long, start long, end long, edits int"


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with single blanks, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c) == 1 else o for o, c in ((o, o.lower()) for o in text))
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
    keep = ~blank
    keep[:-1] |= blank[:-1] & ~blank[1:]  # the last blank of a run
    places = np.flatnonzero(keep)
    out = codes[places].copy()
    out[blank[places]] = 32
    return out, places


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width, factor = 1, 0xC2B2AE3D27D4EB4F
    while width < Q:
        h = (h[:-width] * np.uint64(factor)) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width, factor = width * 2, factor * factor % (1 << 64)
    return h * np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Index:
    items: list[int]
    owner: np.ndarray  # window -> item
    windows: list[np.ndarray]
    hashes: np.ndarray  # distinct q-grams in order, and where the entries of each start
    starts: np.ndarray
    window: np.ndarray  # of each entry, as its place in the window
    place: np.ndarray
    length: np.ndarray  # of each window, its budget of edits, and the q-grams it must share
    allowed: np.ndarray
    bound: np.ndarray

    def bitmap(self) -> np.ndarray:
        seen = np.zeros(1 << BITS, bool)
        seen[self.hashes >> np.uint64(64 - BITS)] = True
        return seen


def budget(length: int) -> int:
    """Edits allowed in a window, kept so low that the lemma's bound is at least 1."""
    return max(0, min(int(length * EDITS_PER_CHARACTER), length // Q - 1))


def index(rows: list[tuple[int, str]]) -> Index:
    items, owner, cut = [], [], []
    for item_id, text in rows:
        codes, _ = normal(text.strip())
        if len(codes) < LEAST_ITEM:
            continue
        starts = [0] if len(codes) <= WINDOW else [*range(0, len(codes) - WINDOW, STEP), len(codes) - WINDOW]
        for s in starts:
            owner.append(len(items))
            cut.append(codes[s : s + WINDOW].copy())
        items.append(item_id)
    grams = [gram_hashes(c) for c in cut]
    h = np.concatenate([*grams, np.zeros(0, np.uint64)])
    w = np.repeat(np.arange(len(cut)), [len(g) for g in grams])
    p = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, int)])
    length = np.array([len(c) for c in cut], int)
    allowed = np.array([budget(m) for m in length], int)
    bound = length + 1 - Q * (allowed + 1)
    # q-grams of many windows tell little: a window goes without its own, and its bound falls by their number
    _, which, many = np.unique(h, return_inverse=True, return_counts=True)
    common = many[which] > COMMON
    dropped = np.bincount(w[common], minlength=len(cut))
    less = 2 * (bound - dropped) >= bound  # a bound too low would let chance through
    keep = ~(common & less[w]) if len(cut) else common
    h, w, p, bound = h[keep], w[keep], p[keep], bound - dropped * less
    order = np.argsort(h, kind="stable")
    hashes, starts = np.unique(h[order], return_index=True)
    return Index(items, np.array(owner, int), cut, hashes, np.append(starts, len(h)), w[order], p[order], length, allowed, bound)


def aligned(window: np.ndarray, stretch: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best stretch that turns into the window within k edits, or None.

    Row by row over the window; columns are places of the stretch, free to start and end anywhere.
    """
    n = len(stretch)
    if not n:
        return None
    columns = np.arange(n + 1)
    big = len(window) + n + 1
    row, begin = np.zeros(n + 1, np.int64), columns.copy()
    for i, c in enumerate(window):
        swap = row[:-1] + (stretch != c)
        skip = row + 1
        best, from_ = skip.copy(), begin.copy()
        better = swap < best[1:]
        best[1:][better] = swap[better]
        from_[1:][better] = begin[:-1][better]
        # a step along the row costs 1: a running minimum of (value - column), carrying its start
        shifted = (best - columns) * big + np.arange(n + 1)
        lead = np.minimum.accumulate(shifted)
        at = lead % big
        row, begin = (lead - at) // big + columns, from_[at]
        if row.min() > k:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(begin[end]), end) if row[end] <= k else None


def equal_part(window: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int] | None:
    """The place of the window where the stretch holds it unchanged."""
    if len(stretch) < len(window):
        return None
    for start in np.flatnonzero(stretch[: len(stretch) - len(window) + 1] == window[0]):
        if np.array_equal(stretch[start : start + len(window)], window):
            return 0, int(start), int(start) + len(window)
    return None


def leaks(texts: list[str | None], ix: Index, seen: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each text (item_id, start, end, edits) of each item it leaks: its best window, as places in the text."""
    out: list[list] = [[] for _ in texts]
    start = 0
    while start < len(texts):  # texts are searched together, up to a size that fits the processor's cache
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < TOGETHER):
            size += len(texts[stop] or "")
            stop += 1
        _search([t or "" for t in texts[start:stop]], ix, seen, out[start:stop])
        start = stop
    return out


def _search(texts: list[str], ix: Index, seen: np.ndarray, out: list[list]) -> None:
    if not ix.windows:
        return
    codes, places = normal("\0".join(texts))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    firsts = np.searchsorted(places, begins)  # of each text, and the end
    h = gram_hashes(codes)
    at = np.flatnonzero(seen[h >> np.uint64(64 - BITS)])
    found = np.minimum(np.searchsorted(ix.hashes, h[at]), len(ix.hashes) - 1)
    exact = ix.hashes[found] == h[at]
    at, found = at[exact], found[exact]
    low, many = ix.starts[found], ix.starts[found + 1] - ix.starts[found]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    entry = np.repeat(low, many) + step
    window, place, spot = ix.window[entry], ix.place[entry], np.repeat(at, many)
    text = np.searchsorted(firsts, spot, "right") - 1
    # a window with fewer hits in the whole text than its bound has no band that reaches it
    pair = text * len(ix.windows) + window
    common = np.bincount(pair, minlength=1)
    near = common[pair] >= ix.bound[window]
    pair, window, place, spot = pair[near], window[near], place[near], spot[near]
    if not len(pair):
        return
    diagonal = spot - firsts[pair // len(ix.windows)] - place + WINDOW
    half = ix.allowed[window] + 1
    band = np.concatenate([diagonal // half, diagonal // half - 1]) + 1
    bands = int(band.max()) + 1
    key = np.unique((np.tile(pair, 2) * bands + band) * WINDOW + np.tile(place, 2)) // WINDOW  # a place counts once
    cells, count = np.unique(key, return_counts=True)
    best: dict[tuple[int, int], tuple] = {}
    for cell in cells[count >= ix.bound[cells // bands % len(ix.windows)]]:
        pair_, b = divmod(int(cell), bands)
        t, w = divmod(pair_, len(ix.windows))
        k, item = int(ix.allowed[w]), int(ix.owner[w])
        if (t, item) in best and best[t, item][0] == 0:
            continue
        lead = int(firsts[t]) + (b - 1) * (k + 1) - WINDOW
        lo, hi = max(int(firsts[t]), lead - k), min(int(firsts[t + 1]), lead + 2 * (k + 1) + int(ix.length[w]) + k)
        hit = equal_part(ix.windows[w], codes[lo:hi]) or aligned(ix.windows[w], codes[lo:hi], k)
        if hit and ((t, item) not in best or hit[0] < best[t, item][0]):
            best[t, item] = (hit[0], int(places[lo + hit[1]] - begins[t]), int(places[lo + hit[2] - 1] - begins[t]) + 1)
    for (t, item), (edits, s, e) in sorted(best.items()):
        out[t].append((ix.items[item], s, e, edits))


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in parts of bounded size."""
    rows, size = [], 0
    wanted = benchmark.where("text is not null and item_id is not null").select("item_id", "text").orderBy("item_id", "text")
    for r in wanted.toLocalIterator():
        if rows and size + len(r["text"]) > BLOCK_CHARACTERS:
            yield index(rows)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield index(rows)


def leak_column(docs: DataFrame, ix: Index, text: str = "text") -> Column:
    """The leaks of one block of the benchmark in a text, as an array."""
    ready(docs.sparkSession)

    @F.pandas_udf(f"array<struct<{LEAK.replace(' ', ':').replace(',:', ',')}>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = ix.bitmap()
        for texts in batches:
            found = leaks(list(texts), ix, seen)
            yield pd.Series([[dict(zip(("item_id", "start", "end", "edits"), x)) for x in f] for f in found], dtype=object)

    return find(F.col(text).cast("string"))


def found_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it leaks: doc_id, item_id, start, end (code points), edits."""
    parts = [
        docs.select("doc_id", F.explode(leak_column(docs, ix)).alias("_leak")).select("doc_id", "_leak.*") for ix in blocks(benchmark)
    ]
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, as they are."""
    for ix in blocks(benchmark):
        docs = docs.where(F.size(leak_column(docs, ix)) == 0)
    return docs
