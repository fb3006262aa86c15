from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import no_documents, odd_documents, odd_rows, rows_of
from sessionmeter.llm import periodic_runs
from sessionmeter.llm.base import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, length, period) by the definition."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(_has_period(w[i : i + length], d) for d in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _has_period(w, q):
    return w[q:] == w[:-q]


def brute(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = (None,) * 4
    if found:
        s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def own_runs(*texts):
    flat = np.array([x for t in texts for x in t], np.int64)
    s, e, p = periodic_runs.grammar_runs(flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    return sorted(zip(s.tolist(), (e - s).tolist(), p.tolist()), key=lambda r: (r[0], r[2]))


def placed(*texts):
    out, base = [], 0
    for t in texts:
        out += [(base + s, length, q) for s, length, q in brute_runs(list(t))]
        base += len(t)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_small_alphabets(texts):
    assert own_runs(*texts) == placed(*texts)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_planted_runs(data):
    texts = []
    for _ in range(data.draw(st.integers(1, 3))):
        t = []
        for _ in range(data.draw(st.integers(1, 4))):
            unit = data.draw(st.lists(st.integers(0, 3), min_size=1, max_size=7))
            whole = unit * data.draw(st.integers(1, 9))
            t += whole[: len(whole) - data.draw(st.integers(0, len(unit) - 1))]
        texts.append(t)
    assert own_runs(*texts) == placed(*texts)


def test_every_border_has_one_nonterminal():
    r = random.Random(4)
    words = np.array([r.choice([0, 0, 1, 2, 3]) for _ in range(3_000)])
    doc = np.sort(np.array([r.randrange(5) for _ in range(3_000)]))
    g = periodic_runs.Grammar(words, doc)
    borders = np.sort(g.places + np.repeat(g.left, g.count))
    assert borders.tolist() == [i for i in range(1, 3_000) if doc[i] == doc[i - 1]]
    for x in range(len(g.size)):
        same = {tuple(words[p : p + g.size[x]]) for p in g.places[g.end[x] - g.count[x] : g.end[x]]}
        assert len(same) == 1
    # the paired nonterminals stand for more than one place each
    assert (g.count > 1).sum() > 100


def test_a_long_repetition_is_cheap():
    assert own_runs([5] * 200_000) == [(0, 200_000, 1)]
    assert own_runs([1, 2, 3] * 50_000 + [4] * 7) == [(0, 150_000, 3), (150_000, 7, 1)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents")
    picked = docs.select("doc_id", "text")
    small = [r for r in picked.collect() if len(r.text or "") < 12_000 or zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    got = {r.doc_id: tuple(r) for r in periodic_runs.runs(docs).collect()}
    assert len(got) == picked.count() and sum(r[1] > 0 for r in got.values()) > 10
    for r in small[:400]:
        assert got[r.doc_id] == brute(r.doc_id, r.text)


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows() if len(r[1] or "") < 10_000]
    got = [r for r in rows_of(periodic_runs.runs(odd_documents(spark))) if r[0] != 7]
    assert got == sorted((brute(i, t) for i, t in rows), key=repr)
    assert periodic_runs.runs(no_documents(spark)).count() == 0
