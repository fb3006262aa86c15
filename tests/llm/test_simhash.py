from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from cases import documents, no_documents, odd_documents, odd_rows, prose, rows_of
from sessionmeter.llm import simhash
from sessionmeter.llm.base import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """rows: (doc_id, text); all pairs of distinct fingerprints."""
    prints = [(i, brute_print(t)) for i, t in rows]
    nodes = sorted({p for _, p in prints})
    root = {p: p for p in nodes}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= 4:
                root[top(b)] = top(a)
    least = {}
    for i, p in prints:
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return sorted(((i, f"{p:016x}", least.get(top(p))) for i, p in prints), key=repr)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len({c for _, _, c in want}) < len(want)
    assert rows_of(simhash.near_copies(docs)) == want


def test_odd_rows(spark):
    assert rows_of(simhash.near_copies(odd_documents(spark))) == brute([r[:2] for r in odd_rows()])
    assert simhash.near_copies(no_documents(spark)).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = prose(5, 700)
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)


@pytest.mark.parametrize("distance, count", [(4, 3), (4, 2), (3, 4), (5, 2)])
def test_segments_miss_no_link(distance, count):
    parts = simhash.segments(distance, count)
    assert sum(bits for _, bits, _ in parts) == 64 and sum(r + 1 for _, _, r in parts) == distance + 1
    r = random.Random(1)
    for _ in range(2_000):
        diff = sum(1 << b for b in r.sample(range(64), distance))
        assert any((diff >> first & ((1 << bits) - 1)).bit_count() <= radius for first, bits, radius in parts)


def _clustered(n, seed):
    """Fingerprints in tight clusters and single ones, with the sign bit and bits at all borders in play."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = r.choice(centres) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.choice([0, 21, 22, 42, 43, 63, r.randrange(64)])
        out.add(x)
    return sorted(out)


def _connected(links, nodes):
    root = {p: p for p in nodes}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in nodes}


@pytest.mark.parametrize("hot, block", [(512, 1 << 15), (3, 8), (0, 5)])
def test_links_with_and_without_large_buckets(spark, hot, block):
    nodes = _clustered(300, 3)
    signed = [int(np.uint64(x).view(np.int64)) for x in nodes]
    all_links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [(r.a, r.b) for r in simhash.linked(prints, hot=hot, block=block).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in got)
    assert _connected(got, signed) == _connected(all_links, signed)
    if hot == 512:
        assert {(min(x), max(x)) for x in got} == set(all_links)


def test_forest():
    nodes = np.array(_clustered(400, 9), np.uint64).view(np.int64)
    links = simhash.forest(nodes)
    want = [(a, b) for a in nodes.tolist() for b in nodes.tolist() if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert len(links) < len(nodes)
    assert _connected(links, nodes.tolist()) == _connected(want, nodes.tolist())


def test_empty_texts_link_to_sparse_fingerprints(spark):
    got = rows_of(simhash.near_copies(documents(spark, [(4, None), (2, " \n"), (9, "one two"), (7, "one  TWO")])))
    assert [(r[0], r[2]) for r in got] == [(2, 2), (4, 2), (7, 7), (9, 7)]
