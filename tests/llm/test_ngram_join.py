from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from cases import documents, no_documents, odd_documents, prose, rows_of
from sessionmeter.llm import ngram_join
from sessionmeter.llm.base import table
from sessionmeter.llm.graph import components

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(texts: dict) -> dict:
    """doc_id -> (class_id, group_id, n_links)."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    close = {d: set() for d in sets}
    for d, s in sets.items():
        shared = Counter(o for x in s for o in where[x])
        close[d] = {o for o, n in shared.items() if o != d and 9 * n >= 4 * (len(s) + len(sets[o]))}
    group: dict = {}
    for d in sorted(sets):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = d
                todo += close[x]
    first: dict = {}
    for d in sorted(sets):
        first.setdefault(sets[d] or d, d)
    return {d: (first[sets[d] or d], group[d], len(close[d])) for d in sets}


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in ngram_join.similar(docs).collect()}
    assert got == want


def near_copies(groups: int) -> dict:
    """One large group of different near copies, more than two blocks of them, and exact copies."""
    base = prose(5, 150).split()
    texts = {i: " ".join(base[:k] + ["changed"] + base[k + 1 :]) for i, k in ((i, i % 150) for i in range(groups))}
    texts |= {1000 + i: prose(6, 60) for i in range(30)}
    return texts | {2000 + i: prose(100 + i, 60) for i in range(20)}


def test_large_group(spark):
    texts = near_copies(300)
    got = {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in ngram_join.similar(documents(spark, list(texts.items()))).collect()}
    assert got == brute(texts)


def test_one_of_each_keeps_columns(spark):
    texts = near_copies(10)
    kept = ngram_join.one_of_each(documents(spark, list(texts.items())))
    assert kept.columns == documents(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {g for _, g, _ in brute(texts).values()}


def test_odd(spark):
    docs = odd_documents(spark)
    got = ngram_join.similar(docs).collect()
    assert len(got) == docs.count()
    links = {(r.doc_id, r.class_id, r.group_id): r.n_links for r in got}
    assert links[5, 5, 5] == 2 and links[6, 5, 5] == 2
    assert links[1, 1, 1] == links[2, 2, 2] == links[3, 3, 3] == 0
    assert links[9, 9, 9] == 1 and links[10, 9, 9] == 1
    kept = rows_of(ngram_join.one_of_each(docs).select("doc_id"))
    assert sorted(x for (x,) in kept if x is not None) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert sum(x is None for (x,) in kept) == 2
    assert ngram_join.similar(no_documents(spark)).count() == 0
    assert ngram_join.one_of_each(no_documents(spark)).count() == 0


def test_banding_reaches_recall():
    bands, rows = ngram_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.MOST_HASHES


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    signer = ngram_join.Signer(256, 1)
    assert abs((signer.bands(a) == signer.bands(b)).mean() - 800 / 1200) < 0.12


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (60, 2))] + [(300, 300)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
