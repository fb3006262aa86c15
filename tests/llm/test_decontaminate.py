from __future__ import annotations

import random

import numpy as np
import pytest

from cases import documents, no_documents, odd_documents, prose
from sessionmeter.llm import decontaminate
from sessionmeter.llm.base import table

ITEMS = "item_id long, text string, doc_id long, start long"


def edited(text: str, edits: int, seed: int) -> str:
    r = random.Random(seed)
    out = list(text)
    for _ in range(edits):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[at] = "q"
        elif kind == 1:
            out.insert(at, "q")
        else:
            del out[at]
    return "".join(out)


def least_edits(window: str, text: str) -> int:
    """Edits that turn the window into some stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_planted_edits(spark):
    items = [(i, prose(40 + i, n), None, None) for i, n in enumerate((6, 12, 25, 60))]
    texts, want = [], set()
    for d in range(60):
        item = items[d % 4]
        part = edited(item[1].upper() if d % 3 == 0 else item[1], d % 30, d)
        text = prose(200 + d, 60) + "\n " + part.replace(" ", " \n ") + " " + prose(300 + d, 30)
        texts.append((d, text))
        plain = " ".join(text.lower().split())
        own = " ".join(item[1].lower().split())
        ix = decontaminate.index([(0, own)])
        if any(least_edits("".join(map(chr, w)), plain) <= k for w, k in zip(ix.windows, ix.allowed)):
            want.add((d, item[0]))
    got = decontaminate.found_leaks(documents(spark, texts), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and 15 < len(want) < 55
    by_id = dict(texts)
    for r in got:
        ix = decontaminate.index([(0, items[r.item_id][1])])
        stretch = " ".join(by_id[r.doc_id][r.start : r.end].lower().split())
        assert any(least_edits(stretch, "".join(map(chr, w))) <= 2 * r.edits + 1 for w in ix.windows)


def test_whole_table(spark):
    """Every document that holds an item word for word is found, and none without a shared passage."""
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    items = {r.item_id: " ".join(r.text.lower().split()) for r in bench.collect()}
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in docs.collect()}
    got = {r.doc_id for r in decontaminate.found_leaks(docs, bench).collect()}
    assert got >= {d for d, t in texts.items() if any(i in t for i in items.values())}
    for d in got:
        assert any(i[k : k + 20] in texts[d] for i in items.values() for k in range(0, len(i) - 20, 5))
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts) - got


def test_blocks_give_the_same(spark, monkeypatch):
    docs, bench = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    whole = sorted(decontaminate.found_leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARACTERS", 3000)
    assert sorted(decontaminate.found_leaks(docs, bench).collect()) == whole


def test_odd(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, None, 1, 1), (None, prose(2, 80), 1, 1), (2, "", 1, 1), (3, "short", 1, 1), (4, prose(2, 80), 1, 1), (5, prose(2, 80), 1, 1)], ITEMS)
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.found_leaks(docs, items).collect())
    assert got == [(5, 4, 0), (5, 4, 0), (5, 5, 0), (5, 5, 0), (6, 4, 0), (6, 5, 0)]
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.found_leaks(docs, none).count() == 0
    assert decontaminate.without_leaks(docs, none).count() == docs.count()
    assert decontaminate.found_leaks(no_documents(spark), items).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_alignment(seed):
    r = random.Random(seed)
    for _ in range(60):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        t = "".join(r.choice("abc") for _ in range(r.randint(1, 20)))
        got = decontaminate.aligned(np.array([*map(ord, p)], np.uint32), np.array([*map(ord, t)], np.uint32), 99)
        assert got[0] == least_edits(p, t)
