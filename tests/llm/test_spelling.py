from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import documents, no_documents, odd_documents, odd_rows, rows_of
from sessionmeter.llm import spelling
from sessionmeter.llm.base import table


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return brute_words({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def shorter(w):
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def brute_words(words):
    form, near, sharing = {}, {}, {}
    for w in words:  # words one letter apart are equal, or become equal, without one letter of either
        for key in shorter(w):
            sharing.setdefault(key, set()).add(w)
    for w, n in words.items():
        close = [x for x in set().union(*(sharing[k] for k in shorter(w))) if one_apart(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], None if form[w] is None else words[form[w]]))
    return sorted(out, key=repr)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(r[1] is not None for r in want) > 5 and len(want) > 500
    assert rows_of(spelling.variants(docs)) == want


def test_odd_rows(spark):
    assert rows_of(spelling.variants(odd_documents(spark))) == brute([r[:2] for r in odd_rows()])
    assert spelling.variants(no_documents(spark)).count() == 0


def test_ties_chains_and_accents(spark):
    text = " ".join(
        ["ABCDE"] * 3 + ["abcdef"] * 6 + ["abcdeg"] * 6 + ["xbcdefg"] * 3 + ["abcdefg"] * 12 + ["ététu"] * 3 + ["étetu"] * 7 + ["zzÉzz"] * 3 + ["abcd"] * 9
    )
    got = spelling.variants(documents(spark, [(1, text)]))
    assert rows_of(got) == brute([(1, text)])
    by_word = {r.word: r for r in got.collect()}
    # equal counts: the least in code-point order; forms of forms lead to the last
    assert (by_word["abcde"].form, by_word["abcde"].root) == ("abcdef", "abcdefg")
    assert by_word["ététu"].form == "étetu"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=8), min_size=1, max_size=40, unique=True), st.integers(0, 99))
def test_index(words, seed):
    r = random.Random(seed)
    counts = [r.randint(1, 4) for _ in words]
    got = {w: (k, n, f) for w, k, n, f in spelling.near_in(words, words, counts, False)}
    for w in words:
        close = [(-n, x) for x, n in zip(words, counts) if one_apart(w, x)]
        assert got.get(w) == ((len(close), -min(close)[0], min(close)[1]) if close else None)


@pytest.mark.parametrize("block", [1 << 14, 7])
def test_shards_and_blocks_miss_nothing(spark, block):
    r = random.Random(2)
    words = {"".join(r.choice("ab") for _ in range(r.randint(5, 9))): r.randint(3, 9) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = {x.word: (x.n_near, x.form_n, x.form) for x in spelling.near_words(df, block).collect()}
    for w in words:
        close = [(-words[x], x) for x in words if one_apart(w, x)]
        assert got.get(w) == ((len(close), -min(close)[0], min(close)[1]) if close else None)
