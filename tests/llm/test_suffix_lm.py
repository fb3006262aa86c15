from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from cases import documents, no_documents, odd_documents
from sessionmeter.llm import suffix_lm
from sessionmeter.llm.base import fold_of, table


def brute(texts: dict) -> tuple[dict, int]:
    """doc_id -> (n_tokens, n_known, N, base_score, score), and the words of the longest state, by the formulas of the operator's docstring."""
    cut = {d: (t or "").encode().lower().split() + [None] for d, t in texts.items()}
    train = [t for d, t in cut.items() if fold_of(d, 7) != 2]
    c = Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)

    def root(w):
        return math.log((c[w] + 1) / (total + kinds + 1))

    def fitted(count, follow, lower):
        kept = {x: n for x, n in follow.items() if n >= 2}
        if not kept:
            return None
        back = 1 - sum(n - 0.75 for n in kept.values()) / count
        own = {x: math.log((n - 0.75) / count + back * math.exp(lower(x))) for x, n in kept.items()}
        gain = sum(n * (own[x] - lower(x)) for x, n in kept.items()) + (count - sum(kept.values())) * math.log(back)
        return (math.log(back), own) if gain >= suffix_lm.LEAST_GAIN else None

    tree: dict = {}  # context -> (log back, own), of any depth

    def ln(context, x):
        if not context:
            return root(x)
        if context not in tree:
            return ln(context[1:], x)
        back, own = tree[context]
        return own[x] if x in own else back + ln(context[1:], x)

    counts, depth, before = c, 0, set()
    while True:
        depth += 1
        follow: dict = defaultdict(Counter)
        for t in train:
            for i in range(depth, len(t)):
                follow[tuple(t[i - depth : i])][t[i]] += 1
        found, candidates = {}, set()
        for s, f in follow.items():
            count = counts[s[0]] if depth == 1 else counts[s[:-1]][s[-1]]
            if count >= 16 and (depth == 1 or s[1:] in tree and s[:-1] in before):
                candidates.add(s)
                if got := fitted(count, f, lambda x: ln(s[1:], x)):
                    found[s] = got
        if not found:
            break
        tree |= found
        counts, before = follow, candidates
    out = {}
    for d, t in cut.items():
        score = 0.0
        for i, x in enumerate(t):
            k = 0
            while k < i and tuple(t[i - k - 1 : i]) in tree:
                k += 1
            score += ln(tuple(t[i - k : i]), x)
        out[d] = (len(t), sum(c[x] > 0 for x in t), total, sum(map(root, t)) / math.log(10), score / math.log(10))
    return out, max(map(len, tree), default=0)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()}


def test_whole_table(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_lm, "HEAD", 2000)  # so that most keys take the join
    want, _ = brute(texts)
    got = suffix_lm.scores(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert len(got) == len(want)
    gain = 0.0
    for r in got:
        tokens, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, total, fold_of(r.doc_id, 7) == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0  # unseen texts are likelier under the tree than under the unigrams


def test_deep_contexts(spark):
    """The next word is ruled by the last one, two, three, four or five, by chance: every depth has something to add."""
    rng = random.Random(5)
    rule: dict = {}
    texts = {}
    for i in range(150):
        t = ["a"] * 5
        for _ in range(120):
            t.append(rule.setdefault(tuple(t[-rng.choice([1, 2, 3, 4, 4, 5, 5, 5]) :]), rng.choice("abcd")))
        texts[i] = " ".join(t)
    want, longest = brute(texts)
    assert longest >= 4
    for r in suffix_lm.scores(documents(spark, list(texts.items()))).collect():
        assert math.isclose(r.score, want[r.doc_id][4], rel_tol=1e-9)


def test_distributions_sum_to_one(spark):
    texts = {i: "a b a c a b d a b" * 3 for i in range(40)}
    docs = documents(spark, [*texts.items(), *[(1000 + k, w) for k, w in enumerate(["a a", "a b", "a c", "a d", "a zz", "a"])]])
    got = {r.doc_id: r for r in suffix_lm.scores(docs).collect()}
    assert all(r.score < 0 for r in got.values())


def test_odd(spark):
    docs = odd_documents(spark)
    got = suffix_lm.scores(docs).collect()
    assert len(got) == docs.count()
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3))
    assert suffix_lm.scores(no_documents(spark)).count() == 0
    held_out = next(i for i in range(100) if fold_of(i, 7) == 2)
    alone = suffix_lm.scores(documents(spark, [(held_out, "only words")])).collect()[0]
    assert (alone.n_known, alone.train_tokens, alone.n_tokens) == (0, 0, 3) and alone.base_score == 0


def test_join_moves_keys_by_chunk_not_by_text(spark, monkeypatch):
    """Copies of a text ask for their keys once: rows that leave the texts' tasks grow with buckets, not with texts."""
    monkeypatch.setattr(suffix_lm, "HEAD", 0)  # so that all keys take the join
    texts = {i: "one two three four five six seven " * 6 for i in range(300)}
    want, _ = brute(texts)
    got = suffix_lm.scores(documents(spark, list(texts.items())).coalesce(1))
    assert all(math.isclose(r.score, want[r.doc_id][4], rel_tol=1e-9) and r.n_known == want[r.doc_id][1] for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandas" in plan


def test_numbers_by_bytes():
    import numpy as np

    for kind, x in ((np.uint64, [0, 1, 258, (1 << 64) - 1]), (np.uint32, [7]), (np.uint64, [])):
        blob = suffix_lm.by_bytes(np.array(x, kind))
        assert suffix_lm.from_bytes(blob, kind).tolist() == x


def test_stretches_keep_all_deep_followers(spark):
    """Contexts of three words and more are counted in stretches cut out of the texts, with the counts of whole texts."""
    rng = random.Random(7)
    texts = documents(spark, [(i, " ".join(rng.choice("abcdefgh") for _ in range(200))) for i in range(60)]).select("text")
    some = bytes(rng.randrange(256) | rng.randrange(256) for _ in range((1 << suffix_lm.CONTEXT_BITS) // 8))
    cut = suffix_lm.stretches(texts, [some] * 3)
    assert cut.count() > 0
    want = Counter()
    import numpy as np

    tables = [np.frombuffer(some, np.uint8)] * 3
    for r in texts.collect():
        tokens, starts = suffix_lm._joined([r.text])
        at = suffix_lm._followed(tokens, starts, tables)
        key = suffix_lm.gram(suffix_lm.context_before(tokens, at, 3), tokens[at])
        want.update(key.view(np.int64).tolist())
    rows = suffix_lm.followers(cut, 3, some, None, 10_000).collect()
    assert {r.key: r.n for r in rows} == {k: n for k, n in want.items() if n >= 2}
    heavy = list({r.context for r in rows})[::2]  # dealt by key instead of by context
    assert sorted(suffix_lm.followers(cut, 3, some, None, 10_000, heavy).collect()) == sorted(rows)


def test_head_holds_the_commonest_key_of_a_slot(spark, monkeypatch):
    """A key that falls into the slot of a rarer one is summed where the text is read; the rarer one is asked for."""
    import numpy as np

    rows = [(k << 52, float(k), suffix_lm.FOLLOWER, k % 97) for k in range(1, 2048)]
    table = suffix_lm.bucketed(spark.createDataFrame(rows, "key long, value double, kind int, weight long"), 3, 16).collect()
    keys = np.concatenate([np.frombuffer(r.head_keys, np.uint64) for r in table])
    assert len(set(suffix_lm.slots_of(keys, 16).tolist())) == 8 and {int(k >> np.uint64(52)) % 97 for k in keys} == {96}
    assert sum(len(suffix_lm.from_bytes(r.keys, np.uint64)) for r in table) == len(rows)
