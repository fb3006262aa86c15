from __future__ import annotations

import hashlib
import random
import time

import numpy as np

from cases import documents, no_documents, odd_documents, prose
from sessionmeter.llm import pii_crf
from sessionmeter.llm.base import table


def leftmost(text: str, start: str, inner, accept) -> list[tuple[int, int]]:
    """Longest match of a grammar at each place from the left, found by trying every end."""
    out, i = [], 0
    while i < len(text):
        if text[i] in start:
            ends = [e for e in range(len(text), i, -1) if inner(text[i:e])]
            if ends:
                if accept(text[i : ends[0]]):
                    out.append((i, ends[0]))
                i = ends[0]
                continue
        i += 1
    return out


DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def is_email(s):
    name, at, host = s.partition("@")
    parts = host.split(".")
    return bool(at and name) and all(c in LETTERS + DIGITS + "._%+-" for c in name) and len(parts) > 1 and all(p and all(c in LETTERS + DIGITS + "-" for c in p) for p in parts)


def is_ip(s):
    parts = s.split(".")
    return len(parts) == 4 and all(p and all(c in DIGITS for c in p) for p in parts)


def is_card(s):
    return len(s) > 1 and all(c in DIGITS + " -" for c in s) and s[0] in DIGITS and s[-1] in DIGITS and not any(a in " -" and b in " -" for a, b in zip(s, s[1:]))


def is_phone(s):
    return len(s) > 3 and s[0] == "+" and s[1] in DIGITS and s[-1] in DIGITS and all(c in DIGITS + " ().-" for c in s[2:-1])


def luhn(s):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in s if c in DIGITS])):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def brute(text: str) -> list[tuple[int, int, int]]:
    n = lambda s: sum(c in DIGITS for c in s)
    out = [(s, 0, e) for s, e in leftmost(text, LETTERS + DIGITS + "._%+-", is_email, lambda s: True)]
    out += [(s, 1, e) for s, e in leftmost(text, DIGITS, is_ip, lambda s: all(int(p) <= 255 for p in s.split(".")))]
    out += [(s, 2, e) for s, e in leftmost(text, DIGITS, is_card, lambda s: 14 <= n(s) <= 19 and luhn(s))]
    out += [(s, 3, e) for s, e in leftmost(text, "+", is_phone, lambda s: 10 <= n(s) <= 15)]
    return sorted(out)


def test_matches_equal_the_plain_search():
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(["1", "22", "255", ".", ".", "+", "@", " ", "-", "(", "ab", "x.y", "4111 1111 1111 1111", "é"]) for _ in range(r.randint(1, 25)))
        assert pii_crf.matches(text) == brute(text), text


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r.doc_id: r for r in pii_crf.spans(docs).collect()}
    for d in docs.collect():
        base = pii_crf.matches(d.text)
        r = rows[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii_crf.joined(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(pii_crf.joined(base).split(",")) <= {*every, ""} and (base or not every)


def test_repeated_number_is_labelled_without_its_signs(spark):
    text = f"{prose(1, 20)} card 4111 1111 1111 1111 then {prose(2, 40)} again 4111-1111-1111-1111x? no 41111111.11111111 end"
    docs = documents(spark, [(1, text), *[(10 + i, prose(50 + i, 30) + f" call +44 20 7946 0{i:03d}, id {i}77.") for i in range(40)]])
    rows = {r.doc_id: r for r in pii_crf.spans(docs).collect()}
    added = [x for x in rows[1].spans.split(",") if x not in pii_crf.joined(pii_crf.matches(text)).split(",")]
    assert [text[int(s) : int(e)] for _, s, e in (x.split(":") for x in added)] == ["41111111.11111111"]
    assert all(rows[10 + i].spans == pii_crf.joined(pii_crf.matches(t)) for i, t in enumerate(d.text for d in docs.orderBy("doc_id").collect()[1:]))


def test_marginals_equal_enumeration_on_a_chain():
    """Without loops belief propagation is exact."""
    rng = np.random.default_rng(2)
    g = pii_crf.Graph([(i, i + 1) for i in range(4)], np.zeros(4, int), [[i] for i in range(4)], [(0, 1), (1, 2)], [(2, 3)])
    weights = np.zeros((pii_crf.FEATURES, 5))
    weights[:4] = rng.normal(size=(4, 5))
    p = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        energy = sum(weights[i, k] for i, k in enumerate(labels))
        energy += sum(pii_crf.CHAIN for a, b in g.chain if labels[a] == labels[b]) + sum(pii_crf.SKIP for a, b in g.skip if labels[a] == labels[b])
        for i, k in enumerate(labels):
            p[i, k] += np.exp(energy)
    assert np.allclose(pii_crf.marginals(g, weights), p / p.sum(1, keepdims=True), atol=1e-3)


def test_masking(spark):
    docs = documents(spark, [(1, "mail a.b@c.org, ip 1.2.3.4 ok"), (2, None), (3, "none 12")])
    weights = pii_crf.train(docs)
    got = {r.doc_id: r.m for r in docs.select("doc_id", pii_crf.masked_column(docs, weights).alias("m")).collect()}
    assert got == {1: "mail <email>, ip <ip> ok", 2: None, 3: "none 12"}


def test_odd(spark):
    docs = odd_documents(spark)
    rows = pii_crf.spans(docs).collect()
    assert len(rows) == docs.count() and all(r.spans == "" for r in rows)
    assert pii_crf.spans(no_documents(spark)).count() == 0


def test_every_repeat_of_a_spaced_match_is_found():
    """However many repeats stand before and behind the match, none is out of its reach."""
    weights = pii_crf.fit_nodes([], np.zeros(0, int))
    weights[0, 0] = 0.5
    for before, behind in ((0, 4), (0, 12), (12, 0), (15, 15), (60, 200)):
        for match in ("+1 555 123 4567", "4111 1111 1111 1111"):
            bare = "".join(c for c in match if c in DIGITS)
            if match[0] != "+":
                bare = bare[:8] + "." + bare[8:]  # no match of its own
            text = " ".join([*(f"no {bare} {w}" for w in prose(1, before).split()[:before]), match, *(f"and {bare} {w}" for w in prose(2, behind).split()[:behind])])
            found = pii_crf.matches(text)
            assert len(found) == 1
            assert [text[s:e] for s, _, e in pii_crf.added(text, found, weights)] == [bare] * text.count(bare)


def test_leading_zeros_of_an_ip_number():
    text = f"a {'0' * 40}1.2.003.{'0' * 25}255 b 1.2.3.0256 c 1.2.3.4.5.6.7.8.9"
    assert pii_crf.matches(text) == brute(text)
    assert sum(k == 1 for _, k, _ in pii_crf.matches(text)) == 3


def test_short_ip_numbers_meet_only_the_same_four_numbers():
    weights = pii_crf.fit_nodes([], np.zeros(0, int))
    weights[0, 0] = 0.5
    text = "host 10.0.0.1 is also 10-0-0-1 but neither 10001 nor 10-0-0-12 nor 1-00-0-1 nor 10_0_01"
    found = pii_crf.matches(text)
    assert [text[s:e] for s, _, e in pii_crf.added(text, found, weights)] == ["10-0-0-1"]


def test_long_runs_take_time_in_step_with_their_length():
    weights = pii_crf.fit_nodes([], np.zeros(0, int))
    weights[0, 0] = 0.5
    n = 1_000_000
    runs = ["7" * n, "1." * (n // 2), "ab+/9Q" * (n // 6) + " x@y.org", "a." * (n // 2) + "@", "@" * n, "+1" + "-" * n, "4 " * (n // 2),
            "10.0.0.1 " + "10-0-0-1 " * 3000 + "7" * n]
    start = time.perf_counter()
    for text in runs:
        found = pii_crf.matches(text)
        if len(found) < 10:
            pii_crf.added(text, found, weights)
    assert time.perf_counter() - start < 40
    # many different matches, and tokens that hold them
    text = " ".join(f"u{i:05d}x@mail{i}.org u{i:05d}x id-u{i:05d}x-mail{i}org" for i in range(3000))
    start = time.perf_counter()
    assert pii_crf.added(text, pii_crf.matches(text), weights)
    assert time.perf_counter() - start < 20


def test_marginals_come_near_enumeration_on_a_loop():
    """Three tokens tied in a ring beside a match: belief propagation is close to exact and picks the same labels."""
    rng = np.random.default_rng(5)
    g = pii_crf.Graph([(i, i + 1) for i in range(4)], np.array([0, 0, 0, 2]), [[i] for i in range(4)], [(0, 1), (1, 2)], [(0, 2), (2, 3)])
    weights = np.zeros((pii_crf.FEATURES, 5))
    weights[:4] = rng.normal(size=(4, 5))
    p = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5):
        labels = (*labels, 2)
        energy = sum(weights[i, k] for i, k in enumerate(labels[:3]))
        energy += sum(pii_crf.CHAIN for a, b in g.chain if labels[a] == labels[b]) + sum(pii_crf.SKIP for a, b in g.skip if labels[a] == labels[b])
        for i, k in enumerate(labels):
            p[i, k] += np.exp(energy)
    p /= p.sum(1, keepdims=True)
    got = pii_crf.marginals(g, weights)
    assert (got.argmax(1) == p.argmax(1)).all() and np.abs(got - p).max() < 0.05
