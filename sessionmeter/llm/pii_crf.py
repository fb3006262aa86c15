"""Personal data: patterns, and a skip-chain conditional random field that adds spans.

Patterns find emails, IP addresses, card and phone numbers (leftmost, non-overlapping, per kind); matches that fail
their check are dropped. Then every document with a match is labelled anew by a conditional random field over its
tokens that could be personal data: tokens with a digit or an at sign, and tokens equal to a part of a match.

* Node potentials: log-linear in features of the token (length and grouping of its digits, signs, at sign, position
  in a match, the word before).
* Chain edges join neighbouring tokens, skip edges join tokens with the same normal form (letters and digits only,
  lower case) and tokens of which one holds the whole normal form of the other; both favour equal labels. A token is
  joined straight to the nearest matches with its form, however many other tokens stand between. Four numbers whose
  digits are too few to be a form of their own (`10.0.0.1`) tie only tokens with the same four numbers (`10-0-0-1`).
* The graph has loops: labels' marginals come from damped loopy belief propagation, run until messages settle. Tokens
  of a match keep their label.

Node weights are fitted on a bounded sample of documents, with the patterns' own labels as the target
(`MOST_DOCUMENTS`, those with the smallest hash of their id); no label table is read. A token outside the matches
whose marginal for a kind is at least `SURE`, and which a skip edge joins to a match of this kind, becomes a span of
this kind (a card or IP number written a second time without or with other signs, say). Spans of matches stay as
they are. Work grows with a text's length, long runs of digits or letters included. A null text is empty: no span. Equal texts get equal spans; no other column is read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import ready

# The kinds in their order, and the patterns of their matches; the first two are searched for from the at
# sign and in whole runs of dotted numbers, so that no long run is read again from each of its characters.
KINDS = ("email", "ip", "card", "phone")
MAIL_NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)
PLAIN = re.compile(r"[\W_]+")

MOST_DOCUMENTS = 2000
SURE = 0.9
CHAIN, SKIP = 0.3, 4.0
# messages are passed on until none changes by more than SETTLED; ROUNDS is only a stop for loops that never settle
ROUNDS, SETTLED, DAMPING = 1000, 1e-4, 0.3
LEAST_NORMAL = 7


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A name reaches back from its at sign, no farther than the last at sign or match."""
    free, at = 0, text.find("@")
    while at >= 0:
        name = text[free:at]
        start = free + len(name.rstrip(MAIL_NAME))
        host = MAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each run of dotted numbers; leading zeros don't count."""
    for m in DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            values = [p.lstrip("0") for p in four]
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                yield start, end
            start = end + 1


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start and kind."""
    out = [(s, 0, e) for s, e in emails(text)] + [(s, 1, e) for s, e in ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def has_candidates(text: str) -> bool:
    return re.search(r"[0-9@]", text) is not None


def normal(token: str) -> str:
    """Letters and digits only, lower case; four numbers too short to be known so stay apart (`10-0-0-1`)."""
    form = PLAIN.sub("", token).lower()
    if len(form) < LEAST_NORMAL and form.isdecimal():
        parts = re.findall(r"[0-9]+", token)
        if len(parts) == 4:
            return "-".join(parts)
    return form


@dataclass
class Graph:
    """Tokens that could be personal data, with edges between them."""

    spans: list[tuple[int, int]]
    target: np.ndarray
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


FEATURES = 128


def features_of(token: str, before: str) -> list[int]:
    """Feature numbers of a token; the target is not among them."""
    digits = sum(c in "0123456789" for c in token)
    letters = sum(map(str.isalpha, token))
    groups = len(re.findall(r"[0-9]+", token))
    out = [0, 1 + min(digits, 20), 22 + min(letters, 8), 31 + min(groups, 6)]
    out += [40 + k for k, c in enumerate("@.+-()_=\"/:") if c in token]
    out += [52 + (len(token) > 40), 54 + (digits == len(token)), 56 + (before[-1:] in "=:")]
    out.append(60 + min(12, token.count(".") * 3 + (digits > 0) + (letters > 0)))
    return out


def graph(text: str, found: list[tuple[int, int, int]]) -> Graph:
    """The graph of a text with at least one match."""
    known = {normal(text[s:e]) for s, _, e in found}
    known |= {normal(text[s:e].split("@")[0]) for s, k, e in found if k == 0}
    known = {k for k in known if len(k) >= LEAST_NORMAL}
    reach = list(accumulate((e for _, _, e in found), max))
    spans, target, feats, last = [], [], [], ""
    at = 0
    for m in TOKEN.finditer(text):
        token, s, e = m.group(), m.start(), m.end()
        if re.search(r"[0-9@]", token) or normal(token) in known:
            while at < len(found) and reach[at] <= s:
                at += 1
            hit = next((x for x in found[at : bisect_left(found, (e,))] if x[2] > s), None)
            spans.append((s, e))
            target.append(0 if hit is None else 1 + hit[1])
            feats.append(features_of(token, last))
        last = token
    # a match of several tokens stands once more as a whole: skip edges need its normal form
    forms = [normal(text[s:e]) for s, e in spans]
    tokens = list(spans)
    for s, k, e in found:
        i = bisect_right(tokens, (s, len(text))) - 1
        if i < 0 or tokens[i][1] < e:
            spans.append((s, e))
            target.append(1 + k)
            feats.append(features_of(text[s:e].replace(" ", ""), ""))
            forms.append(normal(text[s:e]))
    order = np.argsort([s for s, _ in spans], kind="stable")
    chain = [(int(a), int(b)) for a, b in zip(order, order[1:]) if 0 <= spans[b][0] - spans[a][1] <= 1]
    same, skip, search = defaultdict(list), [], ahocorasick.Automaton()
    for i, f in enumerate(forms):
        if len(f) >= LEAST_NORMAL:
            same[f].append(i)
    for whole in known & same.keys():
        if "-" not in whole:  # numbers kept apart are equal or differ
            search.add_word(whole, whole)
    search.make_automaton()
    held = {}
    for f, group in same.items():
        group.sort(key=lambda i: spans[i])
        held[f] = [i for i in group if target[i]]
        skip += tied(group, held[f])
    # a token that holds a whole known form: each joins the nearest matches of the other form
    holders = defaultdict(list)
    for f, group in same.items():
        for whole in inside(f, search):
            if not held[whole] and not held[f]:
                skip.append((same[whole][0], group[0]))
            skip += [(held[whole][0], i) for i in group if held[whole]]
            holders[whole] += held[f][:1]
    for whole, ends in holders.items():
        ends.sort(key=lambda i: spans[i])
        places = [spans[i] for i in ends]
        for i in same[whole]:
            if not target[i]:
                n = bisect_left(places, spans[i])
                skip += [(h, i) for h in ends[max(0, n - 1) : n + 1]]
    return Graph(spans, np.array(target, int), feats, chain, skip)


def inside(form: str, search: ahocorasick.Automaton) -> list[str]:
    """The other known forms within a form, each once."""
    found = dict.fromkeys(w for _, w in search.iter(form)) if len(search) else {}
    return [w for w in found if w != form]


def tied(group: list[int], held: list[int]) -> list[tuple[int, int]]:
    """Edges of a group of equal tokens: each to the nearest matches before and behind it; without a match, a path."""
    if not held:
        return list(zip(group, group[1:]))
    out, place = list(zip(held, held[1:])), {i: n for n, i in enumerate(held)}
    n = 0  # matches passed so far
    for i in group:
        if i in place:
            n += 1
        else:
            out += [(h, i) for h in held[max(0, n - 1) : n + 1]]
    return out


def node_scores(g: Graph, weights: np.ndarray) -> np.ndarray:
    return np.array([weights[f].sum(0) for f in g.features]).reshape(len(g.features), weights.shape[1])


def marginals(g: Graph, weights: np.ndarray) -> np.ndarray:
    """Loopy belief propagation over chain and skip edges; tokens of a match hold their label."""
    unary = node_scores(g, weights)
    held = np.flatnonzero(g.target)
    unary[held] = -np.inf
    unary[held, g.target[held]] = 0.0
    edges = [(a, b, CHAIN) for a, b in g.chain] + [(a, b, SKIP) for a, b in g.skip]
    if not edges:
        return _normal(unary)
    src = np.array([x for a, b, _ in edges for x in (a, b)])
    dst = np.array([x for a, b, _ in edges for x in (b, a)])
    bonus = np.expm1(np.array([w for *_, w in edges for _ in range(2)]))[:, None]
    back = np.arange(len(src)) ^ 1
    messages = np.zeros((len(src), unary.shape[1]))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, messages)
        cavity = _normal(belief[src] - messages[back])
        new = np.log(1.0 + bonus * cavity)
        new -= new.max(1, keepdims=True)
        step = (1 - DAMPING) * (new - messages)
        messages += step
        if np.abs(step).max() < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, dst, messages)
    return _normal(belief)


def _normal(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit_nodes(x: list[list[int]], y: np.ndarray, steps: int = 60, rate: float = 1.0) -> np.ndarray:
    """Node weights by gradient steps on the log likelihood of the patterns' labels."""
    weights = np.zeros((FEATURES, len(KINDS) + 1))
    if not len(y):
        weights[0, 0] = 4.0
        return weights
    owner = np.repeat(np.arange(len(x)), [len(f) for f in x])
    flat = np.concatenate([np.array(f) for f in x])
    goal = np.eye(len(KINDS) + 1)[y]
    speed = np.full_like(weights, 1e-6)
    for _ in range(steps):
        z = np.zeros((len(x), weights.shape[1]))
        np.add.at(z, owner, weights[flat])
        err = (_normal(z) - goal) / len(x)
        grad = np.zeros_like(weights)
        np.add.at(grad, flat, err[owner])
        grad += 1e-4 * weights
        speed += grad**2
        weights -= rate * grad / np.sqrt(speed)
    return weights


def added(text: str, found: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans the field adds to the matches."""
    if not found:
        return []
    g = graph(text, found)
    if not (g.target == 0).any():
        return []
    linked = defaultdict(set)
    for a, b in g.skip:
        linked[a].add(int(g.target[b]))
        linked[b].add(int(g.target[a]))
    # skip edges pass labels on: what any token in reach holds counts as linked
    grown = True
    while grown:
        grown = False
        for a, b in g.skip + g.skip[::-1]:  # both ways, so that a path takes one sweep
            if linked[a] != linked[b]:
                linked[a] = linked[b] = linked[a] | linked[b]
                grown = True
    p = marginals(g, weights)
    reach = list(accumulate((e for _, _, e in found), max))
    out = []
    for i in np.flatnonzero(g.target == 0):
        kind = int(p[i, 1:].argmax()) + 1
        if p[i, kind] >= SURE and kind in linked[int(i)]:
            s, e = g.spans[i]
            core = CORE.search(text[s:e])
            s, e = s + core.start(), s + core.end()
            n = bisect_left(found, (e,))  # matches that begin before the span's end
            if not n or reach[n - 1] <= s:
                out.append((s, kind - 1, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def train(docs: DataFrame, limit: int = MOST_DOCUMENTS) -> np.ndarray:
    """Node weights from the documents that hold a digit or at sign, at most `limit` of them."""
    ready(docs.sparkSession)
    chosen = (
        docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
        .select("text", F.xxhash64("doc_id").alias("_rank"), "doc_id")
    )
    cut = chosen.select("_rank").orderBy("_rank").limit(limit).agg(F.max("_rank")).first()[0]
    if cut is None:
        return fit_nodes([], np.zeros(0, int))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            seen = defaultdict(int)
            for text in rows["text"]:
                found = matches(text)
                g = graph(text, found)
                # what a skip edge ties to a match is for the field to decide, and no example of either
                tied = {i for edge in g.skip for i in edge}
                for i, (f, t) in enumerate(zip(g.features, g.target)):
                    if t or i not in tied:
                        seen[",".join(map(str, f)), int(t)] += 1
            yield pd.DataFrame([(f, t, n) for (f, t), n in seen.items()], columns=["f", "t", "n"])

    counts = chosen.where(F.col("_rank") <= cut).select("text").mapInPandas(tokens, "f string, t int, n long")
    # distinct feature lists are few: each is made of a few bounded numbers
    got = counts.groupBy("f", "t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f", "t").limit(20_000).collect()
    x = [[int(v) for v in r["f"].split(",")] for r in got for _ in range(min(50, int(np.ceil(np.sqrt(r["n"])))))]
    y = np.array([r["t"] for r in got for _ in range(min(50, int(np.ceil(np.sqrt(r["n"])))))], int)
    return fit_nodes(x, y)


def span_columns(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """A struct per text: counts of matches, digest of the matches, all spans."""
    ready(docs.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base = matches(t) if t and has_candidates(t) else []
                every = sorted(base + added(t, base, weights)) if base else []
                counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find(F.col(text).cast("string"))


def masked_column(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """The text with each span replaced by its kind in angle brackets; null stays null."""
    ready(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                base = matches(t) if t and has_candidates(t) else []
                if base:
                    done, parts = 0, []
                    for s, k, e in sorted(base + added(t, base, weights)):
                        if e > done:
                            parts += [t[done : max(s, done)], f"<{KINDS[k]}>"] if s >= done else []
                            done = e
                    t = "".join(parts) + t[done:]
                out.append(t)
            yield pd.Series(out, dtype=object)

    return mask(F.col(text).cast("string"))


def spans(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document."""
    weights = train(docs)
    rows = docs.select("doc_id", span_columns(docs, weights).alias("_found"))
    return rows.select("doc_id", "_found.*")
