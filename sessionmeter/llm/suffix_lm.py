"""Language-model scores by a probabilistic suffix tree over words.

The tree's states are contexts of any number of words. A context is a candidate if it occurs `LEAST_CONTEXT` times
in the training texts, its suffix (the context without its oldest word) is a state and its prefix (the one without its
newest word, from whose followers it is counted) was a candidate. The tree grows by one word at a time until no
candidate is left, however deep that is. A candidate is retained if its
next-word distribution passes a divergence test: the log-likelihood it gains on the words that follow it, against the
distribution of its suffix, is at least `LEAST_GAIN` nats. Distributions are smoothed by absolute discounting:

    P_s(x) = max(n(s, x) - D, 0) / n(s) + b(s) P_suffix(s)(x),    for n(s, x) >= LEAST_FOLLOWER, else b(s) P_suffix(s)(x)

with b(s) what makes it sum to 1, and at the root the add-one unigram P(x) = (c(x) + 1) / (N + V + 1), in which all
unknown words share one place. A word is scored by the longest suffix of its past that is a state.

Work. Words and contexts are 64-bit hashes. Up to depth `SIEVED`, where almost every position has a candidate context,
each depth reads the texts to count followers, and a pass before it deals 32-bit prints of all followers to buckets,
only to learn which occur twice or more (a bit table of bounded size). Deeper contexts are counted in the stretches of
the texts that have candidate contexts of `SIEVED + 1` words, which are cut out once. False positives of bit tables cost
work, never a wrong count. In logarithms the score of a text is a plain sum over keys: unigrams, states (log b) and
followers (what they have above it); a position asks for a longer context only while the shorter one may be a state.
Keys of a bounded head of the model are summed where the text is read, all others by buckets of keys, so no task holds
the model. The head has at most `HEAD` slots; the commonest of the keys that fall into a slot is held there.

Training texts are those outside fold 2 of 7; all of them are counted. The model grows with them. Null and empty
texts consist of the end token alone. Rows equal in id are documents of their own; other columns are not read. Without
training text every token is unknown, with N and V zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionmeter.llm.base import fold, mix, ready, word_hashes
from sessionmeter.llm.graph import bit_filter, stored, tidy, unstore

SIEVED = 2  # depths
LEAST_CONTEXT, LEAST_FOLLOWER, LEAST_GAIN, DISCOUNT = 16, 2, 10.0, 0.75
CONTEXT_BITS, FOLLOWER_BITS, MODEL_BITS = 24, 27, 28
BUCKET_TOKENS = 1_000_000
HEAVY_SHARE = 1000  # contexts of at least a thousandth of the tokens, of which there are a thousand at most
HEAD, HEAD_TOKENS = 1 << 21, 64  # slots at most; a slot for so many training tokens at most
FLUSH = 750_000
WORD_BITS = 9
CHUNK_PAIRS, CHUNK_DOCS = 500_000, 50_000  # documents of a chunk are numbered in 16 bits

END = int(mix(np.array([0x5DEECE66D], np.uint64))[0])
_FACTOR, _STATE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a word after a context; also that of the context made of both."""
    return mix(context * _FACTOR + word)


def state(context: np.ndarray) -> np.ndarray:
    return mix(context ^ _STATE)


def contexts_of(tokens: np.ndarray, starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each depth the context of each token; texts begin at `starts`, contexts don't reach over them (0 there)."""
    before = np.append(np.uint64(0), tokens[:-1])
    age = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
    out = []
    for k in range(1, depth + 1):
        c = before if k == 1 else gram(np.append(np.uint64(0), out[-1][:-1]), before)
        out.append(np.where(age >= k, c, np.uint64(0)))
    return out


def has_bit(bits: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    place = key >> np.uint64(64 - width)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def top_bits(key: str, width: int) -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - width)


def bucket_bits(tokens: int) -> int:
    """Buckets of keys are told apart by this many top bits; a bucket's share of the work is bounded."""
    return max(3, (max(1, tokens // BUCKET_TOKENS)).bit_length())


def bucket_cuts(keys: np.ndarray, wide: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and where the last one ends."""
    edges = np.arange(1 << wide, dtype=np.uint64) << np.uint64(64 - wide)
    return np.append(np.searchsorted(keys, edges), len(keys))


def head_slots(tokens: int) -> int:
    """The head goes to all tasks, so a small corpus gets a small one."""
    return min(HEAD, 1 << (tokens // HEAD_TOKENS).bit_length())


def slots_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each key, in the keys' order."""
    return ((keys >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def empty_slots(slots: int) -> np.ndarray:
    """Keys that belong to other slots than those they lie in."""
    keys = np.zeros(slots, np.uint64)
    keys[:1] = ~np.uint64(0)
    return keys


def _numbers(blobs: Iterable[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def by_bytes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on: the high bytes of sorted keys compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_bytes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def many_from_bytes(blobs: Iterable[bytes], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(from_bytes(b, kind) for b in blobs)])


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Narrow rows are handed to Python by more at a time than texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return (part for part in batches if len(part))


def _joined(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts one after another, and where each text starts."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    words, begins = word_hashes(b"\n".join(parts).lower())
    ends = np.cumsum([len(p) + 1 for p in parts])
    last = np.searchsorted(begins, ends) + np.arange(len(parts))  # the place of each text's end token
    tokens = np.full(len(words) + len(parts), np.uint64(END))
    is_word = np.ones(len(tokens), bool)
    is_word[last] = False
    tokens[is_word] = words
    return tokens, np.append(0, last[:-1] + 1)


def _token_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and where their texts start, of texts or of stretches cut out of them."""
    for part in _filled(batches):
        if "text" in part:
            yield _joined(part["text"])
        else:
            for tokens, sizes in zip(part["tokens"], part["sizes"]):
                sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
                yield np.frombuffer(tokens, np.uint64), np.cumsum(sizes) - sizes


def stretches(texts: DataFrame, candidates: list[bytes]) -> DataFrame:
    """(tokens, sizes), stored: the stretches of texts whose tokens all follow candidate contexts of each length, and those contexts.

    `candidates` has a bit table for each length from one word on. The first token of a stretch has no longer
    candidate context, as the token before it has none of this length: nothing deeper is lost.
    """
    depth = len(candidates)
    tables = [np.frombuffer(c, np.uint8) for c in candidates]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tokens, starts in _token_runs(batches):
            at = _followed(tokens, starts, tables)
            if not len(at):
                continue
            first = np.append(True, np.diff(at) != 1)
            ahead = np.where(first, depth, 0)
            sizes = np.add.reduceat(ahead + 1, np.flatnonzero(first))
            begins = at[first] - depth
            place = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
            yield pd.DataFrame({"tokens": [tokens[place].tobytes()], "sizes": [sizes.astype(np.uint32).tobytes()]})

    return stored(texts.mapInPandas(cut, "tokens binary, sizes binary"), "stretches")


def _followed(tokens: np.ndarray, starts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """The places of the tokens before which contexts of all lengths up to that of `tables` may be candidates."""
    age = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
    at = np.arange(len(tokens))
    for k, table in enumerate(tables, 1):
        at = at[age[at] >= k]
        at = at[has_bit(table, context_before(tokens, at, k), CONTEXT_BITS)]
    return at


def context_before(tokens: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """The context of so many words before each place."""
    out = tokens[at - words]
    for j in range(words - 1, 0, -1):
        out = gram(out, tokens[at - j])
    return out


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, how often each occurs; the keys' order, and where in it each distinct one begins."""
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(key))), order, first


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c), stored. Counts meet by buckets of the word, as arrays."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            cut = bucket_cuts(words, WORD_BITS)
            used = np.flatnonzero(np.diff(cut))
            blobs = [[x[cut[b] : cut[b + 1]].tobytes() for b in used] for x in (words, n.astype(np.uint32))]
            return pd.DataFrame({"bucket": used, "words": blobs[0], "n": blobs[1]})

        for part in _filled(batches):
            tokens, _ = _joined(part["text"])
            held.append(tokens)
            size += len(tokens)
            if size > 2 * FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        words, _, order, first = _distinct(_numbers(part["words"], np.uint64))
        return pd.DataFrame({"word": _long(words), "c": np.add.reduceat(_numbers(part["n"], np.uint32).astype(np.int64)[order], first)})

    rows = texts.mapInPandas(count, "bucket long, words binary, n binary")
    return stored(rows.groupBy("bucket").applyInPandas(summed, "word long, c long"), "words")


def _is_in(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked), bool)
    return keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked


def follower_bits(texts: DataFrame, depth: int, candidates: bytes, tokens: int) -> bytes:
    """A bit for every (context, word) that occurs twice or more after a candidate context."""
    wide = bucket_bits(tokens)
    is_candidate = np.frombuffer(candidates, np.uint8)

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys = np.repeat(keys, np.minimum(n, 2))  # twice here is as good as twice elsewhere
            bucket = (keys >> np.uint64(64 - wide)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange((1 << wide) + 1))
            short = (keys >> np.uint64(32 - wide)).astype(np.uint32)
            used = np.flatnonzero(np.diff(cut))
            return pd.DataFrame({"bucket": used, "prints": [short[cut[b] : cut[b + 1]].tobytes() for b in used]})

        for all_tokens, starts in _token_runs(batches):
            context = contexts_of(all_tokens, starts, depth)[-1]
            ok = (context != 0) & has_bit(is_candidate, context, CONTEXT_BITS)
            held.append(gram(context[ok], all_tokens[ok]))
            size += int(ok.sum())
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def repeated(part: pd.DataFrame) -> pd.DataFrame:
        prints_ = np.sort(np.concatenate([np.frombuffer(p, np.uint32) for p in part["prints"]]))
        twice = prints_[1:][prints_[1:] == prints_[:-1]]
        seen = np.zeros(1 << max(3, FOLLOWER_BITS - wide), bool)
        seen[twice >> np.uint32(32 - FOLLOWER_BITS + wide)] = True
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "bits": [np.packbits(seen, bitorder="little").tobytes()]})

    out = bytearray((1 << FOLLOWER_BITS) // 8)
    size = len(out) >> wide
    for r in texts.mapInPandas(prints, "bucket long, prints binary").groupBy("bucket").applyInPandas(repeated, "bucket long, bits binary").toLocalIterator():
        out[r["bucket"] * size : (r["bucket"] + 1) * size] = r["bits"]
    return bytes(out)


def followers(texts: DataFrame, depth: int, candidates: bytes, twice: bytes | None, tokens: int, heavy: Iterable[int] = ()) -> DataFrame:
    """(context, key, under, n, ends) with n >= LEAST_FOLLOWER, for contexts that may be candidates.

    `key` is the gram of context and word, `under` that of the context's suffix and the word (the word at depth 1),
    `ends` whether the word is the end token. Counts meet by buckets of the context, those of `heavy` contexts by buckets
    of the key, so that no bucket gets a common context whole. A bucket's rows travel as arrays in the order of contexts,
    each context once for all its words; keys are made again of both.
    """
    heavies = np.sort(np.array(list(heavy), np.int64).view(np.uint64))
    is_candidate, may_repeat = np.frombuffer(candidates, np.uint8), np.frombuffer(twice or b"", np.uint8)
    wide = bucket_bits(tokens)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            key, context, suffix, word = (np.concatenate(x) for x in zip(*held))
            key, n, order, first = _distinct(key)
            at = order[first]
            context = context[at]
            bucket = np.where(_is_in(heavies, context), key, context) >> np.uint64(64 - wide)
            by_context = np.argsort(bucket << np.uint64(64 - wide) | context >> np.uint64(wide))
            at, n, context, bucket = at[by_context], n[by_context].astype(np.uint32), context[by_context], bucket[by_context]
            run = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])))
            times = np.diff(np.append(run, len(at))).astype(np.uint32)
            cut = np.searchsorted(bucket, np.arange((1 << wide) + 1, dtype=np.uint64))
            run_cut = np.searchsorted(run, cut)
            used = np.flatnonzero(np.diff(cut))
            columns = {"context": (context[run], run_cut), "suffix": (suffix[at[run]] if depth > 1 else suffix, run_cut), "times": (times, run_cut), "word": (word[at], cut), "n": (n, cut)}
            blobs = {c: [by_bytes(x[of[b] : of[b + 1]]) for b in used] for c, (x, of) in columns.items()}
            return pd.DataFrame({"bucket": used, **blobs})

        for all_tokens, starts in _token_runs(batches):
            contexts = contexts_of(all_tokens, starts, depth)
            at = np.flatnonzero((contexts[-1] != 0) & has_bit(is_candidate, contexts[-1], CONTEXT_BITS))
            key = gram(contexts[-1][at], all_tokens[at])
            if len(may_repeat):
                may = has_bit(may_repeat, key, FOLLOWER_BITS)
                at, key = at[may], key[may]
            word = all_tokens[at]
            held.append((key, contexts[-1][at], contexts[-2][at] if depth > 1 else word[:0], word))
            size += len(at)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        context, suffix, word = (many_from_bytes(part[c], np.uint64) for c in ("context", "suffix", "word"))
        times = many_from_bytes(part["times"], np.uint32)
        context, suffix = np.repeat(context, times), np.repeat(suffix, times) if depth > 1 else suffix
        key, n = gram(context, word), many_from_bytes(part["n"], np.uint32).astype(np.int64)
        _, _, order, first = _distinct(key)
        many = np.add.reduceat(n[order], first)
        kept = many >= LEAST_FOLLOWER
        at = order[first[kept]]
        under = gram(suffix[at], word[at]) if depth > 1 else word[at]
        return pd.DataFrame(
            {"context": _long(context[at]), "key": _long(key[at]), "under": _long(under), "n": many[kept], "ends": word[at] == np.uint64(END)}
        )

    rows = texts.mapInPandas(count, "bucket long, context binary, suffix binary, times binary, word binary, n binary")
    return rows.groupBy("bucket").applyInPandas(summed, "context long, key long, under long, n long, ends boolean")


def fitted(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States and followers of one depth, stored as one table, of (context, key, n, total, lower).

    `lower` is ln P of the word at the suffix. What belongs to a state is kept with one of its followers.
    """
    alike = Window.partitionBy("context")
    rows = grams.withColumn("seen", F.sum("n").over(alike)).withColumn("kinds", F.count(F.lit(1)).over(alike)).withColumn("last", F.max("key").over(alike))
    rows = rows.withColumn("back", 1 - (F.col("seen") - DISCOUNT * F.col("kinds")) / F.col("total"))
    rows = rows.withColumn("own", F.log((F.col("n") - DISCOUNT) / F.col("total") + F.col("back") * F.exp("lower")))
    gain = F.sum(F.col("n") * (F.col("own") - F.col("lower"))).over(alike) + (F.col("total") - F.col("seen")) * F.log("back")
    rows = rows.withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN).withColumn("back", F.log("back"))
    above = (F.col("own") - F.col("lower") - F.col("back")).alias("above")
    of_state = [F.when(F.col("key") == F.col("last"), F.col(c)).alias(c) for c in ("context", "total", "back")]
    kept = stored(rows.select("key", "n", "own", above, *of_state), "kept")
    return kept.where("context is not null").select("context", "total", "back"), kept


def model(texts: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The model by buckets; N; V; the words of the longest contexts.

    A bucket: its keys in order, their values in log10, whether they are words, and its parts of the bit table and the head.
    """
    words = word_counts(texts)
    done = [words]
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    root = F.log((F.col("c") + 1) / F.lit(total + kinds + 1))
    ten = float(np.log(10.0))
    parts = [words.select(F.col("word").alias("key"), (root / ten).alias("value"), F.lit(WORD).alias("kind"), F.col("c").alias("weight"))]
    end = int(np.array([END], np.uint64).view(np.int64)[0])
    candidates = words.where((F.col("c") >= LEAST_CONTEXT) & (F.col("word") != end)).select(F.col("word").alias("context"), F.col("c").alias("total"))
    lower = words.select(F.col("word").alias("under"), root.alias("lower"))
    tables: list[bytes] = []
    source, depth = texts, 0
    while True:
        bits = bit_filter(candidates, top_bits("context", CONTEXT_BITS), CONTEXT_BITS)
        if bits.count(0) == len(bits):
            break
        depth += 1
        tables.append(bits)
        twice = follower_bits(texts, depth, bits, total) if depth <= SIEVED else None
        if depth > SIEVED:
            cut = stretches(source, tables)
            if source is not texts:
                unstore(source)
            source = cut
        tidy(texts.sparkSession)
        heavy = [r.context for r in candidates.where(F.col("total") >= total / HEAVY_SHARE).select("context").collect()]
        grams = stored(followers(source, depth, bits, twice, total, heavy), "followers")
        tidy(texts.sparkSession)
        # the join by context comes last: its rows lie as the windows by context need them
        states, kept = fitted(grams.select("context", "key", "under", "n").join(lower, "under").drop("under").join(candidates, "context"))
        tidy(texts.sparkSession)
        done.append(kept)
        parts.append(states.select(F.col("context").alias("key"), (F.col("back") / ten).alias("value"), F.lit(STATE).alias("kind"), F.col("total").alias("weight")))
        parts.append(kept.select("key", (F.col("above") / ten).alias("value"), F.lit(FOLLOWER).alias("kind"), F.col("n").alias("weight")))
        # a longer context needs its own count, a prefix that was a candidate and a suffix that is a state
        longer = grams.where((F.col("n") >= LEAST_CONTEXT) & ~F.col("ends")).join(candidates, "context", "left_semi")
        longer = longer.select(F.col("key").alias("context"), F.col("under").alias("suffix"), F.col("n").alias("total"))
        last, candidates = candidates, stored(longer.join(states.select(F.col("context").alias("suffix")), "suffix", "left_semi").drop("suffix"), "candidates")
        unstore(grams, *([last] if depth > 1 else []))
        lower = kept.select(F.col("key").alias("under"), F.col("own").alias("lower"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if depth:
        unstore(candidates)
    if source is not texts:
        unstore(source)
    tidy(texts.sparkSession)
    with batches_of(texts.sparkSession, 1 << 14):  # rows of four numbers
        table = stored(bucketed(every, bucket_bits(total), head_slots(total)), "model")
    unstore(*done)
    tidy(texts.sparkSession)
    return table, int(total), int(kinds), depth


WORD, STATE, FOLLOWER = range(3)
PARTS = "bucket long, keys binary, values binary, known binary, weights binary"
BUCKET = "bucket long, keys binary, values binary, known binary, bits binary, head_keys binary, head_values binary"


def bucketed(every: DataFrame, wide: int, slots: int) -> DataFrame:
    """A row per bucket of (key, value, kind, weight; a state is named by its context).

    Beside its keys and values it has its bits of the table that tells which keys there may be, and the keys of the head.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, value, known, weight = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            cut = bucket_cuts(key[order], wide)
            used = np.flatnonzero(np.diff(cut))
            blobs = [pa.array([by_bytes(x[order[cut[b] : cut[b + 1]]]) for b in used], pa.binary()) for x in (key, value, known, weight)]
            return pa.RecordBatch.from_arrays([pa.array(used), *blobs], names=[x.split()[0] for x in PARTS.split(", ")])

        for part in batches:
            key, kind = part["key"].to_numpy().view(np.uint64), part["kind"].to_numpy()
            weight = np.minimum(part["weight"].to_numpy(), 65535).astype(np.uint16)
            held.append((np.where(kind == STATE, state(key), key), part["value"].to_numpy().astype(np.float64), kind == WORD, weight))
            size += part.num_rows
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        key = many_from_bytes(part["keys"], np.uint64)
        order = np.argsort(key)
        key, value, known = key[order], many_from_bytes(part["values"], np.float64)[order], many_from_bytes(part["known"], bool)[order]
        bits = np.zeros(1 << (MODEL_BITS - wide), bool)
        for place in (key >> np.uint64(64 - MODEL_BITS), key):
            bits[place & np.uint64(len(bits) - 1)] = True
        slot, weight = slots_of(key, slots), many_from_bytes(part["weights"], np.uint16)[order]
        by_slot = np.lexsort((weight, slot))
        best = by_slot[np.append(slot[1:] != slot[:-1], True)] if slots else by_slot[:0]
        blobs = (by_bytes(key), value.tobytes(), known.tobytes(), np.packbits(bits, bitorder="little").tobytes(), key[best].tobytes(), value[best].tobytes())
        return pd.DataFrame([(part["bucket"].iloc[0], *blobs)], columns=[x.split()[0] for x in BUCKET.split(", ")])

    return every.select("key", "value", "kind", "weight").mapInArrow(cut_up, PARTS).groupBy("bucket").applyInPandas(joined, BUCKET)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    ready(docs.sparkSession)
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    table, total, kinds, depth = model(docs.where(~held_out).select(F.col("text").cast("string").alias("text")))
    wide = bucket_bits(total)
    bits = np.zeros((1 << MODEL_BITS) // 8, np.uint8)
    size = len(bits) >> wide
    slots = head_slots(total)
    head = empty_slots(slots), np.zeros(slots)
    for r in table.select("bucket", "bits", "head_keys", "head_values").toLocalIterator():
        bits[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        keys = np.frombuffer(r["head_keys"], np.uint64)
        place = slots_of(keys, slots)
        head[0][place], head[1][place] = keys, np.frombuffer(r["head_values"], np.float64)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((*head, bits))  # kept once by a worker, whatever number of tasks it runs
    del head, bits
    sums = summed_values(rows, table, shared, wide, depth)
    unknown = -float(np.log10(total + kinds + 1))
    base_score = F.col("base") + (F.col("n_tokens") - F.col("n_known")) * F.lit(unknown)
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), (base_score + F.col("extra")).alias("score"),
    )


ASKED = "bucket long, chunk long, keys binary, many binary, docs binary, whole binary"
GIVEN = "chunk long, docs binary, extra binary, word_docs binary, base binary, known binary, whole binary"
WHOLE = np.dtype([("doc_id", np.int64), ("null", bool), ("held_out", bool), ("n_tokens", np.int64), ("base", np.float64), ("known", np.int64), ("extra", np.float64)])


def summed_values(docs: DataFrame, table: DataFrame, shared: Broadcast, wide: int, depth: int) -> DataFrame:
    """Sums of the model's values per document: doc_id, held_out, n_tokens, n_known, base, extra.

    A chunk of documents asks each bucket once for a key, with the documents it occurs in (as numbers in the chunk);
    the bucket's task gives back the sums of each chunk's documents, which are added up by chunk. `shared` has the keys
    and values of the head, and the bit table of all keys.
    """
    inner = np.uint64((1 << (MODEL_BITS - wide)) - 1)

    def in_model(key: np.ndarray) -> np.ndarray:
        bits = shared.value[2]
        may = has_bit(bits, key, MODEL_BITS)
        left = key[may]
        place = (left >> np.uint64(64 - MODEL_BITS)) & ~inner | left & inner
        may[may] = has_bit(bits, place << np.uint64(64 - MODEL_BITS), MODEL_BITS)
        return may

    def looked_up(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are in the head, the values of these, and which other ones may be in the model."""
        keys, value, _ = shared.value
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(0), in_model(key)
        place = slots_of(key, len(keys))
        hit = keys[place] == key
        rest = ~hit
        rest[rest] = in_model(key[rest])
        return hit, value[place[hit]], rest

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 33
        asked, wholes, pairs, many_docs = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            key, doc = (np.concatenate(x) for x in zip(*asked))
            key, times, order, first = _distinct(key)
            doc, times = doc[order], times.astype(np.uint32)
            cut = bucket_cuts(key, wide)
            first = np.append(first, len(doc))
            used = np.flatnonzero(np.diff(cut))
            spread = int(mix(np.array([made], np.uint64))[0]) & ((1 << wide) - 1)
            columns = [
                [*used.tolist(), spread],
                [made] * (len(used) + 1),
                [*[by_bytes(key[cut[b] : cut[b + 1]]) for b in used], None],
                [*[by_bytes(times[cut[b] : cut[b + 1]]) for b in used], None],
                [*[doc[first[cut[b]] : first[cut[b + 1]]].tobytes() for b in used], None],
                [*[None] * len(used), np.concatenate(wholes).tobytes()],
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in ASKED.split(", ")])

        for part in batches:
            many = part.num_rows
            if not many:
                continue
            tokens, starts = _joined(part["text"].to_pylist())
            sizes = np.diff(np.append(starts, len(tokens)))
            text = np.repeat(np.arange(many, dtype=np.uint16), sizes)
            whole = np.zeros(many, WHOLE)

            def take(key: np.ndarray, of: np.ndarray, sums: str) -> np.ndarray:
                hit, found, rest = looked_up(key)
                whole[sums] += np.bincount(of[hit], weights=found, minlength=many)
                asked.append((key[rest], of[rest] + np.uint16(many_docs)))
                if sums == "base":
                    whole["known"] = np.bincount(of[hit], minlength=many)
                return hit | rest

            before = len(asked)
            take(tokens, text, "base")
            at, age = np.arange(len(tokens)), np.arange(len(tokens)) - np.repeat(starts, sizes)
            for k in range(1, depth + 1):
                at = at[age[at] >= k]
                context = context_before(tokens, at, k)
                may = take(state(context), text[at], "extra")  # a longer context is no state where this one is none
                at, context = at[may], context[may]
                take(gram(context, tokens[at]), text[at], "extra")
            pairs += sum(len(key) for key, _ in asked[before:])
            whole["doc_id"] = part["doc_id"].fill_null(0).to_numpy()
            whole["null"] = part["doc_id"].is_null().to_numpy(zero_copy_only=False)
            whole["held_out"] = part["held_out"].to_numpy(zero_copy_only=False)
            whole["n_tokens"] = sizes
            wholes.append(whole)
            many_docs += many
            if pairs > CHUNK_PAIRS or many_docs > CHUNK_DOCS:
                yield flush()
                asked, wholes, pairs, many_docs, made = [], [], 0, 0, made + 1
        if wholes:
            yield flush()

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["chunk"].isna()]
        have, worth, words = from_bytes(b"".join(own["keys"]), np.uint64), _numbers(own["many"], np.float64), _numbers(own["docs"], bool)
        out = []
        for r in part[part["chunk"].notna()].itertuples(index=False):
            if r.whole is not None:
                out.append((r.chunk, None, None, None, None, None, r.whole))
                continue
            key = from_bytes(r.keys, np.uint64)
            place = np.minimum(np.searchsorted(have, key), max(0, len(have) - 1))
            hit = have[place] == key if len(have) else np.zeros(len(key), bool)
            times, doc = from_bytes(r.many, np.uint32), np.frombuffer(r.docs, np.uint16)
            of = np.repeat(np.where(hit, place, -1), times)
            got = []
            for wordy in (False, True):
                mine = (of >= 0) & (words[of] == wordy) if len(have) else np.zeros(len(of), bool)
                seen = np.bincount(doc[mine])
                used = np.flatnonzero(seen)
                got += [used.astype(np.uint16).tobytes(), np.bincount(doc[mine], weights=worth[of[mine]])[used].tobytes()]
            out.append((r.chunk, *got, seen[used].astype(np.uint32).tobytes(), None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in GIVEN.split(", ")])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        whole = np.frombuffer(part["whole"].dropna().iloc[0], WHOLE).copy()
        for r in part[part["whole"].isna()].itertuples(index=False):
            whole["extra"][np.frombuffer(r.docs, np.uint16)] += np.frombuffer(r.extra, np.float64)
            words = np.frombuffer(r.word_docs, np.uint16)
            whole["base"][words] += np.frombuffer(r.base, np.float64)
            whole["known"][words] += np.frombuffer(r.known, np.uint32)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(whole["doc_id"]).astype("Int64").mask(whole["null"]), "held_out": whole["held_out"], "n_tokens": whole["n_tokens"],
                "n_known": whole["known"], "base": whole["base"], "extra": whole["extra"],
            }
        )

    mine = table.select("bucket", F.lit(None).cast("long").alias("chunk"), "keys", F.col("values").alias("many"), F.col("known").alias("docs"), F.lit(None).cast("binary").alias("whole"))
    given = docs.mapInArrow(ask, ASKED).unionByName(mine).groupBy("bucket").applyInPandas(answer, GIVEN)
    return given.groupBy("chunk").applyInPandas(add, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, extra double")
