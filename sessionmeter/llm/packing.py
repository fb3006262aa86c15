"""Packing by lexical retrieval: each window is a seed document and its BM25 neighbours.

1. Documents become token ids and an end id. Whole windows of a long document are sequences of their own; what
   remains of each document goes on to be packed. Token counts per document are summed over the whole corpus.
2. Remainders are dealt out by range of a MinHash of their tokens (a random second key splits any hot range), so that
   alike documents come to lie side by side, and cut into index shards of at most `SHARD_DOCS` documents.
3. Each shard gets an inverted index. A seed asks it for the unused documents in order of BM25, with the idf of the
   whole corpus, and they fill its window greedily; the last one is cut to fit, and its rest seeds the next window.

So all sequences are full but the last of each task, which is cut into powers of two: no padding at all. Shards
pass their open window on, and a task holds one shard at a time. Null and empty texts are documents of the end id
alone. Rows equal in id are documents of their own; other columns are not read.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from math import ceil
from types import ModuleType
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import byte_words, mix, ready, word_hashes, word_spans
from sessionmeter.llm.graph import stored

WINDOW = 4096
END = 2
_END = END.to_bytes(2, "little")
TASK_TOKENS = 4_000_000
SHARD_DOCS, SHARD_TOKENS = 512, 1_500_000
K1, B = 1.2, 0.75
BATCH_CHARS = 1_000_000
VOCABULARY = 1 << 16  # ids are kept in 16 bits

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts, as 16-bit numbers.

    The tokenizer's pieces never reach across white space, so the ids of a text are those of its words; these are
    remembered, up to a bounded number of words. A word of Latin letters with marks behind it is two pieces, which are
    remembered for all words they occur in and go to the tokenizer's model directly.
    """

    MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer, self._known, self._pieces, self._most = Tokenizer.from_file(path), {}, {}, most
        if self._tokenizer.get_vocab_size() > VOCABULARY:
            raise ValueError("the vocabulary does not fit 16 bits")
        self._marks: dict[bytes, bytes] = {}
        self._two = [i.to_bytes(2, sys.byteorder) for i in range(self._tokenizer.get_vocab_size())]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._latin = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x250)}

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Python takes one step per distinct word of the texts, numpy all others."""
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        data = b"\n".join(parts)
        begins, ends = word_spans(data)
        hashes, _ = word_hashes(data)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not _same_bytes(np.frombuffer(data, np.uint8), begins, ends - begins, first[which]):
            return self._one_by_one(texts)  # two words with one hash
        words = [data[b:e] for b, e in zip(begins[first].tolist(), ends[first].tolist())]
        pieces = [*map(self._known.get, words), _END]
        missing = [i for i, p in enumerate(pieces) if p is None]
        if missing:
            self._learn([words[i] for i in missing])
            for i in missing:
                pieces[i] = self._known[words[i]]
        pool = np.frombuffer(b"".join(pieces), np.uint16)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
        starts = np.cumsum(sizes) - sizes
        # the words of all texts one after another, an end behind those of each
        last = np.searchsorted(begins, np.cumsum([len(p) + 1 for p in parts])) + np.arange(len(parts))
        order = np.full(len(which) + len(parts), len(words))
        is_word = np.ones(len(order), bool)
        is_word[last] = False
        order[is_word] = which
        many = sizes[order]
        stops = np.cumsum(many)
        ids = pool[np.repeat(starts[order] - stops + many, many) + np.arange(many.sum())]
        return np.split(ids, stops[last[:-1]]) if parts else []

    def _one_by_one(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [byte_words(t) for t in texts]
        distinct = set().union(*cut)
        self._learn(distinct)
        known = {w: self._known[w] for w in distinct}  # small enough for the processor's cache
        return [np.frombuffer(b"".join(map(known.__getitem__, words)) + _END, np.uint16) for words in cut]

    def _learn(self, words: Iterable[bytes]) -> None:
        known, pieces = self._known, self._pieces
        if len(known) > self._most:
            known.clear()
        if len(pieces) > self._most:
            pieces.clear()
        new = [w for w in words if w not in known]
        if not new:
            return
        lows = b"\n".join(new).lower().split(b"\n")
        marks, tokenize = self.MARKS, self._tokenizer.model.tokenize
        for word, low in zip(new, lows):
            core = low.rstrip(marks)
            piece = pieces.get(core, 0)
            if piece == 0:
                if core.isalpha():  # letters of ASCII only
                    piece = self._bytes_of(tokenize(core.decode()))
                else:
                    piece = self._letters(core)
                pieces[core] = piece
            if piece is None:
                known[word] = self._whole(word)
            elif len(core) == len(low):
                known[word] = piece
            else:
                known[word] = piece + self._whole(low[len(core) :])

    def _whole(self, word: bytes) -> bytes:
        """Ids of any other word; those of marks are remembered."""
        got = self._marks.get(word)
        if got is None:
            got = array("H", self._tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
            if len(self._marks) < 10_000:
                self._marks[word] = got
        return got

    def _letters(self, core: bytes) -> bytes | None:
        """Ids of a run of Latin letters; None for anything else."""
        if not core.isalpha():
            if not core:
                return b""
            letters = core.decode()
            low = letters.lower()
            if not low.isalpha() or max(low) >= "\u0250" or not is_normalized("NFC", letters):
                return None
            core = low.translate(self._latin)
        else:
            core = core.decode()
        return self._bytes_of(self._tokenizer.model.tokenize(core))

    def _bytes_of(self, tokens: list) -> bytes:
        two = self._two
        return two[tokens[0].id] if len(tokens) == 1 else b"".join([two[t.id] for t in tokens])


def _same_bytes(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the bytes of the word that `other` names for it."""
    if not np.array_equal(sizes, sizes[other]):
        return False
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.array_equal(raw[inside + np.repeat(begins, sizes)], raw[inside + np.repeat(begins[other], sizes)])


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker; its tasks come one after another and share what it remembers."""
    held = sys.modules.setdefault("sessionmeter_encoders", ModuleType("sessionmeter_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def distinct_ids(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of each text (none is empty), one text after another, and where those of each text begin."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.sort((np.repeat(np.arange(len(texts)), [len(t) for t in texts]) << 16) | np.concatenate(texts))
    key = key[np.append(True, key[1:] != key[:-1])]
    return key & (VOCABULARY - 1), np.searchsorted(key >> 16, np.arange(len(texts)))


def min_hashes(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two MinHashes of each text's distinct ids, in one number."""
    if not len(first):
        return np.zeros(0, np.int64)
    h = mix(own.astype(np.uint64) + np.uint64(1))
    low = [np.minimum.reduceat(x, first) >> np.uint64(33) for x in (h, h * np.uint64(0x9E3779B97F4A7C15))]
    return ((low[0] << np.uint64(31)) | low[1]).astype(np.int64)


def _larger(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """Ids and texts of batches put together up to some `BATCH_CHARS` characters: fewer words are distinct in them."""
    doc_ids, texts, size = [], [], 0
    for part in batches:
        doc_ids += list(part["doc_id"])
        texts += list(part["text"])
        size += sum(len(t) for t in part["text"] if t)
        if size > BATCH_CHARS or len(texts) > BATCH_CHARS // 256:
            yield doc_ids, texts
            doc_ids, texts, size = [], [], 0
    if texts:
        yield doc_ids, texts


TOKENS = PIECE + ", rest binary, place long, counts binary"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Rows of three kinds, stored: whole windows (with sequence_id), remainders (rest, place), counts of a task."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task, made = worker_encoder(path), _task(), 0
        frequency, total = np.zeros(VOCABULARY, np.int64), 0
        for doc_ids, given in _larger(batches):
            out, texts = [], encoder.many(given)
            own, first = distinct_ids(texts)
            frequency += np.bincount(own, minlength=VOCABULARY)
            total += len(texts)
            places = min_hashes(own, first).tolist()
            for doc_id, ids, place in zip(doc_ids, texts, places):
                n = len(ids)
                whole = n // WINDOW * WINDOW
                for s in range(0, whole, WINDOW):
                    out.append((doc_id, s, WINDOW, crc(ids[s : s + WINDOW]), n, 2 * ((task << 33) | made) + 1, 0, None, None, None))
                    made += 1
                if whole < n:
                    out.append((doc_id, whole, n - whole, None, n, None, None, ids[whole:].tobytes(), place, None))
            yield _frame(out)
        if total:
            yield _frame([(None, None, total, None, None, None, None, None, None, frequency.tobytes())])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(encode, TOKENS), "tokens")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in TOKENS.split(", ")])
    whole = [x.split()[0] for x in TOKENS.split(", ") if x.endswith(" long")]
    return frame.astype(dict.fromkeys(whole, "Int64"))


def corpus_counts(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each token, and documents; at most as many rows reach the driver as there are tokens."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, total = np.zeros(VOCABULARY, np.int64), 0
        for part in batches:
            for c, n in zip(part["counts"], part["length"]):
                sums += np.frombuffer(c, np.int64)
                total += n
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"token": np.append(used, -1), "n": np.append(sums[used], total)})

    got = tokens.where("counts is not null").select("counts", "length").mapInPandas(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(VOCABULARY, np.int64), 0
    for r in got:
        if r["token"] < 0:
            total = r["n"]
        else:
            out[r["token"]] = r["n"]
    return out, total


class Shard:
    """A BM25 index of some documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray):
        self.size = len(docs)
        lengths = np.array([len(d) for d in docs])
        key = np.sort((np.repeat(np.arange(self.size), lengths) << 16) | np.concatenate(docs))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key))).astype(float)
        token, doc = key[first] & (VOCABULARY - 1), key[first] >> 16
        self._terms = np.split(token, np.searchsorted(doc, np.arange(1, self.size)))
        lengths = lengths.astype(float)
        weight = idf[token] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[doc] / lengths.mean()))
        order = np.argsort(token, kind="stable")
        self._doc, self._weight = doc[order], weight[order]
        self._starts = np.searchsorted(token[order], np.arange(VOCABULARY + 1))

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents, best score first; equal ones in their order."""
        terms = self._terms[doc]
        low, many = self._starts[terms], self._starts[terms + 1] - self._starts[terms]
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        scores = np.bincount(self._doc[at], weights=self._weight[at], minlength=self.size)
        left = np.flatnonzero(unused)
        return left[np.argsort(-scores[left], kind="stable")]


class Packer:
    """Fills windows; an open one goes from shard to shard."""

    def __init__(self, task: int, idf: np.ndarray):
        self._task, self._idf, self._made = task, idf, 0
        self._open: list[tuple] = []
        self._room = WINDOW

    def shard(self, docs: list[tuple]) -> list[tuple]:
        """Pieces of the windows that got full. A document: (doc_id, start, doc_tokens, ids)."""
        ix = Shard([d[3] for d in docs], self._idf)
        unused, done, out, first = np.ones(len(docs), bool), np.zeros(len(docs), int), [], 0
        seed = None
        while True:
            if seed is None:
                while first < len(docs) and not unused[first]:
                    first += 1
                if first == len(docs):
                    return out
                seed = first
            unused[seed] = False
            turn, order = seed, None
            seed = None
            while turn is not None:
                doc_id, start, n, ids = docs[turn]
                took = ids[done[turn] : done[turn] + self._room]
                self._open.append((doc_id, start + int(done[turn]), n, took))
                self._room -= len(took)
                done[turn] += len(took)
                if done[turn] < len(ids):
                    seed = turn
                if not self._room:
                    out += self._close(WINDOW)
                    break
                if order is None:
                    order = iter(ix.neighbours(turn, unused))
                turn = next((int(t) for t in order if unused[t]), None)
                if turn is not None:
                    unused[turn] = False

    def _close(self, size: int) -> list[tuple]:
        """A sequence of the first `size` tokens of the open window."""
        out, rest, offset = [], [], 0
        name = 2 * ((self._task << 33) | self._made)
        self._made += 1
        for doc_id, start, n, ids in self._open:
            took = ids[: max(0, size - offset)]
            if len(took):
                out.append((doc_id, start, len(took), crc(took), n, name, offset))
                offset += len(took)
            if len(took) < len(ids):
                rest.append((doc_id, start + len(took), n, ids[len(took) :]))
        self._open, self._room = rest, self._room if rest else WINDOW
        return out

    def finish(self) -> list[tuple]:
        """What is left, in sequences of falling powers of two."""
        out = []
        while self._open:
            left = sum(len(p[3]) for p in self._open)
            out += self._close(1 << (left.bit_length() - 1))
        return out


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ready(docs.sparkSession)
    tokens = tokenised(docs, tokenizer or word_bpe())
    frequency, total = corpus_counts(tokens)
    idf = np.log1p((total - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    left = tokens.where("rest is not null")
    size = left.agg(F.sum("length")).first()[0] or 0
    dealt = left.select("doc_id", "start", "doc_tokens", "rest", "place", F.xxhash64("doc_id", "start").alias("salt")).repartitionByRange(
        max(1, ceil(size / TASK_TOKENS)), "place", "salt"
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        packer, waiting, size_ = Packer(_task(), idf), [], 0
        for part in batches:
            for r in part.itertuples(index=False):
                ids = np.frombuffer(r.rest, np.uint16)
                waiting.append((r.doc_id, int(r.start), int(r.doc_tokens), ids))
                size_ += len(ids)
                if len(waiting) >= SHARD_DOCS or size_ >= SHARD_TOKENS:
                    yield pd.DataFrame(packer.shard(waiting), columns=names).astype({"doc_id": "Int64"})
                    waiting, size_ = [], 0
        last = (packer.shard(waiting) if waiting else []) + packer.finish()
        yield pd.DataFrame(last, columns=names).astype({"doc_id": "Int64"})

    packed = dealt.sortWithinPartitions("place", "salt", "doc_id", "start", "rest").select("doc_id", "start", "doc_tokens", "rest").mapInPandas(fill, PIECE)
    names = [x.split()[0] for x in PIECE.split(", ")]
    return tokens.where("sequence_id is not null").select(*names).unionByName(packed)
