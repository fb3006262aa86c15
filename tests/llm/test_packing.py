from __future__ import annotations

import zlib

import numpy as np
import pytest

from cases import no_documents, odd_documents
from sessionmeter.llm import packing
from sessionmeter.llm.base import table


def check(docs, pieces):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_bpe())
    want: dict = {}
    for r in docs.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
    rows = pieces.collect()
    lengths: dict = {}
    at: dict = {}
    for r in rows:
        options = [ids for ids in want[r.doc_id] if len(ids) == r.doc_tokens]
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in options)
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == {d: sum(map(len, ids)) for d, ids in want.items()}
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 4096 and end & (end - 1) == 0  # no padding
    return at


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    at = check(docs, packing.pack(docs))
    full = sum(sum(n for _, n in parts) == 4096 for parts in at.values())
    assert full >= 0.9 * len(at)


def test_odd(spark):
    check(odd_documents(spark), packing.pack(odd_documents(spark)))
    assert packing.pack(no_documents(spark)).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b", "don't 'll é é x y\x1cz", "Aİ ß 12345 !!??", "́ a", "\x85a\x0bb"])
def test_word_by_word_equals_whole_text(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.word_bpe()).encode(text, add_special_tokens=False).ids
    assert packing.Encoder(packing.word_bpe()).many([text])[0].tolist() == [*whole, 2]


def test_python_takes_a_step_per_distinct_word_only(monkeypatch):
    encoder = packing.Encoder(packing.word_bpe())
    odd = [None, "", " \n", "a", "a a  b\x0b", "\ud800 x", "Z\u00e9 z\u00e9, a", None]
    want = [x.tolist() for x in encoder._one_by_one(odd)]
    monkeypatch.setattr(packing.Encoder, "_one_by_one", lambda *_: pytest.fail("word by word"))
    assert [x.tolist() for x in encoder.many(odd)] == want
    assert encoder.many([]) == []


def test_words_of_one_hash_keep_their_own_ids(monkeypatch):
    texts = ["one two", "three one", None]
    want = [x.tolist() for x in packing.Encoder(packing.word_bpe()).many(texts)]
    monkeypatch.setattr(packing, "word_hashes", lambda data: (np.zeros(len(data.split()), np.uint64), None))
    assert [x.tolist() for x in packing.Encoder(packing.word_bpe()).many(texts)] == want


def test_neighbours_are_bm25_order():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 60, rng.integers(5, 50)).astype(np.uint16) for _ in range(30)]
    idf = rng.random(packing.VOCABULARY).astype(np.float32)
    mean = np.mean([len(d) for d in docs])
    unused = np.ones(30, bool)
    unused[[3, 7]] = False

    def score(seed, d):
        return sum(
            float(idf[t]) * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
            for t in set(seed.tolist()) if (n := int((d == t).sum()))
        )

    got = packing.Shard(docs, idf).neighbours(3, unused)
    scores = [score(docs[3], docs[i]) for i in got]
    assert set(got.tolist()) == set(range(30)) - {3, 7} and all(a >= b - 1e-5 for a, b in zip(scores, scores[1:]))


def test_ids_and_min_hashes_of_many_texts_at_once():
    from sessionmeter.llm.base import mix

    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 1 << 16, n).astype(np.uint16) for n in (1, 700, 3)] + [np.array([2, 2, 65535], np.uint16)]
    own, first = packing.distinct_ids(texts)
    assert [x.tolist() for x in np.split(own, first[1:])] == [np.unique(t).tolist() for t in texts]
    for t, place in zip(texts, packing.min_hashes(own, first).tolist()):
        h = mix(np.unique(t).astype(np.uint64) + np.uint64(1))
        assert place == (int(h.min()) >> 33 << 31) | int((h * np.uint64(0x9E3779B97F4A7C15)).min()) >> 33
    assert len(packing.distinct_ids([])[0]) == 0 and len(packing.min_hashes(*packing.distinct_ids([]))) == 0
