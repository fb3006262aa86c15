"""The pipeline against a plain version made of its stages' single-text functions."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from cases import no_documents, odd_documents
from sessionmeter.llm import decontaminate, packing, pii_crf, quality_fm
from sessionmeter.llm.base import sigmoid, table
from test_ngram_join import brute as groups_of

SF = "/root/testdata/sf0.01"


def test_run(spark):
    docs, labels, bench = (table(spark, SF, n) for n in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    machine, features = quality_fm.train(docs, labels), quality_fm.Features()
    good = {d: t for d, (t, n) in texts.items() if sigmoid(machine.margin(*features.of(t, n))) >= 0.5}
    single = {g for _, g, _ in groups_of(good).values()}
    ix = decontaminate.index([(r.item_id, r.text) for r in bench.collect()])
    clean = [d for d in sorted(single) if not decontaminate.leaks([good[d]], ix, ix.bitmap())[0]]
    encoder, weights = packing.Encoder(packing.word_bpe()), None
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(clean) and 0 < len(clean) < len(texts)
    lengths = {d: sum(r.length for r in rows if r.doc_id == d) for d in clean}
    for d in clean:
        found = pii_crf.matches(good[d])
        if not found:
            assert lengths[d] == len(encoder.many([good[d]])[0])
    assert weights is None and all(r.doc_tokens == lengths[r.doc_id] for r in rows)


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, SF, "documents").withColumnRenamed("lang", "_id")
    known = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name == "quality":
            left = {r.doc_id for r in out.collect()}
            good = [r.doc_id in left for r in docs.collect() if known.get(r.doc_id) == 1]
            assert np.mean(good) > 0.99


def test_odd(spark):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd_documents(spark), SF).collect()
        assert stage(spark, no_documents(spark), SF).count() == 0, name
