"""Quality and toxicity: held-out accuracy, odd rows, and the formulas against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from cases import documents, no_documents, odd_documents, prose
from sessionmeter.llm import quality_fm, toxicity
from sessionmeter.llm.base import fold_of, table

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, text string, score double"


def held_out(rows, labels, label):
    known = {r.doc_id: r[label] for r in labels.collect()}
    return [(r.score, r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality_fm.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (fold_of(r.doc_id, 3) == 1) for r in rows)
    got = held_out(rows, labels, "quality")
    assert np.mean([p == y for _, p, y in got]) > 0.97
    assert np.mean([p for _, p, y in got if y == 1]) > 0.99


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    got = held_out(rows, labels, "toxic")
    assert np.mean([p for _, p, y in got if y == 1]) > 0.75
    assert np.mean([p for _, p, y in got if y == 0]) < 0.02


def test_pair_term_equals_the_double_sum():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SLOTS), rng.normal(size=(quality_fm.SLOTS, quality_fm.RANK)))
    slots, x = rng.choice(quality_fm.SLOTS, 20, replace=False), rng.random(20)
    want = 0.3 + sum(m.linear[s] * v for s, v in zip(slots, x))
    want += sum(m.factors[slots[i]] @ m.factors[slots[j]] * x[i] * x[j] for i in range(20) for j in range(i))
    assert np.isclose(m.margin(slots, x), want)


def test_the_machine_learns_a_pair():
    """Two words are good together and bad alone: no linear model can tell."""
    pairs = [([1, 2], 1), ([1, 3], 0), ([4, 2], 0), ([4, 3], 1)] * 60
    rows = [(np.array(s, np.int32), np.ones(2, np.float32)) for s, _ in pairs]
    m = quality_fm.fit(rows, np.array([y for _, y in pairs], float), epochs=60)
    assert all((m.margin(s, x) > 0) == y for (s, x), (_, y) in zip(rows, pairs))


@pytest.mark.parametrize("module,label", [(quality_fm, "quality"), (toxicity, "toxic")])
def test_odd(spark, module, label):
    docs = odd_documents(spark)
    some = [(i, 1 - i % 2, i % 2, "x", 1.0) for i in range(12) if fold_of(i, 3) != 1]
    odd_labels = [*some, (None, 1, 1, "x", 1.0), (5, None, None, "x", 1.0), (6, 0, 0, "x", 1.0), (6, 1, 1, "x", 1.0), (99, 7, 7, "x", 1.0)]
    rows = module.scores(docs, spark.createDataFrame(odd_labels, LABELS)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    nothing = spark.createDataFrame([], LABELS)
    assert {r.score for r in module.scores(docs, nothing).collect()} == {0.5}
    assert module.scores(no_documents(spark), nothing).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    from pyspark.sql import functions as F

    from sessionmeter.llm.base import fold

    turned = labels.withColumn("quality", F.when(fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    turned = turned.withColumn("toxic", F.when(fold("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for module in (quality_fm, toxicity):
        assert sorted(module.scores(docs, labels).collect()) == sorted(module.scores(docs, turned).collect())


def test_compression_distance_tells_trained_words():
    texts = [f"{prose(i, 60)} {'zorgblat vexquim' if i % 2 else ''} {prose(900 + i, 20)}" for i in range(120)]
    d = toxicity.fit(texts, np.array([i % 2 for i in range(120)], float))
    distance = d.distance()
    assert distance.of([b"zorgblat"])[0] > distance.of([b"tioning"])[0]
    assert d.score(distance, toxicity.windows(texts[1])) > 0.7 > d.score(distance, toxicity.windows(texts[0]))


def test_few_toxic_texts_are_enough_to_learn_from(spark):
    """At a tenth of the size, with some tens of toxic texts, insults are still found; no size gives one score to all."""
    for name in ("sf0.001", "sf0.01"):
        docs, labels = (table(spark, f"/root/testdata/{name}", t) for t in ("documents", "labels"))
        rows = toxicity.scores(docs, labels).collect()
        assert len({r.score for r in rows}) > 1
        if name == "sf0.01":
            got = held_out(rows, labels, "toxic")
            assert np.mean([p for _, p, y in got if y == 1]) > 0.3
            assert np.mean([p for _, p, y in got if y == 0]) < 0.02


def test_a_text_without_room_shuts_out_no_other(spark):
    """However long a labelled text is, the shorter ones of its class are learnt from."""
    texts = {i: f"{prose(i, 60)} {'zorgblat vexquim' if i % 2 else ''} {prose(900 + i, 20)}" for i in range(160)}
    texts |= {i: prose(i, 30) * 400 for i in range(200, 220)}
    docs = documents(spark, list(texts.items()))
    labels = spark.createDataFrame([(i, 1, i % 2 if i < 200 else 1, "x", 1.0) for i in texts if fold_of(i, 3) != 1], LABELS)
    d = toxicity.train(docs, labels, most=30_000)
    distance = d.distance()
    assert d.score(distance, toxicity.windows(texts[1])) > 0.7 > d.score(distance, toxicity.windows(texts[0]))
