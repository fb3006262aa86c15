from __future__ import annotations

import re

import pytest

from cases import no_documents, odd_documents, prose
from sessionmeter.llm import line_rules
from sessionmeter.llm.base import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in line_rules.verdicts(docs).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(d.text)
        assert not (r.base_failed and r.kept)


def test_clean_documents_stay(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = line_rules.verdicts(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


@pytest.mark.parametrize("line,rule", [
    ("A plain sentence of some words stands here.", ""), ("Title", ""), ("home | news | about | contact", "navigation"), ("BUY NOW OR CRY", "shouting"),
    ("We use cookies on this site.", "boilerplate"), ("one two three four five six seven eight nine", "punctuation"), ("a# b$ c% d& e", "symbols"),
    ("Inicio › Blog › Año › Más", "navigation"),
])
def test_rules(line, rule):
    removed = line_rules.clean(line + "\n" + prose(1, 60))[6]
    assert {k for k, n in removed.items() if n} == ({rule} if rule else set())


def test_cleaned_text_and_loss():
    body = "\n".join(prose(i, 30) for i in range(3))
    cleaned, *_, keep = line_rules.clean(f"home | news | about | us\n{body}\n\n{prose(0, 30)}")
    assert cleaned == body + "\n" and keep
    assert not line_rules.clean(body + "\n" + "\n".join(["MENU AND MORE"] * 60))[-1]


def test_odd(spark):
    docs = odd_documents(spark)
    rows = line_rules.verdicts(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False)
    assert line_rules.verdicts(no_documents(spark)).count() == 0
    report = line_rules.with_line_report(docs)
    assert report.columns == [*docs.columns, "line_report"]
