from __future__ import annotations

import pathlib

import pytest

from cases import no_documents, odd_documents, prose
from sessionmeter.llm import license_scan

FILES = "path string, text string, licence string, term string, row long"


def files(spark, rows):
    return spark.createDataFrame([(p, t, "x", "y", 1) for p, t in rows], FILES)


APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This program is licensed under the GNU General Public License, version 3."


def test_inheritance(spark):
    rows = [
        ("a/LICENSE", APACHE), ("a/x.txt", prose(1, 50)), ("a/b/y.txt", prose(2, 50)), ("a/b/c/LICENSE", GPL), ("a/b/c/z.txt", prose(3, 50)),
        ("a/b/c/d/z.txt", prose(4, 50)), ("e/own.txt", prose(5, 400) + "\n" + GPL), ("e/other.txt", prose(6, 40)), (None, prose(7, 40)), (None, APACHE),
        ("top.txt", None), ("a/null.txt", None), ("a/x.txt", prose(1, 50)),
    ]
    got = [(r.path, r.own_licence, r.licence, r.licence_from) for r in license_scan.scan(files(spark, rows)).collect()]
    want = [
        ("a/LICENSE", "Apache-2.0", "Apache-2.0", None), ("a/x.txt", None, "Apache-2.0", "a"), ("a/b/y.txt", None, "Apache-2.0", "a"),
        ("a/b/c/LICENSE", "GPL-3.0", "GPL-3.0", None), ("a/b/c/z.txt", None, "GPL-3.0", "a/b/c"), ("a/b/c/d/z.txt", None, "GPL-3.0", "a/b/c"),
        ("e/own.txt", "GPL-3.0", "GPL-3.0", None), ("e/other.txt", None, None, None), (None, None, None, None), (None, "Apache-2.0", "Apache-2.0", None),
        ("top.txt", None, None, None), ("a/null.txt", None, "Apache-2.0", "a"), ("a/x.txt", None, "Apache-2.0", "a"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_anchors_lose_no_line(spark):
    lines = [t for _, t in license_scan.TEMPLATES] + ["licensed under the version", "the general public", "under the mit", "apache", "work is licensed under cc by", "the use of this source"]
    rows = files(spark, [(f"f{i}", x) for i, x in enumerate(lines)])
    anchored = [(r.path, r.own_licence, r.cosine) for r in license_scan.own_licences(rows).orderBy("path").collect()]
    all_terms = license_scan.anchors
    try:
        license_scan.anchors = lambda rows_, weight, least: sorted(weight)
        assert [(r.path, r.own_licence, r.cosine) for r in license_scan.own_licences(rows).orderBy("path").collect()] == anchored
    finally:
        license_scan.anchors = all_terms
    assert sum(x[1] is not None for x in anchored) >= len(license_scan.TEMPLATES)


def wrapped(text, width=60):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


def test_complete_licences_and_headers(spark):
    texts = [(n, t) for n, t in license_scan.TEXTS if len(t) > 600]
    rows, want = [(f"p{i}.txt", prose(i, 60)) for i in range(200)], {f"p{i}.txt": None for i in range(200)}
    for i, (name, text) in enumerate(texts):
        # a long licence is more than its template: other words of its own come with it, and no title
        rows += [(f"d{i}/COPYING", "Copyright 2020 Some Body\n\n" + wrapped(text) + "\n\n" + wrapped(prose(i, 25))), (f"d{i}/x.txt", prose(i, 50))]
        want |= {f"d{i}/COPYING": name, f"d{i}/x.txt": name}
    gpl = next(t for n, t in license_scan.TEXTS if n == "GPL-3.0" and t.startswith("This program"))
    header = "\n".join("# " + x for x in wrapped(gpl, 50).split("\n"))
    rows += [("h/a.py", header + "\n\n" + prose(7, 900)), ("h/b.py", prose(8, 50)), ("m/a.py", "x\n" + prose(9, 40) + "\n\n" + wrapped(texts[-1][1], 30))]
    want |= {"h/a.py": "GPL-3.0", "h/b.py": None, "m/a.py": "MPL-2.0"}
    got = {r.path: r.licence for r in license_scan.scan(files(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("BSD", "BSD-3-Clause")])
def test_full_texts(spark, file, name):
    path = pathlib.Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no licence texts on this machine")
    full = path.read_text(errors="replace")
    title_off = full.split("\n\n", 1)[1]
    rows = [("a/LICENSE", full), ("a/b/x.txt", prose(1, 80)), ("c/LICENSE", title_off), ("c/y.txt", prose(2, 80)), ("z.txt", prose(3, 80))]
    got = {r.path: r.licence for r in license_scan.scan(files(spark, rows)).collect()}
    assert got == {"a/LICENSE": name, "a/b/x.txt": name, "c/LICENSE": name, "c/y.txt": name, "z.txt": None}


def test_odd(spark):
    docs = odd_documents(spark)
    assert license_scan.document_licences(docs).count() == docs.count()
    assert license_scan.document_licences(no_documents(spark)).count() == 0


def test_no_python_on_executors(spark):
    plan = license_scan.document_licences(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
