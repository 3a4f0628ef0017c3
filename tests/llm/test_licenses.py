import os
import re
import textwrap

import pytest

from storygauge.llm import licenses
from storygauge.llm.license_texts import LICENSES, SPELLINGS


def words(text):
    kept = "\n".join(x for x in text.split("\n") if not re.match(r"(?i)[^\w\n]*(\(c\)|copyright|©)", x))
    usual = dict(SPELLINGS)
    return " ".join(usual.get(w, w) for w in re.findall(r"[^\W_]+", kept.lower())).split()


@pytest.fixture(scope="module")
def variants(spark, messy):
    mit, bsd = LICENSES[0][2], next(t for n, _, t in LICENSES if n == "BSD-2-Clause")
    rows = [
        (1, "Copyright (c) 2020 Jo\n\n" + mit), (2, "MIT Licence\n\n  * Copyright 1999, 2001 X\n (C) Y\n" + mit.upper().replace("\n", "\r\n   ")),
        (3, mit.replace("Permission", "Permissions")), (4, bsd.replace('"', "''").replace(".", " ")), (5, mit + "\n\n" + bsd),
        (6, "some text\nReleased under the MIT Licence\nmore\nLICENSED UNDER CC BY-NC 4.0!"), (7, None), (8, ""), (9, "Copyright 2020"),
        (10, "it is Released under the MIT License."), (11, mit), (11, mit),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_entire_texts_and_lines(variants):
    found = {r.doc_id: (r.license, r.notices) for r in licenses.scan(variants).collect()}
    assert {i for i, (name, _) in found.items() if name == "MIT"} == {1, 2, 11}
    assert found[4][0] == "BSD-2-Clause" and found[5][0] is None and found[10] == (None, "")
    assert found[6] == (None, "CC-BY-NC-4.0,MIT") and all(found[i] == (None, "") for i in (3, 7, 8, 9))


def test_digests_equal_where_words_do(variants, small):
    for docs in (variants, small):
        rows = licenses.scan(docs).select("doc_id", "digest").collect()
        text = {r.doc_id: r.text for r in docs.collect()}
        by_digest, by_words = {}, {}
        for r in rows:
            by_digest.setdefault(r.digest, set()).add(r.doc_id)
            by_words.setdefault(tuple(words(text[r.doc_id] or "")), set()).add(r.doc_id)
        assert sorted(map(sorted, by_digest.values())) == sorted(map(sorted, by_words.values()))


def test_own_table(spark, small):
    first = small.orderBy("doc_id").first()
    known = spark.createDataFrame([("own", first.text), ("b", "x y"), ("a", "X, y")], "license string, text string")
    found = licenses.scan(small, known).filter("license is not null").collect()
    assert first.doc_id in {r.doc_id for r in found} and {r.license for r in found} == {"own"}
    assert [r.license for r in licenses.digests(known).orderBy("license").collect()] == ["a", "own"]


def test_messy_and_empty(messy, nothing):
    assert licenses.scan(messy).count() == messy.count() and licenses.scan(nothing).count() == 0


def test_wrapping_does_not_matter(spark, messy):
    import textwrap

    texts, rows = {n: t for n, title, t in LICENSES}, []
    for name, text in texts.items():
        for width in (20, 33, 47, 60, 72, 80, 100, 10 ** 6):
            paragraphs = [textwrap.fill(p, width) for p in text.split("\n\n")]
            head = "Copyright (c) 2020, 2021 Jo 🙂 Doe and others"
            rows += [(name, "\n\n".join(paragraphs)), (name, "\n\n".join([head, *paragraphs])), (name, "\r\n".join(paragraphs)),
                     (name, textwrap.fill(f"{head}. {text}", width))]
    mit = texts["MIT"]
    rows += [("MIT", mit.replace("AUTHORS OR\nCOPYRIGHT", "AUTHORS OR COPYRIGHT")), ("MIT", "The MIT License (MIT) © Jo " + " ".join(mit.split()))]
    rows += [(None, "Some words on copyright ahead.\n\n" + " ".join(mit.split())), (None, " ".join(mit.split()) + " And more."),
             (None, " ".join(mit.replace("COPYRIGHT HOLDERS", "").split()))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    assert [(rows[i], found[i]) for i in found if found[i] != rows[i][0]] == []


PUBLISHED = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(PUBLISHED), reason="needs the published texts")
def test_long_licences_are_known_however_they_are_wrapped(spark, tmp_path):
    import duckdb

    from compare import difference
    from storygauge.llm.oracle import ORACLES

    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows, expected = [], {}
    for name, file in files.items():
        text = open(f"{PUBLISHED}/{file}", encoding="utf-8").read()
        flat = " ".join(text.split())
        forms = [text, flat, "\n".join(textwrap.wrap(flat, 50)), "\n".join(textwrap.wrap(flat, 97)).upper(), re.sub(r"\bLicense\b", "Licence", text)]
        for form in [*forms, text[:-400], text + "\nand one more sentence"]:
            expected[len(rows)] = name if form in forms else None
            rows.append((len(rows), form))
    rows += [(len(rows), "a clean text on gnu and apache cattle"), (len(rows) + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    assert got == expected | {len(rows) - 2: None, len(rows) - 1: None}
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(licenses.scan(docs).select("doc_id", "digest", "license", "notices"), con, ORACLES["op4_license_scan"]) is None
