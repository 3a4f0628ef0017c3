import hashlib
import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storygauge.llm import private_data as pd_

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


ODD = [
    "a@b.c_d@e.f x@y.z.", "mail me: Ü+tag%x@ex-ample.co.uk, 🙂 +1 (555) 010-9999 or 1.2.3.4.5 and 256.1.1.1 0255.01.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 378282246310005 6011000990139424", "+49 (0) 30 1234567 +1 2 +123456789012345678",
    "1" * 300 + " 0.0.0.0 " + "4111111111111111", "a@b @c.d e@f..g 1..2.3.4", "", None, "+1" + " " * 50 + "2 3 4 5 6 7 8 9 0",
]


def test_base_spans(spark, small, messy):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for docs in (odd, small, messy):
        got = docs.select("text", pd_.listed(pd_.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
        assert [(r.text, r.s) for r in got] == [(r.text, brute(r.text)) for r in got]


def planted():
    """An entity that rare tokens go with, near and far, words that go with everything, and fillers."""
    rows = []
    for i in range(400):
        own = chr(97 + i % 26) * 4
        text = f"filler number w{i} the report of the committee was read again today in hall {i}"
        if i < 8:
            middle = " ".join(f"the report w{i * 50 + k} of hall {k}" for k in range(40))
            text = f"Zebulon (Li)\n\nthe report, EMP4711: {middle} by O'Brien for (Zorblax), zed@example.org today {own}"
        elif i < 12:
            text = f"call {own} Quimby at +1 202 555 01{i:02d} the report today"
        rows.append((i, text))
    rows += [(400, None), (None, ""), (401, rows[20][1]), (0, rows[0][1])]
    return rows


def plain_terms(text):
    """(term, start, end) of every token."""
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        word = [k for k, c in enumerate(m[0]) if c.isalpha() or c.isnumeric()]
        if word:
            out.append((m[0][word[0]:word[-1] + 1].lower(), m.start() + word[0], m.start() + word[-1] + 1))
    return out


def entities_of(text):
    """(entity, start, end) of every base span."""
    out = []
    for part in filter(None, brute(text).split(",")):
        kind, a, b = part.split(":")
        value = text[int(a):int(b)]
        out.append((f"{kind}:" + (re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()), int(a), int(b)))
    return out


def brute_terms(rows, at=0.8, support=3):
    """Ratios of (entity, term) counted directly over whole documents."""
    n, d_e, d_et, d_t, seen = len(rows), Counter(), Counter(), Counter(), {}
    for _, t in rows:
        terms, entities = {w for w, _, _ in plain_terms(t)}, {e for e, _, _ in entities_of(t)}
        d_t.update(terms)
        d_e.update(entities)
        d_et.update((e, w) for e in entities for w in terms)
        for e in entities:
            for w in terms:
                seen.setdefault((e, w), set()).add((frozenset(terms), frozenset(entities)))
    ratio = lambda e, w: math.log(n * d_et[e, w] / (d_e[e] * d_t[w])) / math.log(n / d_e[e])
    return {(e, w): ratio(e, w) for e, w in d_et if len(seen[e, w]) >= support and d_e[e] < n and ratio(e, w) >= at}


def brute_spans(text, terms):
    entities = entities_of(text)
    flagged = {w for e, w in terms if e in {x for x, _, _ in entities}}
    return {(a, b) for w, a, b in plain_terms(text) if w in flagged and not any(x < b and a < y for _, x, y in entities)}


@pytest.fixture(scope="module")
def corpus(spark, messy):
    return spark.createDataFrame(planted(), "doc_id long, text string")


def test_terms_that_reveal(corpus):
    rows = planted()
    found = pd_.find_private(corpus)
    terms = brute_terms(rows)
    revealed = {w for e, w in terms if e == "email:zed@example.org"}
    assert {"zebulon", "li", "emp4711", "o'brien", "zorblax"} <= revealed and not revealed & {"the", "report", "today", "hall"}
    for r in found.collect():
        text = next((t for i, t in rows if i == r.doc_id), "") or ""
        assert {(s.start, s.end) for s in r.spans if s.kind == "term"} == brute_spans(text, terms)
        assert [s for s in r.spans if s.kind != "term"] == r.base
    first = rows[0][1]
    assert {first[a:b] for a, b in brute_spans(first, terms)} >= {"Zebulon", "Li", "EMP4711", "O'Brien", "Zorblax"}


def test_sanitised(corpus):
    text = {r.doc_id: r.text for r in pd_.sanitised(corpus).filter("doc_id is not null").collect()}
    assert "zed@" not in text[1] and "<email>" in text[1] and text[1].startswith(" ()\n\nthe report, : the report w50")
    assert not re.search("Zorblax|Zebulon|EMP4711|Brien", text[1]) and text[20] == dict(planted())[20] and text[400] == ""


def test_terms_are_generalised_by_the_corpus(spark):
    """A term that is not quite exclusive becomes the beginning that many tokens share; one without company its class."""
    rows = [(i, f"zed@example.org zorblax qqq x{i}") for i in range(8)] + [(8, "zorblax qqq here")]
    rows += [(10 + i, f"filler zorb{chr(109 + i % 13)}{i} zo{i} {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = brute_terms(rows)
    assert all(0.8 <= terms["email:zed@example.org", w] < 0.99 for w in ("zorblax", "qqq"))
    spans = {r.doc_id: {s.value for s in r.spans if s.kind == "term"} for r in pd_.find_private(docs, remove_at=0.99).collect()}
    assert spans[3] == {"zorb*", "<word>"} and spans[8] == set()
    assert {r.doc_id: r.text for r in pd_.sanitised(docs, remove_at=0.99).collect()}[2] == "<email> zorb* <word> x2"


def test_places_of_very_many_matches(spark):
    """Work grows with the number of matches, not with its square."""
    text = " ".join(f"u{i}@ex.org" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "a@b.cd")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r.base for r in pd_.find_private(docs).collect()}
    assert time.perf_counter() - start < 60 and len(got[1]) == 20_000
    assert all(text[s.start:s.end] == s.value for s in got[1][::997])


def test_copies_prove_nothing(spark, messy):
    same = [(i, "the Gleeb person writes to a@b.cd now") for i in range(30)] + [(99 + i, f"other text {i}") for i in range(300)]
    found = pd_.find_private(spark.createDataFrame(same, "doc_id long, text string"))
    assert found.filter(F.size("spans") > F.size("base")).count() == 0 and found.filter("size(base) = 1").count() == 30


def test_messy_and_empty(messy, nothing):
    rows = pd_.find_private(messy).collect()
    assert len(rows) == messy.count() and all(pd_ is not None and r.base is not None for r in rows)
    assert pd_.find_private(nothing).count() == pd_.sanitised(nothing).count() == 0
    assert pd_.sanitised(messy).count() == messy.count()


def test_query_digest(spark, small):
    from storygauge.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in small.collect()}
    rows = QUERIES["op6_private_data"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest() for r in rows) and len(rows) == len(texts)


def test_query_equals_its_sql_where_terms_are_found(spark, messy, tmp_path):
    import duckdb

    from compare import difference
    from storygauge.llm.oracle import ORACLES
    from storygauge.llm.queries import QUERIES

    rows = [r for r in planted()[:401]] + [(1000 + i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = QUERIES["op6_private_data"](spark, str(tmp_path))
    assert made.filter("spans like '%term%'").count() == 8
    assert difference(made, con, ORACLES["op6_private_data"]) is None
