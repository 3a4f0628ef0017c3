import random
import re
from collections import Counter

import numpy as np
import pytest

from cases import SCHEMA
from storygauge.llm import divergence


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, least, top):
    rows = [(lang or "", source or "", terms_of(text)) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in own for t in set(r[2]))
        kept = {t for t, n in seen.items() if n >= least}
        v = len(kept)
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2] if t in kept) for s in {r[1] for r in own}}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * v)
        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, t) - p(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            above = [(t, p(c, t) - p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", above)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def result(docs, least=3, top=5):
    return sorted(tuple(r) for r in divergence.audit(docs, least, top).collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s) for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")


def drawn(seed, n, sources):
    draw = random.Random(seed)
    words = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)] + ["Éa", "éa", "漢字", "🙂b", "ſ", "K", "aB", "ab"]
    text = lambda: draw.choice([" ", "-1", "_"]).join(draw.choices(words, weights=range(1, len(words) + 1), k=draw.randint(0, 30)))
    return [(text() if draw.random() > .05 else None, draw.choice(["x", "y", None, ""]), draw.choice(sources)) for _ in range(n)]


def test_equals_brute_force(spark, many_parts):
    rows = drawn(1, 300, ["a", "b", "B", "é", None, ""]) + [("one two", "z", "a"), (None, "z", "b"), ("same same", "u", "only")] * 2
    rows += [("common " * 50 + f"w{'a' * (i % 3 + 1)}", "x", "hot") for i in range(100)]  # a source with a third of all rows
    with many_parts():
        assert result(table(spark, rows)) == brute(rows, 3, 5)


def test_more_sources_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", 3)
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", 8)
    monkeypatch.setattr(divergence, "MOST_TERMS", 50)
    rows = drawn(2, 200, [f"s{i}" for i in range(11)])
    assert result(table(spark, rows), 2, 4) == brute(rows, 2, 4)


def test_messy_and_clashing_columns(spark, messy):
    rows = [(r.text, r.lang, r.source) for r in messy.collect()]
    assert result(messy, 2) == brute(rows, 2, 5)


def test_no_kept_terms_and_nothing(spark, messy, nothing):
    assert {(r[2], r[4]) for r in result(messy, 1000)} == {("pair", 0)}
    assert result(nothing) == []
    none = spark.createDataFrame([(None,) * 14] * 2, SCHEMA)
    assert result(none) == []  # one group alone has no one to differ from


@pytest.mark.parametrize("top", [1, 3, 50])
def test_skyband_equals_counting_dominators(top):
    draw = np.random.default_rng(top)
    points = draw.integers(0, 30, (900, 2))
    beaten = [sum((points[:i, 0] >= p[0]) & (points[:i, 1] <= p[1])) for i, p in enumerate(points)]
    assert divergence.skyband(points, top).tolist() == [i for i, n in enumerate(beaten) if n < top]
    assert len(divergence.skyband(points, top)) < len(points) or top == 50
