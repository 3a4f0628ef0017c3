import re
from collections import defaultdict

import pytest

from storygauge.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Targets by sharing the excess round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def check(docs, result):
    rows, texts = result.collect(), docs.collect()
    assert sorted(((r.doc_id, r["size"]) for r in rows), key=repr) == sorted(((r.doc_id, size(r.text)) for r in texts), key=repr)
    sizes, longest = defaultdict(int), defaultdict(int)
    for r in texts:
        sizes[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    target, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    return target, taken, longest


def test_targets_and_sums(small, many_parts):
    with many_parts():
        target, taken, longest = check(small, mixing.mix(small))
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)


def test_messy(messy):
    target, taken, longest = check(messy, mixing.mix(messy))
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in target)  # repeated rows share a decision


def test_targets_that_no_source_can_reach(spark):
    rows = [(i, "w " * n, None, s, 0) for i, (s, n) in enumerate([("a", 1), ("b", 50), ("c", 400), ("d", 2), ("e", 0), ("f", 100)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(docs, mixing.mix(docs))


def test_probability_of_the_chance_part(spark):
    """Over many draws a document is taken as often as its expected copies say."""
    rows = [(i, "w " * (5 + 3 * (i % 9)), None, "ab"[i % 2], 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    total, draws = defaultdict(float), 12
    for seed in range(draws):
        for r in mixing.mix(docs, seed=seed).collect():
            total[(r.source, r["size"])] += r.copies / draws
    plan = mixing.Mix(docs, seed=0)
    expected = plan.attach(plan.narrow, plan.plan, plan.count).withColumn("e", plan.expected()).collect()
    wanted = defaultdict(float)
    for r in expected:
        wanted[(r.source, r["size"])] += r.e
    assert all(abs(total[k] - wanted[k]) < 2 for k in wanted)
    ratio = sum(total.values()) / sum(wanted.values())
    assert 0.95 < ratio < 1.05


def test_reruns_agree_and_copies_are_rows(small):
    columns = ["doc_id", "copies"]
    first, second = (sorted(mixing.mix(small).select(columns).collect()) for _ in range(2))
    assert first == second
    rows = sorted(r.doc_id for r in mixing.mixed(small).collect())
    assert rows == sorted(i for i, n in first for _ in range(n))


def test_mixed_keeps_columns(messy, nothing):
    assert mixing.mixed(messy).schema == messy.schema
    assert mixing.mix(nothing).count() == mixing.mixed(nothing).count() == 0
