import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cases import words
from storygauge.llm import near_dedup as nd, shingles


def plain_shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, threshold=0.8):
    """Connected components of all pairs, each compared; texts without words are one class."""
    sets = [plain_shingles(t) for _, t in rows]
    n, df = len(rows), Counter(k for s in sets for k in s)
    floor = max(1.0, nd.RARE * n)
    idf = {k: 2 + math.log(max(1.0, n / max(v, floor))) / math.log(1 / nd.RARE) for k, v in df.items()}
    whole = [sum(c * idf[k] for k, c in s.items()) for s in sets]
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            shared = sum(min(c, sets[j][k]) * idf[k] for k, c in sets[i].items() if k in sets[j])
            if (not sets[i] and not sets[j]) or (shared and shared / (whole[i] + whole[j] - shared) >= threshold):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[top(i)].append(doc_id)
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    return sorted(((i, least(ids), len(ids)) for ids in groups.values() for i in ids), key=repr)


def variants(seed=9):
    """Groups whose members lie at all distances from their first one, chains, shared passages and copies."""
    draw, rows = random.Random(seed), []
    for g in range(6):
        base = words(100 + g, 150).split()
        for k in range(25):
            w = list(base)
            for _ in range(draw.randint(0, 9)):
                w[draw.randrange(len(w))] = f"n{draw.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
            if k % 5 == 0:
                rows.append((len(rows), "  ".join(w) + "\n"))
    chain = words(300, 200).split()
    for _ in range(12):
        chain = chain[6:] + words(draw.randrange(10 ** 6), 6).split()
        rows.append((len(rows), " ".join(chain)))
    passage = words(400, 60)
    rows += [(len(rows) + k, f"{words(500 + k, 60)} {passage} {words(600 + k, 60)}") for k in range(20)]
    return rows


def classes(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in df.collect()), key=repr)


def test_classes_equal_brute_force(spark, messy, many_parts):
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with many_parts():
        got = nd.near_duplicates(docs)
        assert classes(got) == brute_classes(rows)
    assert got.filter("kept").count() == len({c for _, c, _ in brute_classes(rows)})


def test_blocks_are_small_and_lose_nothing(spark, messy, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(nd, "RUN", 500)
    rows = variants(10)
    assert classes(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_classes(rows)


def test_messy_and_empty(messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert classes(nd.near_duplicates(messy)) == brute_classes(rows)
    kept = nd.without_near_duplicates(messy)
    assert kept.schema == messy.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted(kept_brute(rows), key=repr)
    assert nd.near_duplicates(nothing).count() == nd.without_near_duplicates(nothing).count() == 0


def kept_brute(rows):
    """One id for each class; the class of id 10 that has a repeated row keeps one of them."""
    seen, out = set(), []
    for i, t in rows:
        key = frozenset(plain_shingles(t).items())
        same = [c for c in brute_members(rows) if (i, key) in c][0]
        if id(same) not in seen:
            seen.add(id(same))
            out.append(min((j for j, _ in same), key=lambda j: (j is None, j or 0)))
    return out


_members = {}


def brute_members(rows):
    """The classes as lists of (id, shingles)."""
    if id(rows) not in _members:
        sets = [(i, frozenset(plain_shingles(t).items())) for i, t in rows]
        labels = brute_labels(rows)
        groups = defaultdict(list)
        for label, member in zip(labels, sets):
            groups[label].append(member)
        _members[id(rows)] = list(groups.values())
    return _members[id(rows)]


def brute_labels(rows):
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    label = {i: c for i, c, _ in brute_classes(numbered)}
    return [label[k] for k in range(len(rows))]


def test_shingles_of_a_batch_equal_those_of_each_text():
    texts = ["a b c d e f", "", "a b", " a b c d e", "x" * 300, "a\tb\nc\x0bd\x0ce\rf g", "é ü 漢 字 🙂 z", "a b c d e f"]
    found = list(shingles.of_texts(pa.array(texts)))
    assert [len(s) for s, _ in found] == [2, 0, 1, 1, 1, 3, 2, 2]
    alone = [next(iter(shingles.of_texts(pa.array([t])))) for t in texts]
    assert all((a[0] == b[0]).all() and a[1] == b[1] for a, b in zip(found, alone))
    sliced = list(shingles.of_texts(pa.array(texts).slice(3, 4)))
    assert all((a[0] == b[0]).all() for a, b in zip(sliced, found[3:7]))
    assert (found[0][0] == found[5][0][:2]).all() and found[0][1] == found[7][1] != found[2][1]


def test_samples_agree_as_often_as_texts_are_similar():
    draw, sampler = np.random.default_rng(1), nd.Sampler(samples=2048)
    pool = draw.integers(0, 2 ** 63, 400).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = int(400 * share)
        a, b = np.sort(pool[:300]), np.sort(np.concatenate((pool[:int(300 * share)], pool[300:])))
        weigh = lambda h: (1 + (h % np.uint64(5))).astype(np.float32)
        both = np.intersect1d(a, b)
        true = weigh(both).sum() / (weigh(a).sum() + weigh(b).sum() - weigh(both).sum())
        same = (sampler.codes(a, weigh(a)) == sampler.codes(b, weigh(b))).mean()
        assert abs(same - true) < 0.05, (share, n)


def test_block_product_equals_pairs():
    draw = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        f = np.unique(draw.integers(0, 60, 40).astype(np.uint64))
        sets.append((f, draw.integers(1, 4, len(f)), (1 + (f % np.uint64(3))).astype(np.float32)))
    got = nd.block_similarities(sets[:5], sets[5:])
    want = [[nd.weighted_jaccard(a, b) for b in sets[5:]] for a in sets[:5]]
    assert np.allclose(got, want, atol=1e-5)


def test_components(spark, messy):
    draw = random.Random(3)
    edges = [(bytes([draw.randrange(120)]), bytes([draw.randrange(120)])) for _ in range(90)]
    edges = [e for e in edges if e[0] != e[1]] + [(bytes([200 + i]), bytes([201 + i])) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {bytes(r.node): bytes(r.root) for r in nd.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {x: top(x) for x in parent}


@pytest.mark.parametrize("cut", [2, 3])
def test_document_frequencies(spark, messy, cut):
    texts = [f"{words(i % 7, 12)} {words(i, 9)}" for i in range(60)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes, df, used = nd.frequent_shingles(docs.repartition(5), len(texts) if cut == 2 else int(cut / nd.RARE), 10_000)
    count = Counter(h for s, _ in shingles.of_texts(pa.array([t or "" for t in texts])) for h in set(s.tolist()))
    assert used == cut and dict(zip(hashes.tolist(), df.tolist())) == {h: c for h, c in count.items() if c >= cut}


def test_classes_that_share_their_smallest_id_each_keep_a_document(spark, messy):
    texts = {g: words(700 + g, 90) for g in range(6)}
    near = {g: t.replace(t.split()[40], "changed", 1) for g, t in texts.items()}
    owners = {0: (None, None), 1: (None, None), 2: (7, 7), 3: (7, 8), 4: (7, 9), 5: (20, None)}
    rows = [row for g, (a, b) in owners.items() for row in ((a, texts[g]), (b, near[g]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in nd.without_near_duplicates(docs).collect()]
    group = {t: g for side in (texts, near) for g, t in side.items()}
    assert sorted(group[t] for _, t in kept) == list(range(6))
    assert {group[t]: i for i, t in kept} == {0: None, 1: None, 2: 7, 3: 7, 4: 7, 5: 20}
    assert {r.class_size for r in nd.near_duplicates(docs).collect()} == {2}


def test_one_row_of_a_class_is_kept_though_ids_repeat_or_are_missing(spark):
    same, near, bare = words(800, 90), words(800, 90).replace(words(800, 90).split()[40], "changed", 1), words(801, 90)
    rows = [(1, same), (1, same), (1, near), (None, bare), (None, bare), (None, bare), (2, words(802, 90)), (3, ""), (3, None)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(((r.doc_id, r.class_size) for r in found if r.kept), key=repr)
    assert len(found) == len(rows) and kept == [(1, 3), (2, 1), (3, 2), (None, 3)]
