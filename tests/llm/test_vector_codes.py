import hashlib
import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from storygauge.llm import vector_codes as vc

FIELDS = "vec_id long, embedding array<double>, label int, row string, code long, v string, label_error int"


def brute(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error) of every usable row, and the codebooks' digest, in plain Python integers."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(kept[0][2]) // 4
    parts = [[v[p * size:(p + 1) * size] for _, _, v in kept] for p in range(4)]
    books = [[list(v) for v in part[:entries]] for part in parts]

    def assign(part, book):
        apart = lambda v, e: sum((a - b) ** 2 for a, b in zip(v, e))
        return [min((apart(v, e), j) for j, e in enumerate(book)) for v in part]

    for _ in range(rounds):
        for p in range(4):
            found = defaultdict(list)
            for (_, j), v in zip(assign(parts[p], books[p]), parts[p]):
                found[j].append(v)
            for j, vs in found.items():
                books[p][j] = [sum(c) // len(vs) for c in zip(*vs)]
    last = [assign(parts[p], books[p]) for p in range(4)]
    errors = [sum(last[p][n][0] for p in range(4)) for n in range(len(kept))]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, errors):
        by_label[label] += e
    made = [(i, "".join(f"{last[p][n][1]:02x}" for p in range(4)), errors[n], by_label[label]) for n, (i, label, _) in enumerate(kept)]
    return sorted(made, key=repr), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def result(spark, rows, entries=256):
    df = spark.createDataFrame([(i, v, label, "r", 1, "v", 2) for i, v, label in rows], FIELDS)
    codes = vc.compress(df, entries=entries)
    found = [tuple(r)[:4] for r in vc.with_label_errors(codes).collect()]
    return sorted(found, key=repr), codes.digest()


def drawn(seed, n, size=8, spread=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, spread, (5, size))
    return [(int(i), (centres[i % 5] + draw.normal(0, .1, size)).tolist(), int(i % 3)) for i in draw.permutation(n)]


def test_equals_brute_force_with_nulls_ties_and_repeats(spark, many_parts):
    rows = drawn(1, 300)
    rows += [(None, rows[0][1], None), (None, rows[1][1], 1), (7, rows[2][1], None), rows[3], rows[3]]  # repeated ids and rows
    rows += [(1000 + i, [0.5] * 8, 9) for i in range(150)]  # one vector that a third of all rows share
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, 1), (2004, [-1.5 / 1024] * 8, 1)]
    with many_parts():
        assert result(spark, rows, 16) == brute(rows, 16)


def test_fewer_rows_than_entries_and_blocks_of_one_entry(spark, monkeypatch):
    rows = drawn(2, 40)
    assert result(spark, rows) == brute(rows)
    monkeypatch.setattr(vc, "BLOCK_ROWS", 4)  # most blocks then lie in one entry's cell and are summed as they are stored
    far = drawn(3, 200, 8, 50.0)
    assert result(spark, far, 5) == brute(far, 5)


def test_large_components_take_whole_number_products(spark):
    rows = [(i, [x * 100_000 for x in v], label) for i, v, label in drawn(4, 60, 8, .3)]
    rows = [(i, [max(-131_072.0, min(131_072.0, x)) for x in v], label) for i, v, label in rows]
    assert result(spark, rows, 8) == brute(rows, 8)


def test_nothing_and_vectors_without_components(spark):
    assert result(spark, [])[0] == [] and result(spark, [(1, None, 1)])[0] == []
    assert result(spark, [(1, [], 1), (2, [], None)])[0] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


@pytest.mark.parametrize("rows", [[(1, [0.0] * 8, 1), (2, [0.0] * 4, 1)], [(1, [0.0] * 6, 1)], [(1, [2e5] * 8, 1)]])
def test_vectors_that_cannot_be_coded_are_an_error(spark, rows):
    with pytest.raises(Exception, match="cannot be cut|must not hold"):
        result(spark, rows)


@pytest.mark.parametrize("size,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours_one_after_the_other(size, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=size)))
    keys = vc.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlist_never_misses_the_nearest_entry():
    draw = np.random.default_rng(5)
    for _ in range(200):
        v, entries = draw.integers(-50, 50, (20, 4)) + draw.integers(-200, 200), draw.integers(-250, 250, (30, 4))
        some = vc.shortlist(v.min(0), v.max(0), entries)
        every = vc.distances(v, entries)
        assert set(every.argmin(1)) <= set(some) and len(some) < 30
        assert (every == [[((a - b) ** 2).sum() for b in entries] for a in v]).all()
