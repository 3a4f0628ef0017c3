import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import words
from storygauge.llm import shingles, toxicity as tox

BAD = ("vilrot", "snarkox", "grumble", "Ünrat")


def corpus(n=900):
    """Random words; toxic texts hold a few words of a small list, some in forms never seen twice."""
    draw, rows, labels = random.Random(5), [], []
    for i in range(n):
        own = words(i, draw.choice((20, 80, 200))).split()
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(max(2, len(own) // 25)):
                own[draw.randrange(len(own))] = draw.choice(BAD) + draw.choice(("", "", "s", "ery", f"{i}x"))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, messy):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def scored(tables):
    return {r.doc_id: r for r in tox.toxicity(*tables).collect()}


def test_held_out_accuracy(scored):
    held = {i for i, r in scored.items() if r.held_out}
    assert held == {i for i in scored if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [scored[i].predicted == int(i % 3 == 0) for i in held]
    assert np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored.values())


def test_held_out_labels_and_other_columns_teach_nothing(tables, scored):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r for r in tox.toxicity(docs.withColumn("lang", F.lit("q")), flipped).collect()}
    assert all(abs(again[i].score - scored[i].score) < 1e-6 for i in scored)


def test_gradients_by_differences():
    draw, net = np.random.default_rng(0), tox.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, weight = draw.normal(size=(7, 3, 2 * tox.EMBED)), draw.normal(size=3)
    mask = (np.arange(7)[:, None] < np.array([7, 4, 1])).astype(np.float64)

    def loss():
        logit, trace = net.forward(x @ net.p["input"] + net.p["bias"], mask, keep=True)
        return float(logit @ weight), trace

    _, trace = loss()
    grads, d_projected = net.backward(trace, weight)
    grads["input"], grads["bias"] = np.einsum("tbi,tbj->ij", x, d_projected), d_projected.sum(axis=(0, 1))
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for k in draw.choice(flat.size, min(6, flat.size), replace=False):
            kept, step = flat[k], 1e-3
            flat[k] = kept + step
            up = loss()[0]
            flat[k] = kept - step
            down = loss()[0]
            flat[k] = kept
            assert np.reshape(g, -1)[k] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-3), name


def test_windows_cover_all_tokens():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        starts = tox.window_starts(n)
        covered = {t for s in starts for t in range(s, min(s + tox.WINDOW, n))}
        assert covered == set(range(n)) and (np.diff(starts) <= tox.STRIDE).all()


def test_logits_of_a_batch_equal_those_of_each_window():
    net, draw = tox.Network(), np.random.default_rng(3)
    net.words, net.grams = draw.normal(size=net.words.shape).astype(np.float32), draw.normal(size=net.grams.shape).astype(np.float32)
    texts = ["", "One two, three!", words(1, 150), words(2, 64), "é 漢 🙂", words(3, 65)]
    found = list(tox.text_logits(pa.array(texts), net))
    assert [len(f) for f in found] == [0, 1, 4, 1, 1, 2]
    for text, got in zip(texts, found):
        own = [w for w in shingles.chunks(pa.array([text.lower()]), tox.BETWEEN)][0]
        spell = [own.data[a:b].tobytes().decode() for a, b in zip(own.starts, own.ends)]
        for start, logit in zip(tox.window_starts(len(spell)), got):
            part = " ".join(spell[start:start + tox.WINDOW])
            assert next(iter(tox.text_logits(pa.array([part]), net)))[0] == pytest.approx(logit, abs=1e-4)


def test_regression_recovers_weights():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(20_000, 2))
    y = (draw.random(20_000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert np.allclose(tox.regression(x, y, np.ones(len(y))), (2, -1, 0.5), atol=0.1)


def test_messy_and_empty(spark, messy, nothing, tables):
    _, labels = tables
    rows = tox.toxicity(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, 0, None), (1, 0, 1), (1, 0, 1), (None, 0, 1), (777, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(tox.toxicity(messy, odd).collect()) == messy.count()
    assert tox.toxicity(nothing, labels).count() == 0 and tox.toxicity(messy, labels.limit(0)).count() == messy.count()
