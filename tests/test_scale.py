import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from storygauge.functions import rounding, scale as fs
from storygauge.schemas import SCALE


def test_snap_goes_to_the_higher_bracket(one):
    values = [0.0, 0.5, 1.0, 1.5, 4.0, 10.0, 21.0, 22.0, -3.0, None, float("nan")]
    assert one(values, fs.snap_to_scale, "double") == [1, 1, 1, 2, 5, 13, 21, 21, 1, None, None]


def test_snap_is_on_the_scale_and_not_below(one):
    rng = random.Random(3)
    values = [rng.uniform(-5, 30) for _ in range(500)]
    for value, snapped in zip(values, one(values, fs.snap_to_scale, "double")):
        assert snapped in SCALE and (snapped >= min(value, 21))


def test_export_label_keeps_zero(one):
    assert one([0.0, 0.2, 13.5], fs.export_label, "double") == [0, 1, 21]


def test_sample_class(spark):
    df = spark.createDataFrame([(0.0,), (2.5,)], "v double")
    got = df.select(fs.sample_class(F.col("v"), True), fs.sample_class(F.col("v"), False)).collect()
    assert [tuple(r) for r in got] == [(0, 1), (3, 3)]


def test_label_rounding_is_half_even(one):
    assert one([0.5, 1.5, 2.5, 2.567, None], fs.round_points, "double") == [0.0, 2.0, 2.0, 3.0, None]


def test_display_labels(one):
    assert one([None, 3.0, 2.5, float("nan"), 1e7], fs.points_label, "double") == ["Missing", "3", "2.5", "Missing", "10000000"]


def test_confidence_labels(one):
    assert one([0.75, 0.74, 0.55, 0.54], fs.confidence_label, "double") == ["High", "Medium", "Medium", "Low"]


def test_rounding_follows_the_stored_number(one):
    values = [2.675, 0.565, 0.555, 0.125, 0.375, 0.825, -0.004, -2.675, 1e6 + 0.005] + [0.55 + w / 400 for w in range(101)]
    assert one(values, lambda c: rounding.round_exact(c, 2), "double") == [round(v, 2) for v in values]
    assert one(values, lambda c: rounding.fixed(c, 2), "double") == [f"{v:.2f}" for v in values]


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=50, max_size=200))
def test_rounding_property(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = [r[0] for r in df.select(rounding.round_exact(F.col("v"), 4)).collect()]
    assert got == [round(v, 4) for v in values]
