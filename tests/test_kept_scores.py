"""Scores that new results are added to, against a full recount."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from storygauge.plans import evaluate, scores

FIELDS = "issue_key string, actual_story_points int, predicted_story_points int, similar_tickets_json string, rag_confidence double"


def results(spark, seed, n):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        near = [{"issue_key": f"K-{draw.randint(1, 9)}", "story_points": draw.choice([1, 5, 8]), "similarity": draw.random()} for _ in range(draw.randint(0, 3))]
        rows.append((draw.choice(["hot"] * 10 + [f"K-{i}" for i in range(25)]), draw.choice([0, 1, 3, 8, None]), draw.choice([1, 2, 8, 13]),
                     draw.choice([json.dumps(near), None, "bad"]), draw.choice([None, .3, .6, .9])))
    return spark.createDataFrame(rows, FIELDS)


def report(df):
    return sorted((r.section, r.metric, None if r.value is None else round(r.value, 9)) for r in df.collect())


def test_state_and_new_rows_equal_a_recount(spark, tmp_path):
    state = str(tmp_path / "state")
    parts = [(results(spark, 1, 60), results(spark, 2, 50)), (results(spark, 3, 20), None), (None, results(spark, 4, 30)), (results(spark, 5, 5), results(spark, 6, 5))]
    rag, norag = parts[0]
    for i, (a, b) in enumerate(parts):
        assert scores.add_results(spark, state, a, b) == i + 1
        if i:
            rag, norag = rag if a is None else rag.unionByName(a), norag if b is None else norag.unionByName(b)
        assert report(scores.kept_report(spark, state)) == report(evaluate.ablation_report(rag, norag))


def test_a_lost_batch_is_written_over_and_nothing_is_an_error(spark, tmp_path):
    state = str(tmp_path / "state")
    with pytest.raises(ValueError, match="no results"):
        scores.kept_report(spark, state)
    scores.add_results(spark, state, results(spark, 1, 20), results(spark, 2, 20))
    before = report(scores.kept_report(spark, state))
    results(spark, 3, 9).write.parquet(f"{state}/batch-2/counts")  # a writer that was lost
    assert scores.batches(spark, state) == [1] and report(scores.kept_report(spark, state)) == before
    assert scores.add_results(spark, state, results(spark, 3, 9)) == 2 and os.path.exists(f"{state}/batch-2/paired/_SUCCESS")
    with pytest.raises(ValueError, match="no results"):
        scores.add_results(spark, state)


def test_empty_results_change_nothing(spark, tmp_path):
    state, some = str(tmp_path / "state"), results(spark, 1, 20)
    scores.add_results(spark, state, some, results(spark, 2, 20))
    before = report(scores.kept_report(spark, state))
    scores.add_results(spark, state, some.filter(F.lit(False)), some.filter(F.lit(False)))
    assert report(scores.kept_report(spark, state)) == before
