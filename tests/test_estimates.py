import pytest
from pyspark.sql import functions as F

from storygauge.operators import estimate
from storygauge.schemas import SCALE


@pytest.fixture
def estimates(spark):
    def run(*lists, min_similarity=0.0):
        rows = [
            (str(q), rank, f"A-{rank}", points, sim)
            for q, items in enumerate(lists) for rank, (points, sim) in enumerate(items, 1)
        ]
        df = spark.createDataFrame(rows, "query_key string, rank int, issue_key string, story_points int, similarity double")
        return estimate.estimate_from_neighbours(df, min_similarity).orderBy("query_key").collect()

    return run


def test_single_neighbour(estimates):
    (r,) = estimates([(5, 0.9)])
    assert (r.rag_story_points, r.rag_raw_average) == (5, 5.0) and 0.3 <= r.rag_confidence <= 0.9


def test_equal_weights_average_then_snap(estimates):
    (r,) = estimates([(3, 0.8), (5, 0.8)])
    assert (r.rag_raw_average, r.rag_story_points) == (4.0, 5)


def test_higher_similarity_weighs_more(estimates):
    low, high = estimates([(21, 0.95), (3, 0.05)], [(3, 0.95), (21, 0.05)])
    assert low.rag_story_points > high.rag_story_points


def test_wide_spread_lowers_confidence(estimates):
    tight, wide = estimates([(5, 0.85), (5, 0.8)], [(1, 0.85), (21, 0.8)])
    assert wide.rag_confidence < tight.rag_confidence


def test_threshold_keeps_all_when_none_passes(estimates):
    some, none = estimates([(3, 0.9), (21, 0.1)], [(3, 0.2), (5, 0.1)], min_similarity=0.5)
    assert some.rag_raw_average == 3.0
    assert none.rag_raw_average == pytest.approx((3 * 0.2 + 5 * 0.1) / 0.3)


def test_without_positive_weights_the_nearest_decides(estimates):
    (r,) = estimates([(8, -0.1), (21, -0.4)])
    assert r.rag_raw_average == 8.0


def test_confidence_stays_in_range(estimates):
    got = estimates(*[[(a, s), (b, s / 2)] for a in SCALE for b in SCALE for s in (0.01, 0.5, 0.99)])
    assert len(got) == 147 and all(0.3 <= r.rag_confidence <= 0.9 and r.rag_story_points in SCALE for r in got)


def test_similar_enough_keeps_all_or_the_close_ones(spark):
    rows = [("a", 0.9), ("a", 0.1), ("b", 0.2), ("b", 0.1)]
    df = spark.createDataFrame(rows, "query_key string, similarity double")
    kept = sorted(tuple(r) for r in estimate.similar_enough(df, 0.5).collect())
    assert kept == [("a", 0.9), ("b", 0.1), ("b", 0.2)]


def test_keyword_estimate(spark):
    rows = [
        ("1", "Fix login", ""), ("2", "Rewrite the platform", "implement " + "word " * 80), ("3", None, None),
        ("4", "Add", "x " * 400),
    ]
    df = spark.createDataFrame(rows, "issue_key string, title string, description string")
    got = {r.issue_key: r for r in estimate.estimate_from_keywords(df).collect()}
    assert (got["1"].story_points, got["1"].confidence, got["1"].complex) == (1, round(0.55 + 2 / 400, 2), False)
    # 84 words: 3, large words 6, medium 2 -> 11 -> 13
    assert (got["2"].story_points, got["2"].complex) == (13, True)
    assert [s.story_points for s in got["2"].subtasks] == [3, 8, 3]
    assert (got["3"].story_points, got["3"].confidence) == (1, 0.55)
    assert (got["4"].story_points, got["4"].confidence) == (8, 0.8)


def test_substring_keywords_count_once_per_group(spark):
    df = spark.createDataFrame([("login changelog tweak", "")], "title string, description string")
    row = estimate.estimate_from_keywords(df).head()
    assert row.story_points == 1  # -2 once, then at least 1


def test_merge_replies(spark):
    rows = [
        ("rag", 8, 7.456, 0.6, '{"confidence": 0.9, "reasoning": " r ", "complex": "false", "subtasks": [{"title": "t"}]}', None),
        ("rag default", 13, 13.0, 0.6, '{"reasoning": "r"}', None),
        ("off scale", None, None, None, '{"story_points": 9, "confidence": 0.9, "reasoning": "r"}', None),
        ("defaults", None, None, None, "{}", None),
        ("huge", None, None, None, '{"story_points": 1e30, "subtasks": [{"story_points": 1e12}, {"story_points": 1e12}, {"story_points": 1e12}]}', None),
        ("part", None, None, None, '{"subtasks": [{"story_points": "n/a"}]}', None),
        ("not a number", None, None, None, '{"story_points": 3, "confidence": NaN}', None),
        ("settled", 5, 5.0, 0.5, '{"story_points": "five"}', None),
        ("broken", None, None, None, "nope", None),
        ("failed", None, None, None, None, "ValueError: x"),
    ]
    df = spark.createDataFrame(rows, "k string, rag_story_points int, rag_raw_average double, rag_confidence double, reply string, error string")
    got = {r.k: r for r in estimate.merge_replies(df, "m").collect()}
    r = got["rag"]
    assert (r.story_points, r.confidence, r.reasoning, r.complex, r.source, r.rag_raw_average) == (8, 0.6, "r", False, "rag+llm:m", 7.46)
    assert got["rag default"].complex and got["rag default"].confidence == 0.6
    r = got["off scale"]
    assert (r.story_points, r.confidence, r.no_rag_fallback) == (13, 0.45, True)
    assert r.reasoning.startswith("No similar tickets found") and r.source == "llm:m+no-retrieval"
    assert (got["defaults"].story_points, got["defaults"].confidence) == (3, 0.4)
    assert got["huge"].error == "story_points is no whole number" and got["part"].error == "story_points of a subtask is no whole number"
    assert got["not a number"].error == "confidence is no number" and got["settled"].error is None and got["settled"].story_points == 5
    assert got["broken"].error == "no JSON object in the reply" and got["failed"].error == "ValueError: x"
    for k in ("huge", "part", "not a number", "broken", "failed"):
        made = ("story_points", "confidence", "reasoning", "complex", "subtasks", "source", "no_rag_fallback")
        assert [got[k][c] for c in made] == [None] * len(made)


def test_warning_is_added_once(spark):
    from storygauge.functions.prompts import NO_RETRIEVAL_WARNING

    df = spark.createDataFrame([(f'{{"reasoning": "{NO_RETRIEVAL_WARNING} Small."}}',)], "reply string").withColumns({
        "rag_story_points": F.lit(None).cast("int"), "rag_raw_average": F.lit(None).cast("double"),
        "rag_confidence": F.lit(None).cast("double"), "error": F.lit(None).cast("string"),
    })
    assert estimate.merge_replies(df, "m").head().reasoning.count(NO_RETRIEVAL_WARNING) == 1


def test_subtask_columns(spark):
    df = spark.createDataFrame([([("a", 3, "r"), ("b", 5, "s")],), ([],)], f"s {estimate.SUBTASK_ARRAY}")
    got = df.select(*[c.alias(n) for n, c in estimate.subtask_columns(F.col("s")).items()]).collect()
    assert (got[0].subtask_count, got[0].subtask_points_sum, got[0].subtask_titles) == (2, 8, "a | b")
    assert got[0].subtasks_json == '[{"title":"a","story_points":3,"reasoning":"r"},{"title":"b","story_points":5,"reasoning":"s"}]'
    assert (got[1].subtask_count, got[1].subtask_points_sum, got[1].subtasks_json) == (0, 0, "[]")
