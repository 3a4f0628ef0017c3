import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from storygauge.functions import stats
from storygauge.functions.stats import two_sided_p
from storygauge.operators import metrics, profile, review
from storygauge.plans import evaluate
from storygauge.schemas import RESULTS, RUBRIC_COLUMNS

# Recorded (estimate, subtask sum) of 44 decomposed tickets, as given with the evaluation set.
RECORDED = (
    (8, 8), (8, 12), (2, 6), (5, 5), (5, 5), (2, 5), (13, 17), (5, 5), (13, 17), (5, 10), (13, 17), (8, 8), (21, 25), (8, 8),
    (8, 8), (5, 6), (5, 5), (5, 5), (13, 17), (13, 13), (5, 5), (8, 8), (8, 8), (5, 6), (8, 8), (8, 11), (8, 8), (3, 8), (5, 5),
    (8, 8), (13, 19), (5, 5), (5, 5), (5, 5), (13, 13), (8, 8), (8, 10), (13, 18), (13, 17), (13, 13), (8, 8), (13, 13), (8, 15),
    (13, 18),
)


def results(spark, pairs):
    return spark.createDataFrame([(f"A-{i}", a, p) for i, (a, p) in enumerate(pairs)], "issue_key string, actual_story_points int, predicted_story_points int")


def test_recorded_gaps(spark):
    rows = [(f"K-{i}", p, s, True, 3, "a | b") for i, (p, s) in enumerate(RECORDED)] + [("off", 8, 14, False, 3, ""), ("none", 8, 0, True, 0, "")]
    df = spark.createDataFrame(rows, "issue_key string, predicted_story_points int, subtask_points_sum int, complex_flag boolean, subtask_count int, subtask_titles string")
    row = metrics.mean_reconciliation_gap(df).head()
    assert row.n_decomposed == 44 and f"{row.mean_gap:.2f}" == "1.70"


def test_recorded_confusion(spark):
    rows = [(8, True)] * 22 + [(5, True)] * 22 + [(13, False)] * 8 + [(3, False)] * 28
    counts = metrics.confusion_counts(spark.createDataFrame(rows, "actual_story_points int, complex_flag boolean"))
    assert tuple(counts.head()) == (22, 22, 8, 28)
    row = metrics.precision_recall_f1(counts).head()
    assert [f"{v:.2f}" for v in row] == ["0.50", "0.73", "0.59"]


def test_undefined_precision_is_zero(spark):
    df = spark.createDataFrame([(1, False)], "actual_story_points int, complex_flag boolean")
    assert tuple(metrics.precision_recall_f1(metrics.confusion_counts(df)).head()) == (0.0, 0.0, 0.0)


def test_error_metrics_with_zero_actual(spark):
    row = metrics.error_metrics(results(spark, [(0, 1), (4, 5), (8, 8), (2, 21)])).head()
    assert row.n == 4 and row.mae == pytest.approx(21 / 4) and row.rmse == pytest.approx(math.sqrt((1 + 1 + 0 + 361) / 4))
    assert row.mmre == pytest.approx((0.25 + 0 + 9.5) / 3)  # the zero row is left out
    assert (row.pred25, row.pred50, row.exact_match_rate) == (0.5, 0.5, 0.25)  # and is a miss here


def test_rank_correlation_matches_ranks_by_hand(spark):
    rng = random.Random(9)
    pairs = [(rng.choice([0, 1, 2, 5, 8, 21, 200_000, -70_000]), rng.choice([1, 2, 3, 5, 8])) for _ in range(300)]

    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    x, y = ranks([a for a, _ in pairs]), ranks([b for _, b in pairs])
    mx, my = sum(x) / 300, sum(y) / 300
    rho = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    row = metrics.rank_correlation(results(spark, pairs)).head()
    assert row.n == 300 and row.spearman_rho == pytest.approx(rho) and row.spearman_p == pytest.approx(two_sided_p(rho, 300))


def test_correlation_without_variation_is_missing(spark):
    row = metrics.rank_correlation(results(spark, [(3, 1), (3, 2), (3, 5)])).head()
    assert row.spearman_rho is None and row.spearman_p is None


def test_perfect_correlation(spark):
    row = metrics.rank_correlation(results(spark, [(1, 1), (2, 3), (5, 8)])).head()
    assert row.spearman_rho == pytest.approx(1.0) and row.spearman_p == pytest.approx(0.0, abs=1e-6)


def test_p_values():
    assert two_sided_p(0.0, 80) == 1.0 and two_sided_p(1.0, 80) == 0.0 and two_sided_p(0.5, 2) is None
    assert two_sided_p(0.2455, 80) > 0.024 > two_sided_p(0.2549, 80)
    assert two_sided_p(0.5, 4) == pytest.approx(0.5)  # t with two degrees has a closed form
    for rho, n in [(0.3, 12), (0.05, 900), (-0.8, 30)]:  # against the integral of the cosine power
        steps, t0 = 200_000, math.asin(abs(rho))
        grid = lambda lo, hi: sum(math.cos(lo + (hi - lo) * (i + 0.5) / steps) ** (n - 3) for i in range(steps)) * (hi - lo) / steps
        assert two_sided_p(rho, n) == pytest.approx(grid(t0, math.pi / 2) / grid(0, math.pi / 2), rel=1e-6)


def test_no_results(spark):
    row = metrics.error_metrics(results(spark, [(1, 1)]).filter("false")).head()
    assert row.n == 0 and row.mae is None and row.spearman_rho is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="predicted_story_points"):
        metrics.error_metrics(spark.createDataFrame([("a", 1)], "issue_key string, actual_story_points int"))


def test_worst_misses_break_ties_by_key(spark):
    got = [(r.issue_key, r.abs_error) for r in metrics.worst_misses(results(spark, [(1, 2), (1, 21), (2, 3), (5, 5)]), 3).collect()]
    assert got == [("A-1", 20), ("A-0", 1), ("A-2", 1)]


def test_off_scale(spark):
    got = {tuple(r) for r in metrics.off_scale(results(spark, [(1, 4), (1, 5), (1, None), (1, 0)])).collect()}
    assert got == {("A-0", 4), ("A-2", None), ("A-3", 0)}


def test_pairs_multiply_without_being_listed(spark):
    """A key with a third of all rows on both sides: the scores equal those over all pairs, from few rows."""
    rng = random.Random(4)
    key = lambda i: "hot" if i % 3 == 0 else f"k{i}"
    make = lambda: [(key(i), rng.randint(0, 9), rng.choice([1, 2, 3, 5, 8])) for i in range(600)]
    a, b = make(), make()
    schema = "issue_key string, actual_story_points int, predicted_story_points int"
    rag, norag = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    by_key = {}
    for k, x, p in b:
        by_key.setdefault(k, []).append(abs(p - x))
    deltas = [abs(p - x) - e for k, x, p in a for e in by_key.get(k, [])]
    row = metrics.paired_comparison(rag, norag).head()
    assert row.n_paired == len(deltas) == 200 * 200 + 400
    assert row.mean_abs_error_delta == pytest.approx(sum(deltas) / len(deltas))
    assert row.pct_rag_closer == pytest.approx(sum(d < 0 for d in deltas) / len(deltas))
    assert metrics.paired_errors(rag, norag).filter("issue_key = 'hot'").count() <= 100


def test_no_pairs(spark):
    df = results(spark, [(1, 1)])
    row = metrics.paired_comparison(df, df.withColumn("issue_key", F.lit("other"))).head()
    assert tuple(row) == (0, None, None)


def test_confidence_bands(spark):
    rows = [(0.54, 1, 3), (0.55, 1, 21), (0.69, 1, 21), (0.70, 2, 3), (None, 1, 21), (0.9, 2, 5)]
    df = spark.createDataFrame(rows, "rag_confidence double, actual_story_points int, predicted_story_points int")
    for frame in (df, df.withColumn("rag_confidence", F.coalesce(F.col("rag_confidence").cast("string"), F.lit("n/a")))):
        assert {tuple(r) for r in metrics.confidence_band_errors(frame).collect()} == {("high", 2, 2.0), ("low", 1, 2.0)}


def test_retrieval_stats(spark):
    rows = [
        ("AB-1", '[{"issue_key":"AB-2","story_points":3,"similarity":0.8},{"issue_key":"CD-1","story_points":8,"similarity":0.6}]'),
        ("AB-2", "[]"), ("AB-3", None), ("AB-4", "broken"), ("AB-5", '{"issue_key":"AB-2"}'),
    ]
    row = metrics.retrieval_stats(spark.createDataFrame(rows, "issue_key string, similar_tickets_json string")).head()
    assert tuple(row) == pytest.approx((5, 0.2, 0.8, 0.7, 5.0, 0.5))


def test_citation_checks(spark):
    near = '[{"issue_key":"ab-1","story_points":3,"similarity":0.8}]'
    rows = [
        ("cites", "Like AB-1. Story points: 3", 3, near, ""), ("invents", "Like AB-1 and ZZ-9", 3, near, ""),
        ("none", "no key", 3, near, ""), ("text", "Like CD-2", 3, None, "CD-2 (0.90)"), ("bare", "Like CD-2", 3, "[]", ""),
        ("contradicts", "AB-1: estimated at 8", 3, near, ""),
    ]
    df = spark.createDataFrame(rows, "issue_key string, reasoning string, predicted_story_points int, similar_tickets_json string, neighbour_keys string")
    row = review.automatic_checks(df).head()
    assert row.n == 6 and row.n_eligible_cite == 5
    assert row.pct_cites_neighbour == pytest.approx(4 / 5)
    assert row.pct_no_invented_keys == pytest.approx(4 / 6)  # a row without neighbours cites an invented key
    assert row.pct_sp_consistent == pytest.approx(5 / 6)


def test_rubric(spark):
    rows = [["1"] * 5, ["0", "1.0", "0.0", " 1 ", "0"], ["1", "1", "1", "1", ""], ["1", "1", "1", None, "1"], ["yes"] * 5]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in RUBRIC_COLUMNS))
    assert review.fully_labelled(df).count() == 2
    got = {r.rubric: r for r in review.rubric_rates(df).collect()}
    assert [got[c].positive for c in RUBRIC_COLUMNS] == [1, 2, 1, 2, 1]
    assert (got["useful"].labeled, got["useful"].unlabeled, got["useful"].rate) == (2, 3, 0.5) and got["useful"].mean_rate == pytest.approx(0.7)
    assert review.rubric_rates(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="useful"):
        review.rubric_rates(df.drop("useful"))


def test_hallucination_rates(spark):
    rows = [("a", "grounded"), ("a", "hallucinated"), ("b", "hallucinated"), ("c", "grounded"), ("d", ""), ("d", None)]
    df = spark.createDataFrame(rows, "issue_key string, label string")
    assert {tuple(r) for r in review.label_rates(df).collect()} == {("grounded", 2, 0.5), ("inferred", 0, 0.0), ("hallucinated", 2, 0.5)}
    row = review.hallucination_summary(df).head()
    assert (row.labeled, row.unlabeled, row.hallucinated, row.tickets, row.tickets_hallucinated) == (4, 2, 2, 3, 2)
    assert row.hallucination_rate == 0.5 and row.ticket_rate == pytest.approx(2 / 3)


def test_sheets(spark):
    row = dict.fromkeys(RESULTS.fieldNames())
    full = row | {
        "issue_key": "A-1", "title": "t", "description": "x" * 600, "predicted_story_points": 3, "reasoning": "r",
        "similar_tickets_json": '[{"issue_key":"B-1","similarity":0.825},{"issue_key":"B-2","similarity":0.5}]',
        "subtasks_json": '[{"title":"s","story_points":1,"reasoning":"why"},{"title":"u"}]',
    }
    df = spark.createDataFrame([tuple(full.values()), tuple((row | {"issue_key": "A-2"}).values())], RESULTS)
    (sheet,) = review.justification_sheet(df).collect()
    assert sheet.neighbour_keys == "B-1 (0.82), B-2 (0.50)" and len(sheet.ticket_description_snippet) == 503 and sheet.useful == ""
    got = review.subtask_sheet(df).collect()
    assert [(r.issue_key, r.subtask_title, r.subtask_reasoning, r.label) for r in got] == [("A-1", "s", "why", ""), ("A-1", "u", None, "")]


def test_profile_tables(spark):
    rows = [(None, "t", "d", "High", None), (1.0, " ", "dd", None, "P"), (2.5, None, None, " ", "Unknown"), (2.5, "t", "d", "Low", "P"), (1.5, "t", "", "Low", "P")]
    df = spark.createDataFrame(rows, "Story_Point double, Title string, Description_Text string, Priority string, Project_Name string")
    assert tuple(profile.dataset_summary(df).head()) == (5, 1, 2, 2, 3, 2, 3)
    assert [tuple(r) for r in profile.project_summary(df).collect()] == [("P", 3, 3, 100.0), ("Unknown", 1, 0, 0.0), ("Unknown", 1, 1, 100.0)]
    assert [(r.story_point_label, r["count"]) for r in profile.label_counts(df).collect()] == [("Missing", 1), ("1", 1), ("1.5", 1), ("2.5", 2)]
    assert [(r.story_point_label, r["count"]) for r in profile.rounded_label_counts(df).collect()] == [("Missing", 1), ("1", 1), ("2", 3)]
    assert tuple(profile.fractional_label_stats(df).head()) == (3, 3, 2)
    assert [tuple(r) for r in profile.priority_counts(df).collect()] == [("Low", 2), (" ", 1), ("High", 1), ("Missing", 1)]
    assert profile.dataset_summary(df.filter("false")).head().total == 0
    row = profile.describe_lengths(df).head()
    assert (row["count"], row.mean, row.min, row.p50, row.max) == (4, 1.0, 0, 1.0, 2) and row.std == pytest.approx(math.sqrt(2 / 3))
    bins = profile.length_histogram(df, bins=4).collect()
    assert [(r.bin, r["count"]) for r in bins] == [(1, 1), (2, 0), (3, 2), (4, 1)]
    constant = spark.createDataFrame([("abc",)] * 4, "Description_Text string")
    assert [r["count"] for r in profile.length_histogram(constant, bins=3).collect()] == [4, 0, 0]


def test_ablation_report_sections(spark):
    rag = results(spark, [(1, 2), (5, 5)]).withColumn("rag_confidence", F.lit(0.8)).withColumn("similar_tickets_json", F.lit("[]"))
    sections = {r.section for r in evaluate.ablation_report(rag, results(spark, [(1, 3), (5, 8)])).collect()}
    assert sections == {"rag", "norag", "paired", "retrieval", "confidence"}
    plain = results(spark, [(1, 2), (5, 5)])
    assert {r.section for r in evaluate.ablation_report(plain, plain).collect()} == {"rag", "norag", "paired"}


def test_constant_and_nearly_constant_columns_at_scale(spark):
    """Given counts of pairs of ten billion rows, no noise passes for a correlation."""
    n = 10_000_000_019
    constant = spark.createDataFrame([(3, p, n // (p + 2)) for p in range(5)], "actual int, predicted int, n long")
    assert metrics._rank_correlation(constant).head().spearman_rho is None
    nearly = spark.createDataFrame([(3, 3, n), (5, 8, 1), (3, 5, 4)], "actual int, predicted int, n long")
    (found,) = metrics._rank_correlation(nearly).collect()

    def ranks(counts):
        before, out = 0, {}
        for v in sorted(counts):
            out[v] = Fraction(2 * before + counts[v] + 1, 2)
            before += counts[v]
        return out

    total, a, p = n + 5, ranks({3: n + 4, 5: 1}), ranks({3: n, 5: 4, 8: 1})
    middle = Fraction(total + 1, 2)
    pairs = [(3, 3, n), (5, 8, 1), (3, 5, 4)]
    xy = sum(c * (a[x] - middle) * (p[y] - middle) for x, y, c in pairs)
    xx, yy = sum(c * (a[x] - middle) ** 2 for x, _, c in pairs), sum(c * (p[y] - middle) ** 2 for _, y, c in pairs)
    assert found.spearman_rho == pytest.approx(float(xy) / math.sqrt(xx) / math.sqrt(yy), rel=1e-9)


def test_p_of_many_rows(monkeypatch):
    """The normal limit agrees with the continued fraction where both hold, and with erfc far beyond."""
    for t in (0.5, 1.0, 2.5, 5.0):
        n = 150_000
        rho = t / math.sqrt(n - 2 + t * t)
        near = stats.two_sided_p(rho, n)
        monkeypatch.setattr(stats, "NORMAL_FROM", 10 ** 9)
        assert near == pytest.approx(stats.two_sided_p(rho, n), rel=1e-8)
        monkeypatch.setattr(stats, "NORMAL_FROM", 100_000)
        assert stats.two_sided_p(t / math.sqrt(1e11), 1e11) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-8)
    with pytest.raises(ArithmeticError):
        stats._beta_fraction(1e12, 1e12, 0.5)


def test_fractions_are_refused(spark):
    df = spark.createDataFrame([("k", 1.5, 2)], "issue_key string, actual_story_points double, predicted_story_points int")
    with pytest.raises(ValueError, match="whole numbers"):
        metrics.error_metrics(df)
