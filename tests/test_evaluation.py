import pytest
from pyspark.sql import functions as F

from loomgraph.functions.fuzzy import fuzzy_pairs, token_sort_similarity
from loomgraph.operators import evaluation, sampling


def test_gate_confusion(spark):
    rows = spark.createDataFrame([("a", "test", "yes", "2", True), ("a", "test", "no", "0", True), ("a", "development", "yes", "2", False), ("a", "test", "unclear", "U", True)], "g string, split string, span_label string, support_label string, keep boolean")
    out = {(r["split"]): r for r in evaluation.gate_confusion(rows, {"k": F.col("keep")}, "g", "split").collect()}
    whole = out["all"]
    assert (whole["tp"], whole["fp"], whole["fn"], whole["tn"], whole["retained"]) == (1, 1, 1, 0, 3)
    assert whole["strict_among_retained"] == 0.5 and out["development"]["ppv"] is None


def test_support_statistics_bounds(spark):
    rows = spark.createDataFrame([("g", "1", x) for x in ("2", "2", "1", "0", "U")], "g string, source_pmid string, support_label string")
    r = evaluation.support_statistics(rows, "g").first()
    assert r["strict_support"] == 0.5 and r["lenient_support"] == 0.75 and (r["strict_low"], r["strict_high"]) == (0.4, 0.6)


def test_fuzzy_pairs_lose_nothing(spark):
    left = ["motor neuron one", "smn", "smn1", "survival motor neuron", "abc def ghi", "x", ""]
    right = ["neuron motor one", "smn2", "smn1", "survival motor neurons", "def abc ghj", "xy", "motor neurone one"]
    expected = {(a, b) for a in left for b in right if a.strip() and b.strip() and token_sort_similarity(a, b) >= 85}
    found = fuzzy_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b")
    assert {(r["a"], r["b"]) for r in found.collect()} == expected and expected


def test_kappa(spark):
    rows = spark.createDataFrame([("2", "2"), ("2", "1"), ("0", "0"), ("1", "1")], "a string, b string")
    r = evaluation.cohen_kappa(rows, "a", "b").first()
    assert r["raw_agreement"] == 0.75 and r["cohen_kappa"] == pytest.approx((0.75 - 0.3125) / (1 - 0.3125))
    same = spark.createDataFrame([("2", "2")], "a string, b string")
    assert evaluation.cohen_kappa(same, "a", "b").first()["cohen_kappa"] is None


def _reviews(spark, changes=()):
    base = {c: "" for c in ("second_support_label", "adjudicated_label", "second_reviewer_id", "second_review_date", "adjudication_notes")}
    base |= {c: "yes" for c in evaluation.CHECKS} | {"support_label": "2", "review_status": "completed", "requires_second_review": "no", "reviewer_id": "r", "review_date": "d", "error_type": "none", "review_notes": "n", "sample_group": "primary_random"}
    rows = [dict(base, candidate_id="1"), dict(base, candidate_id="2", support_label="0"), dict(base, candidate_id="3", sample_group="challenge")]
    for k, change in changes:
        rows[k] |= change
    return spark.createDataFrame(rows)


def test_reviews_pending_is_not_zero(spark):
    out = {r["sample_group"]: r for r in evaluation.review_summary(_reviews(spark)).collect()}
    assert out["primary_random"]["strict_rate"] == 0.5 and out["challenge"]["strict_rate"] == 1.0
    pending = evaluation.review_summary(_reviews(spark, [(1, {"support_label": "", "review_status": "pending_review"})]))
    out = {r["sample_group"]: r for r in pending.collect()}
    assert out["primary_random"]["strict_rate"] is None and out["challenge"]["ready"]


def test_reviews_adjudication_and_identity_block(spark):
    open_ = _reviews(spark, [(0, {"requires_second_review": "yes", "second_support_label": "1", "second_reviewer_id": "s", "second_review_date": "d"})])
    assert {r["candidate_id"]: r["final"] for r in evaluation.review_issues(open_).collect()}["1"] is False
    no_name = _reviews(spark, [(0, {"reviewer_id": ""})])
    issues = {r["candidate_id"]: r["issues"] for r in evaluation.review_issues(no_name).collect()}
    assert "incomplete_primary_review" in issues["1"]


def test_challenge_sample_is_deterministic_and_unique(spark):
    rows = spark.createDataFrame([(f"k{i}", "R%d" % (i % 3), 0.5 + i / 100) for i in range(30)], "key string, relation string, computed_confidence double")
    a = sampling.challenge(rows, 20, 15, 42, ["key"], F.lit(True)).collect()
    b = sampling.challenge(rows.repartition(3), 20, 15, 42, ["key"], F.lit(True)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len({r["key"] for r in a}) == 20
    assert sum(r["sample_group"] == "primary_random" for r in a) == 15 and sum(r["requires_second_review"] for r in a) == 4


def test_bootstrap_interval_holds_the_rate(spark):
    rows = spark.createDataFrame([(str(i % 40), i % 4 == 0) for i in range(400)], "c string, hit boolean")
    r = sampling.cluster_bootstrap(rows, "c", F.col("hit"), 200).first()
    assert r["low"] <= 0.25 <= r["high"] and r["high"] - r["low"] < 0.6
