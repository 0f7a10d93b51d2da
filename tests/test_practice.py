"""Boundaries of the rules over hand-made sessions."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import curriculum, practice

COLUMNS = "id int, user_id int, module_type string, k int, target_item string, difficulty string, difficulty_rank int, acc long, completed boolean, status string, seconds long, ts timestamp, day long, dow int, age_seconds long, first_ms long, pause_1 long, pause_2 long, tries_1 int, tries_2 int, scores string"
DAY = 86400


def session(i, acc, age_days, user=1, item="A", module="click", done=True, rank=0, tries=(1, 1), pauses=(0, 0, 0)):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 31) - timedelta(days=age_days)
    names = ["beginner", "intermediate", "advanced"]
    return (i, user, module, 0, item, names[rank], rank, acc, done, "completed" if done else "abandoned", 30, at, 19753 - int(age_days), 3, int(age_days * DAY), *pauses, *tries, json.dumps({"time_before_first_stroke_ms": pauses[0], "hesitation_ms_per_stroke": [{"stroke_id": 1, "ms": pauses[1]}, {"stroke_id": 2, "ms": pauses[2]}], "stroke_attempt_counts": {"1": tries[0], "2": tries[1]}}))


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), COLUMNS)


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(("weeks", "trend"), [((0.5, 0.6, 0.7, 0.8), "improving"), ((0.8, 0, 0, 0.5), "declining"), ((0, 0, 0, 0.9), "stable"), ((0.5, 0, 0, 0.54), "stable")])
def test_trend_looks_only_at_busy_weeks(frame, weeks, trend):
    rows = [session(i, int(w * 10000), 3 + 7 * (3 - i)) for i, w in enumerate(weeks) if w]
    r = one(practice.weekly_accuracy_by_user(sessions=frame(*rows)))
    assert [r[f"week_{i}"] for i in (1, 2, 3, 4)] == list(weeks) and r["trend"] == trend


@pytest.mark.parametrize(("n", "velocity"), [(3, "slow"), (4, "steady"), (11, "steady"), (12, "fast")])
def test_velocity(frame, n, velocity):
    assert one(practice.learning_velocity(sessions=frame(*[session(i, 5000, 1 + i / 10) for i in range(n)])))["velocity"] == velocity


def test_items_need_two_completions_and_the_worst_are_not_the_best(frame):
    rows = [session(i, a, 1 + i / 100, item=item) for i, (item, a) in enumerate([("A", 9000), ("A", 9000), ("B", 2000), ("B", 2000), ("C", 100)])]
    got = {(r.target_item, r.kind) for r in practice.best_worst_items(sessions=frame(*rows)).collect()}
    assert got == {("A", "best"), ("B", "best")}
    got = {(r.target_item, r.kind) for r in practice.best_worst_items(sessions=frame(*rows), top=1).collect()}
    assert got == {("A", "best"), ("B", "worst")}


@pytest.mark.parametrize(("days", "current", "longest", "status"), [((0.5, 1.5, 2.5), 3, 3, "active"), ((1.5, 2.5, 9.5), 2, 2, "active"), ((0.5, 4.5, 5.5, 6.5), 1, 3, "active")])
def test_streaks(frame, days, current, longest, status):
    r = one(practice.streaks(sessions=frame(*[session(i, 5000, d) for i, d in enumerate(days)])))
    assert (r["current_streak"], r["longest_streak"]) == (current, longest)


@pytest.mark.parametrize(("acc", "xp"), [(9000, 10), (8999, 5), (7000, 5), (6999, 2), (5000, 2), (4999, 1), (0, 1)])
def test_xp_tiers(frame, acc, xp):
    assert one(practice.daily_xp_capped(sessions=frame(session(1, acc, 1))))["raw_xp"] == xp


def test_daily_cap_and_levels(frame):
    rows = [session(i, 9500, 1 + i / 1000) for i in range(30)]
    r = one(practice.daily_xp_capped(sessions=frame(*rows)))
    assert (r["raw_xp"], r["xp_earned"], r["daily_xp_remaining"]) == (300, 250, 0)
    assert practice.session_awards(sessions=frame(*rows)).agg(F.sum("xp_earned")).first()[0] == 250
    r = one(practice.level_from_xp(sessions=frame(*rows)))
    assert (r["level"], r["xp_to_next"]) == (3, 50)


@pytest.mark.parametrize(("acc", "rank", "to"), [(8500, 0, "intermediate"), (8499, 0, "beginner"), (5000, 1, "beginner"), (5001, 1, "intermediate"), (9999, 2, "advanced"), (0, 0, "beginner")])
def test_difficulty_steps(frame, acc, rank, to):
    assert one(practice.difficulty_recommendation(sessions=frame(*[session(i, acc, 1 + i, rank=rank) for i in range(3)])))["difficulty"] == to


def test_promotions_and_demotions_follow_time(frame):
    rows = [session(i, 5000, 9 - i, rank=r) for i, r in enumerate([0, 1, 2, 1, 1, 0])]
    r = one(practice.level_changes(sessions=frame(*rows)))
    assert (r["promotions_count"], r["demotions_count"]) == (2, 2)


def test_recovery_compares_first_two_attempts(frame):
    rows = [session(1, 4000, 5), session(2, 6000, 4), session(3, 9999, 3), session(4, 1, 2, item="B")]
    r = one(practice.retry_recovery(sessions=frame(*rows)))
    assert (r["items_analyzed"], r["avg_improvement"], r["recovers_quickly"]) == (1, 0.2, True)


def test_frustration_and_confidence(frame):
    hard = one(practice.engagement_confidence(sessions=frame(*[session(i, 5000, i + 1, tries=(5, 5), pauses=(1, 3000, 3400)) for i in range(3)])))
    easy = one(practice.engagement_confidence(sessions=frame(*[session(i, 9000, i + 1, tries=(1, 1), pauses=(1, 200, 300)) for i in range(3)])))
    assert (hard["frustration"], hard["confidence"]) == ("high", "low") and (easy["frustration"], easy["confidence"]) == ("low", "high")


def test_abandoned_sessions(frame):
    assert one(practice.abandon_rate(sessions=frame(session(1, 0, 1, done=False), session(2, 1, 2), session(3, 1, 40))))["abandon_rate"] == 0.5


def test_mastery_decays_and_gates(frame):
    fresh = one(curriculum.item_mastery(sessions=frame(*[session(i, 9000, 0.1 + i / 10) for i in range(3)])))
    stale = one(curriculum.item_mastery(sessions=frame(*[session(i, 9000, 30 + i) for i in range(3)])))
    assert fresh["motor"] == 0.9 and abs(stale["motor"] - 0.6) < 1e-9 and fresh["confidence"] == 0.9
    assert curriculum.confidence_gate(sessions=frame(*[session(i, 9000, 0.1 + i / 10) for i in range(3)])).first().passes
    assert not curriculum.confidence_gate(sessions=frame(*[session(i, 9000, 0.1 + i / 10) for i in range(2)])).first().passes


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    for op in (practice.dashboard_summary, practice.weekly_accuracy_by_user, curriculum.recommend_items, curriculum.learning_journey):
        assert op(sessions=empty).count() == 0


def test_telemetry_comes_out_of_nested_json(frame):
    """Means over all entries of the latest sessions, values of no pause left out, items by their own means."""
    rows = frame(session(1, 8000, 3, item="A", pauses=(1000, 500, 0), tries=(1, 5)), session(2, 8000, 2, item="B", pauses=(3000, 100, 300), tries=(3, 1)), session(3, 8000, 1, item="C", done=False, pauses=(9000, 9000, 9000), tries=(9, 9)))
    assert one(practice.hesitation_profile(sessions=rows)) == {"user_id": 1, "avg_pause_before_first_ms": 2000.0, "avg_pause_between_ms": 300.0, "high_hesitation_items": "A,B", "low_hesitation_items": ""}
    assert one(practice.retry_pattern(sessions=rows)) == {"user_id": 1, "avg_retries_per_stroke": 2.5, "failsafe_unlock_rate": 0.25, "total_strokes": 4, "high_retry_items": "A,B"}
    assert one(practice.replay_usage(sessions=rows)) == {"user_id": 1, "replay_rate": 0.5, "replay_beneficial": True, "most_replayed": "A,B"}
    assert one(practice.retry_pattern(sessions=rows, last=1))["total_strokes"] == 2


def test_sessions_without_a_time_change_levels_last(spark):
    rows = [(1, "a", 0, "2024-01-01 00:00:00", 1), (1, "a", 2, None, 2), (1, "a", 1, "2024-01-02 00:00:00", None)]
    df = spark.createDataFrame(rows, "user_id long, module_type string, difficulty_rank int, ts string, id long").selectExpr("*", "true AS completed")
    r = practice.level_changes(sessions=df).first()
    assert (r.promotions_count, r.demotions_count) == (2, 0)
