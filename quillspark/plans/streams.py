"""Streams over the events table, run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import practice
from quillspark.operators.base import DUCK, Operator
from quillspark.registry import query
from quillspark.runtime import prepare, shared_folder
from quillspark.sources.views import subquery
from quillspark.streaming import telemetry


def _collected(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """What a stream has said in the end: the last row of each key. The table is written in the shared folder."""
    path = shared_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.selectExpr("*", f"{number} AS batch").write.mode("append").parquet(f"{path}/rows")

    telemetry.drained(stream, put, mode, f"{path}/state")
    rows = spark.read.parquet(f"{path}/rows")
    names = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in names])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return telemetry.read_events(spark, f"{sf_dir}/events.parquet*")


_ACC = "least(10000, CAST(round(value * 100) AS BIGINT))"

_ATTEMPTS = f"""
WITH e AS (SELECT *, event_type <> 'error' AS done, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, count(*) AS n FROM e WHERE done GROUP BY user_id, island)
SELECT e.user_id, count(*) AS sessions, count(CASE WHEN done THEN 1 END) AS completed, round(CAST(sum(CASE WHEN done THEN {_ACC} END) AS DOUBLE) / count(CASE WHEN done THEN 1 END) / 10000, 6) AS accuracy,
       CAST(coalesce((SELECT max(n) FROM r WHERE r.user_id = e.user_id), 0) AS BIGINT) AS best_run
FROM e GROUP BY e.user_id"""


@query("stateful_attempts_stream", _ATTEMPTS)
def stateful_attempts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per learner: sessions, completions, the running mean and the longest run, kept as state."""
    return _collected(spark, telemetry.attempts(_events(spark, sf_dir)), "update", ["user_id"]).withColumn("accuracy", F.round("accuracy", 6)).drop("late")


_WEEKS = f"""
SELECT CAST(floor((epoch(ts) - 172800) / 604800) * 604800 + 172800 AS BIGINT) AS week, event_type, count(*) AS sessions, round(CAST(sum({_ACC}) AS DOUBLE) / count(*) / 10000, 6) AS accuracy
FROM events GROUP BY 1, 2"""


@query("weekly_window_stream", _WEEKS)
def weekly_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly windows of each kind of event; a week is named by the seconds at its start."""
    weeks = telemetry.weekly_accuracy(_events(spark, sf_dir)).select(F.unix_seconds("window.start").alias("week"), "event_type", "sessions", F.round("accuracy", 6).alias("accuracy"))
    return _collected(spark, weeks, "update", ["week", "event_type"])


_GUIDANCE = """
SELECT user_id, day, stroke, count(*) AS attempts, string_agg(CAST(ms AS VARCHAR), ',' ORDER BY ts, event_id) AS hesitations
FROM (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CAST(event_id % 4 AS INT) AS stroke, CAST(floor(value * 40) AS INT) AS ms FROM events) GROUP BY user_id, day, stroke"""


@query("stroke_guidance_stream", _GUIDANCE)
def stroke_guidance_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidance events: tries of every stroke of a learner's day, and the pauses before them in order."""
    events = _events(spark, sf_dir).withColumns({"stroke": F.expr("CAST(event_id % 4 AS INT)"), "pause": F.expr("CAST(floor(value * 40) AS INT)")})
    told = _collected(spark, telemetry.stroke_guidance(events), "update", ["user_id", "day", "stroke", "late"])
    return told.where("NOT late").select("user_id", "day", "stroke", "attempts", F.array_join(F.col("hesitations").cast("array<string>"), ",").alias("hesitations"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed sessions and what each brings before the daily cap."""
    completed = _events(spark, sf_dir).where("event_type <> 'error'")
    return telemetry.day_points(completed, practice.xp_of("event_type", f"({_ACC})"), practice.DAILY_XP)


def _sql(op: Operator) -> str:
    return op.sql(DUCK, **{i: subquery(i) for i in op.inputs})


@query("daily_xp_stream", _sql(practice.daily_xp_capped))
def daily_xp_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each day under the daily cap, kept as state."""
    days = _collected(spark, _points(spark, sf_dir), "append", ["user_id", "day"])
    return days.select("user_id", "day", "raw_xp", "xp_earned", F.expr(f"greatest(0, {practice.DAILY_XP} - raw_xp)").alias("daily_xp_remaining"))


_STREAKS = f"""
SELECT s.user_id, l.total_xp, s.last_active_day, s.current_streak, s.longest_streak FROM ({_sql(practice.streaks)}) s JOIN ({_sql(practice.level_from_xp)}) l ON l.user_id = s.user_id"""


@query("streak_stream", _STREAKS)
def streak_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points under the daily cap and runs of active days of each learner: two keyed states, one on top of the other."""
    return _collected(spark, telemetry.streaks(_points(spark, sf_dir)), "append", ["user_id"])
