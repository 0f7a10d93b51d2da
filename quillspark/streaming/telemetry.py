"""Live practice telemetry: windowed accuracy and per-learner state over a stream of events.

Streams are read with a stated schema. Reports that must equal a batch lose no event, however late (``keyed.py``);
``deduplicated`` and ``practice_bursts`` drop what comes after their watermark, as their names in Spark say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.streaming import keyed

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ANCHOR = "2 days"  # the report's weeks begin on a Wednesday; windows on a Thursday


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events from files as they come; ``at`` is their time in UTC, whatever the session's zone."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("at", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))


#: Accuracy in units of 1e-4, so that sums don't depend on the order of events.
_ACCURACY = "least(10000, CAST(round(value * 100) AS BIGINT))"


def weekly_accuracy(events: DataFrame) -> DataFrame:
    """Sessions and mean accuracy of each week and kind of event.

    Without a watermark no event is late. State is one row for each week and kind, some hundreds in ten years, so none need go.
    """
    return events.groupBy(F.window("at", "7 days", "7 days", ANCHOR), "event_type").agg(F.count("*").alias("sessions"), (F.sum(F.expr(_ACCURACY)) / F.count("*") / 10000).alias("accuracy"))


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once; a session is completed once however often that is sent."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def practice_bursts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a learner's sessions with no longer pause than ``gap``."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("sessions"))


def stroke_guidance(events: DataFrame, late: str = "365 days") -> DataFrame:
    """Tries of every stroke of a learner's day, and the pauses before them in order of time; ``events`` have a ``stroke`` and a ``pause``.

    A day's state goes once the watermark has passed the last of the ``keyed.SPAN`` days that are kept together; events that come later still are rows of their own, with ``late`` true.
    """
    days = keyed.untied(events, late).withColumn("day", F.expr("ms div 86400000")).withColumn("span", F.expr(f"CAST(floor(day / {keyed.SPAN}) AS BIGINT)"))
    return days.groupBy("user_id", "span").transformWithState(keyed.Guidance(), keyed.Guidance.OUTPUT, "Update", "EventTime")


def attempts(events: DataFrame, late: str = "365 days") -> DataFrame:
    """Per learner so far: sessions, completed ones, the running mean of accuracy, the longest run of completed ones in order of time, late events.

    State is six numbers and, for the days that the watermark hasn't passed, their events. Late events count in all but the run.
    """
    rows = keyed.untied(events.withColumn("units", F.expr(_ACCURACY)), late)
    state = rows.groupBy("user_id").transformWithState(keyed.Attempts(), keyed.Attempts.OUTPUT, "Update", "EventTime")
    return state.select("user_id", "sessions", "completed", F.expr("try_divide(units, completed) / 10000").alias("accuracy"), "best_run", "late")


def day_points(events: DataFrame, xp: str, cap: int) -> DataFrame:
    """Points of each learner's day as they grow: ``xp`` is what an event brings, ``cap`` what a day counts at most. Every change is a row. Events without a time belong to no day."""
    rows = events.where("at IS NOT NULL").selectExpr("user_id", "unix_millis(at) div 86400000 AS day", f"coalesce(CAST({xp} AS long), 0) AS xp")
    return rows.groupBy("user_id", "day").transformWithState(keyed.DayPoints(cap), keyed.DayPoints.OUTPUT, "Append", "None")


def streaks(days: DataFrame) -> DataFrame:
    """Points and runs of active days of each learner, kept on top of ``day_points``. Every change is a row."""
    return days.groupBy("user_id").transformWithState(keyed.Streak(), keyed.Streak.OUTPUT, "Append", "None")


def drained(df: DataFrame, sink, mode: str, checkpoint: str) -> None:
    """Run a stream over all there is, batch by batch, into ``sink(batch, number)``."""
    with keyed.keyed_store(df.sparkSession):
        df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
