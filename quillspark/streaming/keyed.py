"""Keyed state over streams that loses no event, in whatever order events come.

State is kept so that the order of arrival doesn't matter: counts and sums as such, days as their events in order of time
until the day is closed, active days as joined intervals. Event-time timers close a day once the watermark has passed it; the watermark is
no filter here (see ``untied``): an event that comes after its day was closed still counts where it can, and is told as late, as is one without a
time. Times are days of UTC.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for streams that start within; the session's own setting returns afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def untied(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark on ``at`` that drives timers and drops nothing: ``ms`` tells the time to operators, not the watched column."""
    return events.withWatermark("at", late).selectExpr("* EXCEPT (at)", "unix_millis(at) AS ms", "unix_micros(at) AS us")


class Runs:
    """Completed sessions in a row, as a summary that joins with the next one: (sessions, at the beginning, at the end, most)."""

    NONE = (0, 0, 0, 0)

    @staticmethod
    def of(done: list[bool]) -> tuple[int, int, int, int]:
        best = run = 0
        for x in done:
            run = run + 1 if x else 0
            best = max(best, run)
        head = next((i for i, x in enumerate(done) if not x), len(done))
        return len(done), head, run, best

    @staticmethod
    def joined(a: tuple, b: tuple) -> tuple[int, int, int, int]:
        return a[0] + b[0], a[1] + b[1] if a[1] == a[0] else a[1], b[2] + a[2] if b[2] == b[0] else b[2], max(a[3], b[3], a[2] + b[1])


class Attempts(StatefulProcessor):
    """Per learner: sessions, completed ones, their summed accuracy, the longest run of completed ones, and events that came after their day was closed.

    An open day keeps its events; when the watermark passes it, a timer folds it into the summary of all earlier days. A late event counts
    in everything but the run.
    """

    OUTPUT = "user_id long, sessions long, completed long, units long, best_run long, late long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "sessions long, completed long, units long, late long")
        self.past = handle.getValueState("past", "n long, head long, tail long, best long")
        self.events = handle.getMapState("events", "day long", "at array<long>, id array<long>, done array<boolean>")
        self.days = handle.getMapState("days", "day long", "n long, head long, tail long, best long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, done, units, late = self.totals.get() or (0, 0, 0, 0)
        closed = timerValues.getCurrentWatermarkInMs()
        new: dict[int, list[tuple]] = {}
        for r in rows:
            completed = r.event_type != "error"
            n, done, units = n + 1, done + completed, units + (r.units or 0) * completed
            day = None if r.ms is None else r.ms // DAY_MS
            if day is None or (day + 1) * DAY_MS <= closed:
                late += 1
            else:
                new.setdefault(day, []).append((r.us, r.event_id, completed))
        for day, more in new.items():
            held = self.events.getValue((day,))
            if held is None:
                self.handle.registerTimer((day + 1) * DAY_MS)
            at_day = sorted([*zip(*held, strict=True), *more] if held else more)
            self.events.updateValue((day,), tuple(list(x) for x in zip(*at_day, strict=True)))
            self.days.updateValue((day,), Runs.of([x[2] for x in at_day]))
        self.totals.update((n, done, units, late))
        runs = self.past.get() or Runs.NONE
        for _, day in sorted(((k[0], tuple(v)) for k, v in self.days.iterator())):
            runs = Runs.joined(tuple(runs), day)
        yield Row(user_id=key[0], sessions=n, completed=done, units=units, best_run=runs[3], late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs()
        runs = tuple(self.past.get() or Runs.NONE)
        for day, summary in sorted((k[0], tuple(v)) for k, v in self.days.iterator()):
            if (day + 1) * DAY_MS <= closed:
                runs = Runs.joined(runs, summary)
                self.days.removeKey((day,))
                self.events.removeKey((day,))
        self.past.update(runs)
        return iter(())

    def close(self) -> None:
        pass


#: Days of a learner that are one key of guidance.
SPAN = 32


class Guidance(StatefulProcessor):
    """Of a learner's days: tries of every stroke, and the pauses before them in order of time. What comes after its day was closed is told on its own, as late.

    A key is a learner's ``SPAN`` days and their events one value, so that a batch takes one read and one write of state for all of them. The state goes
    when the last of these days is closed.
    """

    OUTPUT = "user_id long, day long, stroke int, attempts long, hesitations array<int>, late boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "day array<long>, stroke array<int>, at array<long>, id array<long>, pause array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        user, span = key
        closed = timerValues.getCurrentWatermarkInMs()
        told: dict[tuple, list] = {}
        before: dict[tuple, list] = {}
        kept = []
        for r in rows:
            late = r.day is None or (r.day + 1) * DAY_MS <= closed
            told.setdefault((r.day, r.stroke, late), []).append((r.us, r.event_id, r.pause))
            if not late:
                kept.append((r.day, r.stroke, r.us, r.event_id, r.pause))
        if kept:
            held = self.held.get()
            if held is None:
                self.handle.registerTimer((span + 1) * SPAN * DAY_MS)
            else:
                for day, stroke, *x in zip(*held, strict=True):
                    before.setdefault((day, stroke, False), []).append(tuple(x))
                kept = [*zip(*held, strict=True), *kept]
            self.held.update(tuple(list(x) for x in zip(*kept, strict=True)))
        for (day, stroke, late), new in told.items():
            mine = sorted([*before.get((day, stroke, late), ()), *new], key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0))
            yield Row(user_id=user, day=day, stroke=stroke, attempts=len(mine), hesitations=[x[2] for x in mine], late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class DayPoints(StatefulProcessor):
    """Points of a learner's day so far, and what they add to those under the cap."""

    OUTPUT = "user_id long, day long, raw_xp long, xp_earned long, more_xp long, new_day boolean"

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.raw = handle.getValueState("raw", "xp long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.raw.get()
        before = held[0] if held else 0
        now = before + sum(r.xp for r in rows)
        self.raw.update((now,))
        earned = min(now, self.cap)
        yield Row(user_id=key[0], day=key[1], raw_xp=now, xp_earned=earned, more_xp=earned - min(before, self.cap), new_day=held is None)

    def close(self) -> None:
        pass


class Streak(StatefulProcessor):
    """A learner's points and runs of active days. A run is kept under its first and under its last day, so that a day joins its neighbours in a few lookups."""

    OUTPUT = "user_id long, total_xp long, last_active_day long, current_streak long, longest_streak long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "xp long, last_day long, longest long")
        self.last_of = handle.getMapState("last_of", "first long", "last long")
        self.first_of = handle.getMapState("first_of", "last long", "first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        xp, last_day, longest = self.totals.get() or (0, None, 0)
        for r in rows:
            xp += r.more_xp
            if not r.new_day:
                continue
            first = last = r.day
            if before := self.first_of.getValue((r.day - 1,)):
                first = before[0]
                self.first_of.removeKey((r.day - 1,))
            if after := self.last_of.getValue((r.day + 1,)):
                last = after[0]
                self.last_of.removeKey((r.day + 1,))
            self.last_of.updateValue((first,), (last,))
            self.first_of.updateValue((last,), (first,))
            last_day = r.day if last_day is None else max(last_day, r.day)
            longest = max(longest, last - first + 1)
        self.totals.update((xp, last_day, longest))
        yield Row(user_id=key[0], total_xp=xp, last_active_day=last_day, current_streak=last_day - self.first_of.getValue((last_day,))[0] + 1, longest_streak=longest)

    def close(self) -> None:
        pass
