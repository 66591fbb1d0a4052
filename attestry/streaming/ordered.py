"""T2-T4 as stateful processors: rows wait in the state store until the watermark has passed.

Every read, write and timer is a call from Python to the store and costs far more than a row, and
so does every row that a processor returns.  So keys are dealt over BUCKETS by their hash, a
bucket is what the engine takes for a key, and what it holds of its keys is one value with one
timer; what it says is one row of lists, unpacked by the engine.

`InOrder` lets the rows of each key through by event time, however they arrive.  A bucket keeps up
to HOLD rows beside what it remembers.  Are there more, they are dealt over slices of time, each
with a timer at its end: slices fire in order of time once the watermark is there, and rows that
come are put away by HOLD at a time.  So what is in memory is HOLD rows, or one slice.  Rows behind
the watermark are dropped by the engine (`jobs.route_late` keeps such rows), so every row that
comes is judged at its own place.

State needs the RocksDB provider (`jobs.land` sets it).  What a key remembers is one number, and
a timer removes it when it can matter no longer.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 1024
HOLD = 5000
SLICES = 64

Times = list[tuple[int, int | None]]


def bucket_of(key: str) -> Column:
    """The bucket of a key.  A bucket's keys are read and written together, at a micro-batch that has any of them."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _by_time(rows: Times) -> Times:
    """Rows of the same time go by `event_id`, those without one first."""
    try:
        return sorted(rows)
    except TypeError:
        return sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1]))


Judged = Iterator[tuple[str, Times, list[tuple]]]
_TOLD = Row("key", "event_id", "us", "allowed", "wait_s")


def told_by_row(judged: Judged) -> Iterator[Row]:
    for key, rows, said in judged:
        for (us, event_id), verdict in zip(rows, said, strict=True):
            yield _TOLD(key, event_id, us, *verdict)


def told_in_lists(judged: Judged) -> Iterator[Row]:
    """One row with a list in each column.  All that a task's timers tell is in memory at once, so lists are arrays
    where they can be, and a key is there once."""
    keys, ids, times, verdicts = [], [], [], []
    for key, rows, said in judged:
        keys += [key if key is None else sys.intern(key)] * len(rows)
        times += [r[0] for r in rows]
        ids += [r[1] for r in rows]
        verdicts += said
    if keys:
        allowed, wait = zip(*verdicts, strict=True)
        yield _TOLD(
            keys, ids if None in ids else np.array(ids, dtype="int64"), np.array(times, dtype="int64"),
            np.array(allowed, dtype="bool"), np.array(wait, dtype="float64"),
        )


class InOrder(StatefulProcessor):
    """Calls step(value, us) → (new value, what to say) on each row of a key in time order.

    `value` is a number, None at first; `until(value)` is the time in microseconds from which
    on it is as good as none.  A group's rows may be of many keys, named in `key`.
    """

    def __init__(
        self, step: Callable[[float | None, int], tuple[float, tuple]], until: Callable[[float], float],
        tell: Callable[[Judged], Iterator[Row]] = told_by_row,
    ):
        self._step, self._until, self._tell = step, until, tell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # what is remembered of each key, the rows that wait here, the parts of each slice, the width of a slice in
        # milliseconds, the time of the timer
        self._held = handle.getValueState("held", "packed binary")
        self._rows = handle.getMapState("rows", "slice bigint, part int", "packed binary")

    def _load(self) -> tuple[dict[str, float], dict[str, Times], dict[int, int], int, int | None]:
        held = self._held.get()
        return ({}, {}, {}, 0, None) if held is None else pickle.loads(held[0])

    def _save(self, *held) -> None:
        self._held.update((pickle.dumps(held, 5),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, waiting, parts, width, timer = self._load()
        n, first = sum(map(len, waiting.values())), None
        for row in rows:
            us = row.us
            waiting.setdefault(getattr(row, "key", key[0]), []).append((us, row.event_id))
            n += 1
            if parts:
                self._expect(us, parts, width)
            elif first is None or us < first:
                first = us
            if n > HOLD:
                if not parts:
                    times = sorted(r[0] for some in waiting.values() for r in some)
                    # most rows lie in the slices, whatever a few of them are far away
                    width = (times[3 * n // 4] - times[n // 4]) * 2 // SLICES // 1000 + 1
                    for us in times:
                        self._expect(us, parts, width)
                self._put_away(waiting, parts, width)
                waiting, n = {}, 0
        if not parts and first is not None:
            due = first // 1000 + 1
            if timer is None or due < timer:
                self._handle.registerTimer(due)
                timer = due
        self._save(known, waiting, parts, width, timer)
        return iter([])

    def _expect(self, us: int, parts: dict[int, int], width: int) -> None:
        """See that the slice of a row has a timer."""
        place = us // 1000 // width
        if place not in parts:
            parts[place] = 0
            self._handle.registerTimer((place + 1) * width)

    def _put_away(self, waiting: dict[str, Times], parts: dict[int, int], width: int) -> None:
        """Deal rows over their slices."""
        places: dict[int, dict[str, Times]] = {}
        for key, rows in waiting.items():
            for row in rows:
                places.setdefault(row[0] // 1000 // width, {}).setdefault(key, []).append(row)
        for place, some in places.items():
            self._rows.updateValue((place, parts[place]), (pickle.dumps(some, 5),))
            parts[place] += 1

    def _take(self, place: int, n: int, passed: dict[str, Times]) -> None:
        """Add the rows of a slice to `passed`."""
        for part in range(n):
            for key, rows in pickle.loads(self._rows.getValue((place, part))[0]).items():
                passed.setdefault(key, []).extend(rows)
            self._rows.removeKey((place, part))

    def _judge(self, known: dict[str, float], passed: dict[str, Times]) -> Judged:
        for key, rows in passed.items():
            value, said, rows = known.get(key), [], _by_time(rows)
            for us, _ in rows:
                value, verdict = self._step(value, us)
                said.append(verdict)
            known[key] = value
            yield key, rows, said

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, waiting, parts, width, timer = self._load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if parts:
            ends = [place for place in sorted(parts) if (place + 1) * width <= now]
            if not ends:
                return
            for place in ends:
                passed, waiting = _split(waiting, (place + 1) * width * 1000 - 1)
                self._take(place, parts.pop(place), passed)
                yield from self._tell(self._judge(known, passed))
            now = (ends[-1] + 1) * width
        else:
            passed, waiting = _split(waiting, now * 1000)
            if not passed and timer is not None and timer > now:
                return  # set for rows that went with others
            yield from self._tell(self._judge(known, passed))
        known = {k: value for k, value in known.items() if self._until(value) > now * 1000}
        if not parts:
            if not waiting and not known:
                self._held.clear()
                return
            due = min(min(r[0] for r in rows) for rows in waiting.values()) if waiting else max(map(self._until, known.values()))
            due = int(due // 1000) + 1
            if timer is None or timer <= now or due < timer:
                self._handle.registerTimer(due)
                timer = due
        self._save(known, waiting, parts, width, timer)

    def close(self) -> None:
        pass


def _split(waiting: dict[str, Times], us: int) -> tuple[dict[str, Times], dict[str, Times]]:
    """The rows up to a time, and those after it."""
    passed, left = {}, {}
    for key, rows in waiting.items():
        for row in rows:
            (passed if row[0] <= us else left).setdefault(key, []).append(row)
    return passed, left


IN_ORDER = "key array<string>, event_id array<bigint>, us array<bigint>, allowed array<boolean>, wait_s array<double>"


def in_order(
    events: DataFrame, key: str, step: Callable[[float | None, int], tuple[float, tuple]], until: Callable[[float], float], watermark: str
) -> DataFrame:
    """events(key, event_id, ts) → (key, event_id, ts, allowed, wait_s), each once the watermark is past it."""
    rows = events.select(
        F.col(key).cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts")
    ).withWatermark("ts", watermark)
    # plain numbers, so that no time zone can touch them on the way to Python and back
    said = (
        rows.withColumn("us", F.unix_micros("ts")).withColumn("bucket", bucket_of("key"))
        .groupBy("bucket")
        .transformWithState(InOrder(step, until, told_in_lists), IN_ORDER, "Append", "EventTime")
        .select(F.explode(F.arrays_zip("key", "event_id", "us", "allowed", "wait_s")).alias("told"))
    )
    return said.select(
        F.col("told.key").alias(key), "told.event_id", F.timestamp_micros("told.us").alias("ts"), "told.allowed", "told.wait_s"
    )


class Progress(StatefulProcessor):
    """Of each key the first terminal status, else the latest one.

    Rows are folded one by one and may come in any order; at equal times the status that is
    first by name counts.  A key leaves the state from `keep_us` after its last event on, and
    before twice that time.
    """

    def __init__(self, terminal: tuple[str, ...], keep_us: int):
        self._terminal, self._keep_us = terminal, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # of each key the terminal status and its time, the latest other one and its time, the last time; and the
        # time of the timer
        self._held = handle.getValueState("held", "packed binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held.get()
        seen, timer = ({}, None) if held is None else pickle.loads(held[0])
        touched = {}
        for row in rows:
            us, status = row.us, row.status
            done, done_us, shown, shown_us, last = seen.get(row.key) or (None,) * 5
            if status in self._terminal:
                if done is None or (us, status) < (done_us, done):
                    done, done_us = status, us
            elif status is not None and (shown is None or (-us, status) < (-shown_us, shown)):
                shown, shown_us = status, us
            last = us if last is None else max(last, us)
            seen[row.key] = touched[row.key] = (done, done_us, shown, shown_us, last)
        # a timer that is set is never too late: it finds the keys' ends when it fires
        if timer is None:
            timer = max(self._end(seen), timerValues.getCurrentWatermarkInMs() + 1)
            self._handle.registerTimer(timer)
        self._held.update((pickle.dumps((seen, timer), 5),))
        told = touched.values()
        yield Row(key=list(touched), status=[t[0] or t[2] for t in told], done_us=[t[1] for t in told], us=[t[4] for t in told])

    def _end(self, seen: dict[str, tuple]) -> int:
        """When the last of the keys has ended."""
        return (max(t[4] for t in seen.values()) + self._keep_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held.get()
        if held is not None:
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            seen = {k: t for k, t in pickle.loads(held[0])[0].items() if self._end({k: t}) > now}
            if seen:
                timer = self._end(seen)
                self._handle.registerTimer(timer)
                self._held.update((pickle.dumps((seen, timer), 5),))
            else:
                self._held.clear()
        return iter([])

    def close(self) -> None:
        pass


PROGRESS = "key array<string>, status array<string>, done_us array<bigint>, us array<bigint>"


def progress_stream(
    stages: DataFrame, key: str, terminal: tuple[str, ...], watermark: str, keep_hours: float
) -> DataFrame:
    """T2 over a stream: stages(key, status, ts) → (key, status, done_at, last_seen), a row for each key of a batch."""
    rows = stages.select(
        F.col(key).cast("string").alias("key"), "status", F.col("ts").cast("timestamp").alias("ts")
    ).withWatermark("ts", watermark)
    said = (
        rows.where("ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).withColumn("bucket", bucket_of("key"))
        .groupBy("bucket")
        .transformWithState(Progress(terminal, int(keep_hours * 3600e6)), PROGRESS, "Update", "EventTime")
        .select(F.explode(F.arrays_zip("key", "status", "done_us", "us")).alias("told"))
    )
    return said.select(
        F.col("told.key").alias(key), "told.status", F.timestamp_micros("told.done_us").alias("done_at"),
        F.timestamp_micros("told.us").alias("last_seen"),
    )
