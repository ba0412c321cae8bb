"""The watcher as one streaming query: changes in, scans out, with bounded state.

A keyed processor holds, for each file, the newest change of every poll that the watermark has not passed, the time of the last scan and at
most one postponed change; timers on event time release them.  Every access to state and every timer is a call from Python to the JVM, so
the changes of a batch are first reduced to one per poll and then kept in few rows of many polls, with one timer for each row.  When a second
has passed since the last scan and nothing waits, the file's state is removed, so it does not grow with the number of files ever seen.  What
is released flows on to the scan in the same query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilake.streaming.watch import END, POLL_US, POLLS_PER_SCAN, throttle_step

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: a row of waiting changes holds so many polls, and begins no other one beyond so many characters
POLLS_PER_ROW, CHARS_PER_ROW = 64, 1 << 20
WAITING = "polls array<long>, ats array<long>, events array<long>, contents array<string>"
RELEASED = "repo string, path string, event_id long, poll long, edge string, content string"


def _ms(poll: int) -> int:
    return poll * POLL_US // 1000


def _changes(row) -> Iterator[tuple]:
    """(poll, (time, event, content)) of a row of waiting changes."""
    polls, ats, events, contents = row
    return zip(polls, zip(ats, events, contents))


def _add(newest: dict, poll: int, change: tuple) -> None:
    known = newest.get(poll)
    if known is None or change[:2] > known[:2]:
        newest[poll] = change


class Throttle(StatefulProcessor):
    """At most one scan per second and file; the newest content is never lost."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long", WAITING)
        self.clock = handle.getValueState("clock", "last long, event_id long, content string")

    def _keep(self, newest: dict) -> None:
        """Stores changes (poll: time, event, content) under the first poll of each row, with a timer there."""
        rows, chars = [], 0
        for poll in sorted(newest):
            if not rows or len(rows[-1]) >= POLLS_PER_ROW or chars > CHARS_PER_ROW:
                rows.append([])
                chars = 0
            rows[-1].append(poll)
            chars += len(newest[poll][2] or "")
        for polls in rows:
            changes = {p: newest[p] for p in polls}
            if self.waiting.containsKey((polls[0],)):
                for poll, change in _changes(self.waiting.getValue((polls[0],))):
                    _add(changes, poll, change)
            ordered = sorted(changes)
            self.waiting.updateValue((polls[0],), (ordered, *([changes[p][i] for p in ordered] for i in range(3))))
            self.handle.registerTimer(_ms(polls[0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] != END:
            newest: dict = {}
            for batch in rows:
                for at, event, content in zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["content"].tolist()):
                    _add(newest, int(at) // POLL_US + 1, (int(at), int(event), content))
            self._keep(newest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last, event, content = self.clock.get() if self.clock.exists() else (None, None, None)
        pending = None if event is None else (event, content)
        due, later, scans = {}, {}, []
        for first in sorted(k[0] for k in self.waiting.keys()):
            if _ms(first) <= now:
                for poll, change in _changes(self.waiting.getValue((first,))):
                    _add(due if _ms(poll) <= now else later, poll, change)
                self.waiting.removeKey((first,))
        if later:
            self._keep(later)
        for poll in sorted(due):
            last, pending, new = throttle_step(last, pending, poll, due[poll][1:])
            scans += new
        if pending is not None and _ms(last + POLLS_PER_SCAN) <= now:
            last += POLLS_PER_SCAN
            scans.append((last, pending, "trailing"))
            pending = None
        if last is not None:
            if pending is None and _ms(last + POLLS_PER_SCAN) <= now:
                self.clock.clear()  # a later change is scanned at once, as that of a new file
            else:
                self.clock.update((last, *(pending or (None, None))))
                self.handle.registerTimer(_ms(last + POLLS_PER_SCAN))
        if scans:
            yield pd.DataFrame([(*key, e[0], poll, edge, e[1]) for poll, e, edge in scans],
                               columns=["repo", "path", "event_id", "poll", "edge", "content"])

    def close(self) -> None:
        pass


def released_changes(changes: DataFrame, delay: str) -> DataFrame:
    """The changes (repo, path, event_id, poll, edge, content) that a watcher scans, of a stream of ``watchable`` changes with mtime.

    ``delay`` is how late a change may arrive; results wait, and state is kept, that long.  Needs the RocksDB state store.
    """
    rows = changes.withColumn("at", F.unix_micros("mtime")).withWatermark("mtime", delay)
    return rows.select("repo", "path", "event_id", "mtime", "at", "content").groupBy("repo", "path").transformWithStateInPandas(
        statefulProcessor=Throttle(), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")
