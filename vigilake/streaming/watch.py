"""Continuous scanning: change detection, throttling, and scans of streams of file changes.

A change is a row (repo, path, mtime, event_id, content).  A watcher that polls sees at most
one change per file and poll, the newest.  So changes are first reduced to (file, poll) by a
windowed aggregation, which combines before it shuffles: however often one file changes, two
rows per second of it remain.  Only those reach the keyed state of the throttle, which holds
the time of the last scan, at most one postponed change and the polls that wait for the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilake import fixed_values as fv
from vigilake.functions import paths
from vigilake.functions.bitmaps import bitmap, in_bitmap
from vigilake.model import FINDING_COLUMNS, broadcast_if_small
from vigilake.operators import results
from vigilake.operators.baseline import filter_baseline, load_baseline
from vigilake.operators.files import ignore_filter
from vigilake.plans.scan import scan

POLL_US = 500_000
POLLS_PER_SCAN = int(fv.WATCH_INTERVAL_SECONDS * 1_000_000) // POLL_US
END = "end of input"  # a repository name that only moves the watermark


def watchable(changes: DataFrame) -> DataFrame:
    """Changes of files with a watched suffix (case-sensitive) that the ignore rules let through."""
    name = paths.basename(F.col("path"))
    return changes.filter(paths.suffix(name).isin(fv.WATCHED_SUFFIXES) & paths.default_keep(F.col("path"), name))


def _watermarked(rows: DataFrame, column: str, delay: str | None) -> DataFrame:
    if not rows.isStreaming:
        return rows
    if delay is None:
        raise ValueError("say how late changes may arrive: state is kept, and results wait, that long")
    return rows.withWatermark(column, delay)


def change_detect(changes: DataFrame, snapshot: DataFrame | None = None, delay: str | None = None) -> DataFrame:
    """(repo, path, poll, event_id, at, seen_at): the newest change of each file and poll.

    ``poll`` numbers the polls; a change is seen by the first poll after it.  ``snapshot``
    (repo, path, mtime) holds the files as they were at the start: only newer changes count.
    On streams ``delay`` is the caller's choice, there is no default: changes later than that are dropped, and
    results wait for it.  ``registry.replays`` shows a delay that drops nothing.
    """
    if snapshot is not None:
        before = snapshot.select("repo", "path", F.col("mtime").alias("known"))
        changes = changes.join(before, ["repo", "path"], "left").filter("known is null or mtime > known").drop("known")
    newest = F.max(F.struct(F.unix_micros("mtime").alias("at"), "event_id")).alias("newest")
    return (
        _watermarked(changes, "mtime", delay)
        .groupBy("repo", "path", F.window("mtime", f"{POLL_US // 1000} milliseconds").alias("w"))
        .agg(newest)
        .select(
            "repo", "path", (F.unix_micros("w.end") / POLL_US).cast("long").alias("poll"),
            "newest.event_id", "newest.at", F.window_time("w").alias("seen_at"))
    )


def throttle_step(last, pending, poll, event):
    """One seen change of a file: the new state and the scans (poll, event, edge) it causes.

    The first change is scanned at once.  A change seen less than a second after the last scan
    is postponed; when that second is over the newest postponed change is scanned.
    """
    scans = []
    if pending is not None and poll > last + POLLS_PER_SCAN:
        last += POLLS_PER_SCAN
        scans.append((last, pending, "trailing"))
        pending = None
    if last is None or poll - last >= POLLS_PER_SCAN:
        scans.append((poll, event, "leading"))
        last, pending = poll, None
    else:
        pending = event
    return last, pending, scans


def _poll_ms(poll: int) -> int:
    return poll * POLL_US // 1000


def _throttle(key, batches: Iterator[pd.DataFrame], state: GroupState):
    """Waits for the watermark before it looks at a poll, so the order of arrival does not matter.

    What waits in the state spans the watermark's delay.
    """
    if key[0] == END:
        return
    last, pending, polls, events = state.get if state.exists else (None, None, [], [])
    waiting = dict(zip(polls, events))
    if not state.hasTimedOut:
        for b in batches:
            waiting.update(zip(b["poll"].tolist(), b["event_id"].tolist()))
    now, scans = state.getCurrentWatermarkMs(), []
    for poll in sorted(p for p in waiting if _poll_ms(p) <= now):
        last, pending, new = throttle_step(last, pending, poll, waiting.pop(poll))
        scans += new
    if pending is not None and _poll_ms(last + POLLS_PER_SCAN) <= now:
        last += POLLS_PER_SCAN
        scans.append((last, pending, "trailing"))
        pending = None
    due = [*waiting] + ([last + POLLS_PER_SCAN] if pending is not None else [])
    if due:
        state.setTimeoutTimestamp(_poll_ms(min(due)) + 1)
    state.update((last, pending, list(waiting), list(waiting.values())))
    yield pd.DataFrame([(*key, e, t, edge) for t, e, edge in scans], columns=["repo", "path", "event_id", "poll", "edge"])


def debounce(seen: DataFrame, delay: str) -> DataFrame:
    """Scans to run: at most one per second and file, the newest content never lost.

    ``seen`` is the stream of a table that ``change_detect`` writes; Spark does not chain this
    operator behind an aggregation in one query.  ``delay`` bounds how far out of order the
    table may be read, and is also how long a scan waits.
    """
    rows = _watermarked(seen.select("repo", "path", "poll", "event_id", "seen_at"), "seen_at", delay)
    return rows.groupBy("repo", "path").applyInPandasWithState(
        _throttle, "repo string, path string, event_id long, poll long, edge string",
        "last long, pending long, polls array<long>, events array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def scan_changes(
    changes: DataFrame, min_severity: str = fv.WATCH_MIN_SEVERITY, ignores: DataFrame | None = None,
    extra_ignores: list[str] | None = None, **options,
) -> DataFrame:
    """Findings of each change, scanned alone; works on batches and streams, nothing is shuffled.

    ``ignores`` (repo, glob) apply to the repository of the change.  Git lookups need other files of the tree
    and custom rules are an option here.
    """
    # ignore rules see the repository; then the change travels in its column, so that versions of one file stay apart
    kept = ignore_filter(watchable(changes), ignores, extra_ignores)
    files = kept.select(F.concat_ws("@", "repo", F.col("event_id").cast("string")).alias("repo"), "path", "content")
    found = scan(files, min_severity=min_severity, git_lookup=False, ignore_rules=False, **options)
    return found.select(
        F.substring_index("repo", "@", -1).cast("long").alias("event_id"),
        F.regexp_replace("repo", "@[^@]*$", "").alias("repo"), *[c for c in FINDING_COLUMNS if c != "repo"])


def unknown_to(path: str) -> Callable[[DataFrame], DataFrame]:
    """For ``foreachBatch``: findings that the baseline saved at ``path`` does not know.

    The baseline is read again with every batch, so what is saved between two batches counts from the next one on.
    """

    def fresh(found: DataFrame) -> DataFrame:
        return filter_baseline(found, load_baseline(found.sparkSession, path))

    return fresh


def scan_released(changes: DataFrame, released: DataFrame, n: int = fv.WATCH_TOP, **options) -> DataFrame:
    """The watcher's output: the first findings of every change that the throttle released (batch).

    ``released`` (repo, path, event_id, poll) is what ``debounce`` writes; its content is looked up among
    ``changes`` behind a bitmap, so that few other changes' text moves.
    """
    key = F.xxhash64("repo", "path", "event_id")
    wanted = released.select("repo", "path", "event_id").distinct()
    near = changes.filter(in_bitmap(bitmap(wanted.withColumn("key", key), "key"), key))
    return top_findings(scan_changes(near.join(broadcast_if_small(wanted), ["repo", "path", "event_id"], "left_semi"), **options), n)


def top_findings(found: DataFrame, n: int = fv.WATCH_TOP) -> DataFrame:
    """First n findings of each change and how many more there are (batch only)."""
    apart = found.withColumn("repo", F.concat_ws("@", "repo", F.col("event_id").cast("string")))
    return results.top_n_per_file(apart, n).withColumn("repo", F.regexp_replace("repo", "@[^@]*$", ""))
