import random

import pandas as pd
from pyspark.sql import functions as F

from test_round3 import At, FakeState
from test_streaming import poll_by_poll
from vigilake.plans import corpora
from vigilake.registry import replays
from vigilake.sources import tree
from vigilake.streaming import live, watch


class CountedState(FakeState):
    """Counts the calls that reach the JVM."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue", "removeKey", "keys", "registerTimer"):
            object.__setattr__(self, "calls", object.__getattribute__(self, "calls") + 1)
        return object.__getattribute__(self, name)


def drained(state, throttle, mark):
    scans = []
    while due := sorted(t for t in state.timers if t <= mark):
        state.timers.discard(due[0])
        for out in throttle.handleExpiredTimer(("r", "f"), At(mark), None):
            scans += list(zip(out["poll"], out["event_id"]))
    return scans


def test_the_live_watcher_asks_for_state_by_batch_and_not_by_change(monkeypatch):
    """2,000 changes over 60 polls of a file: a handful of calls and one timer, not some for each change and poll."""
    rng = random.Random(3)
    ats = sorted(rng.randint(1, 60 * watch.POLL_US) for _ in range(2_000))
    frame = pd.DataFrame({"at": ats, "event_id": range(2_000), "content": [str(i) for i in range(2_000)]})
    newest = {at // watch.POLL_US + 1: i for i, at in enumerate(ats)}
    for chars, most in ((1 << 20, 12), (50, 250)):  # the second has many rows of state for the file
        monkeypatch.setattr(live, "CHARS_PER_ROW", chars, raising=False)
        state, throttle = CountedState(), live.Throttle()
        throttle.init(state)
        halves = [frame[:1000], frame[1000:]]
        assert list(throttle.handleInputRows(("r", "f"), iter(halves), At(0))) == []
        if chars > 50:
            assert len(state.timers) == 1
        assert drained(state, throttle, 10**9) == poll_by_poll(newest, max(newest))
        assert state.calls <= most and not state.map and state.value is None


def test_the_live_watcher_puts_back_what_is_not_due():
    """The watermark stops within a row of waiting changes, and another batch brings newer ones for its polls."""
    polls = list(range(2, 40, 3))
    state, throttle = FakeState(), live.Throttle()
    throttle.init(state)
    for late in (0, 10):
        frame = pd.DataFrame({"at": [p * watch.POLL_US - 100 + late for p in polls], "event_id": [p + late for p in polls],
                              "content": ["x"] * len(polls)})
        list(throttle.handleInputRows(("r", "f"), iter([frame.sample(frac=1, random_state=1)]), At(0)))
    scans = [s for mark in range(0, 40_000, 700) for s in drained(state, throttle, mark)]
    assert scans == poll_by_poll({p: p + 10 for p in polls}, polls[-1])
    assert not state.map and state.value is None and not state.timers


def test_a_directory_passes_through_in_batches(tmp_path):
    names = [f"f{i}" for i in range(25_000)]
    for name in names:
        (tmp_path / name).touch()
    batches = list(tree._listed(iter([pd.DataFrame({"root": [str(tmp_path)], "path": [""]})])))
    assert max(map(len, batches)) <= 10_000 and sorted(p for b in batches for p in b["path"]) == sorted(names)


def test_directories_of_a_level_are_listed_by_several_tasks(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.py").write_text("x")
    listing = tree.tree_listing(spark, str(tmp_path))
    assert listing.count() == 12 and len(listing.inputFiles()) > 3


def test_a_written_tree_comes_back_whole(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "BYTES_PER_BATCH", 100)
    contents = {f"a/{i}.py": "é漢😀" * (i % 40) for i in range(300)} | {"empty.js": "", "null.js": None, "b/c/long.ts": "x" * 10_000}
    assert tree.write_tree(files(contents), str(tmp_path)) == len(contents)
    back = tree.read_tree(spark, str(tmp_path), "r").select("path", F.col("content")).collect()
    assert {r.path: r.content for r in back} == contents | {"null.js": ""} and len(back) == len(contents)
    batch = tree.pa.RecordBatch.from_pylist([{"root": str(tmp_path), "path": p, "kind": "file"} for p in sorted(contents)])
    sizes = [(b.num_rows, sum(map(len, b.column("raw").to_pylist()))) for b in tree._read(iter([batch]))]
    assert sum(n for n, _ in sizes) == len(contents) and all(n == 1 or size <= 100 for n, size in sizes)


def test_tasks_over_events_grow_with_their_rows(spark, tmp_path, monkeypatch):
    """As many splits as cores, but many rows in each: batch and stream go to more tasks, with the same findings."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(spark.sparkContext.__class__, "defaultParallelism", 1)
    monkeypatch.setattr(corpora, "ROWS_PER_TASK", {"events": 100}, raising=False)
    tasks = -(-events.count() // 100)
    assert corpora.table(spark, str(tmp_path), "events").rdd.getNumPartitions() == tasks > 4
    columns = ["event_id", "check_name", "line"]
    found = replays.replay_scan(spark, str(tmp_path))
    want = watch.scan_changes(corpora.change_events(events))
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []
    plan = replays.event_stream(spark, str(tmp_path))._jdf.queryExecution().logical().toString()
    assert f", {tasks}" in plan and "RepartitionByExpression" in plan
