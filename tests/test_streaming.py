import random

import pytest
from pyspark.sql import functions as F

from vigilake.registry import replays
from vigilake.streaming import watch


def poll_by_poll(changes, last_poll):
    """What a watcher does that looks every half second: the reference for the throttle."""
    scans, last, unscanned = [], None, None
    for poll in range(0, last_poll + 10):
        if poll in changes:
            unscanned = changes[poll]
        if unscanned is not None and (last is None or poll - last >= 2):
            scans.append((poll, unscanned))
            last, unscanned = poll, None
    return scans


def test_throttle_equals_polling():
    random.seed(5)
    for _ in range(300):
        polls = sorted(random.sample(range(60), random.randint(1, 40)))
        changes = {p: i for i, p in enumerate(polls)}
        last = pending = None
        scans = []
        for p, e in changes.items():
            last, pending, new = watch.throttle_step(last, pending, p, e)
            scans += new
        if pending is not None:
            scans.append((last + watch.POLLS_PER_SCAN, pending, "trailing"))
        assert [(p, e) for p, e, _ in scans] == poll_by_poll(changes, polls[-1])
        assert scans[-1][1] == len(polls) - 1  # the newest content is never lost


def rows(spark):
    data = [("r", "a.js", i, f"2024-01-01 00:00:{s:06.3f}") for i, s in enumerate([1.0, 1.1, 1.3, 1.7, 4.2, 4.3, 9.0])]
    data += [("r", "b.js", 50, "2024-01-01 00:00:02"), ("r", "skip.md", 60, "2024-01-01 00:00:02"), ("r", ".env", 61, "2024-01-01 00:00:02")]
    return spark.createDataFrame(data, "repo string, path string, event_id long, at string").select(
        "repo", "path", "event_id", F.col("at").cast("timestamp").alias("mtime"))


def test_stream_over_several_batches(spark, tmp_path):
    """Changes that arrive in several triggers give the same scans as polling."""
    source = str(tmp_path / "in")
    rows(spark).orderBy("mtime").repartitionByRange(4, "mtime").write.parquet(source)
    stream = spark.readStream.schema(rows(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen_table = replays.replay_to_end(watch.watchable(stream), spark, lambda c: watch.change_detect(c, delay=replays.DELAY))
    seen = spark.read.parquet(seen_table).filter(F.col("repo") != watch.END)
    assert sorted((r.path, r.poll % 100, r.event_id) for r in seen.collect()) == sorted(
        (p, int(poll) % 100, e) for p, poll, e in [
            ("a.js", 1704067201.5 / 0.5, 2), ("a.js", 1704067202.0 / 0.5, 3), ("a.js", 1704067204.5 / 0.5, 5),
            ("a.js", 1704067209.5 / 0.5, 6), ("b.js", 1704067202.5 / 0.5, 50)])
    again = spark.readStream.schema(spark.read.parquet(seen_table).schema).option("maxFilesPerTrigger", 1).parquet(seen_table)
    scans = spark.read.parquet(replays.replay_to_end(again, spark, lambda s: watch.debounce(s, replays.DELAY)))
    assert sorted((r.path, r.event_id, r.edge) for r in scans.collect()) == [
        ("a.js", 2, "leading"), ("a.js", 3, "trailing"), ("a.js", 5, "leading"), ("a.js", 6, "leading"), ("b.js", 50, "leading")]


def test_snapshot_is_not_a_change(spark):
    snapshot = rows(spark).filter("event_id in (3, 50)").select("repo", "path", "mtime")
    seen = watch.change_detect(watch.watchable(rows(spark)), snapshot)
    assert sorted((r.path, r.event_id) for r in seen.collect()) == [("a.js", 5), ("a.js", 6)]


def test_versions_of_a_file_stay_apart(spark):
    changes = spark.createDataFrame(
        [("r@x", "a.js", 1, "eval(x)"), ("r@x", "a.js", 2, "ok"), ("r@x", "a.js", 3, "eval(y)\nstacktrace: true")],
        "repo string, path string, event_id long, content string")
    found = watch.scan_changes(changes)
    assert sorted((r.repo, r.event_id, r.check_name) for r in found.collect()) == [("r@x", 1, "js-eval"), ("r@x", 3, "js-eval")]
    many = changes.select("repo", "path", "event_id", F.repeat(F.lit("eval(x)\n"), 7).alias("content"))
    top = watch.top_findings(watch.scan_changes(many)).groupBy("repo", "event_id").agg(F.count("*"), F.max("more")).collect()
    assert sorted(map(tuple, top)) == [("r@x", i, 5, 2) for i in (1, 2, 3)]


def test_a_folder_in_any_order_gives_the_rows_of_one_file(spark, tmp_path):
    """Many files, late ones first, several triggers: nothing is dropped."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400)
    events.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = next((tmp_path / "one").glob("part-*"))
    (tmp_path / "a").mkdir()
    one.rename(tmp_path / "a/events.parquet")
    events.orderBy(F.desc("ts")).repartitionByRange(5, F.desc("ts")).write.parquet(f"{tmp_path}/b/events.parquet")

    def results(folder, per_trigger):
        changes = watch.watchable(replays.event_stream(spark, f"{tmp_path}/{folder}", files_per_trigger=per_trigger))
        changes = changes.select("repo", "path", "event_id", "mtime")
        table = replays.replay_to_end(changes, spark, lambda c: watch.change_detect(c, delay=replays.DELAY))
        seen = spark.read.parquet(table).filter(F.col("repo") != watch.END)
        return sorted((r.path, r.poll, r.event_id) for r in seen.collect())

    assert results("a", 1000) == results("b", 2) != []


def test_a_stream_needs_a_delay(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows(spark).schema).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError):
        watch.change_detect(stream)


def test_ignore_rules_of_the_repository(spark):
    changes = spark.createDataFrame(
        [("r", "gen/a.js", 1, "eval(x)"), ("r", "src/a.js", 2, "eval(x)"), ("s", "gen/a.js", 3, "eval(x)")],
        "repo string, path string, event_id long, content string")
    ignores = spark.createDataFrame([("r", "gen/*"), ("r", "[z-a]")], "repo string, glob string")
    assert sorted(r.event_id for r in watch.scan_changes(changes, ignores=ignores).collect()) == [2, 3]
    assert sorted(r.event_id for r in watch.scan_changes(changes, extra_ignores=["src/*"]).collect()) == [1, 3]
