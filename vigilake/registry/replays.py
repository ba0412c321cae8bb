"""Replays: the stream operators over the stored table of events, until it is drained.

A replay drops nothing, however the table is laid out and in whatever order its files arrive: the watermark
stays ``DELAY`` behind, and an end marker far in the future moves it past the last window and timer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import baseline as bl
from vigilake.operators.results import at_least
from vigilake.plans import corpora
from vigilake.session import materialize, shared_folder
from vigilake.streaming import live
from vigilake.streaming.watch import END, change_detect, debounce, scan_changes, scan_released, top_findings, unknown_to, watchable

DELAY = "73000 days"
END_TIME = "2250-01-01"
FILES_PER_TRIGGER = 1000


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A stored table as a stream, whether it is a folder of files or one file."""
    path = f"{sf_dir}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def event_stream(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = table_stream(spark, sf_dir, "events", **options)
    return corpora.change_events(corpora.spread(events, "events", *corpora.sizes(table, "events")))


def drain(stream: DataFrame, spark: SparkSession, folder: str, each: Callable | None = None) -> DataFrame:
    """Runs the stream until its source is empty and returns what it wrote.

    Results go to files in the shared folder, never through the driver.  A batch that is
    repeated after a failure replaces its own output.
    """
    out = f"{folder}/out"
    schema = stream.schema if each is None else each(spark.createDataFrame([], stream.schema)).schema
    if each is None:
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        def write(df: DataFrame, batch_id: int) -> None:
            each(df).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        writer = stream.writeStream.foreachBatch(write)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def replay_to_end(
    stream: DataFrame, spark: SparkSession, operator: Callable[[DataFrame], DataFrame], each: Callable | None = None,
) -> str:
    """Drains the stream, then sends an end marker that moves the watermark past the last window and timer.

    Returns the folder of the results.
    """
    folder = shared_folder(spark)
    ends = f"{folder}/ends"
    values = {"string": F.lit(END), "bigint": F.lit(-1).cast("long"), "timestamp": F.lit(END_TIME).cast("timestamp")}
    marker = spark.range(1).select(*[values[t].alias(c) for c, t in stream.dtypes])
    marker.limit(0).write.parquet(ends)
    result = operator(stream.unionByName(spark.readStream.schema(stream.schema).parquet(ends)))
    drain(result, spark, folder, each)
    marker.write.mode("append").parquet(ends)
    drain(result, spark, folder, each)
    return f"{folder}/out"


def _seen(spark: SparkSession, sf_dir: str) -> str:
    changes = watchable(event_stream(spark, sf_dir)).select("repo", "path", "event_id", "mtime")
    return replay_to_end(changes, spark, lambda c: change_detect(c, delay=DELAY))


def replay_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.read.parquet(_seen(spark, sf_dir))
    return seen.filter(F.col("repo") != END).select("repo", "path", "event_id", "poll", "at")


def replay_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _seen(spark, sf_dir)
    seen = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)
    return spark.read.parquet(replay_to_end(seen, spark, lambda s: debounce(s, DELAY)))


def replay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(scan_changes(event_stream(spark, sf_dir)), spark, shared_folder(spark))


def replay_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_changes(event_stream(spark, sf_dir))
    return drain(found, spark, shared_folder(spark), top_findings).select(
        "repo", "path", "event_id", "pos", "more", "check_name", "line")


def replay_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of findings without those that a saved baseline of high findings knows.

    The events are scanned once: the findings that the first stream stores are the baseline's and the second stream's input.
    """
    folder = shared_folder(spark)
    found = drain(scan_changes(event_stream(spark, sf_dir)), spark, f"{folder}/scan")
    bl.save_baseline(at_least(found, "high"), f"{folder}/baseline")
    again = spark.readStream.schema(found.schema).parquet(f"{folder}/scan/out")
    fresh = drain(again, spark, f"{folder}/fresh", unknown_to(f"{folder}/baseline"))
    return fresh.select("repo", "path", "event_id", "check_name", "line", "fingerprint")


def replay_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect, throttle, scan what was released, and show the first findings of each."""
    changes = corpora.change_events(corpora.table(spark, sf_dir, "events"))
    ignores = spark.createDataFrame([("live", "*/file_7*.js"), ("other", "*")], "repo string, glob string")
    return scan_released(changes, replay_debounce(spark, sf_dir), ignores=ignores).select(
        "repo", "path", "event_id", "pos", "more", "check_name", "line")


def replay_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``replay_pipeline`` in one streaming query: detect, throttle, scan, first findings.

    The watermark stays behind by the time that the table's own events span, so nothing is late whatever the order of its files.
    """
    changes = watchable(event_stream(spark, sf_dir)).select("repo", "path", "event_id", "mtime", "content")
    first, last = corpora.change_events(corpora.table(spark, sf_dir, "events")).agg(F.min("mtime"), F.max("mtime")).first()
    delay = f"{int((last - first).total_seconds()) + 1 if first else 1} seconds"
    ignores = spark.createDataFrame([("live", "*/file_7*.js"), ("other", "*")], "repo string, glob string")

    def findings(released: DataFrame) -> DataFrame:
        # the passes of a scan read what the throttle released, not the stateful operator each for itself
        stored = materialize(released)
        return top_findings(scan_changes(corpora.spread(stored, "events", *corpora.sizes(stored, "events")), ignores=ignores))

    before = spark.conf.get(live.STATE_STORE)
    spark.conf.set(live.STATE_STORE, live.ROCKS)
    try:
        out = replay_to_end(changes, spark, lambda c: live.released_changes(c, delay), findings)
    finally:
        spark.conf.set(live.STATE_STORE, before)
    return spark.read.parquet(out).select("repo", "path", "event_id", "pos", "more", "check_name", "line")
