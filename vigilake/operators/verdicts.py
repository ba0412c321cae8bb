"""The reviewer's memory: prompts that were answered once are not sent again.

Answers are rows keyed by the hash of their prompt, appended to a table; a write commits as a whole or not at all, so a lost task or
run leaves no half of it.  Prompts without an answer are tried again, some times with a wait, and by the next run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WAITS = (1.0, 2.0, 4.0)
STORE = "key string, response string"


def prompt_key(prompt: Column) -> Column:
    """The hash of a prompt without the random marks around the untrusted text."""
    plain = F.regexp_replace(prompt, r"(UNTRUSTED_FILE )[0-9a-f]{16}(>>>)", "$1$2")
    return F.sha2(plain.cast("binary"), 256)


def stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STORE).parquet(path)
    except AnalysisException:  # nothing was ever answered
        return spark.createDataFrame([], STORE)


def _ask(reviewer: Callable[[str], str], waits: Sequence[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for prompt in batch["prompt"]:
                answer = None
                for wait in (*waits, None):
                    try:
                        answer = reviewer(prompt)
                        break
                    except Exception:
                        # whatever the reviewer raises is its own; without an answer the prompt stays open
                        if wait is not None:
                            time.sleep(wait)
                answers.append(answer)
            yield pd.DataFrame({"key": batch["key"], "response": answers})

    return run


def review(prompts: DataFrame, reviewer: Callable[[str], str], path: str, waits: Sequence[float] = WAITS) -> DataFrame:
    """(repo, path, part, response) of all prompts that have an answer, old or new; ``response`` is null for the others.

    ``reviewer`` turns a prompt into a response; ``path`` is the table of answers.  Equal prompts are sent once.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("key", prompt_key(F.col("prompt")))
    unseen = keyed.join(stored(spark, path).select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("prompt"))
    answered = unseen.mapInPandas(_ask(reviewer, waits), STORE).filter("response is not null")
    answered.write.mode("append").parquet(path)
    # two runs at once may both have asked
    one = stored(spark, path).groupBy("key").agg(F.min("response").alias("response"))
    return keyed.select("repo", "path", "part", "key").join(one, "key", "left").drop("key")
