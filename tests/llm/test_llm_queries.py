"""The registered queries: equal to their SQL, or checked through the pipeline's own rules."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from vigilake.llm.oracle import ORACLES
from vigilake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equal_to_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLES[name])
    assert got == normal(cursor.fetchall(), [d[0] for d in cursor.description])


@pytest.mark.parametrize("name", ["op3_toxicity", "op5_quality_classifier", "op6_hilbert_sharding"])
def test_one_row_per_document(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(200))


def test_pipeline(spark):
    """Every stage against its operator's report on the stage's own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    start, table = docs, lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    from vigilake.llm import decontamination, jaccard_join, mixing, quality

    want = [
        lambda d: {r["doc_id"] for r in quality.quality(d, table("labels")).filter("predicted = 1").collect()},
        lambda d: {r["doc_id"] for r in jaccard_join.near_duplicates(d, 5, 80).filter("doc_id = component_id").collect()},
        lambda d: {r["doc_id"] for r in decontamination.contamination(d, table("benchmark")).filter("size(spans) = 0").collect()},
        lambda d: {r["doc_id"] for r in mixing.mixture_report(d).filter("taken > 0").collect()},
    ]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        after = stage(spark, docs, DATA).cache()
        assert after.schema.simpleString() == start.schema.simpleString(), name
        assert {r["doc_id"] for r in after.select("doc_id").collect()} == ids(docs), name
        docs = after
    shards = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in shards) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
