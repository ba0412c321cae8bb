"""Odd rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilake.llm import (
    decontamination, exact_dedup, fill_in_middle, jaccard_join, licenses, mixing, prefix_tokens, quality, secrets, sharding, suffix_dedup,
    toxicity,
)

CLASHING = "tag key n node size source_size curve rank digest score y text_hash th lo more row nul src take spans items keep_id kept gone gone_id gone_sha _value".split()


@pytest.fixture
def benchmark(spark, prose):
    return spark.createDataFrame(
        [(1, prose(30, 3)), (2, None), (3, ""), (None, prose(20, 8)), (4, "x"), (4, "漢字"), (5, "\u0000 -- !")], "item_id long, text string")


@pytest.fixture
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 0), (3, 0, 1), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(benchmark, labels):
    return {
        "op1": lambda d: decontamination.contamination(d, benchmark),
        "op2": licenses.license_scan,
        "op3": lambda d: toxicity.toxicity(d, labels),
        "op4": exact_dedup.exact_duplicates,
        "op5": lambda d: quality.quality(d, labels),
        "op6": sharding.hilbert_shards,
        "op7": jaccard_join.near_duplicates,
        "op8": secrets.secret_scan,
        "op9": suffix_dedup.repeated_bytes,
        "op10": mixing.mixture_report,
        "op11": fill_in_middle.fill_in_middle,
        "op12": prefix_tokens.token_counts,
    }


def keepers(benchmark, labels):
    return {
        "accept": lambda d: quality.accept(d, labels),
        "keep_first": jaccard_join.keep_first,
        "remove_documents": lambda d: decontamination.remove_documents(d, benchmark),
        "remove_spans": lambda d: decontamination.remove_spans(d, benchmark),
        "mix": mixing.mix,
        "deduplicate": exact_dedup.deduplicate,
    }


NAMES = list(operators(None, None))
KEEPERS = list(keepers(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(odd, benchmark, labels, name):
    wide = odd.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING])
    run = operators(benchmark, labels)[name]
    got = run(wide)
    rows = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())
    # rows do not depend on the other columns
    assert sorted(map(str, rows)) == sorted(map(str, run(odd).select(*got.columns).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, spark, benchmark, labels, name):
    empty = docs({})
    assert operators(benchmark.limit(0), labels.limit(0))[name](empty).collect() == []


@pytest.mark.parametrize("name", ["op1", "op3", "op5"])
def test_nothing_to_learn_from(odd, benchmark, labels, name):
    rows = operators(benchmark.limit(0), labels.limit(0))[name](odd).collect()
    assert len(rows) == odd.count()
    if name == "op1":
        assert all(r["spans"] == [] and r["items"] == [] for r in rows)
    else:
        assert all(r["score"] == pytest.approx(1.0 if name == "op5" else 0.0, abs=1e-9) for r in rows)


@pytest.mark.parametrize("name", KEEPERS)
def test_keepers(odd, docs, benchmark, labels, name):
    wide = odd.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING])
    run = keepers(benchmark, labels)[name]
    got = run(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[c] == f"other {c}" for r in rows for c in CLASHING)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd.collect()}
    assert run(docs({})).collect() == []


def test_one_row_stays_of_each_component(docs, prose):
    """Null ids, repeated rows of the keeper, and a clean text under the id of a near copy."""
    a, b, c, d, clean = (prose(80, s) for s in (3, 11, 12, 13, 14))
    rows = [
        (3, a), (None, a), (None, a + " more"), (4, a.upper()), (4, clean), (3, a),  # 3 is kept once, the clean text of 4 stays
        (None, b), (None, b), (9, c), (9, c), (9, c + " more"),  # one row each, though every id is null or the same
        (None, d), (1, None), (1, None), (1, " "), (None, "")]
    got = jaccard_join.keep_first(docs(rows)).collect()
    with_text = sorted(((r["doc_id"] or 0, r["text"]) for r in got if (r["text"] or "").strip()))
    assert [(i, t) for i, t in with_text if i not in (9,)] == sorted([(0, b), (0, d), (3, a), (4, clean)])
    assert [t for i, t in with_text if i == 9][0] in (c, c + " more") and sum(i == 9 for i, _ in with_text) == 1
    assert sum(not (r["text"] or "").strip() for r in got) == 4


def test_stages_on_odd_rows(spark, odd, benchmark, labels, tmp_path):
    for name, table in (("documents", odd), ("benchmark", benchmark), ("labels", labels)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert out.count() == 0 if rows is not docs else out.count() >= 0
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.schema.simpleString() == docs.schema.simpleString(), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
