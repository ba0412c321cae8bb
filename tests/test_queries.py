"""Registered queries against their DuckDB equivalents; all of them with VIGILAKE_ALL=1."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from vigilake.registry.oracle import ORACLES
from vigilake.registry.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CORE = [
    "sorted_findings", "read_decode", "rule_validate", "rule_catalog", "ignore_filter", "glob_match", "env_clean_value",
    "baseline_filter", "nearest_git_root", "env_gitignore_lookup", "verdict_join", "reviewed_json_sink", "sarif_sink",
    "review_batch_sink", "fix_prompt_sink", "stack_recommendations", "detection_scorecard", "severity_summary", "top_n_per_file",
    "rules_python_injection", "route_no_auth", "py_routes", "debounce", "stream_baseline_filter", "watch_pipeline", "single_file",
    "baseline_load", "registered_checks", "ignore_malformed", "dialect_rules", "repo_rules", "source_tree_read", "explain_names",
    "explain_enrich", "html_script_rules", "findings_json_sink", "fail_on_gate", "rules_firebase", "rules_stripe",
    "repo_rules_yaml", "refused_rules", "chunked_scan", "snapshot_changes", "changed_scan", "review_store", "document_files", "sql_checks",
    "watch_live",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def test_every_query_has_an_equivalent():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("VIGILAKE_ALL") else CORE)
def test_equal_to_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert got == normal(cursor.fetchall(), [d[0] for d in cursor.description])
    assert got[1], "no rows"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
