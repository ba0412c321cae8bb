"""Properties of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from vigilake.operators import baseline as bl
from vigilake.plans.scan import scan


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, files, tmp_path):
    path = str(tmp_path / "files")
    files({"a.js": "eval(x)\n", "b.py": "eval(x)\n", ".env": "API_KEY=abcd1234"}).write.parquet(path)
    return spark.read.parquet(path)


def test_the_scan_shuffles_no_content(table):
    text = plan(scan(table, git_lookup=False))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_git_lookup_shuffles_paths_only(table):
    text = plan(scan(table, only=["env-not-gitignored", "env-no-gitignore"]))
    for line in text.split("\n"):
        if "Exchange" in line and "Broadcast" not in line:
            assert "content" not in line


def test_two_passes_over_the_text(table):
    text = plan(scan(table, git_lookup=False))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert len(scans) == 2 and text.count("ArrowEvalPython") == 1


def test_path_queries_do_not_read_content(table):
    from vigilake.operators.files import classify, ignore_filter

    text = plan(classify(ignore_filter(table)).select("path", "language"))
    assert "content" not in text.split("ReadSchema")[1]


def test_rules_below_the_threshold_are_not_in_the_plan(table):
    low, high = plan(scan(table, git_lookup=False)), plan(scan(table, git_lookup=False, min_severity="critical"))
    assert "ArrowEvalPython" in low and "ArrowEvalPython" not in high
    assert "document" in low and "document" not in high


def test_baseline_is_an_anti_join(table):
    found = scan(table, git_lookup=False)
    text = plan(bl.filter_baseline(found, bl.baseline_rows(found).filter(F.lit(True))))
    assert "LeftAnti" in text and "NestedLoop" not in text


def test_long_lists_move_only_their_own_text(spark, table, monkeypatch):
    """With broadcasts ruled out, texts pass a bitmap before they meet an exchange, and ignored files are dropped as findings."""
    from vigilake import model
    from vigilake.operators import files as fo
    from vigilake.plans import scan as scan_module

    for module in (model, fo, scan_module):
        monkeypatch.setattr(module, "is_small", lambda df, *a: False)
    changed = spark.createDataFrame([("r", "a.js")], "repo string, path string")
    kept = fo.changed_files(table, changed)
    assert "scalar-subquery" in kept._jdf.queryExecution().optimizedPlan().toString()
    assert [r.path for r in kept.collect()] == ["a.js"]
    ignores = spark.createDataFrame([("r", "b.*"), ("r", "[z-a]"), ("q", "a.js")], "repo string, glob string")
    found = scan(table, ignores=ignores, git_lookup=False)
    for line in plan(found).split("\n"):
        assert not ("Exchange" in line and "content" in line)
    assert sorted(r.path for r in found.collect()) == [".env", "a.js"]


def test_documents_group_nothing(spark, table):
    from vigilake.operators import exports

    found = scan(table, git_lookup=False)
    text = plan(exports._items(found, exports.finding_json(), 1))
    assert "collect_list" not in text


def test_only_control_files_are_read_for_globs(spark, files, tmp_path):
    from vigilake.operators.files import ignore_globs
    from vigilake.sources import tables

    path = str(tmp_path / "stored")
    tables.write_files(files({"a.js": "x", ".scanignore": "b.*", ".gitignore": ".env"}), path)
    text = plan(ignore_globs(tables.read_files(spark, path)))
    assert "PartitionFilters: [isnotnull(language" in text and "control" in text
