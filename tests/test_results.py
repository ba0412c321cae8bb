import json

import pytest
from pyspark.sql import functions as F

from vigilake.model import FINDINGS, broadcast_if_small
from vigilake.operators import baseline as bl
from vigilake.operators import exports, results, review, scoring, stack
from vigilake.operators import files as fo

RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


@pytest.fixture
def findings(spark):
    def make(*rows):
        """Rows of (repo, path, check, severity, line, snippet)."""
        full = [(r, p, p.split("/")[-1], c, s, RANK[s], n, 3, f"about {c}", code, "do this" if s != "info" else "", 400)
                for r, p, c, s, n, code in rows]
        return spark.createDataFrame(full, FINDINGS)

    return make


@pytest.fixture
def some(findings):
    return findings(
        ("a", "x/f.js", "c1", "high", 2, "eval(x)"), ("a", "x/f.js", "c2", "critical", 9, "  k"), ("a", "y/f.js", "c1", "high", 7, "eval(x)  "),
        ("a", "g.js", "c3", "info", 1, ""), ("b", "h.py", "c1", "medium", 1, "q\"\\\t"), ("b", "h.py", "c1", "medium", 1, "q\"\\\t"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_fingerprints_ignore_lines_and_directories(some):
    got = dict(rows(bl.with_fingerprint(some).filter("check_name = 'c1' and repo = 'a'"), "path", "fingerprint"))
    assert got["x/f.js"] == got["y/f.js"] and got["x/f.js"].startswith("c1|f.js|")
    full = dict(rows(bl.with_fingerprint(some, "full").filter("check_name = 'c1' and repo = 'a'"), "path", "fingerprint"))
    assert len(set(full.values())) == 2
    bare = bl.with_fingerprint(some).filter("check_name = 'c3'").select("fingerprint").first()[0]
    assert bare == "c3|g.js|1"


def test_baseline_header_counts_before_deduplication(some):
    assert rows(bl.baseline_header(some), "repo", "version", "count", "distinct_count") == [("a", 1, 4, 3), ("b", 1, 2, 1)]


def test_baseline_document(some):
    ordered = bl.baseline_document(some).filter("repo = 'a'").orderBy("section", "fingerprint").collect()
    doc = json.loads("".join(r.text for r in ordered))
    prints = sorted({r.fingerprint for r in bl.with_fingerprint(some.filter("repo = 'a'")).collect()})
    assert doc == {"version": 1, "count": 4, "fingerprints": prints}


def test_baseline_filter_removes_every_duplicate(some):
    known = bl.baseline_rows(some.filter("check_name = 'c1'"))
    assert rows(bl.filter_baseline(some, known), "repo", "check_name") == [("a", "c2"), ("a", "c3")]
    assert rows(bl.removed_by_baseline(some, known), "repo", "removed") == [("a", 2), ("b", 2)]
    assert bl.filter_baseline(some, None).count() == 6
    assert bl.filter_baseline(some, known.limit(0)).count() == 6


def test_baseline_round_trip_and_missing(spark, some, tmp_path):
    assert bl.load_baseline(spark, str(tmp_path / "none")) is None
    bl.save_baseline(some, str(tmp_path / "b"))
    assert bl.filter_baseline(some, bl.load_baseline(spark, str(tmp_path / "b"))).count() == 0
    doc = tmp_path / "b.json"
    doc.write_text(json.dumps({"repo": "b", "version": 1, "fingerprints": ["x", "x"]}))
    assert bl.load_baseline(spark, str(doc)).count() == 1
    doc.write_text(json.dumps({"version": 1, "fingerprints": ["x"]}))
    assert bl.load_baseline(spark, str(doc), "shop").first().repo == "shop"
    doc.write_text("{broken")
    assert bl.load_baseline(spark, str(doc)) is None


def test_documents_of_all_repositories(spark, some, tmp_path):
    """Every repository has a document of its own, in order, and its lines come back as rows."""
    names = ["repo", "path", "name", "check_name", "snippet", "line"]
    many = spark.createDataFrame([(f"r{i % 3}", f"p/{i}.js", f'{i * 37 % 997}".js', "c", f"s{i}", 1) for i in range(900)], names)
    for found in (some, many):
        at = str(tmp_path / "documents")
        bl.save_documents(found, at)
        want = rows(bl.baseline_rows(found), "repo", "fingerprint")
        assert rows(bl.load_documents(spark, at), "repo", "fingerprint") == want
        for repo in {r for r, _ in want}:
            files = sorted((tmp_path / "documents" / f"repo={repo}").glob("part-*"))
            doc = json.loads("".join(f.read_text() for f in files))
            assert doc["fingerprints"] == sorted(p for r, p in want if r == repo) and doc["count"] == found.filter(f"repo = '{repo}'").count()
    bl.save_documents(some.limit(0), at)
    assert bl.load_documents(spark, at).collect() == [] and bl.load_documents(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken" / "repo=a").mkdir(parents=True)
    (tmp_path / "broken" / "repo=a" / "part-0.txt").write_text('{"version":1,"count":1,"fingerprints":[\n"x"\n')
    assert bl.load_documents(spark, str(tmp_path / "broken")) is None


def test_duplicates(some):
    assert rows(bl.duplicate_fingerprints(some), "repo", "n", "n_paths", "first_path", "last_path") == [
        ("a", 2, 2, "x/f.js", "y/f.js"), ("b", 2, 1, "h.py", "h.py")]


def test_summary_keeps_clean_repositories_and_counts_info_in_total(spark, some):
    files = spark.createDataFrame([("a", "1"), ("a", "2"), ("clean", "3"), ("b", "4")], "repo string, path string")
    cols = ["repo", "files_scanned", "critical", "high", "medium", "low", "total"]
    assert rows(results.severity_summary(some, files), *cols) == [
        ("a", 2, 1, 2, 0, 0, 4), ("b", 1, 0, 0, 2, 0, 2), ("clean", 1, 0, 0, 0, 0, 0)]
    assert rows(results.exit_gate(some, files), "repo", "exit_code") == [("a", 1), ("b", 0), ("clean", 0)]
    summary = results.severity_summary(some, files)
    want = {"critical": (1, 0, 0), "high": (1, 0, 0), "medium": (1, 1, 0), "low": (1, 1, 0), "none": (0, 0, 0)}
    for level, (a, b, c) in want.items():
        assert rows(results.fail_on_gate(summary, level), "repo", "should_fail") == [("a", a), ("b", b), ("clean", c)]


def test_index_and_top(some):
    assert rows(results.finding_index(some).filter("repo = 'a'"), "path", "idx", "check_name") == [
        ("g.js", 0, "c3"), ("x/f.js", 0, "c2"), ("x/f.js", 1, "c1"), ("y/f.js", 0, "c1")]
    assert rows(results.top_n_per_file(some, 1), "path", "check_name", "more") == [
        ("g.js", "c3", 0), ("h.py", "c1", 1), ("x/f.js", "c2", 1), ("y/f.js", "c1", 0)]


def test_pivot_before_after_counts(some):
    pivot = {r["repo"]: (r["critical"], r["high"], r["medium"], r["info"], r["total"]) for r in results.repo_severity_pivot(some).collect()}
    assert pivot == {"a": (1, 2, 0, 1, 4), "b": (0, 0, 2, 0, 2), None: (1, 2, 2, 1, 6)}
    one = results.before_after(some, some.filter("check_name <> 'c1'")).first()
    assert (one.both_before, one.both_after, one.pct_cut) == (3, 1, 66.7)
    empty = results.before_after(some.limit(0), some.limit(0)).first()
    assert empty.pct_cut == 0
    assert rows(results.rule_counts(some), "check_name", "n", "n_files") == [("c1", 4, 3), ("c2", 1, 1), ("c3", 1, 1)]
    assert rows(results.findings_by_file(some), "path", "n", "worst", "checks") == [
        ("g.js", 1, 0, "c3"), ("h.py", 2, 2, "c1,c1"), ("x/f.js", 2, 4, "c2,c1"), ("y/f.js", 1, 3, "c1")]



def test_verdicts(spark, some):
    doc = json.dumps({"findings": [
        {"index": 0, "verdict": "confirmed", "severity": "low", "confidence": 80},
        {"index": 0, "verdict": "false_positive", "severity": "nonsense", "fix": None},
        {"index": 1}, {"verdict": "confirmed"}, {"index": 7, "verdict": "confirmed"}]})
    null = json.dumps({"findings": [{"index": 0, "verdict": None, "severity": "low"}]})
    answers = spark.createDataFrame(
        [("a", "x/f.js", doc), ("a", "y/f.js", null), ("a", "g.js", "{oops"), ("b", "h.py", json.dumps({"findings": [{"index": 1, "severity": "medium"}]}))],
        "repo string, path string, response string")
    joined = review.join_verdicts(some, answers)
    got = {(r.path, r.idx): (r.ai.verdict, r.ai.severity) if r.ai else None for r in joined.collect()}
    assert got == {("x/f.js", 0): ("false_positive", None), ("x/f.js", 1): ("needs_review", None), ("y/f.js", 0): (None, "low"),
                   ("g.js", 0): None, ("h.py", 0): None, ("h.py", 1): ("needs_review", None)}
    assert rows(review.verdict_stats(joined), "repo", "confirmed", "false_positives", "needs_review") == [("a", 0, 1, 3), ("b", 0, 0, 2)]
    effective = {(r.path, r.idx): r.effective_severity for r in review.effective_severity(joined).collect()}
    assert effective[("y/f.js", 0)] == "low" and effective[("x/f.js", 0)] == "critical"
    assert [r.path for r in review.is_false_positive(joined).filter("is_false_positive").collect()] == ["x/f.js"]


def test_review_batches(spark, some, files):
    contents = files({"x/f.js": "z" * 8001, "y/f.js": "short"}, "a")
    batches = review.review_batches(some.filter("repo = 'a'"), contents).collect()
    assert sorted((r.path, r.part, r.parts, r.n_findings) for r in batches) == [("g.js", 0, 1, 1), ("x/f.js", 0, 2, 0), ("x/f.js", 1, 2, 2), ("y/f.js", 0, 1, 1)]
    got = {r.path: r.prompt for r in batches if r.part == r.parts - 1}
    rest = next(r.prompt for r in batches if (r.path, r.part) == ("x/f.js", 0)).split("\n")
    assert rest[0].endswith("(part 1 of 2)") and rest[3] == "z" * 8000 and rest[-2] == "FINDINGS (0 issues flagged by static scanner):"
    lines = got["x/f.js"].split("\n")
    nonce = lines[2].split(" ")[1][:-3]
    assert len(nonce) == 16 and lines[2] == f"<<<UNTRUSTED_FILE {nonce}>>>"
    assert lines[0].endswith("(part 2 of 2)") and lines[3] == "z"
    assert lines[4:] == [
        f"<<<END_UNTRUSTED_FILE {nonce}>>>", "", "FINDINGS (2 issues flagged by static scanner):",
        "", "0. [CRITICAL] Line 9: c2", "   Message: about c2", "   Code:   k", "   Scanner suggestion: do this",
        "", "1. [HIGH] Line 2: c1", "   Message: about c1", "   Code: eval(x)", "   Scanner suggestion: do this"]
    assert "Code:" not in got["g.js"] and "suggestion" not in got["g.js"] and "(file not readable)" in got["g.js"]
    # a nonce that the file contains is replaced
    fixed = review.review_batches(some.filter("path = 'y/f.js'"), files({"y/f.js": "has 0123456789abcdef"}, "a"), F.lit("0123456789abcdef"))
    assert fixed.first().prompt.count("0123456789abcdef") == 1


def document(df, repo):
    ordered = df.filter(F.col("repo") == repo).orderBy(*exports.DOCUMENT_ORDER).collect()
    return json.loads("".join(r.text for r in ordered))


def test_json_documents(spark, some):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("clean", "3")], "repo string, path string")
    doc = exports.json_document(some, results.severity_summary(some, files))
    a = document(doc, "a")
    assert [(f["check"], f["file"], f["line"]) for f in a["findings"]] == [
        ("c2", "x/f.js", 9), ("c1", "x/f.js", 2), ("c1", "y/f.js", 7), ("c3", "g.js", 1)]
    assert a["summary"] == {"files_scanned": 1, "critical": 1, "high": 2, "medium": 0, "low": 0, "total": 4}
    assert a["findings"][0] == {"check": "c2", "severity": "critical", "file": "x/f.js", "line": 9, "column": 3, "message": "about c2",
                                "snippet": "  k", "fix": "do this"}
    assert [f["snippet"] for f in document(doc, "b")["findings"]] == ["q\"\\\t"] * 2
    assert document(doc, "clean") == {"findings": [], "summary": {"files_scanned": 1, "critical": 0, "high": 0, "medium": 0, "low": 0, "total": 0}}


def test_reviewed_json_keeps_inner_nulls(spark, some):
    answers = spark.createDataFrame([("a", "x/f.js", '{"findings":[{"index":0,"verdict":"confirmed"}]}')], "repo string, path string, response string")
    joined = review.join_verdicts(some, answers)
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "repo string, path string")
    doc = exports.json_document(joined, results.severity_summary(joined, files), review.verdict_stats(joined))
    a = document(doc, "a")
    assert a["findings"][0]["ai"] == {"verdict": "confirmed", "confidence": None, "explanation": None, "fix": None, "severity": None}
    assert "ai" not in a["findings"][1]
    assert a["ai"] == {"confirmed": 1, "false_positives": 0, "needs_review": 3}


def test_sarif_documents(spark, some, tmp_path):
    repos = spark.createDataFrame([("a",), ("b",), ("clean",)], "repo string")
    doc = exports.sarif_document(some, repos)
    run = document(doc, "a")["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["c2", "c1", "c3"]
    assert run["tool"]["driver"]["rules"][1] == {
        "id": "c1", "shortDescription": {"text": "about c1"}, "properties": {"security-severity": "7.5"}, "help": {"text": "do this"}}
    assert "help" not in run["tool"]["driver"]["rules"][2]
    assert [r["level"] for r in run["results"]] == ["error", "error", "error", "note"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 9, "startColumn": 3}
    assert document(doc, "clean")["runs"][0]["results"] == []
    exports.write_documents(doc, str(tmp_path / "s"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "s" / "repo=a").glob("part-*")))
    assert json.loads(text)["version"] == "2.1.0"


def test_fix_prompts(some):
    got = {r.check_name: r.prompt for r in exports.fix_prompts(some.filter("repo = 'a'")).collect()}
    assert got["c2"] == (
        "I have a security vulnerability in `x/f.js` at line 9.\n\n**Issue:** about c2\n\n**Vulnerable code:**\n```\n  k\n```\n\n"
        "**Suggested approach:** do this\n\nPlease fix this vulnerability. Show me the corrected code with an explanation of why the "
        "original was insecure.")
    assert "```" not in got["c3"] and "Suggested" not in got["c3"]


def test_scorecard(spark, findings):
    labels = spark.createDataFrame(
        [("v1", "vulnerable", "x", "high"), ("v2", "vulnerable", "x", "high"), ("v3", "vulnerable", "y", "info"), ("c1", "clean", "x", "info"), ("c2", "clean", "x", "info")],
        "name string, kind string, category string, min_severity string")
    found = findings(("r", "v1", "a", "critical", 1, ""), ("r", "v2", "a", "medium", 1, ""), ("r", "c1", "a", "low", 1, ""), ("r", "c2", "a", "medium", 3, ""))
    judged = scoring.label_join(labels, found)
    one = scoring.scorecard(judged).first()
    assert (one.detected, one.n_vulnerable, one.fp_files, one.n_clean) == (1, 3, 1, 2)
    assert (one.recall, one.fp_rate, one.precision, one.f1) == (0.333, 0.5, 0.5, 0.4)
    assert rows(scoring.category_recall(judged), "category", "hits", "total") == [("x", 1, 2), ("y", 0, 1)]
    assert rows(scoring.alarming_findings(labels, found), "name", "check_name", "line") == [("c2", "a", 3)]
    zero = scoring.scorecard(judged.limit(0)).first()
    assert (zero.recall, zero.fp_rate, zero.precision, zero.f1) == (0, 0, 0, 0)


def test_stack(spark, files):
    df = files({"package.json": '{"dependencies": {"next": "1"}, "devDependencies": {"prisma": "1", "react": "1"}}', "next.config.js": "",
                "requirements.txt": "Flask", "pyproject.toml": "flask stripe", "sub/go.mod": ""}, "one").unionByName(
        files({"package.json": "[1", "Dockerfile": ""}, "two"))
    found = stack.detect_stack(df)
    names = {repo: [r.framework for r in found.filter(F.col("repo") == repo).orderBy("ord").collect()] for repo in ("one", "two")}
    assert names == {"one": ["Next.js", "Node.js", "Prisma", "Python", "Flask", "Stripe"], "two": ["Docker", "Node.js"]}
    assert rows(stack.recommended_checks(found).filter("repo = 'one'"), "ord") == [(2,), (4,), (5,), (6,)]
    lines = [r.text for r in stack.suggested_ignores(df, found).filter("repo = 'two'").orderBy("ord").collect()]
    assert lines[0] == "# Dependencies" and lines[-1] == "*.tar"


def test_changed_and_single_files(files, spark):
    df = files({"a.py": "1", "b.py": "2", "node_modules/c.js": "3"})
    changed = spark.createDataFrame([("r", "b.py"), ("r", "b.py"), ("q", "a.py")], "repo string, path string")
    assert rows(fo.changed_files(df, changed), "path") == [("b.py",)]
    assert rows(fo.single_file(df, "r", "node_modules/c.js"), "path") == [("node_modules/c.js",)]


def test_broadcast_only_below_the_bound(spark):
    small, big = spark.range(10), spark.range(1000)
    assert "broadcast" in broadcast_if_small(small, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(big, 100)._jdf.queryExecution().logical().toString().lower()
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert "broadcast" not in broadcast_if_small(wide, 100, 5000)._jdf.queryExecution().logical().toString().lower()
