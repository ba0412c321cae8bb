import json
import os

import pytest

from vigilake.operators import custom_rules as cr
from vigilake.operators import explain
from vigilake.operators import files as fo
from vigilake.operators.git import env_gitignore_findings, nearest_git_root
from vigilake.plans.registry import Checks, with_verdicts
from vigilake.plans.scan import rule_ids, scan
from vigilake.sources.rule_packs import read_rule_packs
from vigilake.sources.tables import control_files, read_files, write_files
from vigilake.sources.tree import read_tree


@pytest.fixture
def tree(tmp_path):
    def put(path, data):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data if isinstance(data, bytes) else data.encode())

    put(".git/HEAD", "ref: x")
    put(".gitignore", "node_modules")
    put(".env", "API_KEY=abcd1234")
    put("_private/a.py", b"x = '\xff'\r\neval(x)\r")
    put("src/b.js", "eval(x)")
    put("node_modules/c.js", "eval(x)")
    put("big.js", b"eval(x)\n" + b"x" * 4_000_001)
    return tmp_path


def test_tree_reads_hidden_files(spark, tree):
    files = read_tree(spark, str(tree), "shop")
    got = {r.path: r.content for r in files.collect()}
    assert sorted(got) == [".env", ".git", ".gitignore", "_private/a.py", "big.js", "node_modules/c.js", "src/b.js"]
    assert got["_private/a.py"] == "x = '�'\neval(x)\n"
    rows = scan(files, only=[r for r in rule_ids() if "eval" in r or "env" in r]).select("repo", "path", "check_name").collect()
    assert sorted(map(tuple, rows)) == [
        ("shop", ".env", "env-has-secret"), ("shop", ".env", "env-not-gitignored"),
        ("shop", "_private/a.py", "eval-usage"), ("shop", "big.js", "js-eval"), ("shop", "src/b.js", "js-eval")]


def test_one_file_and_missing_tree(spark, tree):
    assert [r.path for r in read_tree(spark, str(tree / "src" / "b.js")).collect()] == ["b.js"]
    with pytest.raises(Exception):
        read_tree(spark, str(tree / "nowhere")).collect()


def test_table_layout_prunes_by_language(spark, tree, tmp_path):
    files = read_tree(spark, str(tree), "shop")
    out = str(tmp_path / "table")
    write_files(files, out)
    assert {d for d in os.listdir(out) if d.startswith("language=")} == {
        "language=control", "language=dotenv", "language=javascript", "language=python"}
    stored = read_files(spark, out)
    cols = ["repo", "path", "check_name", "line", "column"]
    want = sorted(map(tuple, scan(files).select(*cols).collect()))
    found = scan(stored)
    assert sorted(map(tuple, found.select(*cols).collect())) == want and want
    assert "language#" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.path for r in control_files(stored).collect()) == [".git", ".gitignore"]


def test_rule_packs(spark, tmp_path):
    rules = tmp_path / ".scan" / "rules"
    rules.mkdir(parents=True)
    (rules / "b.json").write_text(json.dumps([
        {"id": "one", "severity": "HIGH", "message": "m", "pattern": "(?P<a>x)(?P=a)"},
        {"id": "two", "severity": "loud", "message": "m", "pattern": "y"}, {"id": "three"}]))
    (rules / "a.json").write_text(json.dumps({"id": "zero", "severity": "low", "message": "m", "pattern": "z", "languages": ["python"], "fix": "f"}))
    (rules / "c.json").write_text("{broken")
    (rules / "d.json").write_text(json.dumps({"id": "bad", "severity": "low", "message": "m", "pattern": "(("}))
    docs = cr.parse_docs(read_rule_packs(spark, str(tmp_path)))
    checked = {r.id: r.reason for r in cr.validate(docs).collect()}
    assert checked == {"zero": None, "one": None, "two": "invalid severity: loud", "three": "missing fields: severity, pattern, message", "bad": "invalid regex",
                       None: "invalid JSON"}
    refused = []
    loaded = cr.load_rules(docs, refused)
    assert sorted(refused, key=str) == sorted(((k, v) for k, v in checked.items() if v), key=str)
    assert [(r.rule_id, r.severity, r.languages, r.fix) for r in loaded] == [("zero", "low", ("python",), "f"), ("one", "high", ("*",), "")]


def test_yaml_rule_packs(spark, tmp_path):
    pytest.importorskip("yaml")
    rules = tmp_path / ".scan" / "rules"
    rules.mkdir(parents=True)
    (rules / "p.yml").write_text("---\nid: a\nseverity: low\nmessage: m\npattern: 'x\\('\n---\n- {id: b, severity: high, message: m, pattern: y}\n")
    assert [r.rule_id for r in cr.load_rules(cr.parse_docs(read_rule_packs(spark, str(tmp_path))))] == ["a", "b"]


def test_the_engine_side_of_validation(spark):
    rows = [("a", "low", None, "m", p, None) for p in (r"(?P<n>a)(?P=n)\Z", r"(a)?(?(1)b|c)", r"(?<=a+)b", "([", r"x{2,}", r"[\b]x")]
    got = {r.pattern: r.reason for r in cr.validate(spark.createDataFrame(rows, cr.RULE_DOC)).collect()}
    assert got[r"(?P<n>a)(?P=n)\Z"] is None and got[r"x{2,}"] is None
    assert got["(["] == "invalid regex" and got[r"(?<=a+)b"] == "invalid regex"
    assert got[r"(a)?(?(1)b|c)"] == "not supported by the scan engine: conditional group"
    assert got[r"[\b]x"] == "not supported by the scan engine: the pattern does not compile"


def test_packs_in_repositories(spark):
    """YAML streams and JSON of each repository; what cannot be read gives a reason and nothing else is lost."""
    from vigilake.plans.repo_rules import scan_repo_rules
    from vigilake.sources.rule_packs import packs_in

    yml = "# pack\n---\nid: a\nseverity: High\nlanguages: python\nmessage: first\npattern: 'key\\d+'\n---\n- {id: b, severity: low, message: m, pattern: '([ab])\\1'}\n- {id: 7, severity: low, message: 3, pattern: '(?i)SECRET|token'}\n---\njust text\n"
    files = spark.createDataFrame([
        ("r", ".scan/rules/p.yml", yml), ("r", ".scan/rules/q.yaml", "id: [unclosed"), ("r", ".scan/rules/z.json", "{no"), ("r", ".scan/rules/deep/p.yml", yml),
        ("r", "rules/p.yml", yml), ("s", ".scan/rules/s.json", '{"id": "a", "severity": "low", "message": "other", "pattern": "[a-z]+"}'),
        ("s", ".scan/rules/t.yml", "{id: bad, severity: low, message: m, pattern: '(?(1)a|b)'}"), ("r", ".scan/rules/none.yml", None),
        ("r", "m.py", "key12 = 1\n# key13\nxx aa Token secret\n"), ("r", "m.js", "key12\nbb"), ("s", "m.js", "12 key12\n\nSECRET"),
    ], "repo string, path string, content string")
    checked = cr.validate(cr.parse_docs(packs_in(files))).cache()
    refused = sorted((r.repo, r.source.split("/")[-1], r.reason) for r in cr.refused_rules(checked).collect())
    assert [x[:2] for x in refused] == [("r", "none.yml"), ("r", "p.yml"), ("r", "q.yaml"), ("r", "z.json"), ("s", "t.yml")]
    assert refused[0][2] == "not readable" and refused[1][2] == "no rule" and refused[2][2].startswith("invalid YAML") and refused[3][2] == "invalid JSON"
    found = scan_repo_rules(files, checked).filter("path like 'm.%'").select("repo", "path", "check_name", "line", "column", "rule_ord")
    assert sorted(map(tuple, found.collect())) == [
        ("r", "m.js", "b", 2, 0, 1001), ("r", "m.py", "7", 3, 6, 1002), ("r", "m.py", "a", 1, 0, 1000), ("r", "m.py", "b", 3, 3, 1001),
        ("s", "m.js", "a", 1, 3, 1000)]


def test_blocks_of_literals_change_nothing(spark, monkeypatch):
    from vigilake.plans import repo_rules as rr

    rules = [(f"r{i}", "low", None, "m", p, None) for i, p in enumerate(["alpha|beta", "BETA", "(?i)gamma", r"x\d", "alpha.*delta", "[0-9]{2}"])]
    docs = spark.createDataFrame([("r", "p.json", 0, i, *r) for i, r in enumerate(rules)], "repo string, source string, ord long, pos int, " + cr.RULE_DOC)
    files = spark.createDataFrame([("r", "a.js", "alpha beta delta\nBETA Gamma x1 22\n" * 20)], "repo string, path string, content string")
    whole = sorted(map(tuple, rr.scan_repo_rules(files, cr.validate(docs)).collect()))
    monkeypatch.setattr(rr, "LITERALS_PER_BLOCK", 1)
    assert sorted(map(tuple, rr.scan_repo_rules(files, cr.validate(docs)).collect())) == whole and len(whole) == 20 * 6


def test_registered_rules_are_refused_early(spark):
    from vigilake.plans.registry import Checks

    for pattern in ("([", "(a)?(?(1)b|c)"):
        with pytest.raises(ValueError):
            Checks().register_rule({"id": "x", "severity": "low", "pattern": pattern, "message": "m"})


def test_ignore_rules(files):
    df = files({".scanignore": "# c\n\n gen/* \n*.tmp.js\n", "gen/a/b.js": "", "x.tmp.js": "", "ok.js": "", "a.md": "", "b.pyc": "",
                "dist/a.js": "", "dist": "", ".env.local": "", "package-lock.json": "", "sub/.scanignore": "*"})
    kept = fo.ignore_filter(df, fo.ignore_globs(df), ["ok*"])
    assert sorted(r.path for r in kept.collect()) == [".env.local"]


def test_nearest_git_root(files):
    deep = "/".join("abcdefghijk")
    df = files({".git/HEAD": "", "x/.git": "", "x/y/.env": "A=1", "z/.env": "", f"{deep}/.env": "", "x/.gitignore": "*.env", "q/.env.local": ""})
    envs = df.filter("path like '%.env'").select("repo", "path")
    from vigilake.operators.git import git_roots
    got = {r.path: r.dir for r in nearest_git_root(envs, git_roots(df)).collect()}
    assert got == {"x/y/.env": "x", "z/.env": "", f"{deep}/.env": ""}
    assert {r.path for r in nearest_git_root(envs, git_roots(df), max_levels=10).collect()} == {"x/y/.env", "z/.env"}
    assert sorted((r.path, r.check_name) for r in env_gitignore_findings(df).collect()) == [
        (f"{deep}/.env", "env-no-gitignore"), ("z/.env", "env-no-gitignore")]


def test_registered_rules_and_checks(files):
    from pyspark.sql import functions as F

    checks = Checks()
    checks.register_rule({"id": "todo", "severity": "Low", "pattern": "TODO", "message": "left to do"})
    checks.register_check("empty-file", lambda f: f.filter(F.length("content") == 0).select(
        "repo", "path", F.lit("info").alias("severity"), F.lit(1).alias("line"), F.lit(0).alias("column"), F.lit("empty").alias("message"),
        F.lit("").alias("snippet"), F.lit("").alias("fix_hint")))
    df = files({"a.py": "x # TODO", "b.py": "", "c.md": ""})
    assert sorted((r.path, r.check_name) for r in checks.scan(df).collect()) == [("a.py", "todo"), ("b.py", "empty-file")]
    assert [r.check_name for r in checks.scan(df, min_severity="low").collect()] == ["todo"]
    with pytest.raises(ValueError):
        checks.register_rule({"id": "x"})


def test_reviewer_hook(spark):
    def reviewer(frames):
        for f in frames:
            yield f.assign(response='{"findings":[]}')[["repo", "path", "response"]]

    batches = spark.createDataFrame([("r", "p", 1, "text")], "repo string, path string, n_findings long, prompt string")
    assert with_verdicts(batches, reviewer).first().response == '{"findings":[]}'


def test_every_check_is_documented(spark):
    docs = {r.check_name: r for r in explain.rule_docs(spark).collect()}
    assert set(docs) == set(rule_ids())
    assert all(r.title and r.what and r.why and r.patterns for r in docs.values())
