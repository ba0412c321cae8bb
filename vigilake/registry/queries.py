"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import env_values, paths, text
from vigilake.model import FINDING_COLUMNS
from vigilake.operators import baseline as bl
from vigilake.operators import custom_rules as cr
from vigilake.operators import explain, exports, files as fo, git, python_facts as pf, results, review, scoring, stack, verdicts
from vigilake.operators.changes import changed_since, listing, snapshot_diff
from vigilake.operators.line_rules import builtin_line_rules, comment_test
from vigilake.plans import corpora
from vigilake.plans.chunk_scan import chunk_lines, scan_chunks
from vigilake.plans.scan import prepare, scan, sort_findings
from vigilake.session import configure, materialize, shared_folder
from vigilake.plans.repo_rules import packs_in, scan_repo_rules
from vigilake.plans.registry import Checks
from vigilake.registry import replays
from vigilake.plans.sql_checks import findings as check_findings, register_check as register_sql_check
from vigilake.sources import documents, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FAMILIES = {
    "rules_secrets": ["secrets"],
    "rules_config": ["config"],
    "rules_dotenv": ["dotenv-secrets"],
    "rules_supabase": ["frameworks-supabase"],
    "rules_firebase": ["frameworks-firebase"],
    "rules_nextjs": ["frameworks-nextjs"],
    "rules_nextauth": ["frameworks-nextauth"],
    "rules_prisma": ["frameworks-prisma"],
    "rules_stripe": ["frameworks-stripe"],
}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        return fn

    return register


def all_rules() -> list:
    env = [fv.ENV_NOT_GITIGNORED, fv.ENV_NO_GITIGNORE, fv.ENV_SECRET, fv.ENV_EXAMPLE_SECRET]
    return [*builtin_line_rules(), *fv.FACT_RULES.values(), *fv.FILE_RULES.values(), *env]


def family_ids(*families: str) -> list[str]:
    return [r.rule_id for r in all_rules() if r.family in families]


def text_findings(spark: SparkSession, sf_dir: str, min_severity: str = "info", without: str | None = None) -> DataFrame:
    """Findings of the custom rule pack over the text corpus."""
    rules = [r for r in corpora.text_rules() if r.rule_id != without]
    return scan(corpora.text_files(spark, sf_dir), custom_rules=rules, only=[r.rule_id for r in rules], min_severity=min_severity)


def code_scan(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    files = corpora.code_files(spark, sf_dir)
    return scan(files, ignores=fo.ignore_globs(files), **options)


# -- sources and sinks -----------------------------------------------------------------------


@query("source_tree_scan")
def _(spark, sf):
    files = corpora.code_files(spark, sf)
    return files.select("repo", "path", F.length("content").alias("n_chars")).orderBy("repo", "path")


@query("single_file_scan")
def _(spark, sf):
    files = corpora.code_files(spark, sf).filter(F.startswith("path", F.lit("node_modules/")))
    return scan(files, ignore_rules=False, git_lookup=False, only=family_ids("injection"))


@query("read_decode")
def _(spark, sf):
    docs = corpora.table(spark, sf, "documents")
    raw = F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\r\n\xff tail \xc3\r")), F.encode("lang", "UTF-8"))
    files = docs.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), raw.alias("raw"))
    out = fo.decode(files)
    return out.select(
        "repo", "path", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


def rule_packs(spark, sf) -> DataFrame:
    """One rule document per part; some are lists, some lack fields or have a broken pattern."""
    parts = corpora.table(spark, sf, "part")
    ident = F.concat(F.lit("part-"), F.col("p_partkey"))
    broken = F.when(F.pmod("p_partkey", F.lit(11)) == 3, F.concat("p_name", F.lit(" (["))).otherwise(F.col("p_name"))
    sev = F.element_at(
        F.array(*[F.lit(s) for s in ("critical", "HIGH", "Medium", "low", "info", "severe")]),
        F.pmod("p_size", F.lit(6)) + 1)
    message = F.when(F.pmod("p_partkey", F.lit(7)) == 2, F.lit(None)).otherwise(F.col("p_type"))
    doc = F.to_json(F.struct(
        ident.alias("id"), sev.alias("severity"), message.alias("message"), broken.alias("pattern"),
        F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.array(F.lit("python"))).alias("languages")))
    listed = F.concat(F.lit("["), doc, F.lit(","), F.to_json(F.struct(F.concat(ident, F.lit("-b")).alias("id"))), F.lit("]"))
    return parts.select(
        F.concat("p_brand", F.lit(".json")).alias("source"), F.col("p_partkey").alias("ord"),
        F.when(F.pmod("p_partkey", F.lit(5)) == 0, listed).otherwise(doc).alias("doc"))


@query("rule_pack_scan")
def _(spark, sf):
    docs = cr.parse_docs(rule_packs(spark, sf))
    return docs.select("source", "ord", "pos", "id", "severity", F.array_join("languages", ",").alias("languages"),
                       "message", "pattern").orderBy("source", "ord", "pos")


@query("rule_validate")
def _(spark, sf):
    return cr.validate(cr.parse_docs(rule_packs(spark, sf))).select(
        "source", "ord", "pos", "id", "valid", F.coalesce("reason", F.lit("")).alias("reason"),
        F.array_join("languages", ",").alias("languages"))


@query("rule_validate_counts")
def _(spark, sf):
    return cr.validation_counts(cr.validate(cr.parse_docs(rule_packs(spark, sf))))


@query("rule_catalog")
def _(spark, sf):
    """Catalogue with the number of files of the corpus that each rule set applies to."""
    custom = corpora.text_rules()
    # one row per language and a total, which is what "*" stands for
    languages = prepare(corpora.text_files(spark, sf)).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    counts = languages.rollup("language").agg(F.sum("n").alias("n")).select(F.coalesce("language", F.lit("*")).alias("lang"), "n")
    cat = cr.catalog(spark, custom).select("is_custom", "ord", "name", "severity", F.explode("languages").alias("lang"))
    return cat.join(counts, "lang", "left").groupBy("is_custom", "ord", "name", "severity").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


@query("ignore_pattern_scan")
def _(spark, sf):
    return fo.ignore_globs(corpora.code_files(spark, sf))


@query("baseline_sink")
def _(spark, sf):
    return bl.baseline_header(text_findings(spark, sf))


@query("baseline_scan")
def _(spark, sf):
    return bl.baseline_rows(text_findings(spark, sf))


@query("baseline_document")
def _(spark, sf):
    return bl.baseline_document(text_findings(spark, sf))


@query("findings_json_sink")
def _(spark, sf):
    files = corpora.text_files(spark, sf)
    found = materialize(text_findings(spark, sf))
    return exports.json_document(found, results.severity_summary(found, prepare(files)))


@query("sarif_sink")
def _(spark, sf):
    return exports.sarif_document(materialize(text_findings(spark, sf)), corpora.text_files(spark, sf))


@query("fix_prompt_sink")
def _(spark, sf):
    return exports.fix_prompts(text_findings(spark, sf))


def secret_nonce():
    return F.substring(F.md5(F.concat(F.lit("nonce/"), F.col("repo"), F.lit("/"), F.col("path")).cast("binary")), 1, 16)


@query("review_batch_sink")
def _(spark, sf):
    return review.review_batches(text_findings(spark, sf), corpora.text_files(spark, sf), secret_nonce())


# -- projections, filters, predicates ----------------------------------------------------------


@query("detect_language")
def _(spark, sf):
    files = corpora.code_files(spark, sf)
    return fo.classify(files).select("repo", "path", "name", paths.suffix(F.col("name")).alias("suffix"), "language")


@query("ignore_filter")
def _(spark, sf):
    files = corpora.code_files(spark, sf)
    return fo.ignore_filter(files, fo.ignore_globs(files), ["*.conf"]).select("repo", "path")


GLOBS = ["*.py", "src/*", "*/doc_1*", "src?/*.json", "src[0-4]/doc_*[!5].ts", "doc_7.js", "node_modules/"]


@query("glob_match")
def _(spark, sf):
    files = corpora.text_files(spark, sf).select("repo", "path", paths.basename(F.col("path")).alias("name"))
    cases = [F.when(fo.globs_match([g], F.col("path"), F.col("name")), F.lit(g)) for g in GLOBS]
    return files.select("repo", "path", F.explode(F.array_compact(F.array(*cases))).alias("glob"))


@query("severity_filter")
def _(spark, sf):
    return text_findings(spark, sf, min_severity="medium")


@query("check_dispatch")
def _(spark, sf):
    files = prepare(corpora.code_files(spark, sf)).select("repo", "path", "language")
    applies = F.expr("filter(array({}), c -> array_contains(c.langs, language) or array_contains(c.langs, '*'))".format(
        ", ".join("named_struct('name', '{}', 'langs', array({}))".format(n, ", ".join(f"'{x}'" for x in langs))
                  for n, _, langs, _ in fv.CHECKS)))
    return files.select("repo", "path", "language", F.explode(applies).alias("c")).select("repo", "path", "language", "c.name")


@query("comment_skip")
def _(spark, sf):
    lines = fo.numbered_lines(prepare(corpora.code_files(spark, sf))).withColumn("stripped", text.lstrip(F.col("text")))
    flagged = lines.select(
        "repo", "path", "line",
        F.expr(comment_test("stripped", fv.ALL_COMMENTS)).alias("skip_config"),
        F.expr(comment_test("stripped", fv.SLASH_COMMENTS)).alias("skip_js"),
        ((F.col("stripped") == "") | F.startswith("stripped", F.lit("#"))).alias("skip_env"))
    return flagged.groupBy("repo", "path").agg(*[
        F.count(F.when(F.col(c), 1)).alias(c) for c in ("skip_config", "skip_js", "skip_env")],
        F.count(F.lit(1)).alias("n_lines"))


@query("line_numbering")
def _(spark, sf):
    lines = fo.numbered_lines(fo.classify(corpora.text_files(spark, sf)))
    return lines.select("repo", "path", "line", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("finding_fingerprint")
def _(spark, sf):
    return bl.with_fingerprint(code_scan(spark, sf, only=family_ids("injection", "config", "frameworks-nextjs"))).select(
        "repo", "path", "line", "column", "rule_ord", "fingerprint")


@query("severity_levels")
def _(spark, sf):
    return results.severity_levels(text_findings(spark, sf)).groupBy(
        "severity", "sarif_level", "sarif_score", "editor_level").agg(F.count(F.lit(1)).alias("n"))


def env_lines(spark, sf) -> DataFrame:
    files = prepare(corpora.code_files(spark, sf)).filter(F.col("language") == "dotenv")
    lines = fo.numbered_lines(files).withColumn("stripped", text.strip(F.col("text")))
    return lines.filter(F.contains("stripped", F.lit("=")) & ~F.startswith("stripped", F.lit("#")))


@query("env_kv")
def _(spark, sf):
    s = F.col("stripped")
    return env_lines(spark, sf).select(
        "repo", "path", "line", env_values.env_key(s).alias("key"), env_values.env_raw_value(s).alias("raw_value"))


@query("env_clean_value")
def _(spark, sf):
    raw = env_values.env_raw_value(F.col("stripped"))
    return env_lines(spark, sf).select("repo", "path", "line", env_values.clean_value(raw).alias("value"))


@query("env_is_placeholder")
def _(spark, sf):
    value = env_values.clean_value(env_values.env_raw_value(F.col("stripped")))
    return env_lines(spark, sf).select("repo", "path", "line", env_values.is_placeholder(value).alias("placeholder"))


@query("env_secret_key")
def _(spark, sf):
    key = env_values.env_key(F.col("stripped"))
    return env_lines(spark, sf).select("repo", "path", "line", key.alias("key"), env_values.is_secret_key(key).alias("secret"))


# -- joins --------------------------------------------------------------------------------------


@query("rule_line_match")
def _(spark, sf):
    return text_findings(spark, sf)


@query("baseline_filter")
def _(spark, sf):
    found = materialize(text_findings(spark, sf))
    known = bl.baseline_rows(results.at_least(found, "medium"))
    return bl.filter_baseline(found, known).select("repo", "path", "line", "column", "check_name", "fingerprint")


@query("except_baseline")
def _(spark, sf):
    found = materialize(text_findings(spark, sf))
    return bl.removed_by_baseline(found, bl.baseline_rows(results.at_least(found, "medium")))


@query("distinct_fingerprints")
def _(spark, sf):
    return bl.baseline_rows(code_scan(spark, sf, only=family_ids("config")))


@query("duplicate_fingerprints")
def _(spark, sf):
    return bl.duplicate_fingerprints(code_scan(spark, sf, only=family_ids("injection", "secrets")))


@query("custom_ignore_antijoin")
def _(spark, sf):
    files = corpora.code_files(spark, sf)
    kept = fo.ignore_filter(files, fo.ignore_globs(files)).select("repo", "path")
    return fo.ignore_filter(files).select("repo", "path").join(kept, ["repo", "path"], "left_anti")


@query("nearest_git_root")
def _(spark, sf):
    files = corpora.code_files(spark, sf)
    return git.nearest_git_root(git.env_files(files), git.git_roots(files))


@query("env_gitignore_lookup")
def _(spark, sf):
    return git.env_gitignore_findings(corpora.code_files(spark, sf)).select(*FINDING_COLUMNS)


RESPONSES = [
    '{"findings":[{"index":0,"verdict":"confirmed","confidence":{n},"explanation":"real","severity":"low","fix":"f"},'
    '{"index":1,"verdict":"false_positive","severity":"bogus"},{"verdict":"confirmed","confidence":5}]}',
    '{"findings":[{"index":0,"verdict":"confirmed"},{"index":0,"verdict":"false_positive","confidence":{n}}]}',
    '{"findings":[{"index":0},{"index":1,"verdict":null,"severity":"critical"},{"index":99,"verdict":"confirmed"}]}',
    '{"findings":[{"index":0,"verdict":"confirmed"',
    '{"other":[]}',
]


def responses(spark, sf) -> DataFrame:
    """Review responses, one per file of the text corpus; some malformed, some with gaps."""
    docs = corpora.table(spark, sf, "documents")
    files = docs.join(corpora.text_names(docs), "doc_id")
    form = F.element_at(F.array(*[F.lit(r) for r in RESPONSES]), F.pmod("doc_id", F.lit(len(RESPONSES))).cast("int") + 1)
    return files.select(
        F.col("source").alias("repo"), F.concat("source", F.lit("/"), "name").alias("path"),
        F.replace(form, F.lit("{n}"), F.pmod("n_chars", F.lit(101)).cast("string")).alias("response"))


def reviewed(spark, sf) -> DataFrame:
    return review.join_verdicts(text_findings(spark, sf), responses(spark, sf))


@query("verdict_join")
def _(spark, sf):
    return reviewed(spark, sf).select(
        "repo", "path", "idx", "check_name", "severity", F.col("ai").isNotNull().alias("reviewed"),
        F.col("ai.verdict").alias("verdict"), F.col("ai.confidence").alias("confidence"),
        F.col("ai.severity").alias("ai_severity"))


@query("effective_severity")
def _(spark, sf):
    return review.effective_severity(reviewed(spark, sf)).groupBy("severity", "effective_severity").agg(F.count(F.lit(1)).alias("n"))


@query("is_false_positive")
def _(spark, sf):
    return review.is_false_positive(reviewed(spark, sf)).select("repo", "path", "idx", "check_name", "is_false_positive")


@query("verdict_stats")
def _(spark, sf):
    return review.verdict_stats(reviewed(spark, sf))


@query("reviewed_json_sink")
def _(spark, sf):
    found = materialize(reviewed(spark, sf))
    summary = results.severity_summary(found, prepare(corpora.text_files(spark, sf)))
    return exports.json_document(found, summary, review.verdict_stats(found))


@query("stack_signal_join")
def _(spark, sf):
    return stack.detect_stack(corpora.project_files(spark, sf))


@query("stack_by_category")
def _(spark, sf):
    return stack.stack_by_category(stack.detect_stack(corpora.project_files(spark, sf)))


@query("stack_recommendations")
def _(spark, sf):
    files = corpora.project_files(spark, sf)
    found = stack.detect_stack(files)
    checks = stack.recommended_checks(found).select("repo", F.lit("check").alias("kind"), "ord", "text")
    ignores = stack.suggested_ignores(files.select("repo"), found).select("repo", F.lit("ignore").alias("kind"), "ord", "text")
    return checks.unionByName(ignores)


@query("explain_enrich")
def _(spark, sf):
    found = explain.explain_findings(code_scan(spark, sf, only=family_ids("injection", "config", "dotenv-secrets")))
    return found.groupBy(*explain.DOC_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


@query("explain_names")
def _(spark, sf):
    names = corpora.table(spark, sf, "part").select(
        "p_partkey",
        F.element_at(F.array(*[F.lit(x) for x in ("secrets", "frameworks-", "next", "dotenv", "config", "nothing")]),
                     F.pmod("p_partkey", F.lit(6)).cast("int") + 1).alias("name"))
    return explain.explain_names(names)


@query("changed_files_scan")
def _(spark, sf):
    docs = corpora.table(spark, sf, "documents").select("doc_id", "source")
    changed = docs.join(corpora.text_names(docs), "doc_id").join(
        corpora.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.col("source").alias("repo"), F.concat("source", F.lit("/"), "name").alias("path"))
    rules = corpora.text_rules()
    staged = fo.changed_files(corpora.text_files(spark, sf), changed)
    return scan(staged, custom_rules=rules, only=[r.rule_id for r in rules], min_severity=fv.STAGED_MIN_SEVERITY)


def judged(spark, sf) -> DataFrame:
    return scoring.label_join(corpora.truth_labels(spark, sf), text_findings(spark, sf))


@query("label_join")
def _(spark, sf):
    return judged(spark, sf)


# -- aggregations --------------------------------------------------------------------------------


@query("severity_summary")
def _(spark, sf):
    files = corpora.code_files(spark, sf)
    kept = prepare(files, ignores=fo.ignore_globs(files))
    return results.severity_summary(code_scan(spark, sf, only=family_ids("config", "injection")), kept)


@query("exit_gate")
def _(spark, sf):
    return results.exit_gate(text_findings(spark, sf), prepare(corpora.text_files(spark, sf)))


@query("fail_on_gate")
def _(spark, sf):
    summary = results.severity_summary(text_findings(spark, sf, "low"), prepare(corpora.text_files(spark, sf)))
    return results.fail_on_gates(summary, ["critical", "high", "medium", "low", "none"])


@query("findings_by_file")
def _(spark, sf):
    return results.findings_by_file(text_findings(spark, sf))


@query("rule_counts")
def _(spark, sf):
    return results.rule_counts(code_scan(spark, sf))


@query("detection_scorecard")
def _(spark, sf):
    return scoring.scorecard(judged(spark, sf))


@query("category_recall")
def _(spark, sf):
    return scoring.category_recall(judged(spark, sf))


@query("alarming_list")
def _(spark, sf):
    return scoring.alarming_findings(corpora.truth_labels(spark, sf), text_findings(spark, sf))


@query("repo_severity_pivot")
def _(spark, sf):
    return results.repo_severity_pivot(text_findings(spark, sf))


@query("before_after")
def _(spark, sf):
    return results.before_after(text_findings(spark, sf), text_findings(spark, sf, without="card-like-number"))


# -- windows, order, set operations ----------------------------------------------------------------


@query("finding_index")
def _(spark, sf):
    return results.finding_index(text_findings(spark, sf)).select("repo", "path", "idx", "check_name", "line", "column")


@query("top_n_per_file")
def _(spark, sf):
    return results.top_n_per_file(text_findings(spark, sf), 2).select("repo", "path", "pos", "more", "check_name", "line", "column")


@query("sorted_findings")
def _(spark, sf):
    # the sort samples its input first: without a stored copy the scan would run twice
    return sort_findings(materialize(code_scan(spark, sf)))


@query("union_checks")
def _(spark, sf):
    found = code_scan(spark, sf, custom_rules=corpora.text_rules())
    return found.groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))


# -- rule families -----------------------------------------------------------------------------------


def _family(name: str, ids: list[str]) -> None:
    query(name)(lambda spark, sf: code_scan(spark, sf, only=ids))


for _name, _families in FAMILIES.items():
    _family(_name, family_ids(*_families))
_PYTHON = [r for r in fv.FACT_RULES if r != "route-no-auth"]
_family("rules_python_injection", _PYTHON)
_family("rules_js_injection", [r.rule_id for r in fv.INJECTION_JS_RULES])
_family("route_no_auth", ["route-no-auth"])
_family("express_no_middleware", [fv.EXPRESS_RULE.rule_id])


for _rule in all_rules():
    _name = _rule.rule_id.replace("-", "_")
    if _name not in QUERIES:
        _family(_name, [_rule.rule_id])


@query("rules_custom")
def _(spark, sf):
    return text_findings(spark, sf)


@query("html_script_rules")
def _(spark, sf):
    files = corpora.page_files(spark, sf)
    return scan(files, git_lookup=False, custom_rules=cr.compile_rules([
        {"id": "tracking-call", "severity": "info", "languages": ["javascript"], "message": "Tracking call",
         "pattern": r"\btrack\s*\(", "fix": ""}]))


@query("py_calls")
def _(spark, sf):
    ready = prepare(corpora.code_files(spark, sf))
    return pf.py_calls(pf.python_facts(ready, every_file=True)).groupBy("callee", "is_bare", "receiver", "arg0_kind", "arg0_op", "shell_true_kw").agg(
        F.count(F.lit(1)).alias("n"))


@query("py_routes")
def _(spark, sf):
    routes = pf.py_routes(pf.python_facts(prepare(corpora.code_files(spark, sf)), every_file=True))
    lists = ["decorators", "param_names", "annotation_names", "default_calls"]
    return routes.select("repo", "path", "line", "col", "func", *[F.array_join(c, ",").alias(c) for c in lists], "has_dependencies_kw")


@query("py_imports")
def _(spark, sf):
    return pf.py_imports(pf.python_facts(prepare(corpora.code_files(spark, sf)), every_file=True)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# -- streams ---------------------------------------------------------------------------------------------


@query("change_detect")
def _(spark, sf):
    return replays.replay_change_detect(spark, sf)


@query("debounce")
def _(spark, sf):
    return replays.replay_debounce(spark, sf)


@query("stream_scan")
def _(spark, sf):
    return replays.replay_scan(spark, sf)


@query("stream_top5")
def _(spark, sf):
    return replays.replay_top(spark, sf)


@query("stream_baseline_filter")
def _(spark, sf):
    return replays.replay_baseline(spark, sf)


@query("watch_pipeline")
def _(spark, sf):
    return replays.replay_pipeline(spark, sf)


@query("watch_live")
def _(spark, sf):
    return replays.replay_live(spark, sf)


# -- operators under their own name -----------------------------------------------------------------------


@query("single_file")
def _(spark, sf):
    """One file that the ignore rules would skip, named as a user names it."""
    files = corpora.code_files(spark, sf)
    repo, path = files.filter(F.startswith("path", F.lit("node_modules/"))).select(F.min_by("repo", "path"), F.min("path")).first()
    return scan(fo.single_file(files, repo, path), ignore_rules=False, git_lookup=False, only=family_ids("injection"))


@query("baseline_load")
def _(spark, sf):
    """Baselines as they are found: a saved table, JSON documents, a missing and a corrupt one (a null row each)."""
    folder = shared_folder(spark)
    found = materialize(results.at_least(text_findings(spark, sf), "medium"))
    bl.save_baseline(found, f"{folder}/table")
    bl.save_documents(found, f"{folder}/documents")
    spark.range(1).select(F.lit("{not json")).write.text(f"{folder}/corrupt.json")
    loaded = bl.load_documents(spark, f"{folder}/documents")
    out = None
    for kind in ("table", "documents", "missing", "corrupt.json"):
        known = loaded if kind == "documents" else bl.load_baseline(spark, f"{folder}/{kind}")
        if known is None:
            known = spark.createDataFrame([(None, None)], "repo string, fingerprint string")
        part = known.select(F.lit(kind).alias("kind"), "repo", "fingerprint")
        out = part if out is None else out.unionByName(part)
    return out


@query("registered_checks")
def _(spark, sf):
    """A registered rule and a registered check next to built-in ones."""
    checks = Checks()
    checks.register_rule({"id": "licence-line", "severity": "LOW", "pattern": r"(?i)licen[cs]e", "message": "License line"})
    checks.register_check("long-file", lambda files: files.filter(F.length("content") > 10_000).select(
        "repo", "path", F.lit("medium").alias("severity"), F.lit(1).alias("line"), F.lit(0).alias("column"),
        F.concat(F.length("content").cast("string"), F.lit(" characters")).alias("message"), F.lit("").alias("snippet"), F.lit("").alias("fix_hint")))
    found = checks.scan(corpora.text_files(spark, sf), only=["licence-line"], extra_ignores=["src1[0-9]/*"])
    return found.select("repo", "path", "check_name", "severity", "line", "column", "message")


MALFORMED_IGNORES = ["[z-a]*", "doc_[!z-a]1.py", "*/doc_[[]*", "[", "*/doc_[]1-3]5.*", "a&&b", "[[...slug]].js", "(", "doc_7?.{ts,js}", "*[7-", "doc_[5-9-b]0.js"]


@query("ignore_malformed")
def _(spark, sf):
    """Files that odd ignore lines leave; every repository has all of them."""
    files = corpora.text_files(spark, sf)
    lines = files.select("repo").distinct().select(
        "repo", F.lit(fo.IGNORE_FILE).alias("path"), F.lit("\n".join(MALFORMED_IGNORES)).alias("content"))
    return fo.ignore_filter(files, fo.ignore_globs(lines)).select("repo", "path")


DIALECT_RULES = [
    ("named-one", r"(?P<what>token) = (?P<value>\S+)"), ("named-two", r"(?P<what>GNU|MIT) (?P<value>General|License)"),
    ("verbose", "(?x) licen[cs]e  # either spelling ("), ("open-repeat", r"\d{,3}\.\d{1,3}\.\d{,3}\.\d{1,3}"),
    ("nested", r"[[(]\d+[])]"), ("ampersands", r"[&&#]{3}"), ("brace", r"x{|\+1 \(\d{3}\)"), ("conditional", r"(a)?(?(1)b|c)"),
    ("ascii", r"(?a)\w+@"), ("broken", r"(["), ("back", r"(?P<ch>[*$%])(?P=ch){2}"),
]


@query("dialect_rules")
def _(spark, sf):
    """Findings of rules that use what the two regex dialects write differently, and why the others are refused."""
    rows = [(i, n, "low", None, n, p, None) for i, (n, p) in enumerate(DIALECT_RULES)]
    rejected: list = []
    rules = cr.load_rules(spark.createDataFrame(rows, "ord long, " + cr.RULE_DOC), rejected)
    reasons = dict(rejected)
    names = spark.createDataFrame([(n, reasons.get(n, "")) for n, _ in DIALECT_RULES], "check_name string, reason string")
    found = scan(corpora.text_files(spark, sf), custom_rules=rules, only=[r.rule_id for r in rules])
    return names.join(found.groupBy("check_name").agg(F.count(F.lit(1)).alias("n"), F.sum("column").alias("columns")), "check_name", "left").select(
        "check_name", "reason", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("columns", F.lit(0)).alias("columns"))


REPO_PACKS = [
    [{"id": "own", "severity": "high", "message": "License line", "pattern": "(?i)licen[cs]e"}],
    [{"id": "own", "severity": "low", "message": "Token", "pattern": "token = \"[0-9a-f]+", "languages": ["python", "json"]},
     {"id": "mail", "severity": "medium", "message": "Address", "pattern": r"[a-z]+\.?[0-9]*@[a-z0-9.]+"}],
    [{"id": "own", "severity": "nonsense", "message": "x", "pattern": "x"}],
]


@query("repo_rules")
def _(spark, sf):
    """Every repository's own rule pack, read from its files; the same id means different rules."""
    files = corpora.text_files(spark, sf)
    packs = F.array(*[F.lit(json.dumps(p)) for p in REPO_PACKS])
    number = F.regexp_extract("repo", r"(\d+)$", 1).cast("int")
    own = files.select("repo").distinct().select(
        "repo", F.lit(".scan/rules/own.json").alias("path"), F.element_at(packs, F.pmod(number, F.lit(len(REPO_PACKS))) + 1).alias("content"))
    both = files.unionByName(own)
    return scan_repo_rules(both, cr.validate(cr.parse_docs(packs_in(both)))).filter(~F.startswith("path", F.lit(".scan/"))).select(
        "repo", "path", "check_name", "severity", "line", "column", "message")


YAML_PACK = """---
id: own
severity: Medium
languages: [python, yaml]
message: License line
pattern: '(?i)licen[cs]e'
---
- {id: twice, severity: low, message: Repeated sign, pattern: '([*$%#])\\1\\1'}
- {id: digits, severity: info, message: Four digits, pattern: '\\d{4}', languages: json}
---
id: conditional
severity: low
message: x
pattern: '(a)?(?(1)b|c)'
"""
#: a YAML stream, one that is broken, and a JSON list
YAML_FILES = [("a.yml", YAML_PACK), ("b.yaml", "id: [open"), ("c.json", '[{"id": "own", "severity": "low", "message": "Token", "pattern": "token = \\"[0-9a-f]+"}]')]


def with_packs(files: DataFrame) -> DataFrame:
    """The files and, in every repository, one of the packs."""
    number = F.pmod(F.regexp_extract("repo", r"(\d+)$", 1).cast("int"), F.lit(len(YAML_FILES))) + 1
    pack = F.element_at(F.array(*[F.struct(F.lit(f".scan/rules/{n}").alias("path"), F.lit(c).alias("content")) for n, c in YAML_FILES]), number)
    return files.unionByName(files.select("repo").distinct().select("repo", pack["path"].alias("path"), pack["content"].alias("content")))


@query("repo_rules_yaml")
def _(spark, sf):
    """Findings of the rules in the YAML streams and JSON documents that lie in the repositories."""
    both = with_packs(corpora.text_files(spark, sf))
    found = scan_repo_rules(both, cr.validate(cr.parse_docs(packs_in(both))))
    return found.filter(~F.startswith("path", F.lit(".scan/"))).select("repo", "path", "check_name", "severity", "line", "column", "message", "rule_ord")


@query("refused_rules")
def _(spark, sf):
    """Rules and pack files of the repositories that no scan runs, and why."""
    both = with_packs(corpora.text_files(spark, sf))
    refused = cr.refused_rules(cr.validate(cr.parse_docs(packs_in(both))))
    return refused.select("repo", "source", F.coalesce("id", F.lit("")).alias("id"), "reason")


#: documents of one file, so that files have a bounded length whatever their number
DOCS_PER_FILE = 10_000
CHUNK_SNIPPETS = ["eval(input)", "document.write(y)", "app.get('/x', h)", "const router = express(); passport.use(s)", "prisma.$queryRawUnsafe(q)",
                  "createClient(supabase).from('t').insert(r)", "const k = 'AKIAIOSFODNN7EXAMPL' + n", "origin: '*'", "NextAuth({ trustHost: true })", ""]


@query("chunked_scan")
def _(spark, sf):
    """Files of up to 10,000 documents, each read in many splits."""
    docs = corpora.table(spark, sf, "documents")
    folder = f"{shared_folder(spark)}/files"
    line = F.element_at(F.array(*[F.lit(x) for x in CHUNK_SNIPPETS]), F.pmod("doc_id", F.lit(len(CHUNK_SNIPPETS))).cast("int") + 1)
    place = [F.col("source").alias("repo"), F.floor(F.col("doc_id") / DOCS_PER_FILE).alias("n")]
    rows = docs.select(*place, "doc_id", F.concat("text", F.lit("\n"), line).alias("value"))
    order = ["repo", "n", "doc_id"]
    rows.repartition("repo", "n").sortWithinPartitions(*order).select("repo", "n", "value").write.partitionBy("repo", "n").text(folder)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1 << 16, size // 256)))
    try:
        part = F.split("path", "/")
        lines = chunk_lines(spark, folder).withColumn("repo", F.regexp_extract("path", "repo=([^/]*)/", 1)).withColumn(
            "path", F.concat(F.lit("part_"), F.regexp_extract(part[1], r"n=(\d+)", 1), F.lit(".js")))
        return materialize(scan_chunks(lines, ignore_rules=False))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def earlier_files(spark, sf) -> DataFrame:
    """An earlier state of the text corpus: some files are missing, some differ, some lie elsewhere."""
    docs = corpora.table(spark, sf, "documents")
    named = docs.join(corpora.text_names(docs), "doc_id").select(
        "doc_id", F.col("source").alias("repo"), F.concat("source", F.lit("/"), "name").alias("path"), F.col("text").alias("content"))
    changed = F.when(F.pmod("doc_id", F.lit(5)) == 1, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    stayed = named.filter(F.pmod("doc_id", F.lit(5)) != 0).select("repo", "path", changed.alias("content"))
    moved = named.filter(F.pmod("doc_id", F.lit(10)) == 0).select("repo", F.concat(F.lit("old/"), "path").alias("path"), "content")
    return stayed.unionByName(moved)


@query("snapshot_changes")
def _(spark, sf):
    """What has changed between two states of the text corpus."""
    return snapshot_diff(listing(earlier_files(spark, sf)), listing(corpora.text_files(spark, sf)))


@query("changed_scan")
def _(spark, sf):
    """Findings of the files that were added, copied or modified, as a commit hook scans them."""
    rules = corpora.text_rules()
    files = changed_since(listing(earlier_files(spark, sf)), corpora.text_files(spark, sf))
    return scan(files, custom_rules=rules, only=[r.rule_id for r in rules])


def steady_reviewer(prompt: str) -> str:
    return json.dumps({"findings": [{"index": 0, "verdict": "confirmed" if len(prompt) % 2 else "false_positive"}]})


def silent_reviewer(prompt: str) -> str:
    raise RuntimeError("nothing should be sent")


@query("review_store")
def _(spark, sf):
    """Responses from the reviewer's memory, in a second run that sends nothing."""
    prompts = materialize(review.review_batches(text_findings(spark, sf, "medium"), corpora.text_files(spark, sf), secret_nonce()))
    path = f"{shared_folder(spark)}/answers"
    verdicts.review(prompts, steady_reviewer, path)
    return verdicts.review(prompts, silent_reviewer, path, waits=())


@query("document_files")
def _(spark, sf):
    """A JSON file per repository, written with its parts in order and read back as any tool reads it."""
    found = materialize(text_findings(spark, sf))
    summary = results.severity_summary(found, prepare(corpora.text_files(spark, sf)))
    folder = f"{shared_folder(spark)}/documents"
    documents.write_files(exports.json_document(found, summary), exports.DOCUMENT_ORDER, folder)
    entry = "check string, severity string, file string, line int"
    doc = spark.read.schema(f"findings array<struct<{entry.replace(' ', ':').replace(',:', ',')}>>, summary struct<total:bigint>").json(
        f"file://{folder.removeprefix('file://').removeprefix('file:')}", multiLine=True)
    repo = F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json$", 1)
    return doc.select(repo.alias("repo"), F.col("summary.total").alias("total"), F.posexplode("findings").alias("pos", "f")).select(
        "repo", "total", "pos", "f.*")


def long_words(path: str, language: str, content: str):
    """Lines that hold a word of 40 characters or more."""
    for number, line in enumerate(content.split("\n"), 1):
        at = next((i for i, w in enumerate(line.split(" ")) if len(w) >= 40), None)
        if at is not None:
            yield number, sum(len(w) + 1 for w in line.split(" ")[:at]), f"{len(line)} characters", line.rstrip()


@query("sql_checks")
def _(spark, sf):
    """A user's check, registered as a table function and called from SQL."""
    register_sql_check(spark, "long_words", long_words)
    return check_findings(prepare(corpora.text_files(spark, sf)), "long_words", "low", 100_000)


@query("source_tree_read")
def _(spark, sf):
    """The text corpus written as a tree of files and read back by listing it in tasks."""
    folder = shared_folder(spark)
    folder = folder.removeprefix("file:")
    tree.write_tree(corpora.text_files(spark, sf), folder)
    back = tree.read_tree(spark, folder, repo="tree")
    return back.select("path", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))
