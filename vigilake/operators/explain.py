"""Rule documentation as a dimension: enrichment of findings and name lookup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.operators.line_rules import builtin_line_rules

# check: (title, what it finds, why it matters, patterns, example).  Our own texts.
RULE_DOCS = {
    "secrets": (
        "Credentials in the repository", "Credentials written into files: vendor keys, tokens, passwords, connection strings.",
        "Whoever can read the repository or a build artifact can use the credential until it is revoked.",
        ["cloud and vendor API keys", "tokens and private keys", "database URLs with credentials", "generic passwords"],
        "aws_key = 'AKIA...'"),
    "injection": (
        "Input that becomes code", "Input that reaches an interpreter: SQL, a shell, eval, HTML or a redirect target.",
        "An attacker who controls the input controls what the interpreter does with it.",
        ["SQL built from f-strings or concatenation", "eval and exec", "shell commands", "raw HTML", "open redirects",
         "$where built from input"], "cursor.execute(f'select * from t where id = {value}')"),
    "auth": (
        "Routes anybody can call", "Routes without an authentication dependency or middleware.",
        "An endpoint that nobody guards can be called by anyone who knows its address.",
        ["decorated routes without an auth parameter", "Express routes without middleware"], "@app.get('/admin')"),
    "config": (
        "Development settings in production", "Settings that are fine in development and harmful in production.",
        "Debug output, open CORS and unprotected cookies hand information and sessions to others.",
        ["debug mode", "development NODE_ENV", "CORS wildcards", "cookie flags switched off", "verbose errors"], "DEBUG = True"),
    "dotenv-secrets": (
        "Environment files under version control", "Real values in environment files, and environment files that git does not ignore.",
        "A committed environment file stays in the history even after it is deleted.",
        ["secret values in .env files", "real values in example files", ".env missing from .gitignore"], "API_KEY=..."),
    "frameworks-supabase": (
        "Supabase keys and policies", "Service-role keys and inline JWTs in client code, writes without row-level security.",
        "The service-role key bypasses every row-level policy.",
        ["service_role key in source", "JWT literal with createClient", "writes without RLS or policy"], "createClient(url, 'eyJ...')"),
    "frameworks-firebase": (
        "Open Firebase rules", "Security rules that let everyone read or write.",
        "Open rules expose the whole database.", ["read or write set to true in rules files"], '".read": true'),
    "frameworks-nextjs": (
        "Public values and open routes in Next.js", "Secrets behind the public prefix and API routes that change data unguarded.",
        "Values with the public prefix are shipped to every browser.",
        ["NEXT_PUBLIC_ prefix on secret names", "mutating API routes without an auth check"], "process.env.NEXT_PUBLIC_SECRET_KEY"),
    "frameworks-nextauth": (
        "Session signing in NextAuth", "Auth configuration without a secret, or trusting any host header.",
        "Sessions signed with a known key can be forged.", ["NextAuth without secret", "trustHost: true"], "NextAuth({ trustHost: true })"),
    "frameworks-prisma": (
        "Raw Prisma queries", "Raw queries that take plain strings.",
        "Nothing is parameterised, so input can change the query.", ["$queryRawUnsafe", "$executeRawUnsafe"], "prisma.$queryRawUnsafe(sql)"),
    "frameworks-stripe": (
        "Unsigned Stripe webhooks", "Webhook handlers that do not verify signatures.",
        "Anyone can post made-up payment events.", ["webhook without constructEvent or stripe.webhooks"], "app.post('/webhook', handler)"),
}
DOC_COLUMNS = ["check_name", "family", "rule_severity", "title", "what", "why", "patterns", "example"]


def rule_docs(spark: SparkSession) -> DataFrame:
    """One row per built-in rule with the documentation of its check (a few dozen rows)."""
    env = (fv.ENV_NOT_GITIGNORED, fv.ENV_NO_GITIGNORE, fv.ENV_SECRET, fv.ENV_EXAMPLE_SECRET)
    rules = [*builtin_line_rules(), *fv.FACT_RULES.values(), *fv.FILE_RULES.values(), *env]
    rows = [
        (r.rule_id, r.family, r.severity, *RULE_DOCS[r.family][:3], ", ".join(RULE_DOCS[r.family][3]), RULE_DOCS[r.family][4])
        for r in rules]
    return spark.createDataFrame(pd.DataFrame(rows, columns=DOC_COLUMNS), ", ".join(f"{c} string" for c in DOC_COLUMNS))


def explain_findings(findings: DataFrame) -> DataFrame:
    """Findings with the documentation of their check; unknown rules keep nulls."""
    return findings.join(F.broadcast(rule_docs(findings.sparkSession)), "check_name", "left")


def explain_names(names: DataFrame) -> DataFrame:
    """For each looked-up ``name``: the title of the check, or the checks whose name contains it, or else all."""
    keys = F.array(*[F.lit(k) for k in RULE_DOCS])
    titles = F.create_map(*[F.lit(x) for k, d in RULE_DOCS.items() for x in (k, d[0])])
    found = F.element_at(titles, F.col("name"))
    similar = F.filter(keys, lambda k: F.contains(k, F.col("name")))
    return names.withColumns({
        "title": found,
        "suggestions": F.when(found.isNotNull(), "").when(F.size(similar) > 0, F.array_join(similar, ", ")).otherwise(F.array_join(keys, ", ")),
    })
