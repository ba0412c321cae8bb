"""Per-file conditions: gates for line rules and rules decided by the whole file.

They are computed once per file, before the text is split into lines.  ``lowered`` is the
lower-cased content of JavaScript and TypeScript files, ``rooted`` the lower-cased path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions.text import sql_any_of

_NEXTAUTH = sql_any_of("content", ["next-auth", "NextAuth", "@auth/"])

GATES = {
    "express": f"{sql_any_of('lowered', ['express', 'router'])} and {sql_any_of('content', fv.EXPRESS_AUTH_WORDS)}",
    "supabase": "contains(lowered, 'supabase')",
    "supabase_client": "contains(lowered, 'supabase') and contains(content, 'createClient')",
    "firebase_rules": sql_any_of("lower(name)", ["rules", "firestore", "database"]),
    "nextauth": _NEXTAUTH,
    "prisma": "contains(lowered, 'prisma')",
}

FILE_RULE_CONDITIONS = {
    "supabase-rls-not-mentioned": f"""
        contains(lowered, 'supabase') and contains(content, 'createClient')
        and not {sql_any_of('lowered', ['rls', 'policy'])}
        and contains(content, '.from(') and {sql_any_of('content', ['insert', 'update', 'delete'])}""",
    "nextjs-api-no-auth": f"""
        contains(rooted, '/api/') and {sql_any_of('rooted', ['route.ts', 'route.js'])}
        and {sql_any_of('content', fv.NEXTJS_MUTATIONS)} and not {sql_any_of('lowered', fv.NEXTJS_AUTH_WORDS)}""",
    # A second trigger, a mixed-case word looked up in lower-cased text, can never hold.
    "nextauth-no-secret": f"""
        {_NEXTAUTH} and contains(content, 'NextAuth(')
        and not {sql_any_of('content', ['NEXTAUTH_SECRET', 'secret:', 'secret :'])}""",
    "stripe-webhook-no-verify": f"""
        contains(lowered, 'stripe') and (contains(rooted, 'webhook') or contains(lowered, 'webhook'))
        and not {sql_any_of('content', ['constructEvent', 'stripe.webhooks'])} and contains(lowered, 'post')""",
}

_JS = "language in ('javascript', 'typescript')"
_JS_JSON = "language in ('javascript', 'typescript', 'json')"


def with_gates(files: DataFrame, gates: set[str], file_rules: list[str]) -> DataFrame:
    """Adds ``gates`` (struct of booleans) and ``file_hits`` (ordinals of the file rules that hold)."""
    fields = ["'open', true"] + [
        f"'{g}', {_JS_JSON if g == 'firebase_rules' else _JS} and {GATES[g]}" for g in sorted(gates)]
    hits = [f"if({FILE_RULE_CONDITIONS[r]}, {fv.FILE_RULES[r].ord}, null)" for r in file_rules]
    file_hits = f"if({_JS}, array_compact(array({', '.join(hits)})), null)" if hits else "cast(null as array<int>)"
    lowered = files.withColumns({
        "lowered": F.expr(f"if({_JS}, lower(content), null)"),
        "rooted": F.concat(F.lit("/"), F.lower("path")),
    })
    return lowered.select(
        *files.columns, F.expr(f"named_struct({', '.join(fields)})").alias("gates"), F.expr(file_hits).alias("file_hits"))
