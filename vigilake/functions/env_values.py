"""Scalar steps for environment files: key/value split, value cleaning, placeholder test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions.text import matches, strip

MIN_VALUE_CHARS = 4


def env_key(stripped: Column) -> Column:
    """Text before the first ``=``."""
    return strip(F.substring_index(stripped, "=", 1))


def env_raw_value(stripped: Column) -> Column:
    """Text after the first ``=``."""
    return F.substr(stripped, F.instr(stripped, "=") + 1)


def clean_value(raw: Column) -> Column:
    """A quoted value up to its closing quote, an unquoted one up to an inline comment."""
    v = strip(raw)
    quote = F.substring(v, 1, 1)
    close = F.call_function("locate", quote, v, F.lit(2))
    quoted = F.when(close > 0, F.substr(v, F.lit(2), close - 2)).otherwise(F.substr(v, F.lit(2)))
    comment = r"[\s\x1c-\x1f]#"
    cut = strip(F.regexp_extract(v, r"(?Ud)^(.*?)" + comment, 1))
    return F.when(quote.isin("'", '"'), quoted).when(matches(v, comment), cut).otherwise(v)


def is_placeholder(value: Column) -> Column:
    v = strip(F.btrim(strip(value), F.lit("'\"")))
    ends = F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1))
    wrapped = (
        ends.isin("[]", "<>")
        | (F.startswith(v, F.lit("{{")) & F.endswith(v, F.lit("}}")))
        | (F.startswith(v, F.lit("${")) & F.endswith(v, F.lit("}")))
        | (F.startswith(v, F.lit("__")) & F.endswith(v, F.lit("__")))
    )
    return (
        (F.length(v) < MIN_VALUE_CHARS)
        | wrapped
        | matches(v, fv.ENV_PLACEHOLDER_URL)
        | matches(v, fv.ENV_PLACEHOLDER_TOKENS)
    )


def is_secret_key(key: Column) -> Column:
    """The key names a secret; flags, URLs and ids are exempt unless they are connection keys."""
    return matches(key, fv.ENV_SECRET_KEY) & (
        matches(key, fv.ENV_CONNECTION_KEY) | ~matches(key, fv.ENV_NON_SECRET_KEY)
    )
