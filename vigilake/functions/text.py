"""Text helpers with pinned semantics, as Column expressions.

White space is the Unicode set that Python's ``str.strip`` removes, offsets count code
points, and regular expressions follow Python's Unicode defaults (``(?U)``) with ``\\n`` as
the only line terminator (``(?d)``).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: the 29 characters for which str.isspace() is true
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

JAVA_FLAGS = "(?Ud)"

_BACK_REFERENCE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)")
_VERBOSE = re.compile(r"\(\?[a-zA-Z]*x[a-zA-Z]*\)")
_REPEAT = re.compile(r"\{(\d*)(?:(,)(\d*))?\}")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def universal_newlines(c: Column) -> Column:
    """``\\r\\n`` and ``\\r`` become ``\\n``; rows without ``\\r`` skip the regex."""
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def decode_utf8(raw: Column) -> Column:
    """Binary to text; undecodable bytes become U+FFFD, newlines are normalised."""
    return universal_newlines(F.make_valid_utf8(raw.cast("string")))


def java_body(pattern: str, named: bool = True) -> str:
    """A Python-dialect pattern in Java's dialect, without flags.

    Group names become ``g0``, ``g1``, ... (or plain groups), ``{,n}`` gets its zero, braces that repeat nothing and
    brackets inside classes are escaped, and a verbose pattern ends with a line end, so that a comment cannot
    swallow what is put behind it.
    """
    verbose = bool(_VERBOSE.match(pattern))
    names: dict[str, str] = {}
    out, i, n = [], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            out.append(r"\z" if pattern[i + 1] == "Z" else pattern[i:i + 2])
            i += 2
        elif ch == "[":
            body, i = _class_body(pattern, i + 1, verbose)
            out.append(body)
        elif pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            names[pattern[i + 4:end]] = f"g{len(names)}"
            out.append(f"(?<{names[pattern[i + 4:end]]}>" if named else "(?:")
            i = end + 1
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"\k<{names[pattern[i + 4:end]]}>")
            i = end + 1
        elif pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
        elif ch == "#" and verbose:
            end = pattern.find("\n", i)
            i = n if end < 0 else end
        elif ch == "{":
            found = _REPEAT.match(pattern, i)
            if found and (found[1] or found[2]):
                out.append("{" + (found[1] or "0") + (found[2] or "") + (found[3] or "") + "}")
                i = found.end()
            else:
                out.append(r"\{")
                i += 1
        else:
            out.append(ch)
            i += 1
    return "".join(out) + ("\n" if verbose else "")


def _class_body(pattern: str, i: int, verbose: bool) -> tuple[str, int]:
    """The class that starts behind a bracket, and where the pattern goes on."""
    out = ["["]
    if pattern[i:i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(pattern) and (first or pattern[i] != "]"):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i:i + 2])
            i += 2
        else:
            special = ch in "[]&^~" or verbose and (ch.isspace() or ch == "#")
            out.append("\\" + ch if special else ch)
            i += 1
        first = False
    return "".join(out) + "]", i + 1


def unsupported(pattern: str) -> str | None:
    """What in a valid Python pattern has no equivalent in Java, else None."""
    if re.search(r"(?<!\\)\(\?\(", pattern):
        return "conditional group"
    if re.search(r"(?<!\\)\(\?[a-zA-Z]*[aL]", pattern):
        return "flag a or L"
    if re.search(r"(?<!\\)(?:\\\\)*\\N\{", pattern):
        return "named character"
    return None


def java_pattern(pattern: str, named: bool = True) -> str:
    """A Python-dialect pattern in Java's dialect."""
    return JAVA_FLAGS + java_body(pattern, named)


def executed_forms(pattern: str) -> list[str]:
    """Every form in which a pattern reaches the JVM."""
    body = java_body(pattern)
    forms = [JAVA_FLAGS + body, f"{JAVA_FLAGS}^(?:{body})"]
    if has_back_reference(pattern):
        return forms
    return [*forms, f"{JAVA_FLAGS}^(.*?)(?:{body})", f"(?:{java_pattern(pattern, named=False)})"]


def has_back_reference(pattern: str) -> bool:
    return bool(_BACK_REFERENCE.search(java_pattern(pattern)))


def matches(c: Column, pattern: str) -> Column:
    """``re.search(pattern, c) is not None``."""
    return F.rlike(c, F.lit(java_pattern(pattern)))


def match_offset(c: Column, pattern: str) -> Column:
    """Code points before the first match; defined only where ``matches`` is true.

    Wrapping the pattern in a capturing prefix would renumber its own groups, so patterns
    with back-references are cut with ``split`` instead.
    """
    java, body = java_pattern(pattern), java_body(pattern)
    if has_back_reference(pattern):
        at_start = F.rlike(c, F.lit(f"{JAVA_FLAGS}^(?:{body})"))
        return F.when(at_start, F.lit(0)).otherwise(F.length(F.element_at(F.split(c, java, 2), 1)))
    return F.length(F.regexp_extract(c, f"{JAVA_FLAGS}^(.*?)(?:{body})", 1))


def after_match(c: Column, pattern: str) -> Column:
    """The text that follows the first match."""
    body = java_body(pattern)
    return F.regexp_replace(c, f"{JAVA_FLAGS}^.*?(?:{body})", "")


def any_of(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """True when the text contains one of the literals (byte search, no regex)."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def lines_of(content: Column) -> Column:
    """All lines; a trailing empty line is kept."""
    return F.split(content, "\n", -1)


def _code(ch: str) -> str:
    return f"\\x{{{ord(ch):X}}}"


def _glob_class(body: str) -> str:
    """The inside of a glob's brackets as a Java class: empty ranges hold nothing, all else is literal."""
    negated = body.startswith("!")
    items, p = [], 1 if negated else 0
    while p < len(body):
        if p + 2 < len(body) and body[p + 1] == "-":
            if body[p] <= body[p + 2]:
                items.append(f"{_code(body[p])}-{_code(body[p + 2])}")
            p += 3
        else:
            items.append(_code(body[p]))
            p += 1
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored Java regex: ``*`` and ``?`` cross ``/``, case matters.  Any string is a glob."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*" if not out or out[-1] != ".*" else "")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            skip = i + 1 if glob[i:i + 1] == "!" else i
            end = glob.find("]", skip + 1)
            if end < 0:
                out.append(_code(ch))
            else:
                out.append(_glob_class(glob[i:end]))
                i = end + 1
        else:
            out.append(ch if ch.isalnum() and ch.isascii() else _code(ch))
    return "(?s)^(?:" + "".join(out) + r")\z"


@F.pandas_udf(T.StringType())
def _glob_regexes(globs: pd.Series) -> pd.Series:
    return globs.map(glob_regex, na_action="ignore")


def glob_regex_column(glob: Column) -> Column:
    """``glob_regex`` of a column: one row for each line of an ignore file, so few rows leave the JVM."""
    return _glob_regexes(glob)


# The same conditions as SQL text: a plan with many rules is built from a few strings instead
# of thousands of Column calls.


def sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_matches(column: str, pattern: str) -> str:
    return f"rlike({column}, {sql_string(java_pattern(pattern))})"


def sql_any_of(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {sql_string(w)})" for w in words) + ")"


def sql_match_offset(column: str, pattern: str) -> str:
    java, body = java_pattern(pattern), java_body(pattern)
    if has_back_reference(pattern):
        at_start = f"rlike({column}, {sql_string(f'{JAVA_FLAGS}^(?:{body})')})"
        return f"if({at_start}, 0, length(element_at(split({column}, {sql_string(java)}, 2), 1)))"
    return f"length(regexp_extract({column}, {sql_string(f'{JAVA_FLAGS}^(.*?)(?:{body})')}, 1))"


def sql_after_match(column: str, pattern: str) -> str:
    body = java_body(pattern)
    return f"regexp_replace({column}, {sql_string(f'{JAVA_FLAGS}^.*?(?:{body})')}, '')"
