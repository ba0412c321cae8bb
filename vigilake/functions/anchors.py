"""One cheap regex that finds any of many literals, used to prefilter files and lines.

A plain alternation tries every literal at every character.  Here each literal is pinned to
one of its characters, and the characters are chosen to be few and rare: the regex engine
skips on a single character class and looks around (fixed-length look-behind and look-ahead)
only at the positions that pass.

Literals in lower case are found in any case, Unicode variants included; literals with an
upper-case letter are found as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict

# FIXED VALUES: how often a character occurs in text, in per mille
FREQUENCY = {
    "e": 127, "t": 91, "a": 82, "o": 75, "i": 70, "n": 67, "s": 63, "h": 61, "r": 60, "d": 43, "l": 40, "c": 28, "u": 28,
    "m": 24, "w": 24, "f": 22, "g": 20, "y": 20, "p": 19, "b": 15, "v": 10, "k": 8, "j": 2, "x": 2, "q": 1, "z": 1,
    ".": 15, "_": 15, " ": 180, "-": 8, ":": 8, "/": 8, "(": 15, ")": 15, "=": 15, "'": 10, '"': 10, "$": 2, "+": 2, "@": 1,
}
CASE_VARIANTS = {"s": "ſ", "k": "K", "i": "ıİ"}
PIVOTS_PER_GROUP = 4
MAX_COST = 8


def _weight(ch: str) -> int:
    if ch.isupper():
        return 2
    # characters with Unicode case variants make their class slow
    return FREQUENCY.get(ch, 5) * (3 if ch in CASE_VARIANTS else 1)


def _members(ch: str, exact: bool) -> str:
    """The characters that count as ``ch``, for use inside a character class."""
    if ch.isalpha() and not exact:
        return ch + ch.upper() + CASE_VARIANTS.get(ch, "")
    return ch if ch.isalnum() else "\\" + ch


def _class(ch: str, exact: bool) -> str:
    members = _members(ch, exact)
    return f"[{members}]" if len(members) > 2 or members[0] != "\\" and len(members) > 1 else members


def _pivots(literals: list[str]) -> dict[str, str]:
    """A character for each literal: greedy cover by few and rare characters."""
    left, out = set(literals), {}
    while left:
        chars = sorted({c for x in left for c in x})
        best = min(chars, key=lambda c: (_weight(c) / sum(c in x for x in left), c))
        for x in [x for x in left if best in x]:
            out[x] = best
            left.discard(x)
    return out


def anchor_pattern(literals) -> str:
    """Java regex that finds any of the literals."""
    wanted = sorted(set(literals))
    if not all(x.isascii() and x for x in wanted):
        raise ValueError("anchors are non-empty ASCII literals")
    # a literal that contains another one is found with it
    wanted = [x for x in wanted if not any(y != x and y in x and y.islower() for y in wanted)]
    tails = defaultdict(list)
    for literal, pivot in _pivots(wanted).items():
        exact = literal != literal.lower()
        at = literal.index(pivot)
        look = ""
        if literal[at + 1:]:
            look += "(?=" + "".join(_class(c, exact) for c in literal[at + 1:]) + ")"
        if literal[:at]:
            look += "(?<=" + "".join(_class(c, exact) for c in literal[:at + 1]) + ")"
        tails[(pivot, exact)].append(look)
    branches = []
    for (pivot, exact), looks in sorted(tails.items()):
        found = _class(pivot, exact) + ("" if "" in looks else "(?:" + "|".join(sorted(looks)) + ")")
        branches.append((_members(pivot, exact), found))
    groups = [branches[i:i + PIVOTS_PER_GROUP] for i in range(0, len(branches), PIVOTS_PER_GROUP)]
    look = lambda part: f"(?=[{''.join(m for m, _ in part)}])"
    return look(branches) + "(?:" + "|".join(f"{look(g)}(?:{'|'.join(b for _, b in g)})" for g in groups) + ")"


# -- literals that every match of a pattern contains ----------------------------------------------

_parse = getattr(re, "_parser", None)


def _runs(items) -> list[list[str]]:
    """Alternatives, each a list of literals, one of which every match of the sequence contains."""
    options, run = [], ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and 32 < arg < 127:
            run += chr(arg).lower()
            continue
        if run:
            options.append([run])
            run = ""
        if name == "SUBPATTERN":
            options += _runs(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            options += _runs(arg[2])
        elif name == "ATOMIC_GROUP":
            options += _runs(arg)
        elif name == "BRANCH":
            each = [_best(_runs(b)) for b in arg[1]]
            if all(each):
                options.append([x for b in each for x in b])
    if run:
        options.append([run])
    return options


def _cost(literal: str) -> float:
    return min(map(_weight, literal)) / len(literal)


def _best(options: list[list[str]]) -> list[str]:
    """The most selective alternative: rare characters, long literals, few of them."""
    return min(options, key=lambda words: sum(map(_cost, words))) if options else []


def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match contains one.

    Empty where none are known, or where they are so common that the pattern itself is the
    better filter.
    """
    if _parse is None:
        return ()
    try:
        found = sorted(set(_best(_runs(_parse.parse(pattern)))))
    except (re.error, RecursionError, OverflowError):
        return ()
    return tuple(found) if all(_cost(x) <= MAX_COST for x in found) else ()
