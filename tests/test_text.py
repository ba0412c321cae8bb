import fnmatch
import random
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import paths, text
from vigilake.functions.anchors import anchor_pattern, required_literals

ODD = ["", " a ", " x ", "\x1c\x1d a\x85", "\t　", "é😀 eval(1)", "a᠎b", "​z"]


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_whitespace_is_pythons():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_like_python(spark):
    rows = column(spark, ODD).select("v", text.strip(F.col("v")), text.lstrip(F.col("v")), text.rstrip(F.col("v"))).collect()
    for v, s, left, right in rows:
        assert (s, left, right) == (v.strip(), v.lstrip(), v.rstrip())


def test_lines_keep_trailing_empty_line(spark):
    values = ["", "a\n", "a\nb", "\n\n", "a\x0bb\x85c d"]
    for v, lines in column(spark, values).select("v", text.lines_of(F.col("v"))).collect():
        assert lines == v.split("\n")


def test_decode_like_python(spark):
    random.seed(1)
    raws = [b"a\r\nb\rc\n", b"\xff\xfe", "é😀".encode()[:-1], b"\xc3(", b"\xe2\x82", b"\xf0\x9f\x98x", b"\xed\xa0\x80"]
    raws += [bytes(random.choice([65, 13, 10, 0xC3, 0xA9, 0xF0, 0x9F, 0x98, 0x80, 0xE2]) for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(bytearray(r),) for r in raws], "raw binary").select("raw", text.decode_utf8(F.col("raw")))
    for raw, got in df.collect():
        want = bytes(raw).decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
        assert got == want


PATTERNS = [
    r"(?i)\bdebug\s*=\s*true\b", r"(?<![.\w])eval\s*\(", r"(\w)\1", r"(?P<q>['\"]).*?(?P=q)", r"a|bc", r"x*", r"\bé\b",
    r"^\s*#", r"[0-9]{2,}$", r"end\Z",
]
LINES = [
    "DEBUG = True", "é = eval (x)", "éeval(x)", "😀😀 aa", "say 'hi' \"x\"", "xbc", "", "bé é", " # c", "a 12", "the end",
    "foo.eval(1)", "x eval(1)", "aab 'q'",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_and_offset_like_python(spark, pattern):
    df = column(spark, LINES)
    rows = df.select(
        "v", text.matches(F.col("v"), pattern), text.match_offset(F.col("v"), pattern),
        F.expr(text.sql_matches("v", pattern)), F.expr(text.sql_match_offset("v", pattern))).collect()
    for v, hit, at, sql_hit, sql_at in rows:
        m = re.search(pattern, v)
        assert hit == sql_hit == (m is not None), (pattern, v)
        if m:
            assert at == sql_at == m.start(), (pattern, v)


def test_suffix_like_pathlib(spark):
    names = ["a.py", ".env", ".env.local", "a.", "a.b.c", "noext", ".a.b", "x.PY", "ü.js", "a b.ts", "a..", "..", "a..b", ".", "x.tar.gz"]
    for v, s in column(spark, names).select("v", paths.suffix(F.col("v"))).collect():
        assert s == PurePosixPath(v).suffix


def test_globs_like_fnmatch(spark):
    globs = ["*.py", "src/*", "a?c", "[ab]*", "[!a]*", "x[", "d/", "*/t_[0-9].js", "a+b", "[]]x", "*.min.js", "q.{a}"]
    names = ["a.py", "src/x/y.py", "abc", "b", "zz", "x[", "d/", "d/e", "p/q/t_1.js", "a+b", "]x", "z.min.js", "aab", "q.{a}"]
    df = column(spark, names)
    for g in globs:
        for v, hit in df.select("v", F.rlike("v", F.lit(text.glob_regex(g)))).collect():
            assert hit == fnmatch.fnmatchcase(v, g), (g, v)
    random.seed(3)
    globs += ["[z-a]*", "[!z-a]", "[[]x", "[[...slug]].js", "a&&b", "[a&&b]", "[]", "[!]", "[", "[!", "[a-", "[a-]", "[--a]", "[a-c-e]", "[z-a-c]", "[^a]", "[\\]", "\\", "(", "a|b", "**", "[!]]", "[]-a]", "{x}", "[~b]"]
    globs += ["".join(random.choice("[]!-^\\az&|*?b.]") for _ in range(random.randint(1, 8))) for _ in range(3000)]
    pairs = [(v, g) for g in globs for v in random.sample(names, 4)] + [
        ("".join(random.choice("[]!-^\\az&|b.") for _ in range(random.randint(0, 4))), g) for g in globs for _ in range(6)]
    frame = spark.createDataFrame(pairs, "v string, g string")
    for v, g, hit in frame.select("v", "g", F.rlike("v", text.glob_regex_column(F.col("g")))).collect():
        assert hit == fnmatch.fnmatchcase(v, g), (g, v)


DIALECT = [
    r"(?P<a>x)(?P<b_c>y)", r"(?x) a b  # comment (", r"a{,2}b", r"a{,}b", r"a{b", r"x{}", r"[[(]\d", r"[]a]b", r"[^]a]b", r"[a&&b]c", r"[&&#]{2}", r"a(?#note)b",
    r"(?P<q>['\"])z(?P=q)", r"(?i)[a-c~^]{2}", r"(?x)[ #]a", r"a++b", r"(?>ab|a)c", r"\Aa\Z", r"[\]x]", r"(?s)a.b", r"x(?=y)", r"(?<!a)b",
]


def test_patterns_of_users_like_python(spark):
    random.seed(11)
    values = ["".join(random.choice("aabbxyz&#~^[](){},;12 '\"") for _ in range(random.randint(0, 7))) for _ in range(400)]
    values += ["xy", "aab", "a{b", "x{}", "[1", "]b", "&&", "##", "ab", "'z'", " a", "#a", "aac", "a", "a\nb", "b"]
    df = column(spark, values)
    for p in DIALECT:
        assert text.unsupported(p) is None
        for form in text.executed_forms(p):
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(form)
        for v, hit, at in df.select("v", text.matches(F.col("v"), p), text.match_offset(F.col("v"), p)).collect():
            m = re.search(p, v)
            assert hit == (m is not None) and (not m or "\n" in v or at == m.start()), (p, v)
    union = "|".join(f"(?:{text.java_pattern(p, named=False)})" for p in DIALECT if not text.has_back_reference(p))
    spark.sparkContext._jvm.java.util.regex.Pattern.compile(union)
    assert text.unsupported("(a)?(?(1)b|c)") and text.unsupported("(?a)x") and text.unsupported(r"\N{DASH}")


def test_skipped_names_like_fnmatch(spark):
    values = ["a.pyc", "a.min.js", "min.js", ".map", "yarn.lock", "package-lock.json", "xpackage-lock.json", "a.js", "a.PYC", "lock", "a.lock"]
    for v, hit in column(spark, values).select("v", paths.is_skipped_name(F.col("v"))).collect():
        assert hit == any(fnmatch.fnmatchcase(v, g) for g in fv.SKIPPED_FILES), v
    odd = ["a?c", "*.x*", "*.pyc", "plain", "[ab]z"]
    for v, hit in column(spark, ["abc", "q.xy", "1.pyc", "plain", "az", "cz"]).select("v", paths.matches_any_glob(F.col("v"), odd)).collect():
        assert hit == any(fnmatch.fnmatchcase(v, g) for g in odd), v


def test_skipped_directories_like_fnmatch(spark):
    values = ["a/b.py", "node_modules/x.js", "x/node_modules/y.js", "node_modules", "pkg.egg-info/x.py", "a/dist2/x.js", "env/x.py", "x/env", ".egg-info/x", "a.egg-info", "x/y.egg-info/z/w", "xenv/a", "a/.git/b/c"]
    for v, hit in column(spark, values).select("v", paths.in_skipped_dir(F.col("v"))).collect():
        want = any(fnmatch.fnmatchcase(p, d) for p in v.split("/")[:-1] for d in fv.SKIPPED_DIRS)
        assert hit == want, v


def test_anchor_pattern_finds_exactly_the_literals(spark):
    random.seed(7)
    words = sorted({a for r in [*fv.SECRET_RULES, *fv.INJECTION_JS_RULES, *fv.CONFIG_RULES, *fv.FRAMEWORK_LINE_RULES] for a in r.anchors})
    pieces = words + ["ev", "al", "x", "-", ".", "_", " ", "$", "se", "cure", "//", ":", "é"]
    values = ["".join(random.choice(pieces) for _ in range(random.randint(0, 4))) for _ in range(800)]
    values = [v.upper() if i % 3 == 0 else v for i, v in enumerate(values)] + ["ſECURE", "Ky", "accesſtoken", "evaL", "lıve", "k_lıve_"]
    fold = str.maketrans("ſKıİ", "skii")
    pattern = anchor_pattern(words)
    for v, hit in column(spark, values).select("v", F.rlike("v", F.lit(pattern))).collect():
        want = any(w in v if w != w.lower() else w in v.translate(fold).lower() for w in words)
        assert hit == want, v


def test_long_blank_runs_are_linear(spark):
    line = " " * 300_000 + "x" + " " * 300_000
    assert column(spark, [line]).select(F.length(text.strip(F.col("v")))).first()[0] == 1


def test_required_literals():
    cases = {
        r'\btoken\s*=\s*"[0-9a-f]{40}"': ("token",), r"[a-z]+@[a-z]+\.[a-z]{2,}": ("@",), r"(?i)\b(?:licen[cs]e|copyright)\b": ("copyright", "licen"),
        r"(a|b)?x*": (), r"\.from\(.+\)\.(select|insert)\(": (".from(",), r"(\w)\1": (), r"(?:ab|c?)zq": ("zq",), r"(?!key)vw": ("vw",),
        r"(?x) k e y # comment": ("key",), r"(?i)éx": ("x",), r"(?:\$q){2,}|[xy]": (), r"\b[0-9]+\.[0-9]+": (),
    }
    assert {p: required_literals(p) for p in cases} == cases


def test_matches_contain_a_required_literal():
    random.seed(9)
    for pattern in [r"(?i)abc|de[fg]+h", r"x(?:yz|zy)+\d", r"q(?=u)[a-z]{2}", r"(?:(?:jk)|(?:vw)){1,2}"]:
        words = required_literals(pattern)
        for _ in range(3000):
            v = "".join(random.choice("abcdefghjkquvwxyzABC1") for _ in range(6))
            if re.search(pattern, v) and words:
                assert any(w in v.lower() for w in words), (pattern, v)
