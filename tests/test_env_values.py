import random
import re

from pyspark.sql import functions as F

from vigilake import fixed_values as fv
from vigilake.functions import env_values as ev


def clean(raw):
    v = raw.strip()
    if v and v[0] in "'\"":
        return v[1:].split(v[0])[0]
    return re.split(r"\s#", v, maxsplit=1)[0].strip() if re.search(r"\s#", v) else v


def placeholder(value):
    v = value.strip().strip("'\"").strip()
    wraps = [("[", "]"), ("<", ">"), ("{{", "}}"), ("${", "}"), ("__", "__")]
    return len(v) < 4 or any(v.startswith(a) and v.endswith(b) for a, b in wraps) or bool(
        re.search(fv.ENV_PLACEHOLDER_URL, v) or re.search(fv.ENV_PLACEHOLDER_TOKENS, v))


def secret_key(key):
    return bool(re.match(fv.ENV_SECRET_KEY, key)) and (
        bool(re.search(fv.ENV_CONNECTION_KEY, key)) or not re.search(fv.ENV_NON_SECRET_KEY, key))


def test_like_python(spark):
    random.seed(3)
    parts = ["'", '"', " #", "#", " ", "abc", "your_", "[", "]", "{{", "}}", "${", "}", "__", "postgres://", "user:", "u:p@",
             "localhost", "sk-...", "é", " ", "here", "changeme", "=", "0123"]
    keys = ["API_KEY", "auth_url", "ENABLE_TOKEN", "DATABASE_URL", "db_dsn", "SECRET_ID", "PWD", "x", "private-key", "REDIS", "KEY_EXPIRES"]
    raws = ["".join(random.choice(parts) for _ in range(random.randint(0, 6))) for _ in range(600)]
    rows = [(random.choice(keys), r) for r in raws]
    df = spark.createDataFrame(rows, "key string, raw string")
    got = df.select(
        "key", "raw", ev.clean_value(F.col("raw")).alias("clean"), ev.is_placeholder(F.col("raw")).alias("ph"),
        ev.is_secret_key(F.col("key")).alias("secret")).collect()
    for r in got:
        assert r.clean == clean(r.raw), r.raw
        assert r.ph == placeholder(r.raw), r.raw
        assert r.secret == secret_key(r.key), r.key


def test_key_and_value_split_at_the_first_equals(spark):
    df = spark.createDataFrame([("A = b=c",), ("=x",), ("A=",)], "s string")
    assert [tuple(r) for r in df.select(ev.env_key(F.col("s")), ev.env_raw_value(F.col("s"))).collect()] == [
        ("A", " b=c"), ("", "x"), ("A", "")]
