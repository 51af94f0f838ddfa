import json
import random

from pyspark.sql import functions as F

from lustrum.functions import secrets as S
from lustrum.functions.secrets import Config
from lustrum.operators import output
from lustrum.operators import redact as R

V = "Zq8vTr5mXw2kLp9sNd4hBf7c"
FIXED = [
    f"-----begin rsa private key-----\n{V}\n-----end rsa private key-----",
    f"-----Begin EC Private Key-----\n{V}",
    f"token\u00a0= {V}",
    f"token_größe = {V}",
    f"token_² = {V}",
    f'paſſword = "{V}"',
    f"to\u212aen\x1c={V}",
    f"token_{'x' * 600}={V}",
    f'my_secret_{"y" * 600} => "{V}"',
]


def mixed(n=600):
    rng = random.Random(4)
    names = ["token", "TOKEN", "to\u212aen", "api-key", "paſſwd", "Secret", "bearer", "auth_token", "db_pass", "word"]
    tails = ["", "_a", "-größe", "_²", "s", "_" + "x" * 600]
    gaps = ["", " ", "\u00a0", "\x1c", "\u2003", "\x85", "'", '"', "\n"]
    return [f"a {rng.choice(names)}{rng.choice(tails)}{rng.choice(gaps)}{rng.choice(['=', ':', ':=', '=>', '!=', ' '])}{rng.choice(gaps)}{rng.choice(['', chr(34)])}{V}{rng.choice(['', chr(34)])} z" for _ in range(n)]


def test_hinted_is_a_superset(spark):
    texts = [*FIXED, *mixed()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.hinted(F.col("t"), Config()).alias("h"), R.redact(F.col("t"))["text"].alias("r")).orderBy("i").collect()
    changed = [S.redact(t)[0] != t for t in texts]
    assert all(changed[: len(FIXED)]) and sum(changed) > 200
    assert [t for t, c, r in zip(texts, changed, rows, strict=True) if c and not r.h] == []
    assert [r.r for r in rows] == [S.redact(t)[0] for t in texts]


def test_hostile_names_take_linear_time(spark):
    texts = ["key" * 200_000, "key " * 100_000, "key" + " " * 300_000, "key-" * 100_000 + "?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.h for r in df.select(R.hinted(F.col("t"), Config()).alias("h")).collect()] == [False] * 4


def test_escaped_json_is_redacted(spark):
    doc = json.dumps({"a": f'"token"\t=\t"{V}"'})
    got = spark.createDataFrame([(doc,)], "t string").select(output.sanitize_value(F.col("t"), config=Config()).alias("v")).first().v
    assert V not in got.value and got.modified
