"""What the first layer makes of each kind of text, in the one-text entry and as columns, plain and as HTML."""

import pytest
from pyspark.sql import functions as F

from lustrum import api
from lustrum.operators import layer1, output

#: kind, text, cleaned, found
CASES = [
    ("plain", "good morning", "good morning", []),
    ("empty", "", "", []),
    ("zero-width space", "pa​th", "path", ["cf-format"]),
    ("joiners in a row", "x‍‍y", "xy", ["cf-format"]),
    ("bidi override", "see ‮fdp.exe‬", "see fdp.exe", ["cf-format"]),
    ("soft hyphen", "re\xadenter", "reenter", ["cf-format"]),
    ("byte order mark in front", "﻿head", "﻿head", []),
    ("word joiner", "to⁠gether", "together", ["cf-format"]),
    ("emoji", "well \U0001f680 done", "well \U0001f680 done", []),
    ("mathematical letters", "let \U0001d4b3 be", "let \U0001d4b3 be", []),
    ("ideographs", "東京​ tower", "東京 tower", ["cf-format"]),
    ("colour", "\x1b[32mgreen\x1b[0m", "green", ["ansi"]),
    ("clear screen", "\x1b[2Jgone", "gone", ["ansi"]),
    ("cursor move", "\x1b[12;4Hhere", "here", ["ansi"]),
    ("both", "k​\x1b[4mL\x1b[0m⁠m", "kLm", ["cf-format", "ansi"]),
    ("tag characters", "q\U000e0068\U000e0069r", "qr", ["cf-format"]),
    ("variation selector", "s️t", "st", ["variation-selectors"]),
    ("no-break space", "u\xa0v", "u\xa0v", []),
    ("line breaks", "one\ntwo​\n", "one\ntwo\n", ["cf-format"]),
    ("combining marks", "é̂w", "é̂w", []),
    ("lone high surrogate", "y\ud83dz", "y�z", ["lone-surrogates"]),
    ("lone low surrogate", "y\ude00z", "y�z", ["lone-surrogates"]),
    ("surrogates the wrong way round", "\ude00\ud83d", "��", ["lone-surrogates"]),
]


@pytest.mark.parametrize("kind,text,cleaned,found", CASES, ids=[c[0] for c in CASES])
@pytest.mark.parametrize("html", [False, True])
def test_one_text(kind, text, cleaned, found, html):
    got = api.sanitize(text, html=html)
    assert (got.cleaned, got.found) == (cleaned, found)
    assert bool(got.warnings) == bool(found)


def test_columns(spark):
    texts = [c for c in CASES if not any("\ud800" <= ch < "" for ch in c[1])]
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(texts)], "i int, t string")
    for html in (False, True):
        rows = output.sanitize(df, "t", html=html).orderBy("i").collect()
        assert [(r.sanitized.cleaned, r.sanitized.found) for r in rows] == [(c[2], c[3]) for c in texts]
    raw = spark.createDataFrame([(i, bytearray(c[1].encode("utf-8", "surrogatepass"))) for i, c in enumerate(CASES)], "i int, b binary")
    rows = raw.withColumn("l", layer1.layer1_binary(F.col("b"))).orderBy("i").collect()
    assert [(r.l.cleaned, r.l.found) for r in rows] == [(c[2], c[3]) for c in CASES]
