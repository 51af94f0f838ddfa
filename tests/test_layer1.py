import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lustrum import api
from lustrum import constants as K
from lustrum.functions import charset as C
from lustrum.functions import plain
from lustrum.operators import layer1 as L

ESC = "\x1b"
#: name, input, cleaned, found
CASES = [
    ("plain", "hello", "hello", ""),
    ("empty", "", "", ""),
    ("zero width space", "a​b", "ab", "cf-format"),
    ("run of joiners", "a‍‍b", "ab", "cf-format"),
    ("bidi override", "a‮live‬b", "aliveb", "cf-format"),
    ("soft hyphen", "co­op", "coop", "cf-format"),
    ("leading mark", "﻿text", "﻿text", ""),
    ("two marks", "﻿﻿x﻿", "﻿x", "cf-format"),
    ("emoji", "hi 😀 there", "hi 😀 there", ""),
    ("colour", f"{ESC}[31mred{ESC}[0m", "red", "ansi"),
    ("erase", f"{ESC}[2Jwipe", "wipe", "ansi"),
    ("eight bit", "\x9b2Jx\x9d0;t\x07y\x90z", "xyz", "ansi"),
    ("open string command", f"a{ESC}]8;;http://x", "a", "ansi"),
    ("closed string command", f"a{ESC}]8;;http://x{ESC}\\b", "ab", "ansi"),
    ("mixed", f"a​{ESC}[1mb️", "ab", "cf-format,variation-selectors,ansi"),
    ("tags", "x\U000e0041\U000e0042", "x", "cf-format"),
    ("selector run", "a︀\U000e0101b", "ab", "variation-selectors"),
    ("fillers", "aㅤ⠀͏b", "ab", "blank-fillers"),
    ("no-break space", "a b", "a b", ""),
    ("accents", "éclair", "éclair", ""),
    ("nested escapes", f"{ESC}[{ESC}[0m31mred", "red", "ansi"),
    ("escape joined by a stripped character", f"{ESC}​[31mx", "x", "cf-format,ansi"),
    ("Persian", "می‌خواهم", "می‌خواهم", ""),
    ("joiner between Latin letters", "a‌b", "ab", "cf-format"),
    ("conjunct", "क्‍ष", "क्‍ष", ""),
    ("family", "\U0001f468‍\U0001f469‍\U0001f467", "\U0001f468‍\U0001f469‍\U0001f467", ""),
    ("flag with selector", "\U0001f3f3️‍\U0001f308", "\U0001f3f3️‍\U0001f308", ""),
    ("heart", "I ❤️ it, ❤︎ too", "I ❤️ it, ❤︎ too", ""),
    ("selector after a letter", "a️b", "ab", "variation-selectors"),
]


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")


@pytest.mark.parametrize("name,text,cleaned,found", CASES)
def test_plain(name, text, cleaned, found):
    one = plain.layer1(text)
    assert (one.cleaned, ",".join(one.found)) == (cleaned, found)


def test_columns_agree(spark):
    got = texts(spark, [c[1] for c in CASES] + [None]).select("i", L.layer1(F.col("t")).alias("l")).orderBy("i").collect()
    assert [(r.l.cleaned, ",".join(r.l.found)) for r in got[:-1]] == [c[2:] for c in CASES] and got[-1].l is None
    got = texts(spark, [c[1] for c in CASES]).select("i", L.strip_invisible(F.col("t")).alias("s"), L.payload_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [(r.s.cleaned, r.s.found, r.n) for r in got] == [(*plain.drop_invisible(c[1]), plain.payload_count(c[1])) for c in CASES]


alphabet = st.sampled_from("ab9[];#m\n​‌‍️︀\U000e0041ㅤ­﻿‮❤\U0001f468بم्क\x1b\x9b\x9d\x9c\x07\\\x90é2JH")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet, max_size=60))
def test_invariants(text):
    one = plain.layer1(text)
    again = plain.layer1(one.cleaned)
    assert again.cleaned == one.cleaned and not again.found
    rest = iter(text)
    assert all(ch in rest for ch in one.cleaned)  # only deletions
    assert not plain.INTRODUCER.search(one.cleaned)
    assert bool(one.found) == (one.cleaned != text)


def test_random_texts_agree(spark):
    import random

    rng = random.Random(1)
    signs = "ab9[];#m\n​‌‍️︀\U000e0041ㅤ­﻿‮❤\U0001f468بم्क\x1b\x9b\x9d\x9c\x07\\\x90é2JH"
    rows = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    got = texts(spark, rows).select("i", L.layer1(F.col("t")).alias("l"), L._native_layer1(F.regexp_replace("t", "[‌‍️︎]", "")).alias("n")).orderBy("i").collect()
    for text, r in zip(rows, got, strict=True):
        one = plain.layer1(text)
        assert (r.l.cleaned, r.l.de_ansi, r.l.found) == (one.cleaned, one.de_ansi, one.found), text
        bare = plain.layer1("".join(ch for ch in text if ch not in "‌‍️︎"))
        assert (r.n.cleaned, r.n.de_ansi, r.n.found) == (bare.cleaned, bare.de_ansi, bare.found), text


def test_long_input_needs_no_stack(spark):
    long = [ESC + "[" + "1;" * 100_000 + "m", "​" * 200_000, (ESC + "[") * 2000 + "0m", "x" + ";#" * 50_000 + ESC + ";#" * 50_000]
    got = texts(spark, long).select("i", L.layer1(F.col("t"))["cleaned"].alias("c"), L.long_run(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.c for r in got] == [plain.layer1(t).cleaned for t in long] and [r.r for r in got] == [False, True, False, False]


def test_budgets():
    dense = "ب‌" * 40 + "ب"
    assert plain.layer1(dense).cleaned.count("‌") == K.CLUSTER_CAP
    words = "می‌خواهم " * 100
    assert plain.layer1(words).cleaned == words
    short = "ب‌ب xx " * 25
    kept = plain.layer1(short)
    assert kept.cleaned.count("‌") == max(K.BUDGET_FLOOR, -(-len(short.replace("‌", "")) // 8)) and kept.found == [K.CF]
    drowned = "می‌خواهم" + "x​" * K.SCATTERED
    assert "‌" not in plain.layer1(drowned).cleaned


def test_surrogates(spark):
    raw = [b"a\xed\xa0\x80b", b"\xed\xa0\xbd\xed\xb8\x80", b"ok", None]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(raw)], "i int, b binary")
    got = df.select("i", L.layer1_binary(F.col("b")).alias("l")).orderBy("i").collect()
    assert [(r.l.cleaned, r.l.found) for r in got[:3]] == [("a�b", [K.SURROGATES]), ("😀", []), ("ok", [])]
    assert api.sanitize("a\udc00").cleaned == "a�"


def test_warning(spark):
    rows = ["a" + "​" * 10, f"{ESC}[1mx"]
    got = texts(spark, rows).select("i", L.layer1(F.col("t")).alias("l")).select("i", L.describe_stripped(F.col("l.found"), F.col("l.de_ansi")).alias("w")).orderBy("i").collect()
    assert got[0].w == "Stripped: Format chars (Cf)" + K.LONG_RUN_NOTE + K.HEX_DUMP_NOTE == plain.describe_stripped(["cf-format"], rows[0])
    assert got[1].w == "Stripped: ANSI escapes" + K.HEX_DUMP_NOTE


def test_tables():
    assert len(C.extra_points()) == 264 and C.format_points() >= {0x200B, 0xAD, 0xFEFF, 0xE0041}
    types = {"ب": "D", "ا": "R", "́": "T", "a": "U", "ꡲ": "L", "‍": "C"}
    assert {ch: C.joining_type(ch) for ch in types} == types
    assert all(C.is_virama(ch) for ch in "््్්") and not C.is_virama("क")
