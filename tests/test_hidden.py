import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lustrum import constants as K
from lustrum.functions import css, html, markdown
from lustrum.operators import exfil
from lustrum.operators import hidden as H

HIDDEN = """
display:none | DISPLAY : NONE | display:none ! important | visibility:hidden | visibility:collapse | content-visibility:hidden
opacity:0 | opacity:.004 | opacity:-2 | opacity:0% | opacity:.9% | height:0 | width:0px | font-size:1e-4px
position:absolute;left:-5000px | position:fixed;top:-901px | position:fixed;right:-1e4px | position:absolute;bottom:-100vh | position:absolute;left:-120% | clip:rect(0 0 0 0);position:absolute
text-indent:-1000px | text-indent:-100vw | clip-path:inset(50%) | clip-path:inset(75.5%) | clip-path:circle( 0)
transform:scale(0) | transform:scalex(1E-3) | transform:matrix(0,0,0,0,0,0) | transform:rotateX(-90deg) | transform:rotatey(450deg) | transform:translatey(-9999px) | transform:translate(3px, -2000px)
filter:opacity(0) | filter:blur(1px) opacity(.2%) | color:transparent | color:#ABC;background:#aabbcc | color:black;background:rgb(0,0,0) url(y) | color:white;background-color:#fff
overflow:hidden;height:0 | overflow:hidden;max-width:0px | /* c */display:none | background:url(a;b);display:none
"""
SEEN = """
display:block | visibility:visible | content-visibility:auto | opacity:.02 | opacity:1 | opacity:0px | opacity:3% | height:2px | font-size:9px
position:absolute;left:-900px | position:absolute;left:-99vw | position:static;left:-9999px | left:-9999px | position:absolute;left:calc(-100vw) | position:absolute;clip:rect(1px,2px)
text-indent:-2em | clip-path:inset(49%) | clip-path:circle(0.5px) | transform:scale(.5) | transform:scale(1e2) | transform:rotate(90deg) | transform:rotatex(89deg) | transform:translate(-5px,0)
filter:opacity(.5) | filter:none | color:white | color:var(--a);background:var(--a) | color:inherit;background:inherit | color:#777;background:#787878 | background:white
overflow:visible;max-height:0 | overflow:hidden;max-width:4px | a{b:c} | display | ; | color:__proto__
"""


@pytest.mark.parametrize("style", [s.strip() for line in HIDDEN.strip().split("\n") for s in line.split(" | ")])
def test_hiding_styles(style):
    assert css.hidden_style(style)


@pytest.mark.parametrize("style", [s.strip() for line in SEEN.strip().split("\n") for s in line.split(" | ")])
def test_showing_styles(style):
    assert not css.hidden_style(style)


@settings(max_examples=200, deadline=None)
@given(st.floats(-5, 5, allow_nan=False))
def test_opacity_follows_its_number(n):
    assert css.hidden_style(f"opacity:{n:f}") == (float(f"{n:f}") < K.NEAR_ZERO)


C, X = K.COMMENT_MARK, K.HIDDEN_MARK
#: input, text after the cut
CUTS = [
    ("a <!-- x --> b", f"a {C} b"),
    ("a <!-- x --><!-- y -->", f"a {C}{C}"),
    ("a <!x> b <?y?> c", f"a {C} b {C} c"),
    ("<div>\n<!-- open\n</div>", f"<div>\n{C}"),
    ("see <span hidden>x</span> there", f"see {X} there"),
    ("see <span HIDDEN='' >x <b>y</b></span> there", f"see {X} there"),
    ("see <span aria-hidden='TRUE'>x</span>", f"see {X}"),
    ('see <a style="display:none">x <a>y</a> z</a> there', f"see {X} there"),
    ("see <i hidden>x never closed\nmore\n\nnext", f"see {X}\n\nnext"),
    ("see <img hidden> there", f"see {X} there"),
    ("# head <b hidden>x</b> end", f"# head {X} end"),
    ("- item <b hidden>x</b> end", f"- item {X} end"),
    ("> <div hidden>x</div>\n> seen", f"> {X}\n> seen"),
    ("| a | b |\n|---|---|\n| <b hidden>x</b> | y |", f"| a | b |\n|---|---|\n| {X} | y |"),
    ("<p hidden>one<p>two", f"{X}<p>two"),
    ("<ul><li hidden>one<li>two</ul>", f"<ul>{X}<li>two</ul>"),
    ("<div hidden><div>a</div>b</div>c", f"{X}c"),
    ("<div style='opacity:0'>cut short", X),
    ("<div>a</div>\n\n1. x <u hidden>y</u>\n   z", f"<div>a</div>\n\n1. x {X}\n   z"),
    ("<!DOCTYPE html><html><body><!-- c --><p>x</p>", f"<!DOCTYPE html><html><body>{C}<p>x</p>"),
    ("<svg><desc><p hidden>x</p></desc></svg>", f"<svg><desc>{X}</desc></svg>"),
]
UNCUT = [
    "`<div hidden>x</div>`", "```\n<div hidden>x</div>\n```", "    <div hidden>x</div>", "\\<div hidden>x\\</div>", "a < b and c > d", "<div>seen</div>", "1 <!doctype html> 2",
    "<script>if (a <!-- b) {}</script>", "<textarea><p hidden></textarea>", "<p data-hidden>x</p>", "``<b hidden>` ``", "<hidden>x</hidden>",
]


@pytest.mark.parametrize("text,want", CUTS)
def test_cuts(text, want):
    assert H.sanitize(text)[0] == want


@pytest.mark.parametrize("text", UNCUT)
def test_uncut(text):
    got = H.sanitize(text)
    assert got is None or got[0] == text


@pytest.mark.parametrize("tag", sorted(html.REPORTED))
def test_reported(tag):
    text, removed, (tags, data) = H.sanitize(f"x <{tag} src='data:,a'></{tag}> y")
    assert tags == {tag: 1} and data == 1 and removed == (0, 0) and text == f"x <{tag} src='data:,a'></{tag}> y"


def test_templates_are_not_shown():
    assert html.scan_fragment("<template><p hidden>x</p></template>").ranges == []


def test_source_heuristic(spark):
    rows = ["<p>\n<b>\nx\ny\nz", "<p>\n<b>\nx\ny", "<p>\nw\nx\ny\nz", "<p>\n<b>\nx\ny\nz\n\n\n", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(H.looks_like_source(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [H.source_like(t) for t in rows] == [True, False, False, False, False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.sampled_from(["comment", "hidden"])), max_size=8))
def test_splice_keeps_the_rest(ranges):
    text = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ"
    spans = [(a, min(a + n, len(text)), k) for a, n, k in ranges]
    out = H.splice(text, spans)
    cut = {i for a, z, _ in spans for i in range(a, z)}
    assert out.replace(C, "").replace(X, "") == "".join(ch for i, ch in enumerate(text) if i not in cut)


def test_merge_is_the_relation(spark):
    import random

    rng = random.Random(2)
    rows = []
    for key in range(40):
        for _ in range(rng.randint(0, 8)):
            a = rng.randrange(20)
            rows.append((key, a, a + rng.randint(1, 6), rng.choice(["comment", "hidden"])))
    got = H.merge_ranges(spark.createDataFrame(rows, "k int, start int, end int, kind string"), "k").collect()
    want = [(k, *r) for k in range(40) for r in H.merge([x[1:] for x in rows if x[0] == k])]
    assert sorted((r.k, r.start, r.end, r.kind) for r in got) == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>/!-abpdiv hidden=\"'\n`*[]()&;"), max_size=80))
def test_parsers_never_fail(text):
    H.sanitize(text)
    markdown.links(text)
    html.attribute_urls(text)
    for node in html.parse(text).walk():
        assert 0 <= node.start <= node.end <= len(text)


def test_hostile_input_takes_no_time():
    import time

    began = time.time()
    for style in ("/*" * 100_000, "a:" + "(" * 100_000, "a:" + "'(" * 50_000, ";" * 200_000, "a:b;" * 30_000):
        css.hidden_style(style)
    for text in ("<div>" * 30_000, "<svg>" * 20_000 + "<p>" * 2000, "<!" * 50_000, "<a b " * 20_000, "[" * 30_000 + "](", "`" * 30_000 + "a", "<p hidden>" * 20_000, "*_" * 30_000):
        H.sanitize(text)
        markdown.links(text)
    assert time.time() - began < 30


def test_deep_nesting():
    assert H.sanitize("<div>" * 20_000 + "<p hidden>x")[0].endswith(X)
    assert H.sanitize("> " * 3000 + "<b hidden>x</b>") is not None


def test_columns(spark):
    rows = [c[0] for c in CUTS] + UNCUT + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", H.sanitize_html(F.col("t")).alias("h")).orderBy("i").collect()
    assert [r.h and r.h.text for r in got[: len(CUTS)]] == [c[1] for c in CUTS] and got[-1].h is None
    told = df.where("i = 0").select(H.describe_removed(H.sanitize_html(F.col("t"))["removed"]).alias("d")).first().d
    assert told == "1 HTML comment(s)"
    tags = spark.createDataFrame([("<script></script><style></style> x",)], "t string").select(H.sanitize_html(F.col("t"))["warned"].alias("w"))
    got = tags.select(H.describe_warned(F.col("w")).alias("a"), H.describe_warned_output(F.col("w")).alias("b")).first()
    assert got.a == "Preserved but reported (page source kept inspectable): script×1, style×1"
    assert got.b.startswith("Scripting/resource content present and preserved (1 <script>, 1 <style>) — ")


N = 30_000
HOSTILE = {
    "unclosed links": "[](" * N, "backticks": "`a " * N, "definitions": "[a]: <\n" * N, "comments": "x <!--" * N, "instructions": "x <?" * N, "cdata": "x <![CDATA[" * N, "declarations": "x <!a " * N,
    "parentheses": "http://a" + ")" * N, "stops": "www.a" + "." * N, "blank lines": "- a" + "\n" * N + "b", "quotes": "> " * N, "closed links": "[](" * N + ")" * N, "blank links": "[]( " * N, "tags": 'x <a b="' * N,
}


@pytest.mark.parametrize("text", HOSTILE.values(), ids=HOSTILE)
def test_hostile_markdown_takes_linear_time(text):
    start = time.monotonic()
    markdown.links(text)
    H.sanitize(text + "<b>")
    assert time.monotonic() - start < 5


def test_hostile_markdown_as_columns(spark):
    start = time.monotonic()
    df = spark.createDataFrame([(t,) for t in HOSTILE.values()], "t string")
    assert df.select(exfil.detect_exfil(F.col("t")).alias("x"), H.sanitize_html(F.col("t")).alias("h")).collect()
    assert time.monotonic() - start < 40


def test_parentheses_in_destinations():
    cases = [("[a](b(c)d)", "b(c)d"), (r"[a](b\(c)", "b(c"), ("[a](b(c)", None), ("[a]( b )", "b"), ("[a](b (t))", "b"), ("[a](b) c)", "b"), ('[a](b "t")', "b"), ("[a](b c)", None), ("[a]((b)", None), ("x) [a](b)", "b"), ("( [a](b)", "b"), ("([a](b)", "b"), ("[a]()", "")]
    assert [(t, dict(markdown.links(t)) and markdown.links(t)[0][0] if markdown.links(t) else None) for t, _ in cases] == cases
