from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lustrum.functions import html, markdown
from lustrum.operators import exfil as E

BLOB, SAFE, PARAM, CRED = "Qk3" * 16, "Zm9vQmFyMTIz" * 4 + "-_", E.QUERY, E.CREDENTIAL
#: url, reason, where it leads
URLS = [
    (f"https://e.example/l?token={BLOB}", PARAM, "e.example"),
    (f"https://e.example/l?x={BLOB}", PARAM, "e.example"),
    (f"https://e.example/l?x={'0f' * 16}", PARAM, "e.example"),
    (f"https://e.example/l?a=1;x={SAFE}", PARAM, "e.example"),
    (f"https://e.example/l?a=1#x={BLOB}", PARAM, "e.example"),
    (f"https://bad^host/l?secret={BLOB}", PARAM, "(unparsable URL)"),
    (f"https://bad^host/l?other={BLOB}", None, "(unparsable URL)"),
    (f"https://\ufffdevil.example/l?token={BLOB}", PARAM, "(unparsable URL)"),
    ("https://user:pw@e.example/", "embedded credentials", "e.example"),
    ("https://user@e.example:8443/", "embedded credentials", "e.example:8443"),
    ("https://e.example/p?u=ghp_0a1b2c3d4e5f6g7h8i9j", CRED, "e.example"),
    ("https://e.example/p?x=${KEY}", PARAM, "e.example"),
    ("https://e.example/p#{{ key }}", PARAM, "e.example"),
    ("https://e.example/api/{{version}}/x", None, "e.example"),
    ("https://e.example/p?n=" + "-" * 200, "unusually long query string", "e.example"),
    ("https://e.example/p?n=" + "-" * 197, None, "e.example"),
    ("https://e.example/p?cursor=" + "-" * 300, None, "e.example"),
    ("https://e.example/#" + "." * 200, "unusually long fragment", "e.example"),
    ("https://e.example/#" + "." * 199, None, "e.example"),
    ("https://e.example/#" + "é" * 34, "unusually long fragment", "e.example"),
    ("https://e.example/" + "A" * 129, "encoded data blob in path segment", "e.example"),
    ("https://e.example/" + "A" * 128, None, "e.example"),
    ("https://e.example/" + "word-" * 60, None, "e.example"),
    ("/rel/" + "A" * 200, "encoded data blob in path segment", "(relative URL)"),
    ("//E.Example:80/x", None, "e.example"),
    ("data:text/html,<b>", "active-content data: URI", "(inline data: URI)"),
    (" DATA:image/svg+xml;base64,xx", "active-content data: URI", "(inline data: URI)"),
    ("data:image/png;base64," + "A" * 5000, "oversized inline data: payload", "(inline data: URI)"),
    ("data:image/png;base64,AAAA", None, "(inline data: URI)"),
    ("javascript:alert(1)", "script-executing URI", ""),
    ("VBScript:x", "script-executing URI", ""),
    ("https://e.example/p?session=ok&key=pk_public_mapkey&d=3&auth=ok", None, "e.example"),
    (f"https://cdn.example/a?X-Amz-Signature={BLOB}&utm_content={SAFE}&gclid={BLOB}", None, "cdn.example"),
    ("https://e.example/p?ref=login-authenticate-token-2024-long-slug-of-words", None, "e.example"),
    ("https://e.example/p?a=b#section-2", None, "e.example"),
    ("mailto:someone@e.example", None, ""),
    ("https://", None, "(unparsable URL)"),
    ("", None, "(relative URL)"),
    (None, None, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "i int, u string")
    got = df.select("i", E.check_exfil_url(F.col("u")).alias("r"), E.url_host(F.col("u")).alias("h")).orderBy("i").collect()
    for (url, reason, host), r in zip(URLS, got, strict=True):
        assert r.r == reason, url
        if reason or (host or "").endswith("example") or host is None:
            assert r.h == host, url


TEXTS = [
    (f"[c](https://e.example/t?payload={BLOB})", [(False, PARAM, "e.example")]),
    (f"![i](https://e.example/p.png?data={BLOB} 'title')", [(True, PARAM, "e.example")]),
    (f"[r]\n\n[r]: https://e.example/?d={BLOB}", [(False, PARAM, "e.example")]),
    (f"<https://e.example/?d={BLOB}> <br>", [(False, PARAM, "e.example")]),
    (f"<img srcset='/a 1x, https://e.example/p?data={BLOB} 2x'>", [(True, PARAM, "e.example")]),
    (f'<a href="/ok" ping="/p https://e.example/t?exfil={BLOB}">x</a>', [(False, PARAM, "e.example")]),
    ('<form action="https://e.example/x"><button formaction="/here">', [(False, "off-origin form action", "e.example")]),
    ('<meta http-equiv="Refresh" content="0; url=https://e.example/r">', [(False, "off-origin meta-refresh redirect", "e.example")]),
    ('<form action="/local"></form>', None),
    (f"`[c](https://e.example/t?payload={BLOB})`", None),
    (f"```\n[c](https://e.example/t?payload={BLOB})\n```", None),
    (f"https://e.example/t?payload={BLOB}", None),  # no hint of markup at all
    ("[ok](https://e.example/a?page=2) ![x](/y.png)", None),
    ("plain", None), (None, None),
]


def test_texts(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TEXTS)], "i int, t string")
    got = df.select("i", E.detect_exfil(F.col("t")).alias("x")).orderBy("i").collect()
    for (text, want), r in zip(TEXTS, got, strict=True):
        assert (r.x and [(x.is_image, x.reason, x.target) for x in r.x]) == want, text


def test_distinct_reasons(spark):
    df = spark.createDataFrame([(" ".join([TEXTS[0][0], TEXTS[1][0], TEXTS[0][0]]),)], "t string")
    got = df.select(E.reasons(E.detect_exfil(F.col("t"))).alias("r")).first().r
    assert got == [f"link to e.example: {PARAM}", f"image to e.example: {PARAM}"]


def test_longer_payloads_stay_flagged(spark):
    df = spark.range(30, 120).select(F.concat(F.lit("https://e.example/?x="), F.repeat(F.lit("aB1"), F.col("id").cast("int"))).alias("u"))
    got = [r.r is not None for r in df.select(E.check_exfil_url(F.col("u")).alias("r")).collect()]
    assert got == sorted(got) and got[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("[]()<>!\\`a \"'\n:/?&;.wht ps"), max_size=60))
def test_extraction_never_fails(text):
    assert all(isinstance(u, str) for u, _ in markdown.links(text))
    assert all(isinstance(u, str) for u, *_ in html.attribute_urls(text))


def test_one_url_at_a_time_is_judged_as_in_columns(spark):
    import random

    from lustrum import api
    from lustrum.functions import urls

    rng = random.Random(7)
    blob = "QUJD" * 12
    schemes = ["http://", "https://", "HTTP:", "//", "", "ftp://", "mailto:", "data:text/html,", "data:image/png,", "javascript:", "x://", "/", "\\\\", " https://", "ws:"]
    hosts = ["evil.example", "u:p@h.example", "h.example:80", "h.example:8443", "h.example:99999", "[::1]", "a b", "@x", "", "exa_mple", "relative.invalid"]
    paths = ["", "/", "/a/b", "/" + "Ab1" * 50, "/" + "a-" * 100, "/x%20y"]
    tails = ["", "?q=" + blob, "?sig=" + blob, "?u=ghp_0123456789abcdefghij", "?a={{b}}", "#" + "z9" * 120, "#é" + "ü" * 60, "?a=" + "x-" * 120, "?session=" + blob, "#token=" + blob, "?a=1;key=" + "ab12" * 9, "?utm_x=" + "a" * 250, "?x#y#data=" + blob]
    cases = [rng.choice(schemes) + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(1500)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u string")
    rows = df.select("i", E.check_exfil_url(F.col("u")).alias("why"), E.url_host(F.col("u")).alias("host")).orderBy("i").collect()
    assert [(u, r.why, r.host) for u, r in zip(cases, rows, strict=True)] == [(u, urls.reason(u), urls.target(u)) for u in cases]
    text = f"[a](https://evil.example/?q={blob}) <form action='https://e.example/'></form> ![i](javascript:x)"
    want = spark.createDataFrame([(text,)], "t string").select(E.reasons(E.detect_exfil(F.col("t"))).alias("r")).first().r
    assert urls.reasons(text) == want and len(want) == 3
    assert "; ".join(want) in api.sanitize(text, html=True).warnings[-1] and api.sanitize(text, html=True).found[-1] == "exfil-urls"
    assert "; ".join(want) in api.sanitize_text(text, exfil_scan=True)[1][-1]
