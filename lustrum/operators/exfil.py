"""URLs shaped to carry data out: extracted by an Arrow UDF, judged by native columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import html, markdown
from ..functions import patterns as P
from ..functions.rows import arrow, let, utf16_length
from .hidden import tag_present

# Shapes of names, values and schemes
SECRET_HINT = (
    r"(?i)secret|token|password|passwd|pwd|bearer|credential|authorization|contrase[nñÑ]a|-----BEGIN|(?:api|auth|service|account|db|database|priv|private|client|access)[_-]?key|"
    r"(?:db|database|key)[_-]?pass|(?:A3T|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]|github_pat_|gl[a-z]{2,12}-[0-9A-Za-z_-]{20}|sk-ant-|"
    r"AIza[0-9A-Za-z_-]{35}|sk_live_|sk_test_|rk_live_|rk_test_|xox[bpasr]-|eyJ[A-Za-z0-9]|do[opr]_v1_[a-f0-9]{16}|v1\.0-[a-f0-9]{24}-|hv[sb]\.[A-Za-z0-9_-]{20}|"
    r"(?<![a-z0-9])[a-z0-9]{14}\.atlasv1\.|sk-or-v1-[0-9a-f]{16}|gsk_[A-Za-z0-9]{16}|xai-[A-Za-z0-9]{16}|r8_[A-Za-z0-9]{16}"
)
SECRET_HINT_MORE = (
    r"(?i)(?:AC|SK)[a-z0-9]{32}|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}|sq0csp-[0-9A-Za-z_-]{43}|(?<![0-9])[0-9]{8,10}:[0-9A-Za-z_-]{35}|(?<![0-9a-z])[0-9a-z]{32}-us[0-9]{1,2}|"
    r"(?<![A-Za-z0-9_-])[MNO][A-Za-z0-9_-]{23,25}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27}|T3BlbkFJ|pypi-AgE|(?<![A-Za-z0-9])AKC[A-Za-z0-9]{10}|"
    r"(?<![A-Za-z0-9])AP[0-9A-Fa-f][A-Za-z0-9]{8}|://[^\s:/@]{1,64}:[^\s:/@]{1,64}@|(?:key|pw|pass)[\"']?[\s:=>]+[\"']?[A-Za-z0-9_/+-]{20}"
)
BENIGN_PARAM = (
    r"(?i)\A(?:x-(?:amz|goog|ms|oss|obs)-[a-z0-9-]+|amz-[a-z0-9-]+|utm_[a-z]+|sig|signature|hmac|policy|credential|expires|key-pair-id|se|sp|sr|sv|st|spr|si|skoid|sktid|"
    r"cursor|after|before|continuation|continuationtoken|continuation_token|pagetoken|page_token|nexttoken|next_token|gclid|fbclid|dclid|msclkid|gbraid|wbraid|_ga|_gl|"
    r"mc_eid|mc_cid)\z"
)
KEYWORD_PARAM = r"(?i)\A(?:data|d|payload|exfil|leak|steal|secret|token|key|env|password|pwd|cookie|session|auth)\z"
ACTIVE_DATA = r"(?i)\A[\s\x{A0}\x{FEFF}]*data:(?:text/html|image/svg\+xml|application/(?:javascript|ecmascript|xhtml\+xml))[;,]"
DATA = r"(?i)\A[\s\x{A0}\x{FEFF}]*data:"
SCRIPT = r"(?i)\A[\s\x{A0}\x{FEFF}]*(?:javascript|vbscript):"
TEMPLATES = (r"\$\{[^{}]+\}", r"\{\{[^{}]+\}\}")
BASE_HOST = "relative.invalid"
CREDENTIAL, QUERY = "credential-shaped token in URL parameter", "suspicious query parameter"
OFF_ORIGIN = {"form": "off-origin form action", "refresh": "off-origin meta-refresh redirect"}
TOO_DEEP = ("input too deeply nested to scan for exfil URLs", "(unparseable HTML)")
URLS = "array<struct<url:string,is_image:boolean,context:string>>"
THREATS = "array<struct<is_image:boolean,reason:string,target:string>>"


def link_hint(text: Column) -> Column:
    return text.rlike(P.LINK_HINT)


def needs_markdown(text: Column) -> Column:
    return tag_present(text) | link_hint(text)


def secret_hint(text: Column) -> Column:
    return text.rlike(SECRET_HINT) | text.rlike(SECRET_HINT_MORE)


def raw_params(query: Column) -> Column:
    """array of struct(name, value): names in lower case, values as they are written."""
    pairs = F.filter(F.split(query, "[&;]", -1), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_extract(p, r"\A([^=]*)", 1)).alias("name"), F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1).alias("value")))


def _url_safe_blob(value: Column) -> Column:
    return value.rlike(r"\A[A-Za-z0-9_-]{40,}={0,2}\z") & value.rlike("[A-Za-z0-9]{40,}")


def param_reason(name: Column, value: Column) -> Column:
    token = value.rlike("[A-Za-z0-9_]{20,}") & value.rlike("[0-9]") & secret_hint(value)
    blob = value.rlike(r"\A[A-Za-z0-9+/]{40,}={0,2}\z") | value.rlike(r"\A[A-Fa-f0-9]{32,}\z") | _url_safe_blob(value)
    return F.when(name.rlike(BENIGN_PARAM), F.lit(None).cast("string")).when(token, CREDENTIAL).when(blob, QUERY)


def _first_reason(params: Column) -> Column:
    return F.get(F.filter(F.transform(params, lambda p: param_reason(p["name"], p["value"])), lambda r: r.isNotNull()), F.lit(0))


def _keyword_reason(url: Column) -> Column:
    behind = F.regexp_extract(url, r"(?s)[?#](.*)\z", 1)
    params = F.flatten(F.transform(F.split(behind, "#", -1), raw_params))
    named = F.filter(params, lambda p: p["name"].rlike(KEYWORD_PARAM))
    return F.when(url.rlike("[?#]"), _first_reason(named))


def parse_url(url: Column) -> Column:
    """struct of a URL resolved against an http page, as browsers read it; valid is false where they refuse it.

    Special schemes (http, https, ftp, ws, wss) take any run of slashes before the host; other
    absolute URLs have a host only behind two; the rest is relative.
    """

    def parts(u: Column) -> Column:
        special = u.rlike(r"(?i)\A(?:https?|ftp|wss?):")
        same = u.rlike(r"(?i)\Ahttp:(?![/\\])")  # the page's own scheme without slashes is relative
        net = u.rlike(r"\A[/\\]{2}")
        other = u.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") & ~special
        scheme = F.when((special & ~same) | other, F.lower(F.regexp_extract(u, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))).otherwise("http")
        has_host = (special & ~same) | net | (other & u.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"))
        authority = F.when(special & ~same, F.regexp_extract(u, r"\A[A-Za-z]+:[/\\]*([^/\\?#]*)", 1)).when(net, F.regexp_extract(u, r"\A[/\\]+([^/\\?#]*)", 1)).when(has_host, F.regexp_extract(u, r"\A[^:]*://([^/?#]*)", 1))
        host_port = F.regexp_extract(authority, r"([^@]*)\z", 1)
        port = F.regexp_extract(host_port, r":([0-9]*)\z", 1)
        host = F.lower(F.regexp_replace(host_port, r":[0-9]*\z", ""))
        default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | ((scheme == "ftp") & (port == "21")) | (port == "")
        bad = has_host & ~other & ((host == "") | host.rlike(r"[\x00-\x20<>\[\]^|%\x7f\\:\x{FFFD}]") & ~host.rlike(r"\A\[[0-9a-f:.]+\]\z") | (F.length(port) > 5) | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535))
        rest = F.when(has_host & ~other, F.regexp_extract(u, r"(?s)\A(?:[A-Za-z]+:)?[/\\]*[^/\\?#]*(.*)\z", 1)).when(has_host, F.regexp_extract(u, r"(?s)\A[^:]*://[^/?#]*(.*)\z", 1)).when(other, F.regexp_extract(u, r"(?s)\A[^:]*:(.*)\z", 1)).otherwise(u)
        return F.struct(
            (~bad).alias("valid"),
            scheme.alias("scheme"),
            F.when(has_host, F.when(default, host).otherwise(F.concat(host, F.lit(":"), port))).when(other, "").otherwise(BASE_HOST).alias("host"),
            (has_host & authority.rlike(r"\A[^@]*[^@:][^@]*@|\A:[^@]+@|@.*@")).alias("userinfo"),
            F.regexp_extract(rest, r"\A([^?#]*)", 1).alias("path"),
            F.regexp_extract(rest, r"(?s)\A[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(rest, r"(?s)#(.*)\z", 1).alias("fragment"),
            (~has_host & ~other).alias("relative"),
        )

    clean = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    return let(clean, parts)


def _encoded_length(fragment: Column) -> Column:
    """UTF-16 length of a fragment with its ``#`` once browsers have percent-encoded it."""
    wide = F.octet_length(F.regexp_replace(fragment, r"[\x00-\x7F]", ""))
    odd = F.regexp_count(fragment, F.lit(r'[\x00-\x20"<>`\x7f]'))
    plain = F.length(F.regexp_replace(fragment, r"[^\x00-\x7F]", "")) - odd
    return F.when(fragment == "", 0).otherwise(1 + plain + 3 * (wide + odd))


def check_exfil_url(url: Column) -> Column:
    """Why the URL looks like an exfiltration channel, or null: the first rule that fires."""

    def judged(u: Column) -> Column:
        tail = F.regexp_extract(u, r"(?s)([?#].*)\z", 1)
        data = F.when(u.rlike(ACTIVE_DATA), "active-content data: URI").when(utf16_length(u) > K.LONG_DATA_URI, "oversized inline data: payload")
        template = tail.rlike(TEMPLATES[0]) | tail.rlike(TEMPLATES[1])
        early = F.when(template, QUERY).otherwise(_keyword_reason(u))
        parsed = let(parse_url(u), lambda p: _parsed_reason(u, p))
        return F.when(u.rlike(DATA), data).when(u.rlike(SCRIPT), "script-executing URI").otherwise(F.coalesce(early, parsed))

    return let(url, judged)


def _parsed_reason(u: Column, p: Column) -> Column:
    params = raw_params(p["query"])
    long_query = utf16_length(F.regexp_extract(u, r"(?s)(\?.*)\z", 1)) > K.LONG_QUERY
    benign = F.forall(params, lambda x: x["name"].rlike(BENIGN_PARAM))
    blob = F.exists(
        F.split(p["path"], "/", -1),
        lambda s: (utf16_length(s) > K.LONG_SEGMENT) & (s.rlike(r"\A(?:[A-Za-z0-9+/]+={0,2}|[A-Fa-f0-9]+)\z") | _url_safe_blob(s)),
    )
    found = F.coalesce(_first_reason(params), _first_reason(raw_params(p["fragment"])), F.when(blob, "encoded data blob in path segment"))
    return (
        F.when(~p["valid"], F.lit(None).cast("string"))
        .when(p["userinfo"], "embedded credentials")
        .when(long_query & ~benign, "unusually long query string")
        .when(_encoded_length(p["fragment"]) > K.LONG_QUERY, "unusually long fragment")
        .otherwise(found)
    )


def url_host(url: Column) -> Column:
    """Where a URL leads, without its payload."""
    named = let(parse_url(url), lambda p: F.when(~p["valid"], "(unparsable URL)").when(p["relative"] & ~url.startswith(f"http://{BASE_HOST}"), "(relative URL)").otherwise(p["host"]))
    return F.when(url.isNull(), F.lit(None).cast("string")).when(url.rlike(DATA), "(inline data: URI)").otherwise(named)


def off_origin(url: Column) -> Column:
    return let(parse_url(url), lambda p: p["valid"] & ~p["relative"])


@arrow("urls " + URLS + ", failed boolean")
def _extract(text: pd.Series) -> pd.DataFrame:
    urls, failed = [], []
    for t in text:
        try:
            got = None if t is None else [(u, image, "resource") for u, image in markdown.links(t)] + html.attribute_urls(t)
            urls.append(got and [{"url": u, "is_image": image, "context": c} for u, image, c in got])
            failed.append(False)
        except (RecursionError, ValueError, IndexError):
            urls.append(None)
            failed.append(True)
    return pd.DataFrame({"urls": urls, "failed": failed})


def extract_urls(text: Column) -> Column:
    """struct(urls, failed): every URL of links, images, definitions and attributes."""
    return _extract(F.when(needs_markdown(text), text))


def score_urls(urls: Column) -> Column:
    """Threats among extracted URLs."""
    reason = lambda u: F.coalesce(check_exfil_url(u["url"]), *[F.when((u["context"] == c) & off_origin(u["url"]), why) for c, why in OFF_ORIGIN.items()])
    judged = F.transform(urls, lambda u: F.struct(u["is_image"].alias("is_image"), reason(u).alias("reason"), u["url"].alias("url")))
    bad = F.filter(judged, lambda t: t["reason"].isNotNull())
    return F.transform(bad, lambda t: F.struct(t["is_image"].alias("is_image"), t["reason"].alias("reason"), url_host(t["url"]).alias("target")))


def detect_exfil(text: Column) -> Column:
    """array of struct(is_image, reason, target), or null where nothing is found."""
    got = extract_urls(text)
    deep = F.array(F.struct(F.lit(False).alias("is_image"), F.lit(TOO_DEEP[0]).alias("reason"), F.lit(TOO_DEEP[1]).alias("target")))
    return F.when(got["failed"], deep).otherwise(let(score_urls(got["urls"]), lambda t: F.when(F.size(t) > 0, t)))


def reasons(threats: Column) -> Column:
    """Distinct reasons in the order in which they are first seen."""
    kind = lambda t: F.when(t["is_image"], "image").otherwise("link")
    return F.array_distinct(F.transform(threats, lambda t: F.concat(kind(t), F.lit(" to "), t["target"], F.lit(": "), t["reason"])))
