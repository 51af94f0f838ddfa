"""URLs judged one at a time, without Spark, by the rules that the columns of operators.exfil state."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from .. import constants as K


@functools.cache
def _java(pattern: str) -> re.Pattern:
    """A pattern of the columns: classes and case are those of ASCII, as in Java."""
    for java, python in ((r"\z", r"\Z"), (r"\x{A0}", r"\xa0"), (r"\x{FEFF}", r"\ufeff"), (r"\x{2028}", r"\u2028"), (r"\x{2029}", r"\u2029")):
        pattern = pattern.replace(java, python)
    return re.compile(pattern, re.A)


def utf16(text: str) -> int:
    return len(text) + sum(ch > "\uffff" for ch in text)


@dataclass(frozen=True)
class Url:
    valid: bool
    host: str
    userinfo: bool
    path: str
    query: str
    fragment: str
    relative: bool


_SPECIAL, _SAME, _SCHEME = re.compile(r"(?i)(?:https?|ftp|wss?):"), re.compile(r"(?i)http:(?![/\\])"), re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def parse(url: str, base: str) -> Url:
    u = re.sub(r"[\t\n\r]", "", re.sub(r"\A[\x00-\x20]+|[\x00-\x20]+\Z", "", url))
    named, special, same, net = _SCHEME.match(u), bool(_SPECIAL.match(u)), bool(_SAME.match(u)), u[:1] in ("/", "\\") and u[1:2] in ("/", "\\")
    absolute, other = special and not same, bool(named) and not special
    has_host = absolute or net or (other and u.startswith("://", named.end() - 1))
    scheme = named[1].lower() if absolute or other else "http"
    if has_host and not other:
        m = re.match(r"(?:[A-Za-z]+:)?[/\\]*([^/\\?#]*)", u) if absolute else re.match(r"[/\\]+([^/\\?#]*)", u)
    elif has_host:
        m = re.match(r"[^:]*://([^/?#]*)", u)
    else:
        m = None
    authority = m[1] if m else ""
    rest = u[m.end() :] if m else u[named.end() :] if other else u
    named_host = authority.rpartition("@")[2]
    port = re.search(r":([0-9]*)\Z", named_host)
    host, number = (named_host[: port.start()] if port else named_host).lower(), port[1] if port else ""
    odd = re.search(r"[\x00-\x20<>\[\]^|%\x7f\\:\ufffd]", host) and not re.fullmatch(r"\[[0-9a-f:.]+\]", host)
    bad = has_host and not other and (not host or odd or len(number) > 5 or int(number or 0) > 65535)
    default = number == "" or _PORTS.get(scheme) == number
    where = (host if default else f"{host}:{number}") if has_host else "" if other else base
    return Url(
        not bad,
        where,
        has_host and re.search(r"\A[^@]*[^@:][^@]*@|\A:[^@]+@|@.*@", authority) is not None,
        re.match(r"[^?#]*", rest)[0],
        re.match(r"[^?#]*(?:\?([^#]*))?", rest)[1] or "",
        rest.partition("#")[2],
        not has_host and not other,
    )


def params(query: str) -> list[tuple[str, str]]:
    """Names in lower case, and values as they are written."""
    return [(p.partition("=")[0].lower(), p.partition("=")[2]) for p in re.split("[&;]", query) if p]


def _encoded_length(fragment: str) -> int:
    """UTF-16 length of a fragment with its ``#`` once browsers have percent-encoded it."""
    odd = len(re.findall(r'[\x00-\x20"<>`\x7f]', fragment))
    wide = sum(len(ch.encode("utf-8", "surrogatepass")) for ch in fragment if ch > "\x7f")
    plain = sum(ch <= "\x7f" for ch in fragment) - odd
    return 1 + plain + 3 * (wide + odd) if fragment else 0


def _safe_blob(value: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9_-]{40,}={0,2}", value) is not None and re.search("[A-Za-z0-9]{40,}", value) is not None


def param_reason(name: str, value: str) -> str | None:
    from ..operators import exfil as E

    if _java(E.BENIGN_PARAM).search(name):
        return None
    if re.search("[A-Za-z0-9_]{20,}", value) and re.search("[0-9]", value) and (_java(E.SECRET_HINT).search(value) or _java(E.SECRET_HINT_MORE).search(value)):
        return E.CREDENTIAL
    blob = re.fullmatch(r"[A-Za-z0-9+/]{40,}={0,2}", value) or re.fullmatch(r"[A-Fa-f0-9]{32,}", value) or _safe_blob(value)
    return E.QUERY if blob else None


def _first(pairs: list[tuple[str, str]]) -> str | None:
    return next((r for r in (param_reason(n, v) for n, v in pairs) if r), None)


def reason(url: str) -> str | None:
    """Why the URL looks like an exfiltration channel: the first rule that fires."""
    from ..operators import exfil as E

    if _java(E.DATA).search(url):
        return "active-content data: URI" if _java(E.ACTIVE_DATA).search(url) else "oversized inline data: payload" if utf16(url) > K.LONG_DATA_URI else None
    if _java(E.SCRIPT).search(url):
        return "script-executing URI"
    tail = re.search(r"[?#]", url)
    behind = url[tail.start() :] if tail else ""
    if any(re.search(t, behind) for t in E.TEMPLATES):
        return E.QUERY
    if early := _first([p for part in behind[1:].split("#") for p in params(part) if _java(E.KEYWORD_PARAM).search(p[0])]):
        return early
    u = parse(url, E.BASE_HOST)
    if not u.valid:
        return None
    if u.userinfo:
        return "embedded credentials"
    asked = url[url.find("?") :] if "?" in url else ""
    if utf16(asked) > K.LONG_QUERY and not all(_java(E.BENIGN_PARAM).search(n) for n, _ in params(u.query)):
        return "unusually long query string"
    if _encoded_length(u.fragment) > K.LONG_QUERY:
        return "unusually long fragment"
    if found := _first(params(u.query)) or _first(params(u.fragment)):
        return found
    long = [s for s in u.path.split("/") if utf16(s) > K.LONG_SEGMENT]
    return "encoded data blob in path segment" if any(re.fullmatch(r"[A-Za-z0-9+/]+={0,2}|[A-Fa-f0-9]+", s) or _safe_blob(s) for s in long) else None


def target(url: str) -> str:
    """Where a URL leads, without its payload."""
    from ..operators import exfil as E

    if _java(E.DATA).search(url):
        return "(inline data: URI)"
    u = parse(url, E.BASE_HOST)
    return "(unparsable URL)" if not u.valid else "(relative URL)" if u.relative and not url.startswith(f"http://{E.BASE_HOST}") else u.host


def reasons(text: str) -> list[str]:
    """Distinct findings over a text's URLs, in the order in which they are first seen."""
    from ..operators import exfil as E
    from . import html, markdown, patterns

    if not (re.search(patterns.TAG_PRESENT, text) or _java(patterns.LINK_HINT).search(text)):
        return []
    try:
        found = [(u, image, "resource") for u, image in markdown.links(text)] + html.attribute_urls(text)
    except (RecursionError, ValueError, IndexError):
        return [f"link to {E.TOO_DEEP[1]}: {E.TOO_DEEP[0]}"]
    out = {}
    for url, image, context in found:
        why = reason(url)
        if why is None and context in E.OFF_ORIGIN:
            u = parse(url, E.BASE_HOST)
            why = E.OFF_ORIGIN[context] if u.valid and not u.relative else None
        if why:
            out[f"{'image' if image else 'link'} to {target(url)}: {why}"] = None
    return list(out)
