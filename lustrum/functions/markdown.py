"""A CommonMark reader for what matters here: where markup stands, and where links lead.

Blocks: quotes, lists, fenced and indented code, headings, HTML blocks, tables, link
definitions, paragraphs.  Inline: code spans, escapes, raw HTML, links, images,
autolinks.  Emphasis isn't resolved, so markup inside it belongs to its paragraph.
Everything keeps offsets into the source, and nothing is searched for twice from places
that can't find it, so that hostile text takes linear time.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from . import html as H

# The element names that open HTML blocks, and the shapes of inline markup
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody "
    "td tfoot th thead title tr track ul"
).split()
_NAME = r"[a-zA-Z][a-zA-Z0-9-]*"
_ATTR = r"""\s+[a-zA-Z_:][a-zA-Z0-9_.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_OPEN_TAG = re.compile(rf"<{_NAME}(?:{_ATTR})*\s*/?>")
_CLOSE_TAG = re.compile(rf"</{_NAME}\s*>")
_INLINE_MARKUP = re.compile(rf"<!-->|<!--->|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!\[CDATA\[[\s\S]*?\]\]>|<![a-zA-Z][^>]*>|{_OPEN_TAG.pattern}|{_CLOSE_TAG.pattern}")
_HTML_STARTS = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|\Z)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![a-zA-Z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_BLOCK_TAGS)})(?:\s|/?>|\Z)", re.I), None),
    (re.compile(rf"(?:{_OPEN_TAG.pattern}|{_CLOSE_TAG.pattern})[ \t]*\Z"), None),
)
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*\Z)|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|\Z)")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*\Z")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_BULLET = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|\Z)")
_DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(?:<([^<>\n]*)>|(\S+))(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?=\n|\Z)""")
_AUTOLINK = re.compile(r"<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*)>")
_BARE = re.compile(r"(?:https?://|www\.)[^\s<]+", re.I)
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Line:
    text: str
    at: int  # offset of its first character in the source


@dataclass
class Document:
    """HTML blocks (start, end); phrases: runs of lines with inline content; definitions' urls."""

    html: list[tuple[int, int]] = field(default_factory=list)
    phrases: list[list[Line]] = field(default_factory=list)
    definitions: list[str] = field(default_factory=list)


def source_lines(text: str) -> list[Line]:
    out, at = [], 0
    for part in re.split(r"(?<=\n)", text):
        out.append(Line(part.rstrip("\r\n"), at))
        at += len(part)
    return out


_LEAD = re.compile(r"[ \t]*")


def _blank(text: str) -> bool:
    return not text or text.isspace()


def _indent(text: str) -> int:
    return len(_LEAD.match(text)[0].expandtabs(4))


def _starts_html(text: str, in_paragraph: bool):
    if _indent(text) > 3:
        return None
    body = text.lstrip(" ")
    for k, (start, end) in enumerate(_HTML_STARTS):
        if start.match(body) and not (k == 6 and in_paragraph):
            return (end,)
    return None


def _interrupts(text: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if _blank(text) or _starts_html(text, True) or _FENCE.match(text) or _HEADING.match(text) or _RULE.match(text):
        return True
    bullet = _BULLET.match(text)
    return text.lstrip(" ").startswith(">") and _indent(text) < 4 or bool(bullet and text[bullet.end() :].strip() and bullet[2] in ("-", "+", "*", "1.", "1)"))


def _cut(line: Line, n: int) -> Line:
    return Line(line.text[n:], line.at + n)


def read(text: str) -> Document:
    doc = Document()
    todo = [source_lines(text)]
    while todo:  # containers are read after what stands around them; nesting needs no recursion
        _blocks(todo.pop(), doc, todo)
    return doc


def _blocks(lines: list[Line], doc: Document, todo: list) -> None:
    i, n = 0, len(lines)
    while i < n:
        text = lines[i].text
        if _blank(text):
            i += 1
        elif _indent(text) > 3:
            i += 1  # indented code
        elif fence := _FENCE.match(text):
            close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*\Z")
            i += 1
            while i < n and not close.match(lines[i].text):
                i += 1
            i += 1
        elif _HEADING.match(text):
            doc.phrases.append([lines[i]])
            i += 1
        elif _RULE.match(text):
            i += 1
        elif opened := _starts_html(text, False):
            i = _html_block(lines, i, opened[0], doc)
        elif text.startswith(">", len(_LEAD.match(text)[0])):
            i = _quote(lines, i, todo)
        elif bullet := _BULLET.match(text):
            i = _item(lines, i, bullet, todo)
        else:
            i = _paragraph(lines, i, doc)


def _html_block(lines: list[Line], i: int, end, doc: Document) -> int:
    first = i
    if end is None:
        while i < len(lines) and lines[i].text.strip():
            i += 1
        last = i - 1
    else:
        while i < len(lines) and not end.search(lines[i].text):
            i += 1
        last = min(i, len(lines) - 1)
        i += 1
    doc.html.append((lines[first].at, lines[last].at + len(lines[last].text)))
    return i


def _quote(lines: list[Line], i: int, todo: list) -> int:
    inner: list[Line] = []
    while i < len(lines):
        body = lines[i].text.lstrip(" ")
        if body.startswith(">") and _indent(lines[i].text) < 4:
            skip = len(lines[i].text) - len(body) + 1
            skip += body[1:2] in (" ", "\t")
            inner.append(_cut(lines[i], skip))
        elif inner and inner[-1].text.strip() and body.strip() and not _interrupts(lines[i].text):
            inner.append(lines[i])  # a lazy line goes on with the paragraph
        else:
            break
        i += 1
    todo.append(inner)
    return i


def _item(lines: list[Line], i: int, bullet: re.Match, todo: list) -> int:
    text = lines[i].text
    gap = len(text[bullet.end() :]) - len(text[bullet.end() :].lstrip(" \t"))
    width = bullet.end() + (gap if 1 <= gap <= 4 and text[bullet.end() :].strip() else 1)
    inner = [_cut(lines[i], min(width, len(text)))]
    i += 1
    while i < len(lines):
        text = lines[i].text
        if _blank(text):
            ahead = i
            while ahead < len(lines) and _blank(lines[ahead].text):
                ahead += 1
            if ahead == len(lines) or _indent(lines[ahead].text) < width:
                break
            inner += [_cut(x, len(x.text)) for x in lines[i:ahead]]
            i = ahead
            continue
        if _indent(text) >= width:
            inner.append(_cut(lines[i], min(width, len(text) - len(text.lstrip(" \t")))))
        elif inner[-1].text.strip() and not _interrupts(text) and not _BULLET.match(text):
            inner.append(lines[i])
        else:
            break
        i += 1
    todo.append(inner)
    return i


def _cells(line: Line) -> list[Line]:
    out, start = [], 0
    for m in re.finditer(r"(?<!\\)\||\Z", line.text):
        cell = line.text[start : m.start()]
        if cell.strip():
            lead = len(cell) - len(cell.lstrip())
            out.append(Line(cell.strip(), line.at + start + lead))
        start = m.end()
    return out


def _paragraph(lines: list[Line], i: int, doc: Document) -> int:
    first = i
    if i + 1 < len(lines) and "|" in lines[i].text and _DELIMITERS.match(lines[i + 1].text) and len(_cells(lines[i])) == len(_cells(lines[i + 1])):
        rows = [lines[i]]
        i += 2
        while i < len(lines) and lines[i].text.strip() and not _interrupts(lines[i].text):
            rows.append(lines[i])
            i += 1
        doc.phrases += [[cell] for row in rows for cell in _cells(row)]
        return i
    i += 1
    while i < len(lines) and not _interrupts(lines[i].text):
        if _UNDERLINE.match(lines[i].text):
            break
        i += 1
    text, at, skip = "\n".join(x.text for x in lines[first:i]), 0, 0
    while at < len(text) and (m := _DEFINITION.match(text, at)):
        doc.definitions.append(_plain(m[2] if m[2] is not None else m[3]))
        at, skip = m.end() + 1, skip + text_lines(m[0])
    if not _blank(text[at:]):
        doc.phrases.append(lines[first + skip : i])
    if i < len(lines) and _UNDERLINE.match(lines[i].text):
        i += 1
    return i


def text_lines(text: str) -> int:
    return text.count("\n") + 1


def _plain(url: str) -> str:
    """A destination without escapes and character references."""
    return entities.unescape(re.sub(r"\\([" + re.escape(_PUNCTUATION) + r"])", r"\1", url))


@dataclass
class Inline:
    markup: list[tuple[int, str]] = field(default_factory=list)  # (source offset, text) of raw HTML
    urls: list[tuple[str, bool]] = field(default_factory=list)  # (url, is image)
    end: int = 0


class _Source:
    """The joined lines of a phrase, and where each of their characters is in the source."""

    def __init__(self, lines: list[Line]):
        self.text = "\n".join(x.text for x in lines)
        self.own, self.sources, at = [], [], 0
        for x in lines:
            self.own.append(at)
            self.sources.append(x.at)
            at += len(x.text) + 1
        self.end = lines[-1].at + len(lines[-1].text)

    def offset(self, i: int) -> int:
        k = bisect_right(self.own, i) - 1
        return self.sources[k] + i - self.own[k]


class _Parens:
    """Which parentheses of a text belong together within its runs without blanks."""

    def __init__(self, text: str):
        self.text = text
        self.close: dict[int, int] = {}  # of an opening one
        self.open_last: dict[int, int] = {}  # run's end: the last one that nothing closes
        self.close_first: dict[int, int] = {}  # run's end: the first one that nothing opened
        self.ends = [m.start() for m in re.finditer(r"[ \t\n]|\Z", text)]
        waiting: list[int] = []
        for m in re.finditer(rf"\\[{re.escape(_PUNCTUATION)}]|[()]|[ \t\n]|\Z", text):
            at, ch = m.start(), m[0]
            if ch == "(":
                waiting.append(at)
            elif ch == ")" and waiting:
                self.close[waiting.pop()] = at
            elif ch == ")":
                self.close_first.setdefault(self.end(at), at)
            elif len(ch) < 2:
                if waiting:
                    self.open_last[at] = waiting[-1]
                waiting = []

    def end(self, at: int) -> int:
        """Where the run that ``at`` is in ends."""
        return self.ends[bisect_left(self.ends, at)]

    def url_end(self, paren: int, start: int) -> int | None:
        """Where a destination from ``start`` ends, behind the link's opening parenthesis."""
        end = self.end(start)
        if start > paren + 1:  # blanks between: a run of its own
            return self.close_first.get(end, None if end in self.open_last else end)
        return self.close.get(paren, end if self.open_last.get(end) == paren else None)


#: what opens and closes raw markup that runs on to its end
_OPENED = (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">"))


class _Closers:
    """Whether markup that opens at some place closes; places are asked about in order."""

    def __init__(self, text: str):
        self.text, self.missing = text, set()

    def closes(self, at: int) -> bool:
        for opening, closing in _OPENED:
            if self.text.startswith(opening, at):
                if closing not in self.missing and self.text.find(closing, at + 2) < 0:
                    self.missing.add(closing)
                return closing not in self.missing
        return True


def inline(lines: list[Line]) -> Inline:
    src = _Source(lines)
    text, out, i = src.text, Inline(end=src.end), 0
    closers, parens = _Closers(text), _Parens(text) if "](" in text else None
    brackets: list[tuple[int, bool]] = []
    runs = {}
    for m in re.finditer("`+", text):
        runs.setdefault(len(m[0]), []).append(m.start())
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text) and text[i + 1] in _PUNCTUATION:
            i += 2
        elif ch == "`":
            size = len(re.compile("`+").match(text, i)[0])
            alike = runs.get(size, ())
            k = bisect_left(alike, i + size)
            i = alike[k] + size if k < len(alike) else i + size
        elif ch == "<" and (m := _AUTOLINK.match(text, i)):
            out.urls.append((m[1], False))
            i = m.end()
        elif ch == "<" and closers.closes(i) and (m := _INLINE_MARKUP.match(text, i)):
            out.markup.append((src.offset(i), m[0]))
            i = m.end()
        elif ch == "!" and text[i + 1 : i + 2] == "[":
            brackets.append((i, True))
            i += 2
        elif ch == "[":
            brackets.append((i, False))
            i += 1
        elif ch == "]":
            i = _link_end(text, i, brackets, out, parens)
        elif ch in "hHwW" and (i == 0 or text[i - 1] in " \t\n*_~(") and (m := _BARE.match(text, i)):
            url = _trimmed(m[0])
            out.urls.append((url if "://" in url[:8] else f"http://{url}", False))
            i += len(url)
        else:
            i += 1
    return out


def _trimmed(url: str) -> str:
    """A bare URL without the punctuation that ends the sentence around it."""
    end, spare = len(url), url.count(")") - url.count("(")
    while end:
        if url[end - 1] in "?!.,:*_~'\"":
            end -= 1
        elif url[end - 1] == ")" and spare > 0:
            end, spare = end - 1, spare - 1
        elif url[end - 1] == ";" and (m := _REFERENCE.fullmatch(url, max(0, url.rfind("&", 0, end)), end)):
            end = m.start()
        else:
            break
    return url[:end]


_REFERENCE = re.compile("&[a-zA-Z0-9]+;")


def _link_end(text: str, i: int, brackets: list, out: Inline, parens: _Parens | None) -> int:
    if not brackets:
        return i + 1
    _, image = brackets.pop()
    if text[i + 1 : i + 2] != "(":
        return i + 1
    found = _destination(text, i + 1, parens)
    if found is None:
        return i + 1
    url, end = found
    out.urls.append((url, image))
    if not image:  # links don't nest
        brackets[:] = [b for b in brackets if b[1]]
    return end


_ANGLED, _BLANKS = re.compile(r"<((?:[^<>\n\\]|\\.)*)>"), re.compile(r"\s*")
_TITLE = re.compile(r"""\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))""", re.S)


def _destination(text: str, paren: int, parens: _Parens) -> tuple[str, int] | None:
    """(url, end) of an inline link whose parenthesis opens at ``paren``."""
    i = _BLANKS.match(text, paren + 1).end()
    if text[i : i + 1] == "<":
        if not (m := _ANGLED.match(text, i)):
            return None
        url, i = m[1], m.end()
    else:
        end = parens.url_end(paren, i)
        if end is None:
            return None
        url, i = text[i:end], end
    if m := _TITLE.match(text, i):
        i = m.end()
    i = _BLANKS.match(text, i).end()
    return (_plain(url), i + 1) if text[i : i + 1] == ")" else None


def scan(text: str) -> H.Scan:
    """What to cut and what to report in markdown that holds markup."""
    doc, out = read(text), H.Scan()
    for a, z in doc.html:
        out.take(H.scan_fragment(text[a:z]), a)
    for lines in doc.phrases:
        _balance(inline(lines), out)
    return out


def _balance(phrase: Inline, out: H.Scan) -> None:
    """Hidden elements of a phrase, from the opening tag to its match or the phrase's end."""
    tag, depth, start = "", 0, 0
    for at, piece in phrase.markup:
        closing = re.match(r"</([a-zA-Z][a-zA-Z0-9:._-]*)\s*>", piece)
        node = None if piece.startswith("</") else H.first_element(piece)
        if depth:
            if closing and closing[1].lower() == tag:
                depth -= 1
                if not depth:
                    out.ranges.append((start, at + len(piece), "hidden"))
            elif node and node.tag == tag:
                depth += 1
            continue
        out.ranges += [(at + a, at + z, "comment") for a, z in H.comment_spans(piece)]
        if node is None:
            continue
        if not H.is_hidden(node):
            out.count(node)
        elif node.tag in H.VOID:
            out.ranges.append((at, at + len(piece), "hidden"))
        else:
            tag, depth, start = node.tag, 1, at
    if depth:
        out.ranges.append((start, phrase.end, "hidden"))


def links(text: str) -> list[tuple[str, bool]]:
    """(url, is image) of the links, images and definitions."""
    doc = read(text)
    return [u for lines in doc.phrases for u in inline(lines).urls] + [(u, False) for u in doc.definitions]
