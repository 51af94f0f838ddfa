"""An HTML fragment parser that keeps source offsets.

It knows raw-text and void elements, comments of all kinds, implied end tags, and
foreign content as far as nesting needs them.  Foster parenting and the adoption of
misnested formatting are not modelled: such elements nest as they are written.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

from .css import hidden_style

# Element names with rules of their own
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REPORTED = frozenset("script style object embed iframe svg math".split())
_RAW = frozenset("script style xmp iframe noembed noframes".split())
_ESCAPABLE_RAW = frozenset("textarea title".split())
_IGNORED = frozenset("html head body frameset frame".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "listing main menu nav ol p plaintext pre search section summary table ul xmp li dd dt".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an opening tag closes the nearest of these, unless one of the walls stands between
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "a": ({"a"}, {"table", "template"}),
    "button": ({"button"}, {"template"}),
}
_WALLS = frozenset(
    "address applet article aside blockquote button caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup li main marquee menu nav object ol p pre section summary table tbody td template tfoot th thead tr ul".split()
)
_P_SCOPE = frozenset("applet caption table td th marquee object template button".split())
_BREAKOUT = frozenset(
    "b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup "
    "table tt u ul var".split()
)
_HTML_POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_COMMENT_END = re.compile(r"--!?>")


@dataclass
class Node:
    kind: str  # root, element, comment, text
    start: int
    end: int
    tag: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    closed: bool = False

    def walk(self):
        """This node and those below in order; what a template holds isn't part of the page."""
        todo = [self]
        while todo:
            node = todo.pop()
            skip = yield node
            if not skip and node.tag != "template":
                todo += reversed(node.children)


def _end_of_raw(text: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
    return m.start() if m else len(text)


class _Builder:
    def __init__(self, text: str):
        self.text = text
        self.root = Node("root", 0, len(text))
        self.stack = [self.root]
        self.n_open: Counter = Counter()  # by tag, so that deep stacks aren't searched in vain

    def add_text(self, start: int, end: int) -> None:
        if end > start:
            siblings = self.stack[-1].children
            if siblings and siblings[-1].kind == "text" and siblings[-1].end == start:
                siblings[-1].end = end
            else:
                siblings.append(Node("text", start, end))

    def add_comment(self, start: int, end: int) -> None:
        self.stack[-1].children.append(Node("comment", start, end))

    def shut(self, depth: int, at: int, tag_end: int | None = None) -> None:
        """Elements from ``depth`` on end at ``at``; the first of them with its own end tag if there is one."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.n_open[node.tag] -= 1
            own = tag_end is not None and len(self.stack) == depth
            node.closed = own
            node.end = tag_end if own else (node.children[-1].end if node.children else at)

    def nearest(self, names, walls=frozenset()) -> int | None:
        if not any(self.n_open[name] for name in names):
            return None
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in names:
                return depth
            if tag in walls:
                return None
        return None

    def foreign(self) -> bool:
        if not self.n_open["svg"] and not self.n_open["math"]:
            return False
        for node in reversed(self.stack[1:]):
            if node.tag in ("svg", "math"):
                return True
            if node.tag in _HTML_POINTS:
                return False
        return False

    def open(self, tag: str, attrs: dict[str, str], selfclosing: bool, start: int, end: int) -> bool:
        """Adds an element; whether it stays open."""
        foreign = self.foreign()
        if foreign and tag in _BREAKOUT:
            while self.foreign():
                self.shut(len(self.stack) - 1, start)
            foreign = False
        if not foreign:
            if tag in _IGNORED:
                return False
            if tag in _ENDS_P and (depth := self.nearest({"p"}, _P_SCOPE)):
                self.shut(depth, start)
            if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
                self.shut(len(self.stack) - 1, start)
            if tag in _CLOSES:
                names, walls = _CLOSES[tag]
                while depth := self.nearest(names, walls):
                    self.shut(depth, start)
        node = Node("element", start, end, tag, attrs)
        self.stack[-1].children.append(node)
        if (not foreign and tag in VOID) or (selfclosing and (foreign or tag in ("svg", "math"))):
            node.closed = True
            return False
        self.stack.append(node)
        self.n_open[tag] += 1
        return True

    def close(self, tag: str, start: int, end: int) -> None:
        names = _HEADINGS if tag in _HEADINGS else {tag}
        walls = frozenset() if tag in _WALLS or self.foreign() else _WALLS
        if depth := self.nearest(names, walls):
            self.shut(depth, start, end)


def parse(text: str) -> Node:
    """The fragment's tree; every node has its source offsets."""
    b, at, n = _Builder(text), 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            b.add_text(at, n)
            break
        b.add_text(at, lt)
        at = _markup(b, lt)
    b.shut(1, n)
    return b.root


def _bogus_end(text: str, at: int) -> int:
    gt = text.find(">", at)
    return len(text) if gt < 0 else gt + 1


def _markup(b: _Builder, lt: int) -> int:
    """Reads what starts with the ``<`` at ``lt``; where to go on."""
    text = b.text
    if text.startswith("<!--", lt):
        if m := re.compile(r"-?>").match(text, lt + 4):
            end = m.end()
        else:
            m = _COMMENT_END.search(text, lt + 4)
            end = m.end() if m else len(text)
        b.add_comment(lt, end)
        return end
    if text.startswith("<!", lt):
        if text[lt + 2 : lt + 9].lower() == "doctype":
            return _bogus_end(text, lt)
        if text.startswith("[CDATA[", lt + 2) and b.foreign():
            end = text.find("]]>", lt)
            end = len(text) if end < 0 else end + 3
            b.add_text(lt, end)
            return end
        b.add_comment(lt, end := _bogus_end(text, lt))
        return end
    if text.startswith("<?", lt):
        b.add_comment(lt, end := _bogus_end(text, lt))
        return end
    closing = text.startswith("</", lt)
    name = _TAG_NAME.match(text, lt + 1 + closing)
    if not name:
        if closing and lt + 2 < len(text):
            end = _bogus_end(text, lt)
            if end != lt + 3 or text[lt + 2] != ">":
                b.add_comment(lt, end)
            return end
        b.add_text(lt, lt + 1)
        return lt + 1
    attrs, end, selfclosing = _attributes(text, name.end())
    if end is None:  # the text ends inside the tag
        return len(text)
    tag = name[0].lower()
    if closing:
        b.close(tag, lt, end)
        return end
    foreign = b.foreign()
    stays = b.open(tag, attrs, selfclosing, lt, end)
    if stays and not foreign and tag in _RAW | _ESCAPABLE_RAW:
        stop = _end_of_raw(text, end, tag)
        b.add_text(end, stop)
        return stop
    if stays and tag == "plaintext":
        b.add_text(end, len(text))
        return len(text)
    return end


def _attributes(text: str, at: int) -> tuple[dict[str, str], int | None, bool]:
    attrs: dict[str, str] = {}
    while True:
        rest = re.compile(r"[\s/]*").match(text, at)
        if rest.end() >= len(text):
            return attrs, None, False
        if text[rest.end()] == ">":
            return attrs, rest.end() + 1, text[rest.end() - 1] == "/" and rest.end() > at
        m = _ATTRIBUTE.match(text, at)
        if not m or m.end() == at:
            return attrs, None, False
        value = next((v for v in m.groups()[1:] if v is not None), "")
        if m.end() < len(text) and m[2] is m[3] is None and m[4] is not None and m[4][:1] in ("'", '"'):
            return attrs, None, False  # a quote that never closes
        attrs.setdefault(m[1].lower(), entities.unescape(value))
        at = m.end()


def is_hidden(node: Node) -> bool:
    if node.kind != "element":
        return False
    attrs = node.attrs
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true":
        return True
    return bool(attrs.get("style")) and hidden_style(attrs["style"])


def has_data_source(node: Node) -> bool:
    return node.attrs.get("src", "").startswith("data:")


def first_element(text: str) -> Node | None:
    return next((n for n in parse(text).walk() if n.kind == "element"), None)


@dataclass
class Scan:
    """Ranges to cut (start, end, comment or hidden), and what is kept but reported."""

    ranges: list[tuple[int, int, str]] = field(default_factory=list)
    tags: Counter = field(default_factory=Counter)
    data_sources: int = 0

    def count(self, node: Node) -> None:
        if node.tag in REPORTED:
            self.tags[node.tag] += 1
        self.data_sources += has_data_source(node)

    def take(self, other: Scan, shift: int) -> None:
        self.ranges += [(a + shift, z + shift, kind) for a, z, kind in other.ranges]
        self.tags.update(other.tags)
        self.data_sources += other.data_sources


def scan_fragment(text: str) -> Scan:
    """Comments and hidden elements of a fragment, whole; what is below them is theirs."""
    out = Scan()
    walk = parse(text).walk()
    node = next(walk)
    try:
        while True:
            cut = node.kind == "comment" or is_hidden(node)
            if cut:
                out.ranges.append((node.start, node.end, "comment" if node.kind == "comment" else "hidden"))
            elif node.kind == "element":
                out.count(node)
            node = walk.send(cut)
    except StopIteration:
        return out


def comment_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the comments, proper and bogus, in one inline piece of markup."""
    out, at = [], 0
    while m := re.compile("<[!?]").search(text, at):
        at = m.start()
        if text.startswith("<!--", at):
            end = text.find("-->", at + 2)
            out.append((at, len(text) if end < 0 else end + 3))
            at = out[-1][1]
            continue
        first = next(iter(parse(text[at:]).children), None)
        if first is not None and first.kind == "comment":
            out.append((at, at + first.end))
            at = out[-1][1]
        else:
            at = m.end() - 1
    return out


def attribute_urls(text: str) -> list[tuple[str, bool, str]]:
    """(url, is image, resource | form | refresh) of every attribute that names one."""
    out = []
    for node in parse(text).walk():
        if node.kind != "element":
            continue
        a, image = node.attrs, node.tag == "img"
        out += [(a[k], image, "resource") for k in ("src", "href", "background") if k in a]
        several = a.get("srcset", "").split(",") + a.get("ping", "").split()
        out += [(c.split()[0], image, "resource") for c in several if c.strip()]
        out += [(a[k], False, "form") for k in ("action", "formaction") if k in a]
        if node.tag == "meta" and "refresh" in a.get("http-equiv", "").lower() and (m := re.search(r"""url\s*=\s*['"]?([^'"\s;]+)""", a.get("content", ""), re.I)):
            out.append((m[1], False, "refresh"))
    return out
