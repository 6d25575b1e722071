"""Node selection inside one page: the per-row helper behind the extraction jobs.

Spark partitions the pages and hands them over in Arrow batches; this module parses a page
once and answers all selectors asked of it. Selector lists are compiled once per process.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

# Fixed lists from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
BARRIER = frozenset("table ul ol dl select html body div article section nav".split())

# Implicit roles of plain elements.
ROLES = {
    "heading": "h1,h2,h3,h4,h5,h6", "link": "a[href]", "listitem": "li", "list": "ul,ol",
    "navigation": "nav", "contentinfo": "footer", "banner": "header", "main": "main",
    "article": "article", "button": "button", "img": "img", "table": "table", "row": "tr", "cell": "td",
}


class Node:
    __slots__ = ("tag", "raw", "parent", "children", "start", "end", "_attrs")

    def __init__(self, tag, raw, parent, start):
        self.tag, self.raw, self.parent, self.start = tag, raw, parent, start
        self.children: list = []
        self.end = self._attrs = None

    @property
    def attrs(self) -> dict[str, str]:
        """Parsed on first use: most nodes are never asked."""
        if self._attrs is None:
            found: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(self.raw):
                value = m[2] or m[3] or m[4] or ""
                found.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
            self._attrs = found
        return self._attrs

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack.extend(reversed(item.children))
        return "".join(out)

    def elements(self):
        return [c for c in self.children if not isinstance(c, str)]


# Quotes only open a value after an equals sign; nothing here backtracks.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]++|=)*+)>|<[!?][^>]*+>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "iframe", "title", "textarea")}
_DECODED = ("title", "textarea")


class Page:
    """Tree of one page; ``nodes`` is in document order and carries source offsets."""

    __slots__ = ("root", "nodes")

    def __init__(self, html: str):
        self.root = Node("", "", None, 0)
        self.nodes: list[Node] = []
        stack, at, search, size = [self.root], 0, _TOKEN.search, len(html)
        while at < size:
            m = search(html, at)
            data = html[at : m.start() if m else size]
            if data:
                stack[-1].children.append(unescape(data) if "&" in data else data)
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                _close(stack, tag, m.start(), at)
                continue
            _close_implied(stack, tag, m.start())
            node = Node(tag, m[3], stack[-1], m.start())
            stack[-1].children.append(node)
            self.nodes.append(node)
            if tag in VOID:
                node.end = at
            elif tag in _RAW_END:
                at = _raw_text(node, html, at)
            else:
                stack.append(node)
        for node in stack:
            node.end = size

    def close(self) -> None:
        """Take the tree apart: parents and children hold each other, so else it stays until the collector comes by."""
        for node in (self.root, *self.nodes):
            node.parent = None
            node.children.clear()
        self.nodes.clear()


def _close(stack: list[Node], tag: str, start: int, end: int) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            for inner in stack[i + 1 :]:
                inner.end = start
            stack[i].end = end
            del stack[i:]
            return


def _close_implied(stack: list[Node], tag: str, start: int) -> None:
    closed, closes_p = CLOSES.get(tag, ()), tag in CLOSES_P
    if not closed and not closes_p:
        return
    for i in range(len(stack) - 1, 0, -1):
        open_tag = stack[i].tag
        if open_tag in closed or (closes_p and open_tag == "p"):
            for inner in stack[i:]:
                inner.end = start
            del stack[i:]
        elif open_tag in BARRIER:
            return


def _raw_text(node: Node, html: str, at: int) -> int:
    """Content without markup, up to the element's end tag or the end of the page."""
    stop = _RAW_END[node.tag].search(html, at)
    data = html[at : stop.start() if stop else len(html)]
    if data:
        node.children.append(unescape(data) if node.tag in _DECODED else data)
    node.end = stop.end() if stop else len(html)
    return node.end


_PART = re.compile(
    r"""(?P<comb>\s*[>+~]\s*|\s+)|(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""",
    re.X,
)


class UnsupportedSelector(ValueError):
    pass


def _split_commas(text: str) -> list[str]:
    depth, quote, start, out = 0, "", 0, []
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in out + [text[start:]]]


@lru_cache(maxsize=4096)
def compile_css(selector: str):
    """Comma list -> [(compound, combinator to its left), ...] per alternative."""
    alternatives = []
    for text in _split_commas(selector):
        steps, tests, comb, at = [], [], " ", 0
        if not text:
            raise UnsupportedSelector(selector)
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise UnsupportedSelector(selector)
            at = m.end()
            if m["comb"] is not None:
                steps.append((tests, comb))
                tests, comb = [], m["comb"].strip() or " "
            else:
                tests.append(_simple_test(m, selector))
        if not tests:
            raise UnsupportedSelector(selector)
        alternatives.append(steps + [(tests, comb)])
    return alternatives


def _simple_test(m, selector):
    if m["tag"]:
        tag = m["tag"].lower()
        return (lambda n: True) if tag == "*" else (lambda n: n.tag == tag)
    if m["id"]:
        return lambda n, v=m["id"]: n.attrs.get("id") == v
    if m["cls"]:
        return lambda n, v=m["cls"]: v in n.attrs.get("class", "").split()
    if m["attr"]:
        name, op = m["attr"].lower(), m["op"]
        if op is None:
            return lambda n: name in n.attrs
        val = m["val"]
        val = val[1:-1] if val[0] in "\"'" else val
        ops = {
            "=": lambda a: a == val, "*=": lambda a: bool(val) and val in a,
            "^=": lambda a: bool(val) and a.startswith(val), "$=": lambda a: bool(val) and a.endswith(val),
            "~=": lambda a: val in a.split(), "|=": lambda a: a == val or a.startswith(val + "-"),
        }
        return lambda n, test=ops[op]: name in n.attrs and test(n.attrs[name])
    pseudo, arg = m["pseudo"], m["arg"]
    if pseudo in ("has", "not") and arg:
        inner = compile_css(arg.strip())
        if pseudo == "not":
            return lambda n: not _matches_any(n, inner)
        return lambda n: any(_matches_any(d, inner) for d in descendants(n))
    if pseudo == "nth-of-type" and arg and arg.strip().isdigit():
        k = int(arg)

        def nth(n):
            same = [c for c in n.parent.elements() if c.tag == n.tag]
            return len(same) >= k and same[k - 1] is n

        return nth
    if pseudo in ("first-child", "last-child"):
        return lambda n, i=0 if pseudo[0] == "f" else -1: n.parent.elements()[i] is n
    raise UnsupportedSelector(selector)


def descendants(node):
    stack = list(reversed(node.elements()))
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n.elements()))


def _matches_any(node, alternatives) -> bool:
    return any(_matches(node, steps, len(steps) - 1) for steps in alternatives)


def _matches(node, steps, i) -> bool:
    tests, comb = steps[i]
    if node.parent is None or not all(t(node) for t in tests):
        return False
    if i == 0:
        return True
    if comb == ">":
        return _matches(node.parent, steps, i - 1)
    if comb == " ":
        up = node.parent
        while up is not None:
            if _matches(up, steps, i - 1):
                return True
            up = up.parent
        return False
    before = node.parent.elements()
    before = before[: next(k for k, c in enumerate(before) if c is node)]
    if comb == "+":
        before = before[-1:]
    return any(_matches(b, steps, i - 1) for b in before)


_XPATH = re.compile(r"""^//([\w*]+)(?:\[@([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')\])?$""")


@lru_cache(maxsize=4096)
def compile_selector(selector: str, strategy: str):
    """A node predicate for any strategy; a ``text=``, ``xpath=`` or ``css=`` prefix wins over it."""
    for prefix in ("text", "xpath", "css"):
        if selector.startswith(prefix + "="):
            selector, strategy = selector[len(prefix) + 1 :], prefix
            break
    if strategy == "role":
        role = selector.strip().lower()
        implicit = compile_css(ROLES[role]) if role in ROLES else None

        def by_role(n):
            own = n.attrs.get("role")
            return own == role if own else bool(implicit) and _matches_any(n, implicit)

        return by_role
    if strategy == "aria":
        label = selector.lower()
        return lambda n: label in n.attrs.get("aria-label", "").lower() if label else False
    if strategy == "test_id":
        return lambda n: n.attrs.get("data-testid") == selector
    if strategy == "text":
        return _text_test(selector)
    if strategy == "xpath":
        m = _XPATH.match(selector.strip())
        if not m:
            raise UnsupportedSelector(selector)
        tag, attr, val = m[1].lower(), m[2], m[3] if m[3] is not None else m[4]
        return lambda n: (tag == "*" or n.tag == tag) and (attr is None or n.attrs.get(attr.lower()) == val)
    alternatives = compile_css(selector.strip())
    return lambda n: _matches_any(n, alternatives)


def _text_test(wanted: str):
    exact = len(wanted) > 1 and wanted[0] == wanted[-1] and wanted[0] in "\"'"
    needle = " ".join((wanted[1:-1] if exact else wanted.lower()).split())

    def holds(n):
        text = " ".join(n.text().split())
        return text == needle if exact else needle in text.lower()

    # The smallest element that holds the text: none of its children holds it.
    skip = {"script", "style", "noscript", "head", "title"}
    return lambda n: n.tag not in skip and holds(n) and not any(holds(c) for c in n.elements())


def parse(html: str) -> Page:
    return Page(html)


def first(page: Page, selector: str, strategy: str):
    test = compile_selector(selector, strategy)
    return next((n for n in page.nodes if test(n)), None)


def drop_hidden(html: str) -> str:
    """Cut out of the source every subtree that is hidden by attribute or inline style."""
    cuts: list[tuple[int, int]] = []
    page = parse(html)
    for n in page.nodes:
        if _hidden(n) and (not cuts or n.start >= cuts[-1][1]):
            cuts.append((n.start, n.end))
    page.close()
    out, at = [], 0
    for lo, hi in cuts:
        out.append(html[at:lo])
        at = hi
    return "".join(out + [html[at:]])


def _hidden(n: Node) -> bool:
    if "hidden" in n.attrs or n.attrs.get("type", "").lower() == "hidden":
        return True
    style = n.attrs.get("style", "").lower().replace(" ", "")
    # "opacity:0" is a substring test, so 0.5 counts as hidden too.
    return any(s in style for s in ("display:none", "visibility:hidden", "opacity:0"))
