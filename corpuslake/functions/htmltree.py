"""A forgiving HTML tree builder: one pass over the text, implied start and end tags, raw-text elements, void elements, self-closing ones in math and svg."""

from __future__ import annotations

import html
import re

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
FOREIGN = frozenset("math svg".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An opening tag closes these open elements, looked for up to the given scope.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset({"table", "td", "th", "caption", "html", "body", "template", "button", "object"})
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_OPEN = re.compile(r"""<([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<([A-Za-z][^\s/>]*)([^>]*)>?")
_CLOSE = re.compile(r"</([A-Za-z][^\s/>]*)[^>]*>?")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Node:
    """An element; children are nodes and strings, in order; foreign: the math or svg that it is, or is in, else empty."""

    __slots__ = ("tag", "attrs", "children", "parent", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None") -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.foreign = tag if tag in FOREIGN else parent.foreign if parent is not None and parent.tag != "foreignobject" else ""


def attributes(source: str) -> dict[str, str]:
    """Lower-case names; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def build(source: str) -> Node:
    """The tree of a document or fragment; its root is ``#root``."""
    root = Node("#root", {}, None)
    at, n, here = 0, len(source), root
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            here.children.append(_text(source[at:lt]))
        if lt == n:
            break
        at = lt
        mark = source[lt + 1 : lt + 2]
        if mark == "!" or mark == "?":
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif source.startswith("<![CDATA[", lt):
                end = source.find("]]>", lt)
                here.children.append(source[lt + 9 : n if end < 0 else end])
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
        elif mark == "/":
            m = _CLOSE.match(source, lt)
            if m:
                here = _close(here, m[1].lower())
                at = m.end()
            else:
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
        elif mark.isascii() and mark.isalpha():
            m = _OPEN.match(source, lt) or _LOOSE.match(source, lt)
            tag, at = m[1].lower(), m.end()
            here = _open(here, tag)
            node = Node(tag, attributes(m[2]) if m[2].strip(" /\n\t\r") else {}, here)
            here.children.append(node)
            if node.foreign and m[2].endswith("/"):
                continue
            if tag in RAW or tag in RCDATA:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                inner = source[at : end.start() if end else n]
                if inner:
                    node.children.append(_text(inner) if tag in RCDATA else inner)
                close = source.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
            elif tag not in VOID:
                here = node
        else:
            here.children.append("<")
            at = lt + 1
    return root


def _text(s: str) -> str:
    return html.unescape(s) if "&" in s else s


def _open(here: Node, tag: str) -> Node:
    """The node that a new element of this tag goes into, after implied end tags."""
    if tag in IMPLIED_END:
        ends, scope = IMPLIED_END[tag]
        top, x = None, here
        while x.parent is not None and x.tag not in scope:
            if x.tag in ends:
                top = x
            x = x.parent
        if top is not None:
            return top.parent
        return here
    if tag in CLOSES_P:
        x = here
        while x.parent is not None and x.tag not in SCOPE:
            if x.tag == "p":
                here = x.parent
                break
            x = x.parent
        if tag in HEADINGS and here.tag in HEADINGS:
            here = here.parent
    elif tag == "body":
        x = here
        while x.parent is not None:
            if x.tag == "head":
                return x.parent
            x = x.parent
    if here.tag == "head" and tag not in HEAD_ONLY:
        return here.parent
    return here


def _close(here: Node, tag: str) -> Node:
    """The node that is open after an end tag; one that closes nothing is ignored, and no end tag closes a table cell from inside but a table's own."""
    x = here
    while x.parent is not None:
        if x.tag == tag:
            return x.parent
        if x.tag in ("td", "th", "caption") and tag not in ("td", "th", "tr", "caption", "thead", "tbody", "tfoot", "table", "body", "html"):
            return here
        x = x.parent
    return here


def walk(root: Node):
    """All elements in document order, without recursion."""
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if not isinstance(c, str)]


def inner_text(node: Node, skip=lambda x: False) -> str:
    """All text below a node whose ancestors up to it aren't skipped."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not skip(x):
            stack += reversed(x.children)
    return "".join(out)
