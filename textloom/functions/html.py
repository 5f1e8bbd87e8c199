"""HTML to text with the standard library's parser, as an Arrow UDF: a page is a Python object only while it is parsed."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre"}
#: Elements that end an open element of these names when they start.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
SKIP = {"script", "style", "nav", "header", "footer", "noscript", "template"}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.children = tag, dict(attrs or []), []

    def text(self) -> str:
        out = []
        todo = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in SKIP:
                mark = "\n" if n.tag in BLOCKS else ""
                todo += [mark, *reversed(n.children), mark]
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open, self.count = [self.root], {}

    def _close(self):
        self.count[self.open.pop().tag] -= 1

    def handle_starttag(self, tag, attrs):
        own = ENDS.get(tag, {"p"} if tag in BLOCKS else ())
        while self.open[-1].tag in own or (tag in ENDS and tag != "a" and self.open[-1].tag == "p"):
            self._close()
        n = Node(tag, attrs)
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, attrs))

    def handle_endtag(self, tag):
        if self.count.get(tag):
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _walk(n):
    todo = [c for c in reversed(n.children) if not isinstance(c, str)]
    while todo:
        c = todo.pop()
        yield c
        todo += [x for x in reversed(c.children) if not isinstance(x, str)]


def containers(root: Node, tags=("main", "article")) -> list[Node]:
    """Outermost content containers in order: one nested in another is not taken again."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag in tags:
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def _shown(root: Node) -> set[int]:
    """The ids of nodes that hold text or a picture, told from the leaves up in one pass."""
    nodes = [root, *_walk(root)]  # parents before children
    text, picture = set(), set()
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    text.add(id(n))
            else:
                if id(c) in text and c.tag not in SKIP:
                    text.add(id(n))
                if c.tag == "img" or id(c) in picture:
                    picture.add(id(n))
    return text | picture


def _begin(n: Node, most: int) -> str:
    """The beginning of a node's text without the space around it: no more of it is read than ``most`` letters need."""
    out, size, todo = [], 0, [n]
    while todo and size <= most:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            size += len(n.strip())
        elif n.tag not in SKIP:
            todo += reversed(n.children)
    return "".join(out).strip()


def strip_apparatus(n: Node) -> Node:
    """Drop small print, superscripts, empty anchors, and an h3 'Footnotes' with all that follows it."""
    todo, shown = [n], _shown(n)
    while todo:
        own, kept = todo.pop(), []
        for c in own.children:
            if not isinstance(c, str):
                if c.tag == "sup" or c.tag == "font" and c.attrs.get("size") == "1":
                    continue
                if c.tag == "a" and id(c) not in shown:
                    continue
                if c.tag == "h3" and _begin(c, 20).lower().rstrip(":") == "footnotes":
                    break
                todo.append(c)
            kept.append(c)
        own.children = kept
    return n


def main_text(html: str | None, apparatus: bool = False) -> str:
    """The text of the content containers (else of the body), a line a block."""
    root = parse(html)
    found = containers(root) or [c for c in _walk(root) if c.tag == "body"] or [root]
    text = "\n".join((n if apparatus else strip_apparatus(n)).text() for n in found)
    return "\n".join(x for x in (re.sub(r"[ \t\r\f\v]+", " ", y).strip() for y in text.split("\n")) if x)


@F.arrow_udf(StringType())
def html_main_text(s: pa.Array) -> pa.Array:
    return pa.array((main_text(x.as_py()) for x in s), pa.string())
