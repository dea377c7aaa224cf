"""A small HTML tree on the standard library's tokenizer, with the usual repairs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

#: Sets of tags as the HTML standard has them: void elements, implied ends, scopes, formatting.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag on the left closes an open one on the right, up to the nearest boundary.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"},
}
BOUNDARY = {"ul", "ol", "table", "dl", "select", "div", "article", "section", "body", "html", "blockquote", "td", "th", "ruby"}
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
INLINE = {"a", "abbr", "b", "cite", "code", "del", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "u", "var"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text, self.children, self.parent = tag, attrs or {}, text, [], None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    @property
    def is_text(self) -> bool:
        return self.tag == "#text"

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag[0] != "#"]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; without recursion, so that depth is no limit."""
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            if n.tag[0] != "#":
                yield n
                todo.extend(reversed(n.children))

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def content(self, skip: tuple[str, ...] = ("script", "style")) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            n = todo.pop()
            if n.is_text:
                out.append(n.text)
            elif n.tag not in skip:
                todo.extend(reversed(n.children))
        return "".join(out)

    def has_ancestor(self, *tags: str) -> bool:
        n = self.parent
        while n is not None:
            if n.tag in tags:
                return True
            n = n.parent
        return False


class _Builder(HTMLParser):
    #: Elements nested deeper than any page needs are siblings from there on, so that handlers may recurse.
    DEPTH = 120

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and any(n.tag == "p" for n in self.stack):
            self._close("p", {"table", "td", "th", "button"})
        if tag in CLOSES:
            for k in range(len(self.stack) - 1, 0, -1):
                t = self.stack[k].tag
                if t in CLOSES[tag]:
                    del self.stack[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif t in BOUNDARY:
                    break
        if tag == "a" and any(n.tag == "a" for n in self.stack):
            self._close("a", BOUNDARY)
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        node = self.stack[-1].add(Node(tag, seen))
        if tag not in VOID and len(self.stack) < self.DEPTH:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def _close(self, tag, stop=()):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in stop:
                return

    def handle_endtag(self, tag):
        if tag == "br":
            self.stack[-1].add(Node("br"))
        elif tag not in VOID:
            self._close(tag, () if tag not in INLINE else BOUNDARY)

    def handle_data(self, data):
        last = self.stack[-1].children
        if last and last[-1].is_text:
            last[-1].text += data
        else:
            self.stack[-1].add(Node("#text", text=data))

    def handle_comment(self, data):
        self.stack[-1].add(Node("#comment", text=data))


def parse(html: str | None) -> Node:
    """The tree of a page; whatever its state, there is one. Scripts and styles hold their text raw."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
