"""HTML to Markdown: handlers by tag over the tree, then clean-up of lines, tables and links."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html import unescape
from urllib.parse import urljoin

from . import codelang
from .dom import Node, parse

#: Tags that make blocks, and tags that are left out.
BLOCK = {
    "address", "article", "aside", "base", "basefont", "blockquote", "body", "caption", "center", "col", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "iframe", "legend", "li",
    "link", "main", "menu", "menuitem", "nav", "noframes", "ol", "optgroup", "option", "p", "param", "pre", "script", "search", "section", "style", "summary", "table",
    "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "track", "ul",
}
DROPPED = {
    "footer", "form", "iframe", "button", "input", "select", "textarea", "dialog", "script", "style", "svg", "canvas", "track", "rt", "rp", "noscript", "template", "title", "link", "meta",
}
#: Parts of class, id and label that mark page furniture.
WIDGET_CLASS = (
    "social", "share", "follow", "cookie", "popup", "modal", "overlay", "ad-", "ads-", "advertisement", "copy", "clipboard", "toolbar", "code-actions", "code-header",
    "theme-toggle", "mobile-menu", "hamburger", "menu-toggle", "search-button", "docusaurus", "edit-page", "print-button", "sr-only", "screen-reader-only", "visually-hidden",
    "skip-link", "skip-to-content", "skip-to-main", "skip-nav", "skiplink", "ai-assist", "ai-button", "ask-ai", "footer-chrome", "page-footer", "site-footer", "disclaimer", "legal",
    "page-meta", "document-meta", "keyboard", "shortcut", "hotkey", "keybinding", "key-combo", "kbd-indicator", "assistant", "ai-notice", "ai-indicator", "bot-indicator",
)
WIDGET_ID = ("cookie", "popup", "modal", "overlay", "ad-", "ads-", "toolbar", "actions", "controls")
WIDGET_LABEL = ("copy", "print", "ai", "skip", "jump to")
WIDGET_ROLE = ("button", "menuitem", "tab", "switch")
#: Parts of classes that mark furniture inside table cells.
CELL_CLASS = (
    "copy", "clipboard", "toolbar", "button", "menu", "social", "share", "follow", "cookie", "popup", "modal", "overlay", "ad-", "ads-", "advertisement", "theme-toggle", "hamburger",
    "search-button",
)
#: Kinds of admonitions and what classes mark them.
ADMONITIONS = (
    "note", "tip", "hint", "warning", "caution", "important", "info", "danger", "error", "success", "example", "quote", "abstract", "summary", "tldr", "todo", "bug", "question", "faq",
    "help", "see also", "seealso",
)
ALERTS = ("info", "warning", "danger", "success")
ADMONITION_CLASS = ("admonition", "callout", "alert", "custom-block")
#: Parts of classes of what only the dark theme shows.
DARK_CLASS = ("dark-only", "dark:block", "theme-dark", "only-dark")
#: Zero-width space, non-joiner and joiner, word joiner, byte order mark, soft hyphen, Mongolian vowel separator.
INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x180E))


@dataclass
class Options:
    links: bool = True
    images: bool = True
    tables: bool = True
    base_url: str | None = None
    skip_tags: frozenset[str] = frozenset()
    #: A tag, #id or .class: what is converted is the first such element, or the whole page if there is none.
    selector: str | None = None
    #: Own handlers by tag: (converter, node) to Markdown, or None for the built-in treatment.
    handlers: dict[str, Callable] = field(default_factory=dict)

    @classmethod
    def minimal(cls, **kw) -> Options:
        return cls(images=False, **kw)

    @classmethod
    def text_only(cls, **kw) -> Options:
        return cls(links=False, images=False, tables=False, **kw)


def is_widget(n: Node) -> bool:
    """Whether an element is page furniture, by parts of its attributes; fewer of them count inside table cells."""
    cls, role = n.get("class", "").lower(), n.get("role", "").lower()
    data = [k[5:] for k in n.attrs if k.startswith("data-")]
    clip = any("clipboard" in d or "copy" in d or d in ("action", "command") for d in data)
    if n.has_ancestor("td", "th"):
        return clip or role in WIDGET_ROLE or any(w in cls for w in CELL_CLASS)
    label, ident = n.get("aria-label", "").lower(), n.get("id", "").lower()
    return (
        n.get("aria-hidden", "").strip().lower() == "true" or clip or any("theme" in d for d in data) or any(w in cls for w in WIDGET_CLASS) or any(w in ident for w in WIDGET_ID)
        or any(w in label for w in WIDGET_LABEL) or role in WIDGET_ROLE or "contentinfo" in role or "complementary" in role
    )


def is_theme_variant(n: Node) -> bool:
    cls, style = n.get("class", "").lower(), n.get("style", "").replace(" ", "").lower()
    return n.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or any(w in cls for w in DARK_CLASS) or n.get("data-theme") == "dark"


def squeezed(t: str) -> str:
    """One blank for each run of whitespace."""
    words = " ".join(t.split())
    return f"{' ' * t[0].isspace()}{words}{' ' * t[-1].isspace()}" if words else t and " "


def escape(text: str, line_start: bool) -> str:
    text = re.sub(r"([\\*_`\[\]])", r"\\\1", text)
    text = re.sub(r"<(?=[A-Za-z/!])", r"\\<", text)
    if line_start:
        text = re.sub(r"^(\s*)([=~>]|[-+](?= )|#{1,6}(?= ))", r"\1\\\2", text)
        text = re.sub(r"^(\s*\d+)\.(?= )", r"\1\\.", text)
    return text


def _spaced(before: str, core: str, mark: str) -> str:
    """Marks around the core, with its outer whitespace outside."""
    m = re.fullmatch(r"(\s*)(.*?)(\s*)", core, re.S)
    return f"{m[1]}{mark}{m[2]}{mark}{m[3]}" if m[2] else core


#: Characters that words of Latin letters and digits are made of.
LATIN = re.compile("[0-9A-Za-zÀ-ÿ]")


def raw_text(n: Node) -> str:
    """Text as it stands, without page furniture: blocks begin lines, and a space parts words of neighbouring elements.

    Only Latin words are parted; Chinese, Japanese and Korean characters and punctuation stay close.
    """
    if n.is_text:
        return n.text
    if n.tag[0] == "#" and not n.children or is_widget(n):
        return ""
    out = ""
    for c in n.children:
        part = raw_text(c)
        if part and out:
            if c.tag in BLOCK:
                out += "" if out.endswith("\n") else "\n"
            elif LATIN.match(out[-1]) and LATIN.match(part[0]):
                out += " "
        out += part
    return out


#: Classes, texts and names of the links that headings carry to themselves.
SELF_LINK_CLASS = ("anchor", "permalink", "header-link", "heading-link", "hash-link")
SELF_LINK_TEXT = ("#", "§", "¶", "navigate to header")


def is_self_link(n: Node) -> bool:
    if n.tag != "a":
        return False
    text = " ".join(n.content().translate(INVISIBLE).lower().split())
    return any(w in n.get("class", "").lower() for w in SELF_LINK_CLASS) or n.get("aria-hidden") == "true" or text in SELF_LINK_TEXT or not text and bool(n.content().strip())


class Converter:
    def __init__(self, options: Options | None = None):
        self.o = options or Options()

    # --- walking

    def children(self, n: Node) -> str:
        out = ""
        for c in self._merged(n.children):
            part = self.node(c, out)
            if not part:
                continue
            if part.startswith("\n") and out:
                head = len(out) - len(out.rstrip("\n"))
                lead = len(part) - len(part.lstrip("\n"))
                part = "\n" * max(0, min(2, max(head, lead)) - head) + part.lstrip("\n") if head + lead > 2 else part
                if not part.startswith("\n") and not out.endswith("\n"):
                    part = "\n" + part
            elif out.endswith("\n"):
                part = part.lstrip(" ")
            elif out.endswith(" ") and part.startswith(" "):
                part = part.lstrip(" ")
            out += part
        return out

    def _merged(self, nodes: list[Node]) -> list[Node]:
        """Neighbouring equal emphasis with single texts becomes one element."""
        same = {"i": "em", "b": "strong"}
        out: list[Node] = []
        for n in nodes:
            p = out[-1] if out else None
            if (p is not None and n.tag in ("i", "em", "b", "strong", "s", "del", "mark", "u") and same.get(p.tag, p.tag) == same.get(n.tag, n.tag)
                    and all(len(x.children) == 1 and x.children[0].is_text for x in (p, n))):
                new = Node(p.tag, p.attrs)
                new.parent = p.parent
                new.add(Node("#text", text=p.children[0].text + n.children[0].text))
                out[-1] = new
            else:
                out.append(n)
        return out

    def node(self, n: Node, before: str = "") -> str:
        if n.is_text:
            t = squeezed(n.text if n.text.isascii() else n.text.translate(INVISIBLE))
            start = not before or before.endswith("\n")
            return escape(t.lstrip() if start else t, start)
        if n.tag[0] == "#" or n.tag in self.o.skip_tags:
            return ""
        if n.tag in self.o.handlers and (own := self.o.handlers[n.tag](self, n)) is not None:
            return own
        if n.tag in DROPPED:
            return ""
        if (f := getattr(self, f"on_{n.tag}", None)) is not None:
            return f(n)
        return self.block(n) if n.tag in BLOCK else self.children(n)

    def block(self, n: Node) -> str:
        t = self.children(n).strip("\n").rstrip()
        return f"\n\n{t}\n\n" if t.strip() else ""

    # --- headings and text

    def heading(self, n: Node) -> str:
        inner = Node(n.tag, n.attrs)
        inner.parent = n.parent
        open_ = list(n.children)
        while open_:
            c = open_.pop(0)
            if c.tag == "div" and "heading-wrapper" in c.get("class", "").lower():
                open_ = [*c.children, *open_]
            elif not is_self_link(c):
                inner.children.append(c)
        t = re.sub(r"\s+", " ", self.children(inner)).strip()
        return f"\n\n{'#' * int(n.tag[1])} {t}\n\n" if t else ""

    on_h1 = on_h2 = on_h3 = on_h4 = on_h5 = on_h6 = heading

    def on_a(self, n: Node) -> str:
        cls = n.get("class", "").lower()
        if is_widget(n) or any(w in cls for w in ("headerlink", "permalink", "heading-anchor")):
            return ""
        t = self.children(n)
        if not (href := n.get("href")):
            return t
        if not t.strip():
            return ""
        url = f"<{href}>" if re.search(r"\s", href) else href.replace("(", r"\(").replace(")", r"\)")
        title = f' "{n.get("title").replace(chr(34), chr(92) + chr(34))}"' if n.get("title") else ""
        m = re.fullmatch(r"(\s*)(.*?)(\s*)", t, re.S)
        return f"{m[1]}[{m[2]}]({url}{title}){m[3]}"

    def on_img(self, n: Node) -> str:
        if is_theme_variant(n) or not n.get("src"):
            return ""
        title = f' "{n.get("title")}"' if n.get("title") else ""
        alt, src = re.sub(r"\s+", " ", n.get("alt", "")), n.get("src").replace("(", r"\(").replace(")", r"\)")
        return f"![{alt}]({f'<{src}>' if ' ' in src else src}{title})"

    def on_picture(self, n: Node) -> str:
        img = n.find("img")
        return self.on_img(img) if img is not None else ""

    def _mark(mark: str):  # noqa: N805
        def run(self, n: Node) -> str:
            return _spaced("", self.children(n) or re.sub(r"\s+", " ", n.content()), mark)

        return run

    on_strong = on_b = on_mark = on_dfn = _mark("**")
    on_em = on_i = on_cite = _mark("*")
    on_del = on_s = on_strike = _mark("~~")

    def code(self, n: Node) -> str:
        t = re.sub(r"\s+", " ", raw_text(n)).strip()
        if not t:
            return ""
        if re.search(r"(?<!`)`(?!`)", t):
            return f"`` {t} ``" if t.startswith("`") else f"``{t}``"
        return f"`{t}`"

    on_code = on_kbd = on_samp = on_var = on_output = code

    def on_pre(self, n: Node) -> str:
        code = n.find("code")
        return self.fence(raw_text(code if code is not None else n), [code, n, n.parent])

    def fence(self, text: str, owners: list[Node | None]) -> str:
        text = text.removeprefix("\n").rstrip("\n")
        if not text.strip():
            return ""
        hint = next((h for o in owners if o is not None and (h := codelang.from_class(o.get("class")) or o.get("data-lang") or o.get("data-language"))), None)
        longest = max((len(m) for m in re.findall("`+", text)), default=0)
        mark = "`" * min(10, max(3, longest + 1))
        return f"\n\n{mark}{codelang.language(text, hint) or ''}\n{text}\n{mark}\n\n"

    def on_br(self, n: Node) -> str:
        return "  \n"

    def on_hr(self, n: Node) -> str:
        return "\n\n* * *\n\n"

    def on_blockquote(self, n: Node) -> str:
        t = self.children(n).strip()
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in t.split("\n")) + "\n\n" if t else ""

    # --- lists

    def list_(self, n: Node, depth: int = 0) -> str:
        cls = n.get("class", "").lower()
        if any(w.startswith("nav") or "breadcrumb" in w for w in cls.split()):
            return ""
        start = n.get("start", "1")
        k, lines = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, []
        for li in n.elements():
            if li.tag in ("ul", "ol"):
                lines.append(self.list_(li, depth + 1))
                continue
            if li.tag != "li":
                continue
            inline, inner = Node("span"), []
            for c in li.children:
                if c.tag in ("ul", "ol"):
                    inner.append(self.list_(c, depth + 1))
                elif c.tag in ("pre", "blockquote", "table"):
                    pad = "  " * (depth + 1)
                    inner.append("\n".join(pad + x if x else x for x in self.node(c).strip("\n").split("\n")))
                else:
                    inline.children.append(c)
            inline.parent = li
            text = re.sub(r"\n{2,}", "\n", self.children(inline)).strip()
            mark = f"{k}." if n.tag == "ol" else "-"
            k += 1
            rows = text.split("\n") if text else []
            if rows or inner:
                lines.append("\n".join(["  " * depth + f"{mark} {rows[0] if rows else ''}".rstrip(), *("  " * (depth + 1) + r.strip() for r in rows[1:])]))
            lines += [x for x in inner if x.strip()]
        return "\n".join(x for x in lines if x)

    def on_ul(self, n: Node) -> str:
        t = self.list_(n)
        return f"\n\n{t}\n\n" if t else ""

    on_ol = on_ul

    def on_li(self, n: Node) -> str:
        t = self.children(n).strip()
        return f"\n*   {t}\n" if t else ""

    # --- tables

    def on_table(self, n: Node) -> str:
        if not self.o.tables:
            return "\n\n" + "\n".join(" ".join(re.sub(r"\s+", " ", self.children(c)).strip() for c in r.elements()) for r in n.walk() if r.tag == "tr") + "\n\n"
        rows, caption = [], None
        for r in n.walk():
            if r.tag == "caption" and caption is None:
                caption = re.sub(r"\s+", " ", self.children(r)).strip()
            if r.tag == "tr":
                cells = [c for c in r.elements() if c.tag in ("td", "th")]
                rows.append(([self._cell(c) for c in cells], bool(cells) and all(c.tag == "th" for c in cells)))
        rows = [r for r in rows if r[0]]
        if not rows:
            return ""
        at = next((i for i, r in enumerate(rows) if r[1]), 0)
        head = rows.pop(at)[0]
        width = max(len(head), *(len(r[0]) for r in rows)) if rows else len(head)
        grid = [x + [""] * (width - len(x)) for x in [head, *(r[0] for r in rows)]]
        size = [max(3, *(len(r[i]) for r in grid)) for i in range(width)]
        line = lambda r: "| " + " | ".join(c.ljust(s) for c, s in zip(r, size, strict=True)) + " |"
        body = [line(grid[0]), "| " + " | ".join("-" * s for s in size) + " |", *map(line, grid[1:])]
        return "\n\n" + (f"{caption}\n\n" if caption else "") + "\n".join(body) + "\n\n"

    def _cell(self, c: Node) -> str:
        t = re.sub(r"\s+", " ", self.children(c)).strip()
        if not t and c.tag == "th":
            t = c.get("aria-label") or c.get("data-label") or c.get("title") or ""
        return t.replace("|", "&#124;")

    # --- containers

    def container(self, n: Node) -> str:
        if is_widget(n):
            return ""
        if "expressive-code" in n.get("class", "") and (pre := n.find("pre")) is not None:
            code = pre.find("code")
            lines = [x.content(()).rstrip("\n") for x in pre.walk() if "ec-line" in x.get("class", "").split()]
            return self.fence("\n".join(lines) if lines else pre.content(()), [code, pre, n])
        return self.admonition(n) or self.block(n)

    on_div = on_section = on_aside = container

    def admonition(self, n: Node) -> str:
        """A quote with its kind: by class, else by a short label in front, which then goes; the rest is taken as it stands."""
        cls = n.get("class", "").lower()
        tokens, marked, skip = cls.split(), any(w in cls for w in ADMONITION_CLASS), None
        kind = None
        if marked:
            named = [m[1] for w in tokens if (m := re.match("(?:admonition|callout|alert|markdown-alert)-(.*)", w))]
            kind = next((w for w in [*named, *tokens[1:2]] if w in ADMONITIONS), None) or next((w for w in ALERTS if f"alert-{w}" in cls), None)
        first = next(iter(n.elements()), None)
        label = raw_text(first).strip() if first is not None else ""
        if kind is None and 0 < len(label.encode()) <= 30 and label.lower() in ADMONITIONS:
            kind, skip = label.lower(), first
        if kind is None and not marked:
            return ""
        t = ("".join(raw_text(c) for c in n.children if c is not skip) if skip is not None else self.children(n)).strip()
        if not t:
            return ""
        kind = kind or "note"
        lines = t.split("\n")
        return "\n\n" + "\n".join([f"> **{kind[0].upper()}{kind[1:]}:** {lines[0]}", *(f"> {x}" if x.strip() else "> " for x in lines[1:])]).rstrip() + "\n\n"

    def on_nav(self, n: Node) -> str:
        h, links = n.find("h1"), [c for c in n.elements() if c.tag == "a"]
        out = [self.heading(h)] if h is not None else []
        if len(links) > 1:
            out.append("\n\n" + "\n".join(x for a in links if (x := self.on_a(a))) + "\n\n")
        return "".join(out)

    def on_header(self, n: Node) -> str:
        h = n.find("h1")
        return self.heading(h) if h is not None else ""

    def on_span(self, n: Node) -> str:
        cls, style = n.get("class", "").lower(), n.get("style", "").replace(" ", "").lower()
        if "katex" in cls or "math" in cls.split():
            tex = next((x for x in n.walk() if x.tag == "annotation"), None)
            t = (tex if tex is not None else n).content().strip()
            return f"$${t}$$" if "display" in cls else f"${t}$"
        if is_widget(n):
            return ""
        mark = ("**" if re.search(r"font-weight:(bold|[6-9]00)", style) else "") + ("*" if "font-style:italic" in style else "")
        return _spaced("", self.children(n), mark) if mark else self.children(n)

    def on_dl(self, n: Node) -> str:
        rows = []
        for c in n.walk():
            if c.tag == "dt":
                rows.append(("\n" if rows else "") + re.sub(r"\s+", " ", self.children(c)).strip())
            elif c.tag == "dd":
                rows.append(": " + re.sub(r"\s*\n\s*", " ", self.children(c)).strip())
        return "\n\n" + "\n".join(rows) + "\n\n" if rows else ""

    def on_summary(self, n: Node) -> str:
        t = re.sub(r"\s+", " ", self.children(n)).strip()
        return "" if not t else f"\n\n### {t}\n\n" if n.parent is not None and n.parent.tag == "details" else f"\n\n**{t}**\n\n"

    def on_figcaption(self, n: Node) -> str:
        t = re.sub(r"\s+", " ", self.children(n)).strip()
        return f"\n\n*{t}*\n\n" if t else ""

    def _source(self, n: Node) -> str | None:
        s = n.find("source")
        return n.get("src") or (s.get("src") if s is not None else None)

    def on_video(self, n: Node) -> str:
        src = n.get("poster") or self._source(n)
        return f"\n\n![Video]({src})\n\n" if src else ""

    def on_audio(self, n: Node) -> str:
        src = self._source(n)
        return f"\n\n[Audio]({src})\n\n" if src else ""

    def on_source(self, n: Node) -> str:
        return ""

    def on_abbr(self, n: Node) -> str:
        t = self.children(n)
        return f"{t} ({n.get('title')})" if n.get("title") else t

    def on_time(self, n: Node) -> str:
        return self.children(n) or n.get("datetime", "")

    def on_ruby(self, n: Node) -> str:
        notes = "".join(x.content() for x in n.walk() if x.tag == "rt").strip()
        base = self.children(n).strip()
        return f"{base}({notes})" if notes else base

    def on_sub(self, n: Node) -> str:
        return f"<sub>{self.children(n)}</sub>"

    def on_sup(self, n: Node) -> str:
        return f"<sup>{self.children(n)}</sup>"

    def convert(self, root: Node) -> str:
        return self.children(root).strip("\n")


# --- clean-up ----------------------------------------------------------------------------------------------------

FENCE = re.compile(r"^\s*(```|~~~)")


def line_kind(line: str) -> str:
    t = line.strip()
    if not t:
        return "blank"
    if t.startswith("<!--"):
        return "comment"
    if FENCE.match(t):
        return "fence"
    if re.match(r"#{1,6}( |$)", t):
        return "heading"
    if t[0] == ">":
        return "quote"
    if t[0] == "|" and t[-1] == "|":
        return "table"
    if len(t) >= 3 and t[0] in "-*_" and t.count(t[0]) >= 3 and not t.strip(t[0] + " "):
        return "rule"
    if all(w in ("*", "-", "+") for w in t.split()):
        return "marker"
    if re.match(r"[-*+] ", t):
        return "bullet"
    return "number" if re.match(r"\d+[.)] ", t) else "text"


def normalize_lines(md: str) -> str:
    """At most two blank lines in a row, one before headings, fences and rules; no comments, bare markers or section links."""
    out: list[str] = []
    before, blanks, fence, after_heading = "blank", 0, False, False
    for line in md.splitlines():
        if fence:
            fence = not FENCE.match(line)
            out.append(line)
            continue
        kind = line_kind(line)
        fence = kind == "fence"
        if kind in ("comment", "marker"):
            continue
        if kind == "blank":
            blanks += 1
            if blanks <= 2:
                out.append(line)
            before = kind
            continue
        if after_heading and before == "blank" and kind == "text" and re.fullmatch(r'\[Section titled "[^"]*"\]\(#.*\)', line.strip()):
            after_heading = False
            continue
        if kind in ("heading", "fence", "rule") and before != "blank":
            out.append("")
        out.append(line)
        after_heading, blanks, before = kind == "heading", 0, kind
    return "\n".join(out)


def is_separator_row(row: str) -> bool:
    return all(re.fullmatch(r":?-*:?", c.strip()) for c in row.strip().strip("|").split("|"))


def format_tables(md: str) -> str:
    """Rows as wide as the header, whose separator is made anew. Empty cells vanish before counting."""
    out, rows = [], []

    def is_row(x):
        t = x.strip()
        return t.endswith("|") and t.count("|") >= 2

    def flush():
        if not rows:
            return
        cells = [[c.strip() for c in r.split("|") if c.strip()] for r in rows if not is_separator_row(r)]
        if cells:
            counts = [len(c) for c in cells[1:]]
            width = len(cells[0]) or (max(set(counts), key=lambda k: (counts.count(k), k)) if counts else 1)
            for i, c in enumerate(cells):
                out.append("| " + " | ".join((c + [""] * width)[:width]) + " |")
                if i == 0:
                    out.append("|" + "---|" * width)
        rows.clear()

    for line in md.split("\n"):
        if is_row(line):
            rows.append(line)
        else:
            flush()
            out.append(line)
    flush()
    return "\n".join(out)


LINK = re.compile(r"(?<!!)\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\(((?:[^()\\\s]|\\.)*)((?:\s+\"[^\"]*\")?)\)")
IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")


def absolutize(md: str, base: str) -> str:
    """Relative link targets joined to the page's URL; fragments, other schemes and absolute ones stay."""

    def one(m):
        ref = m[2]
        if not ref or ref.startswith(("#", "<")) or re.match(r"(?i)(https?|mailto|tel|javascript|data):", ref):
            return m[0]
        try:
            return f"[{m[1]}]({urljoin(base, ref)}{m[3]})"
        except ValueError:
            return m[0]

    return LINK.sub(one, md)


def selected(root: Node, selector: str | None) -> Node | None:
    """The first element that a tag, #id or .class names, in a root of its own."""
    if not selector:
        return None
    name = selector[1:]
    fits = {"#": lambda n: n.get("id") == name, ".": lambda n: name in n.get("class", "").split()}.get(selector[0], lambda n: n.tag == selector.lower())
    found = next((n for n in root.walk() if fits(n)), None)
    if found is None:
        return None
    own = Node(root.tag)
    own.children = [found]
    return own


def html_to_markdown(html: str | None, options: Options | None = None) -> str:
    o = options or Options()
    root = parse(html)
    md = normalize_lines(Converter(o).convert(selected(root, o.selector) or root))
    if o.tables:
        md = format_tables(md)
    if not o.links:
        md = LINK.sub(lambda m: m[1] if m[1].strip() else m[2], md)
    if not o.images:
        md = IMAGE.sub("", md)
    return absolutize(md, o.base_url) if o.base_url else md


def bare_markdown(html: str | None) -> str:
    """What is left if a page can't be converted: its text without scripts, styles and tags, block by block."""
    t = re.sub(r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", " ", html or "")
    t = re.sub(rf"(?i)</?(?:{'|'.join(sorted(BLOCK))}|br)\b[^>]*>", "\n\n", t)
    t = unescape(re.sub(r"<[^>]*>", "", t))
    return "\n\n".join(escape(" ".join(x.split()), True) for x in t.split("\n\n") if x.strip())
