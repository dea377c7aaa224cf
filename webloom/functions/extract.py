"""Structured records of pages: metadata, headings, links, resources, security and interactive elements."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import types as T

from .dom import Node, parse

S, A = T.StringType(), T.ArrayType


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"s": S, "i": T.IntegerType(), "b": T.BooleanType(), "m": T.MapType(S, S), "a": A(S), "n": A(T.IntegerType())}[k]) for n, k in (x.split(":") for x in spec.split())])


METADATA = _struct("title:s description:s keywords:a author:s published:s modified:s language:s canonical:s robots:s viewport:s")
HEADING, LINK = _struct("level:i text:s id:s ordinal:n"), _struct("url:s text:s title:s rel:s is_external:b path:s")
SECURITY = _struct("https:b hsts:b csp:s x_frame_options:s permissions_policy:s")
SCRIPT, SHEET, IMAGE, MEDIUM = _struct("url:s type:s async:b defer:b"), _struct("url:s media:s"), _struct("url:s alt:s format:s width:i height:i"), _struct("url:s kind:s format:s")
VALIDATION = _struct("pattern:s min_length:i max_length:i min:s max:s step:s")
ELEMENT = T.StructType([*_struct("tag:s kind:s id:s text:s type:s name:s href:s disabled:b required:b attributes:m handlers:a").fields, T.StructField("validation", VALIDATION)])
PAGE = T.StructType([
    T.StructField("metadata", METADATA), T.StructField("headings", A(HEADING)), T.StructField("links", A(LINK)), T.StructField("security", SECURITY),
    T.StructField("resources", T.StructType([T.StructField("scripts", A(SCRIPT)), T.StructField("stylesheets", A(SHEET)), T.StructField("images", A(IMAGE)), T.StructField("media", A(MEDIUM)), T.StructField("fonts", A(S))])),
    T.StructField("interactive", A(ELEMENT)),
])

#: Tags, event handlers and roles that make an element interactive, and tags that can be clicked.
CONTROLS, HANDLERS = {"button", "input", "select", "textarea"}, {"onclick", "onsubmit", "onchange", "ondblclick"}
CLICKABLE = {"details", "summary", "dialog", "menu"}
ROLES = {
    "button", "checkbox", "radio", "switch", "tab", "slider", "spinbutton", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "link", "searchbox", "textbox",
    "combobox", "gridcell", "treeitem",
}
KINDS = {"button": "button", "a": "link", "input": "input", "select": "input", "textarea": "input"}


def _join(base: str, ref: str) -> str | None:
    try:
        return urljoin(base, ref)
    except ValueError:
        return None


def _text(n: Node) -> str:
    return re.sub(r"\s+", " ", n.content()).strip()


def metadata(root: Node, base: str) -> dict:
    """The last of repeated meta tags wins; og: and article: names stand in where the plain ones are missing."""
    meta: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "meta" and (name := n.get("name") or n.get("property")) and n.get("content") is not None:
            meta[name.lower()] = n.get("content")
    title, doc = root.find("title"), root.find("html")
    canonical = [n for n in root.walk() if n.tag == "link" and "canonical" in (n.get("rel") or "").lower().split()]
    pick = lambda *names: next((meta[k] for k in names if meta.get(k)), None)
    words = [w.strip() for w in (meta.get("keywords") or "").split(",")]
    return {
        "title": _text(title) if title else None, "description": pick("description", "og:description"), "keywords": [w for w in words if w] or None, "author": pick("author", "og:author"),
        "published": pick("article:published_time", "publisheddate"), "modified": pick("article:modified_time", "modifieddate"), "language": doc.get("lang") if doc else None,
        "canonical": _join(base, canonical[0].get("href") or "") if canonical else None, "robots": pick("robots"), "viewport": pick("viewport"),
    }


def ordinals(levels: list[int]) -> list[list[int]]:
    """Counters by heading level; a heading resets the deeper ones, and zeros are left out."""
    count, out = [0] * 7, []
    for k in levels:
        count[k] += 1
        count[k + 1 :] = [0] * (6 - k)
        out.append([c for c in count[1 : k + 1] if c])
    return out


def headings(root: Node) -> list[dict]:
    found = [n for n in root.walk() if re.fullmatch("h[1-6]", n.tag)]
    return [{"level": int(n.tag[1]), "text": _text(n), "id": n.get("id"), "ordinal": o} for n, o in zip(found, ordinals([int(n.tag[1]) for n in found]), strict=True)]


def links(root: Node, base: str) -> list[dict]:
    """http(s) targets of anchors, absolute, the first of each; external by host with port."""
    out, own = {}, urlsplit(base).netloc.lower()
    for n in root.walk():
        if n.tag != "a" or n.get("href") is None:
            continue
        url = _join(base, n.get("href").strip())
        if url and url.split(":")[0].lower() in ("http", "https") and url not in out:
            at = urlsplit(url)
            out[url] = {"url": url, "text": _text(n), "title": n.get("title"), "rel": n.get("rel"), "is_external": at.netloc.lower() != own, "path": at.path or "/"}
    return list(out.values())


def static_links(root: Node, base: str) -> list[str]:
    """Targets worth crawling: no empty, javascript:, mailto:, tel: or fragment-only references."""
    out: dict[str, None] = {}
    for n in root.walk():
        ref = (n.get("href") or "").strip() if n.tag == "a" else ""
        if ref and not ref.lower().startswith(("javascript:", "mailto:", "tel:", "#")) and (url := _join(base, ref)) and url.lower().startswith(("http://", "https://")):
            out[url] = None
    return list(out)


def _number(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"\d{1,9}", x.strip()) else None


def _extension(url: str) -> str | None:
    m = re.search(r"\.([A-Za-z0-9]{1,8})$", urlsplit(url).path)
    return m[1].lower() if m else None


def resources(root: Node, base: str) -> dict:
    out: dict[str, list] = {"scripts": [], "stylesheets": [], "images": [], "media": [], "fonts": []}
    for n in root.walk():
        src = _join(base, n.get("src")) if n.get("src") else None
        rel = (n.get("rel") or "").lower().split()
        if n.tag == "script" and src:
            out["scripts"].append({"url": src, "type": n.get("type"), "async": "async" in n.attrs, "defer": "defer" in n.attrs})
        elif n.tag == "img" and src:
            out["images"].append({"url": src, "alt": n.get("alt"), "format": _extension(src), "width": _number(n.get("width")), "height": _number(n.get("height"))})
        elif n.tag in ("video", "audio"):
            inner = n.find("source")
            src = src or (_join(base, inner.get("src")) if inner is not None and inner.get("src") else None)
            if src:
                out["media"].append({"url": src, "kind": n.tag, "format": _extension(src)})
        elif n.tag == "link" and n.get("href"):
            href = _join(base, n.get("href"))
            if "stylesheet" in rel:
                out["stylesheets"].append({"url": href, "media": n.get("media")})
            elif n.get("as") == "font" and href:
                out["fonts"].append(href)
    return out


def security(root: Node, base: str) -> dict:
    by = {}
    for n in root.walk():
        if n.tag == "meta" and n.get("http-equiv"):
            by[n.get("http-equiv").lower()] = n.get("content") or ""
    return {
        "https": base.lower().startswith("https://"), "hsts": "strict-transport-security" in by, "csp": by.get("content-security-policy", ""),
        "x_frame_options": by.get("x-frame-options", ""), "permissions_policy": by.get("permissions-policy", ""),
    }


def classify(n: Node) -> str | None:
    """What an interactive element is, by its tag; others can be clicked if they have a role or a handler, else they are nothing."""
    if kind := KINDS.get(n.tag):
        return kind
    known = n.tag in CLICKABLE or n.tag == "label" or n.get("role") in ROLES or any(k.startswith("on") for k in n.attrs)
    return "clickable" if known else None


def interactive(root: Node) -> list[dict]:
    """Elements of these tags, handlers, roles and editing attributes, in document order; those that are no kind go."""
    out = []
    for n in root.walk():
        a = n.attrs
        found = (
            n.tag in CONTROLS or n.tag in CLICKABLE or n.tag == "a" and "href" in a or n.tag == "label" and "for" in a or not HANDLERS.isdisjoint(a) or a.get("role") in ROLES
            or a.get("contenteditable") == "true" or a.get("draggable") == "true" or "tabindex" in a
        )
        if not found or n.tag == "a" and "href" not in a or n.tag == "label" and "for" not in a or (kind := classify(n)) is None:
            continue
        handlers = sorted(k for k in a if k.startswith("on"))
        rules = {"pattern": n.get("pattern"), "min_length": _number(n.get("minlength")), "max_length": _number(n.get("maxlength")), "min": n.get("min"), "max": n.get("max"), "step": n.get("step")}
        out.append({
            "tag": n.tag, "kind": kind, "id": n.get("id"), "text": _text(n), "type": n.get("type"), "name": n.get("name"), "href": n.get("href"), "disabled": "disabled" in n.attrs,
            "required": "required" in n.attrs, "attributes": dict(n.attrs), "handlers": handlers, "validation": rules if any(v is not None for v in rules.values()) else None,
        })
    return out


def page(html: str | None, base: str | None) -> dict:
    root, base = parse(html), base or ""
    return {"metadata": metadata(root, base), "headings": headings(root), "links": links(root, base), "security": security(root, base), "resources": resources(root, base), "interactive": interactive(root)}


#: Image types by their first bytes.
IMAGE_MAGIC = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"))


def image_type(data: bytes) -> str | None:
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return next((t for m, t in IMAGE_MAGIC if data.startswith(m)), None)


# --- resource references in HTML ---------------------------------------------------------------------------------

TAG = re.compile(r"<(link|img)\b[^>]*>", re.I)
ATTR = re.compile(r"""([\w:-]+)\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _attrs(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(tag):
        out.setdefault(m[1].lower(), next(x for x in m.groups()[2:] if x is not None))
    return out


def resource_urls(root: Node, base: str) -> dict[str, list[str]]:
    """css, images and svg references, absolute, without data: URLs; svg if '.svg' is in the source."""
    out: dict[str, list[str]] = {"css": [], "images": [], "svg": []}
    for n in root.walk():
        if n.tag == "link" and "stylesheet" in (n.get("rel") or "").lower().split() and n.get("href"):
            kind, ref = "css", n.get("href")
        elif n.tag == "img" and n.get("src"):
            ref = n.get("src")
            kind = "svg" if ".svg" in ref else "images"
        else:
            continue
        if not ref.startswith("data:") and (url := _join(base, ref)) and url not in out[kind]:
            out[kind].append(url)
    return out


def inline_resources(html: str, base: str, css: dict[str, str], images: dict[str, str], svg: dict[str, str]) -> tuple[str, int]:
    """The page with stylesheets and images replaced by downloaded contents, in one pass; (html, replaced).

    A stylesheet becomes a style element, an image gets a data URL as source, an svg image its markup; svg wins.
    """
    n = 0

    def one(m):
        nonlocal n
        a, tag = _attrs(m[0]), m[1].lower()
        if tag == "link" and "stylesheet" in a.get("rel", "").lower().split():
            if (body := css.get(_join(base, a.get("href", "")) or "")) is not None:
                n += 1
                return f"<style>{body}</style>"
        elif tag == "img" and a.get("src"):
            url = _join(base, a["src"]) or ""
            if url in svg:
                n += 1
                return svg[url]
            if url in images:
                n += 1
                return m[0].replace(a["src"], images[url], 1)
        return m[0]

    return TAG.sub(one, html), n


def search_results(html: str | None, most: int = 10) -> list[dict]:
    """(rank, title, url, snippet) of a saved result page: blocks with a heading inside or beside an anchor."""
    out, root = [], parse(html)
    for n in root.walk():
        if len(out) == most:
            break
        if n.tag == "a" and (n.get("href") or "").startswith("http") and (h := n.find("h2", "h3") or (n.parent if n.parent is not None and n.parent.tag in ("h2", "h3") else None)):
            box = n
            while box.parent is not None and box.parent.tag in ("a", "h2", "h3", "div") and not box.find("p"):
                box = box.parent
            p = box.find("p")
            out.append({"rank": len(out) + 1, "title": _text(h), "url": n.get("href"), "snippet": _text(p) if p else ""})
    return out
