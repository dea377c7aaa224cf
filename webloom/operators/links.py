"""The link graph as two DataFrames, pages(url, local_path, domain, saved_at) and edges(source_url, target_url)."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U


def inbound(edges: DataFrame, pages: DataFrame, target: str) -> DataFrame:
    """(url, local_path) of known pages that link to the target."""
    return edges.where(F.col("target_url") == U.normalize_url(F.lit(target))).join(pages, F.col("source_url") == F.col("url")).select("url", "local_path")


def outbound(edges: DataFrame, source: str) -> DataFrame:
    return edges.where(F.col("source_url") == U.normalize_url(F.lit(source))).select("target_url")


def existing(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """The normalised requested urls that are known pages."""
    return urls.select(U.normalize_url(F.col("url")).alias("url")).distinct().join(pages, "url", "left_semi")


def local_path(pages: DataFrame, url: str) -> DataFrame:
    """(local_path) of a known page; no row for others, a null where none is known."""
    return pages.where(F.col("url") == U.normalize_url(F.lit(url))).select("local_path")


def counts(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (pages, links), repeats counted; zeros for empty tables."""
    return pages.agg(F.count("*").alias("pages")).crossJoin(edges.agg(F.count("*").alias("links")))  # a row each


def register(pages: DataFrame, edges: DataFrame, saved: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (pages, edges) after saving (url, local_path, saved_at) with its (source_url, target_url) links.

    A known page keeps its domain; all its edges are replaced by the new ones, each once.
    """
    new = saved.select(U.normalize_url(F.col("url")).alias("url"), "local_path", "saved_at")
    new = new.groupBy("url").agg(F.max_by(F.struct("local_path", "saved_at"), "saved_at").alias("s")).select("url", "s.*")
    old = pages.select("url", F.col("domain").alias("old_domain"))
    merged = new.join(old, "url", "left").select("url", "local_path", F.coalesce("old_domain", U.link_domain(F.col("url"))).alias("domain"), "saved_at")
    fresh = links.select(U.normalize_url(F.col("source_url")).alias("source_url"), U.normalize_url(F.col("target_url")).alias("target_url")).distinct()
    kept = edges.join(new.select(F.col("url").alias("source_url")), "source_url", "left_anti")
    return pages.join(new, "url", "left_anti").unionByName(merged), kept.unionByName(fresh)


def to_rewrite(edges: DataFrame, pages: DataFrame, saved: DataFrame) -> DataFrame:
    """(source_url, local_path, targets): pages with a link to a newly saved one, each once."""
    hit = edges.join(saved.select(U.normalize_url(F.col("url")).alias("target_url")).distinct(), "target_url", "left_semi")
    known = pages.select(F.col("url").alias("source_url"), "local_path")
    return hit.join(known, "source_url").groupBy("source_url", "local_path").agg(F.sort_array(F.collect_set("target_url")).alias("targets"))


def on_page_saved(pages: DataFrame, edges: DataFrame, saved: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What saving pages sets off, in this order: (pages, edges, outbound, inbound).

    The saved pages (url, local_path, saved_at) with their links (source_url, target_url) are registered first, so a
    link to the page itself counts. outbound: (source_url, target_url, local_path) of their links to known pages, to
    be rewritten in the saved files; inbound: as to_rewrite(), known pages whose files link to the saved ones.
    """
    pages, edges = register(pages, edges, saved, links)
    new = saved.select(U.normalize_url(F.col("url")).alias("source_url")).distinct()
    known = pages.select(F.col("url").alias("target_url"), "local_path")
    return pages, edges, edges.join(new, "source_url", "left_semi").join(known, "target_url").select("source_url", "target_url", "local_path"), to_rewrite(edges, pages, saved)


# --- texts -------------------------------------------------------------------------------------------------------

HREF = re.compile(r"""(<a\b[^>]*?\bhref\s*=\s*)(["'])(.*?)\2""", re.I | re.S)
MD_LINK = re.compile(r'(\]\()([^()\s]+)((?:\s+"[^"]*")?\))')
MD_REF = re.compile(r"^(\s*\[[^\]]+\]:\s*)(\S+)(.*)$")
MD_AUTO = re.compile(r"<(https?://[^>\s]+)>")


def normalized(url: str) -> str:
    """What normalize_url does, for single strings."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", url)
    if not m or not m[2]:
        return url.lower()
    scheme, host = m[1].lower(), m[2].rpartition("@")[2].lower()
    host = re.sub(":80$" if scheme == "http" else ":443$" if scheme == "https" else "$^", "", host)
    path = m[3] or "/"
    return f"{scheme}://{host}{path[:-1] if path.endswith('/') and path != '/' else path}{m[4] or ''}"


def _target(ref: str, base: str, here: str, known: dict[str, str]) -> str | None:
    """The relative path to the saved copy of what a reference names, with its fragment."""
    if ref.startswith(("#", "mailto:", "javascript:", "tel:", "data:")):
        return None
    try:
        url, _, frag = urljoin(base, ref).partition("#")
    except ValueError:
        return None
    path = known.get(normalized(url))
    return None if path is None else posixpath.relpath(path, posixpath.dirname(here) or ".") + (f"#{frag}" if frag else "")


def rewrite_html(html: str, base: str, here: str, known: dict[str, str]) -> tuple[str, int]:
    n = 0

    def one(m):
        nonlocal n
        if (new := _target(m[3].strip(), base, here, known)) is None:
            return m[0]
        n += 1
        return f"{m[1]}{m[2]}{new}{m[2]}"

    return HREF.sub(one, html), n


def rewrite_markdown(md: str, base: str, here: str, known: dict[str, str]) -> tuple[str, int]:
    """Inline links, then reference definitions, then autolinks (named by their file), line by line."""
    n = 0
    to_md = {u: p.replace("/index.html", "/index.md").replace(".html", ".md") for u, p in known.items()}

    def target(ref):
        nonlocal n
        new = _target(ref, base, here, to_md)
        n += new is not None
        return new

    out = []
    for line in md.split("\n"):
        line = MD_LINK.sub(lambda m: m[0] if (t := target(m[2])) is None else m[1] + t + m[3], line)
        line = MD_REF.sub(lambda m: m[0] if (t := target(m[2])) is None else m[1] + t + m[3], line)
        out.append(MD_AUTO.sub(lambda m: m[0] if (t := target(m[1])) is None else f"[{posixpath.basename(t.partition('#')[0])}]({t})", line))
    return "\n".join(out), n


def rewrite_one_link(md, url: str, relative: str):
    """Column: '](url)' and '](url ' point to the relative path instead."""
    return F.replace(F.replace(md, F.lit(f"]({url})"), F.lit(f"]({relative})")), F.lit(f"]({url} "), F.lit(f"]({relative} "))


def rewrite_links(pages: DataFrame, edges: DataFrame, known: DataFrame, column: str = "html") -> DataFrame:
    """(url, local_path, <column>) with links to known pages made relative; (url, local_path, text, n_links).

    Each page gets the paths of its own targets by a join of the edges, so nothing of the corpus is broadcast.
    """
    own = edges.join(known.select(F.col("url").alias("target_url"), F.col("local_path").alias("to")), "target_url").groupBy("source_url").agg(F.map_from_entries(F.collect_set(F.struct("target_url", "to"))).alias("known"))
    joined = pages.withColumn("_key", U.normalize_url(F.col("url"))).join(own, F.col("_key") == F.col("source_url"), "left")
    rewrite = rewrite_html if column == "html" else rewrite_markdown

    @F.pandas_udf("text string, n_links long")
    def run(text: pd.Series, base: pd.Series, here: pd.Series, known_: pd.Series) -> pd.DataFrame:
        rows = [(t, 0) if t is None or k is None else rewrite(t, b, h, dict(k)) for t, b, h, k in zip(text, base, here, known_, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_links"])

    return joined.select("url", "local_path", run(F.col(column), "url", "local_path", "known").alias("r")).select("url", "local_path", "r.text", "r.n_links")
