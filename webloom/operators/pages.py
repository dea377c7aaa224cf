"""Pages to records, Markdown and indexable documents: one Arrow pass each, partition by partition."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import extract, mdtext
from webloom.functions import urls as U
from webloom.functions.dom import parse
from webloom.functions.markdown import Options, bare_markdown, html_to_markdown


#: Rows that are Python objects at a time: a batch of Spark's holds 10,000 pages, whose trees and texts would.
SLICE = 128


def _mapped(df: DataFrame, schema: T.StructType, fn) -> DataFrame:
    """fn(row dict) to a dict or a list of dicts of the schema, over slices of batches."""

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for b in it:
            for at in range(0, b.num_rows, SLICE):
                out = []
                for row in b.slice(at, SLICE).to_pylist():
                    got = fn(row)
                    out += got if isinstance(got, list) else [got]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.mapInArrow(run, schema)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, metadata, headings, links, security, resources, interactive)."""
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), *extract.PAGE.fields])

    def one(r):
        got = extract.page(r["html"], r["url"])
        # Arrow takes maps as pairs.
        for e in got["interactive"]:
            e["attributes"] = list(e["attributes"].items())
        return {"page_id": r["page_id"], "url": r["url"], **got}

    return _mapped(pages.select("page_id", "url", "html"), schema, one)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, target): links worth crawling, the first of each."""
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("target", T.StringType())])
    return _mapped(pages.select("page_id", "url", "html"), schema, lambda r: [{"page_id": r["page_id"], "url": r["url"], "target": t} for t in extract.static_links(parse(r["html"]), r["url"] or "")])


def _converted(base: Options):
    """(html, url) to Markdown."""

    def one(html: str | None, url: str | None) -> str:
        try:
            return html_to_markdown(html, Options(**{**base.__dict__, "base_url": base.base_url or url}))
        except (ValueError, RecursionError, IndexError, AttributeError, TypeError):
            return bare_markdown(html)  # one page that can't be converted is no reason to fail a task

    return one


def to_markdown(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """(page_id, url, html) to (page_id, url, markdown); links are absolute by the page's URL."""
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("markdown", T.StringType())])
    convert = _converted(options or Options())
    return _mapped(pages.select("page_id", "url", "html"), schema, lambda r: {"page_id": r["page_id"], "url": r["url"], "markdown": convert(r["html"], r["url"])})


def _document(page_id, url: str | None, markdown: str | None) -> dict:
    md = markdown or ""
    text = mdtext.plain_text(md)
    return {"doc_id": page_id, "url": url, "title": mdtext.title(md), "content": text, "raw": md, "snippet": mdtext.snippet(text), "word_count": mdtext.word_count(text), "file_size": len(md.encode())}


def _documents(df: DataFrame, one, crawl_id: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("doc_id", df.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
        T.StructField("raw", T.StringType()), T.StructField("snippet", T.StringType()), T.StructField("word_count", T.LongType()), T.StructField("file_size", T.LongType()),
    ])
    u = F.col("url")
    return _mapped(df, schema, one).withColumn("path", U.mirror_path(u, "/data", "index.md.gz")).withColumn("domain", U.index_domain(u)).withColumn("crawl_id", F.lit(crawl_id))


def to_documents(markdown: DataFrame, crawl_id: str = "0") -> DataFrame:
    """(page_id, url, markdown) to the search documents: doc_id, url, path, title, content, raw, snippet, word_count,
    file_size, domain, crawl_id."""
    return _documents(markdown.select("page_id", "url", "markdown"), lambda r: _document(r["page_id"], r["url"], r["markdown"]), crawl_id)


def documents(pages: DataFrame, options: Options | None = None, crawl_id: str = "0") -> DataFrame:
    """(page_id, url, html) to the search documents, in one pass: to_documents of to_markdown."""
    convert = _converted(options or Options())
    return _documents(pages.select("page_id", "url", "html"), lambda r: _document(r["page_id"], r["url"], convert(r["html"], r["url"])), crawl_id)


@F.pandas_udf(T.StringType())
def etag(content: pd.Series) -> pd.Series:
    """Quoted xxh3-64 of the bytes, in lower-case hexadecimal without leading zeros."""
    return content.map(lambda x: f'"{xxhash.xxh3_64_intdigest(x.encode() if isinstance(x, str) else bytes(x)):x}"', na_action="ignore")


def with_cache(saved: DataFrame) -> DataFrame:
    """(content, saved_at, ...) with etag and expires_at, seven days later; nulls stay null."""
    return saved.withColumn("etag", etag("content")).withColumn("expires_at", F.col("saved_at") + F.expr("INTERVAL 7 DAYS"))


def cached_etags(cache: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """(url, etag) of the wanted urls that are cached and not expired at ``now``; of several the one that lasts longest."""
    alive = cache.where(F.col("etag").isNotNull() & (F.col("expires_at") > now))
    return alive.join(urls.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.max_by("etag", "expires_at").alias("etag"))


def valid_outlinks(pages: DataFrame, start: str, allowed: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """(page_id, url) of the links of pages that are in scope, each once a page."""
    found = page_links(pages).select("page_id", F.col("target").alias("url"))
    return found.where(U.in_scope(F.col("url"), start, allowed or [], excluded or [])).distinct()


def inline_resources(pages: DataFrame, downloads: DataFrame) -> DataFrame:
    """(page_id, url, html) and (page_id, kind, url, body) to (page_id, html, successes, failures).

    Downloads are gathered by page: a page's own references bound their number. kind: css, images or svg.
    """
    own = downloads.groupBy("page_id").agg(F.collect_list(F.struct("kind", "url", "body")).alias("found"))
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("html", T.StringType()), T.StructField("successes", T.LongType()), T.StructField("failures", T.ArrayType(T.StringType()))])

    def one(r):
        have: dict[str, dict[str, str]] = {"css": {}, "images": {}, "svg": {}}
        for d in r["found"] or ():
            have[d["kind"]][d["url"]] = d["body"]
        html, n = extract.inline_resources(r["html"] or "", r["url"] or "", have["css"], have["images"], have["svg"])
        wanted = extract.resource_urls(parse(r["html"]), r["url"] or "")
        return {"page_id": r["page_id"], "html": html, "successes": n, "failures": [u for k, us in wanted.items() for u in us if u not in have[k]]}

    return _mapped(pages.select("page_id", "url", "html").join(own, "page_id", "left"), schema, one)


def failure_rate(successes: Column, failures: Column) -> Column:
    n = successes + F.size(failures)
    return F.when(n == 0, 0.0).otherwise(F.size(failures) / n)


def data_url(content: Column, mime: Column, most_bytes: int) -> Column:
    """A data: URL, or null beyond the limit."""
    return F.when(F.octet_length(content) <= most_bytes, F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content)))


def search_results(saved: DataFrame) -> DataFrame:
    """(page_id, html) of saved result pages to (page_id, rank, title, url, snippet), ten at most."""
    schema = T.StructType([T.StructField("page_id", saved.schema["page_id"].dataType), T.StructField("rank", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("title", "url", "snippet"))])
    return _mapped(saved.select("page_id", "html"), schema, lambda r: [{"page_id": r["page_id"], **x} for x in extract.search_results(r["html"])])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
