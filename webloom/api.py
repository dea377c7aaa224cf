"""Corpora as one object: build from pages, search, fetch, list and drop; options with their checks."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.markdown import Options
from webloom.operators import bus, crawl, pages, search
from webloom.sources.crawl_output import Manifest, write_html, write_json


class InvalidOption(ValueError):
    """A bad argument, with what was expected and a suggestion."""

    def __init__(self, name: str, detail: str, suggestion: str = ""):
        super().__init__(f"{name}: {detail}" + (f" ({suggestion})" if suggestion else ""))
        self.name, self.detail, self.suggestion = name, detail, suggestion


@dataclass
class CrawlOptions:
    start_url: str
    storage_dir: str
    max_depth: int = 3
    limit: int | None = None
    allowed_domains: list[str] = field(default_factory=list)
    excluded_patterns: list[str] = field(default_factory=list)
    rate_rps: float = 2.0
    max_concurrent: int = 10
    max_concurrent_per_domain: int = 2
    breaker_failures: int = 5
    breaker_retry_s: float = 300.0
    breaker_successes: int = 2
    compression: str = "gzip"
    stemming: bool = True
    crawl_id: str = "0"
    #: Hosts below the start's, and any other host, are in scope too.
    allow_subdomains: bool = False
    allow_external_domains: bool = False
    #: What is converted of a page: a tag, #id or .class.
    content_selector: str | None = None
    save_raw_html: bool = False
    save_json: bool = False
    breaker_enabled: bool = True
    max_page_retries: int = 3
    max_inline_image_bytes: int | None = None
    event_capacity: int = bus.CAPACITY

    def __post_init__(self):
        if not self.start_url.strip():
            raise InvalidOption("start_url", "is empty", "give an http(s) URL")
        if not self.start_url.startswith(("http://", "https://")):
            self.start_url = f"https://{self.start_url}"
        if self.max_depth < 0:
            raise InvalidOption("max_depth", "is negative")
        if self.limit is not None and self.limit < 1:
            raise InvalidOption("limit", "must be positive")
        if self.max_concurrent < 1 or self.max_concurrent_per_domain < 1:
            raise InvalidOption("max_concurrent", "must be positive")
        if self.rate_rps < 0:
            raise InvalidOption("rate_rps", "is negative", "0 is no limit")
        if self.event_capacity < 1:
            raise InvalidOption("event_capacity", "must be positive")
        if self.max_page_retries < 0:
            raise InvalidOption("max_page_retries", "is negative")
        if self.compression not in ("none", "gzip", "zstd", "snappy"):
            raise InvalidOption("compression", f"is not known: {self.compression}", "none, gzip, zstd or snappy")

    def scope(self, url: Column) -> Column:
        """Whether a url is crawled: by the start's scope, or that of its subdomains or of all hosts, but for what is excluded."""
        own = U.in_scope(url, self.start_url, self.allowed_domains, self.excluded_patterns)
        start = F.lit(self.start_url)
        valid = U.is_valid_url(url) & ~U.excluded(url, self.excluded_patterns)
        if self.allow_external_domains:
            return F.coalesce(own | valid, F.lit(False))
        if self.allow_subdomains:
            return F.coalesce(own | valid & U.host(url).endswith(F.concat(F.lit("."), U.host(start))), F.lit(False))
        return own


def check_web_query(text: str) -> str:
    """A trimmed web search query: not empty, at most 1000 bytes."""
    t = text.strip()
    if not t:
        raise InvalidOption("query", "is empty")
    if len(t.encode()) > 1000:
        raise InvalidOption("query", "has more than 1000 bytes")
    return t


class Corpora:
    """Named corpora below a folder: documents, postings, link graph and a manifest each."""

    FIELDS = {"title": "content", "content": "content", "url": "exact", "path": "exact", "raw": "whitespace"}

    #: Indexes that stay open, and for how long without a search.
    OPEN, IDLE_S = 5, 1800.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._open: dict[str, tuple[float, search.Index]] = {}

    def at(self, options: CrawlOptions) -> str:
        host = self.spark.range(1).select(U.output_dir(F.lit(options.start_url))).first()[0]
        return f"{self.root}/{host}"

    def build(self, fetched: DataFrame, options: CrawlOptions) -> Manifest:
        """From fetched (page_id, url, html): pages in scope within the depth are converted and indexed."""
        at = self.at(options)
        scope = fetched.where(options.scope(F.col("url")))
        edges = pages.page_links(scope).select(U.normalize_url(F.col("url")).alias("source_url"), U.normalize_url(F.col("target")).alias("target_url")).distinct()
        edges.write.mode("overwrite").parquet(f"{at}/edges")
        edges = self.spark.read.parquet(f"{at}/edges")
        reached = crawl.bfs(edges, [options.start_url], options.max_depth, options.limit)
        own = scope.withColumn("_n", U.normalize_url(F.col("url"))).join(reached.select(F.col("url").alias("_n")), "_n", "left_semi").drop("_n")
        converted = pages.to_markdown(own, Options(selector=options.content_selector))
        pages.to_documents(converted, options.crawl_id).write.mode("overwrite").option("compression", options.compression).parquet(f"{at}/documents")
        if options.save_raw_html:
            write_html(own.select("url", "html"), f"{at}/html")
        if options.save_json:
            write_json(pages.extract_pages(own), f"{at}/json")
        ix = search.build(self.spark.read.parquet(f"{at}/documents"), self.FIELDS, options.stemming)
        ix.save(f"{at}/index")
        m = Manifest(options.crawl_id, options.start_url, "completed", self.spark.read.parquet(f"{at}/documents").count(), 0, {"max_depth": options.max_depth, "stemming": options.stemming})
        m.save(self.spark, f"{at}/manifest")
        self._open.pop(at, None)
        return m

    def index(self, options: CrawlOptions) -> search.Index:
        at = self.at(options)
        now = time.monotonic()
        self._open = {k: v for k, v in self._open.items() if now - v[0] < self.IDLE_S}
        _, ix = self._open.pop(at, (now, None))
        if ix is None:
            docs = self.spark.read.parquet(f"{at}/documents")
            ix = search.open_or_build(self.spark, f"{at}/index", docs, self.FIELDS, options.stemming)
        self._open[at] = now, ix  # the last in the order of use
        while len(self._open) > self.OPEN:
            del self._open[next(iter(self._open))]
        return ix

    def search(self, options: CrawlOptions, text: str, fetched: DataFrame | None = None, **more) -> tuple[DataFrame, Row]:
        """Builds first if there is nothing yet and pages are given."""
        if self.status(options) is None:
            if fetched is None:
                raise InvalidOption("corpus", f"nothing built for {options.start_url}", "build it first or give pages")
            self.build(fetched, options)
        return search.SearchQuery(text, **more).run_with_metadata(self.index(options))

    def fetch(self, options: CrawlOptions, url: str) -> Row | None:
        """(url, title, markdown) of one page."""
        docs = self.spark.read.parquet(f"{self.at(options)}/documents")
        return docs.where(U.normalize_url(F.col("url")) == U.normalize_url(F.lit(url))).select("url", "title", F.col("raw").alias("markdown")).first()

    def status(self, options: CrawlOptions) -> Manifest | None:
        return Manifest.load(self.spark, f"{self.at(options)}/manifest")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def list(self) -> list[Manifest]:
        path, fs = self._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        found = [Manifest.load(self.spark, f"{self.root}/{n}/manifest") for n in names]
        return sorted((m for m in found if m), key=lambda m: (m.crawl_id, m.start_url))

    def drop(self, options: CrawlOptions) -> bool:
        _, fs = self._fs()
        self._open.pop(self.at(options), None)
        return fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.at(options)), True)


class Registry:
    """What clients have under way, by (connection, id); a connection that closes takes its own along."""

    def __init__(self):
        self._of: dict[tuple[str, str], CrawlOptions] = {}

    def add(self, connection: str, options: CrawlOptions) -> None:
        if (connection, options.crawl_id) in self._of:
            raise InvalidOption("crawl_id", f"{options.crawl_id} is taken")
        self._of[connection, options.crawl_id] = options

    def get(self, connection: str, crawl_id: str) -> CrawlOptions | None:
        return self._of.get((connection, crawl_id))

    def of(self, connection: str) -> list[CrawlOptions]:
        return [o for (c, _), o in sorted(self._of.items()) if c == connection]

    def kill(self, spark: SparkSession, connection: str, crawl_id: str) -> bool:
        """Cancels the jobs of a crawl, which run under its id as job group."""
        if self._of.pop((connection, crawl_id), None) is None:
            return False
        spark.sparkContext.cancelJobGroup(f"{connection}/{crawl_id}")
        return True

    def close(self, spark: SparkSession, connection: str) -> int:
        """Ends all that a connection has under way; how many there were."""
        return sum(self.kill(spark, connection, o.crawl_id) for o in self.of(connection))
