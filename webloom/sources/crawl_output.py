"""Crawled Markdown on disk: discovery of index.md(.gz) files, URLs from paths, bounded decompression, manifests."""

from __future__ import annotations

import io
import zlib
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U

#: Folders that are left out.
SKIPPED = ("node_modules", "target", "dist", "build", "__pycache__")
MB = 1_000_000


@dataclass(frozen=True)
class Limits:
    max_compressed_mb: int = 20
    max_decompressed_mb: int = 100
    max_ratio: float = 20.0


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, url, content) of files named index.md or index.md.gz below the root.

    Hidden folders, build folders and empty files are left out; deeper than 100 folders too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "index.md{,.gz}").load(root)
    base = F.lit(root.rstrip("/"))
    local = F.regexp_replace("path", "^file:/*", "/")
    below = F.substr(local, F.length(base) + 2)
    parts = F.split(below, "/")
    ok = ~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(".") | p.isin(*SKIPPED)) & (F.size(parts) <= 100)
    return files.where(F.col("length") > 0).where(ok).withColumn("url", U.url_from_index_path(local, root))


def decompressed(raw: bytes, limits: Limits = Limits()) -> tuple[str | None, str | None]:
    """(text, error) of a plain or gzip file; sizes and ratio are held against the limits while reading."""
    if len(raw) > limits.max_compressed_mb * MB:
        return None, f"size limit: {len(raw)} compressed bytes"
    if raw[:2] == b"\x1f\x8b":
        out, z, src = io.BytesIO(), zlib.decompressobj(31), io.BytesIO(raw)
        try:
            while chunk := z.unconsumed_tail or src.read(8192):
                out.write(z.decompress(chunk, 65536))
                n = out.tell()
                if n > limits.max_decompressed_mb * MB:
                    return None, f"size limit: more than {limits.max_decompressed_mb} MB decompressed"
                if n > len(raw) * limits.max_ratio:
                    return None, f"ratio above {limits.max_ratio}"
            out.write(z.flush())
            if not z.eof:
                return None, "gzip: file is cut off"
        except zlib.error as e:
            return None, f"gzip: {e}"
        raw = out.getvalue()
    elif len(raw) > limits.max_decompressed_mb * MB:
        return None, f"size limit: more than {limits.max_decompressed_mb} MB"
    try:
        return raw.decode("utf-8"), None
    except UnicodeDecodeError as e:
        return None, f"utf-8: {e.reason} at {e.start}"


def read_markdown(files: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(good: url, path, markdown, file_size, crawl_date; bad: path, url, message). One url once: its smallest path."""

    @F.pandas_udf("text string, error string")
    def unpack(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decompressed(bytes(c), limits) for c in content], columns=["text", "error"])

    got = files.where("url is not null").withColumn("r", unpack("content")).drop("content")
    good = got.where("r.error is null").groupBy("url").agg(F.min(F.struct("path", F.col("r.text").alias("markdown"), F.col("length").alias("file_size"), F.date_trunc("second", "modificationTime").alias("crawl_date"))).alias("d")).select("url", "d.*")
    return good, got.where("r.error is not null").select("path", "url", F.col("r.error").alias("message"))


@dataclass
class Manifest:
    """One row about a crawl, kept as JSON."""

    crawl_id: str
    start_url: str
    status: str = "running"
    pages: int = 0
    created_at: int = 0
    config: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        row = {**asdict(self), "config": {k: str(v) for k, v in self.config.items()}}
        spark.createDataFrame([row], "crawl_id string, start_url string, status string, pages long, created_at long, config map<string,string>").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest | None:
        try:
            r = spark.read.schema("crawl_id string, start_url string, status string, pages long, created_at long, config map<string,string>").json(path).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return cls(**r.asDict()) if r else None


def write_mirror(docs: DataFrame, path: str) -> None:
    """Markdown as gzip-compressed text rows by domain: (domain, url, path, markdown, etag)."""
    docs.write.mode("overwrite").partitionBy("domain").option("compression", "gzip").parquet(path)


def write_html(pages: DataFrame, path: str) -> None:
    """Whole pages (url, html, ...) uncompressed, by domain; null pages are left out."""
    pages.where("html is not null").withColumn("domain", U.link_domain(F.col("url"))).write.mode("overwrite").partitionBy("domain").option("compression", "none").parquet(path)


def write_markdown(docs: DataFrame, path: str, feed: str, seq: int = 0) -> None:
    """As write_mirror(), then an upsert for each url appended to the change feed (seq, op, url, priority)."""
    write_mirror(docs, path)
    docs.select(F.lit(seq).cast("long").alias("seq"), F.lit("upsert").alias("op"), "url", F.lit("normal").alias("priority")).write.mode("append").parquet(feed)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)
