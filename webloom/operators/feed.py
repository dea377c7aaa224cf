"""Change feeds and the documents they change: last operation by url, upsert, delete, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIORITY = {"critical": 3, "high": 2, "normal": 1, "low": 0}
CONTROL = ("optimize", "shutdown")


def last_by_url(feed: DataFrame) -> DataFrame:
    """Of (seq, op, url, ...) the last row of each url in order of arrival; control messages all stay."""
    cols = feed.columns
    control = feed.where(F.col("op").isin(*CONTROL))
    rest = feed.where(~F.col("op").isin(*CONTROL)).groupBy("url").agg(F.max_by(F.struct(*cols), "seq").alias("r")).select("r.*")
    return rest.unionByName(control.select(*cols))


def priority(feed: DataFrame, force: bool = False) -> DataFrame:
    """Deletes are high, a forced optimize critical, an unforced one low; most urgent first, then by arrival."""
    rank = F.when(F.col("op") == "delete", PRIORITY["high"]).when(F.col("op") == "optimize", PRIORITY["critical" if force else "low"])
    for k, v in PRIORITY.items():
        rank = rank.when(F.lower("priority") == k, v)
    return feed.withColumn("rank", rank.otherwise(PRIORITY["normal"])).orderBy(F.desc("rank"), "seq")


def upsert(docs: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """docs with the rows of ``new`` in place of those with the same key. Rows of ``new`` all stay, repeats and null keys too."""
    return docs.join(new.select(key), key, "left_anti").unionByName(new)


def delete(docs: DataFrame, urls: DataFrame, key: str = "url") -> DataFrame:
    """docs without the keys in ``urls``; null keys are never deleted, repeated ones all are."""
    return docs.join(urls.select(key), key, "left_anti")


def apply_feed(docs: DataFrame, feed: DataFrame, contents: DataFrame) -> DataFrame:
    """Docs after a feed's last operation by url; upserts take their row from ``contents`` (by url)."""
    ops = last_by_url(feed).where(~F.col("op").isin(*CONTROL))
    kept = docs.join(ops.select("url"), "url", "left_anti")
    return kept.unionByName(contents.join(ops.where("op = 'upsert'").select("url"), "url", "left_semi").select(*docs.columns))


def index_stats(docs: DataFrame) -> DataFrame:
    """One row (num_documents, words, bytes); nulls count nothing, an empty table gives zeros."""
    return docs.agg(F.count("*").alias("num_documents"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
