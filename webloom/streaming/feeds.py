"""Structured Streaming over change feeds and crawl events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators import feed as O
from webloom.operators.bus import with_retries
from webloom.operators.crawl import Breaker, Bucket

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
FEED = "seq long, op string, url string, path string, priority string"


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream; files_per_batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class VersionedTable:
    """A table whose versions are folders; ``current`` names the latest committed one, so readers see whole versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(done(f"{self.root}/{n}/_SUCCESS")))

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v < 0 else self.spark.read.parquet(f"{self.root}/v{v}")

    def commit(self, df: DataFrame, version: int | None = None) -> None:
        v = self.version() + 1 if version is None else version
        df.write.mode("overwrite").parquet(f"{self.root}/v{v}")


def apply_changes(feed: DataFrame, table: VersionedTable, content_of: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Applies each micro-batch of a feed (last operation by url) to a table. A replayed batch rewrites its version.

    ``content_of`` gives the table's rows for the upserted (url, path) of a batch. ``every``: a trigger interval, as
    '100 milliseconds'; without it what is there is applied and the query ends. A version whose writing fails for a
    passing reason is written again, as often as bus.with_retries() does.
    """

    def batch(df: DataFrame, n: int) -> None:
        last = O.last_by_url(df).where(~F.col("op").isin(*O.CONTROL))
        new = content_of(last.where("op = 'upsert'").select("url", "path"))
        before = table.spark.read.parquet(f"{table.root}/v{n - 1}") if n else None
        after = new if before is None else before.join(last.select("url"), "url", "left_anti").unionByName(new)
        with_retries(lambda: table.commit(after, n))

    w = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def progress_stats(query: StreamingQuery) -> dict:
    """What a query has done so far: batches, rows, rows a second of the last batch, the last batch's time in ms."""
    done = [p for p in query.recentProgress if p["numInputRows"]]
    last = done[-1] if done else None
    return {
        "batches": len(done), "rows": sum(p["numInputRows"] for p in done), "rows_per_second": (last["processedRowsPerSecond"] or 0.0) if last else 0.0,
        "last_batch_ms": last["durationMs"].get("triggerExecution", 0) if last else 0, "active": query.isActive,
    }


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, value): tumbling windows behind a watermark. An extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, events): session windows. An extension."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def subscribe(events: DataFrame, predicate) -> DataFrame:
    """Events that a Column predicate takes."""
    return events.where(predicate)


def running_count(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def breaker_stream(events: DataFrame, threshold: int = 5, successes: int = 2, delay_s: float = 300.0) -> DataFrame:
    """(domain string, ts double, seq long, ok boolean) to (domain, seq, state), state by domain across batches."""

    def each(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(threshold, successes, delay_s, tuple(state.get) if state.exists else None)
        if b.opened == -1.0:
            b.opened = None
        for f in frames:
            f = f.sort_values(["ts", "seq"])
            yield pd.DataFrame({"domain": f.domain, "seq": f.seq, "state": [b.record(bool(ok), ts) for ok, ts in zip(f.ok, f.ts, strict=True)]})
        state.update((b.state, b.fails, b.wins, -1.0 if b.opened is None else b.opened))

    return events.groupBy("domain").applyInPandasWithState(each, "domain string, seq long, state string", "state string, fails long, wins long, opened double", "append", GroupStateTimeout.NoTimeout)


def bucket_stream(requests: DataFrame, rate: float) -> DataFrame:
    """(domain string, ts double, seq long) to (domain, seq, allowed, retry_after)."""

    def each(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Bucket(rate, (state.get[0], None if state.get[1] < 0 else state.get[1]) if state.exists else None)
        for f in frames:
            f = f.sort_values(["ts", "seq"])
            got = [b.take(t) for t in f.ts]
            yield pd.DataFrame({"domain": f.domain, "seq": f.seq, "allowed": [g[0] for g in got], "retry_after": [g[1] for g in got]})
        state.update((b.tokens, -1.0 if b.at is None else b.at))

    return requests.groupBy("domain").applyInPandasWithState(each, "domain string, seq long, allowed boolean, retry_after double", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def run_to_memory(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is available into a memory table; for tests and small checks."""
    name = f"t{uuid.uuid4().hex}"
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
