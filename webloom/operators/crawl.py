"""Crawl planning and health: frontier, token bucket, circuit breaker, retries, event metrics."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import urls as U
from webloom.session import shared_dir


def _cut(df: DataFrame, at: str) -> DataFrame:
    """Writes a level to the shared folder and rereads it, so that the plan doesn't grow with the depth."""
    path = f"{at}/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bfs(edges: DataFrame, start: list[str], max_depth: int, limit: int | None = None, work_dir: str | None = None) -> DataFrame:
    """(url, depth) reached from normalised start urls over (source_url, target_url), each at its least depth.

    A driver loop over levels: join, anti-join against the visited, union. Within a level urls are taken in
    order if a limit on pages cuts it; no level is searched once there are enough. ``work_dir``: shared folder for
    the levels, by default spark.checkpoint.dir. Null urls lead nowhere; repeated edges and starts count once;
    without edges the starts are all there is.
    """
    spark = edges.sparkSession
    at = work_dir or shared_dir(spark)
    level = spark.createDataFrame([(u,) for u in start], "url string").select(U.normalize_url(F.col("url")).alias("url")).distinct()
    visited, total = level.withColumn("depth", F.lit(0)), len(start)
    for depth in range(1, max_depth + 1):
        nxt = edges.join(level, F.col("source_url") == F.col("url")).select(F.col("target_url").alias("url")).distinct().join(visited, "url", "left_anti")
        level = _cut(nxt.where("url is not null"), at)
        found = level.count()
        if not found:
            break
        total += found
        visited = visited.unionByName(level.withColumn("depth", F.lit(depth)))
        if limit is not None and total >= limit:
            break
    return visited if limit is None else visited.orderBy("depth", "url").limit(limit)


def unvisited(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """Rows of candidates whose url is not visited; repeats and null urls stay."""
    return candidates.join(visited, "url", "left_anti")


# --- folds over ordered events by domain ---------------------------------------------------------------------------


class Breaker:
    """Closed opens after ``threshold`` failures in a row; after ``delay_s`` it is half open; ``successes`` close it,
    a failure at once reopens it."""

    def __init__(self, threshold: int = 5, successes: int = 2, delay_s: float = 300.0, state: tuple | None = None):
        self.threshold, self.successes, self.delay = threshold, successes, delay_s
        self.state, self.fails, self.wins, self.opened = state or ("closed", 0, 0, None)

    def allows(self, now: float) -> bool:
        if self.state == "open" and now - self.opened >= self.delay:
            self.state, self.wins = "half_open", 0
        return self.state != "open"

    def record(self, ok: bool, now: float) -> str:
        self.allows(now)
        if ok:
            self.fails = 0
            if self.state == "half_open":
                self.wins += 1
                if self.wins >= self.successes:
                    self.state = "closed"
        else:
            self.fails += 1
            if self.state in ("closed", "half_open") and self.fails >= self.threshold:
                self.state, self.opened = "open", now
        return self.state


class Bucket:
    """Token bucket of max(rate, 1) tokens, refilled at ``rate`` a second; a rate of 0 or less allows all."""

    def __init__(self, rate: float, state: tuple | None = None):
        self.rate, self.room = rate, max(rate, 1.0)
        self.tokens, self.at = state or (self.room, None)

    def take(self, now: float) -> tuple[bool, float]:
        """(allowed, seconds until a token if not)."""
        if self.rate <= 0:
            return True, 0.0
        if self.at is not None:
            self.tokens = min(self.room, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now
        if self.tokens >= 1 - 1e-9:
            self.tokens -= 1
            return True, 0.0
        return False, (1 - self.tokens) / self.rate


def _fold(df: DataFrame, schema: str, make, each) -> DataFrame:
    """A fold over (domain, ts, seq, ...) in order within each domain.

    Rows arrive sorted by domain and are folded as they stream through a task; no domain is gathered.
    """
    cols = df.columns

    def run(it):
        key, state = None, None
        for b in it:
            out = []
            for r in b.itertuples(index=False):
                if r.domain != key or state is None:
                    key, state = r.domain, make()
                out.append(each(state, r))
            if out:
                yield pd.DataFrame(out)

    del cols
    return df.repartition("domain").sortWithinPartitions("domain", "ts", "seq").mapInPandas(run, schema)


def breaker_states(outcomes: DataFrame, threshold: int = 5, successes: int = 2, delay_s: float = 300.0) -> DataFrame:
    """(domain, ts double, seq, ok) to (domain, seq, state): the breaker's state after each outcome."""
    return _fold(outcomes.select("domain", "ts", "seq", "ok"), "domain string, seq long, state string", lambda: Breaker(threshold, successes, delay_s), lambda s, r: (r.domain, r.seq, s.record(bool(r.ok), r.ts)))


def token_bucket(requests: DataFrame, rate: float) -> DataFrame:
    """(domain, ts double, seq) to (domain, seq, allowed, retry_after)."""
    return _fold(requests.select("domain", "ts", "seq"), "domain string, seq long, allowed boolean, retry_after double", lambda: Bucket(rate), lambda s, r: (r.domain, r.seq, *s.take(r.ts)))


def consecutive_failures(outcomes: DataFrame) -> DataFrame:
    """(domain, seq, streak): failures in a row up to each outcome, by windows alone."""
    w = Window.partitionBy("domain").orderBy("ts", "seq")
    run = F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w)
    return outcomes.withColumn("_run", run).withColumn("streak", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("domain", "_run").orderBy("ts", "seq"))).select("domain", "seq", "streak")


def state_counts(states: DataFrame) -> DataFrame:
    """(state, domains) of the last state of each domain."""
    last = states.groupBy("domain").agg(F.max_by("state", "seq").alias("state"))
    return last.groupBy("state").agg(F.count("*").alias("domains"))


def open_domains(states: DataFrame) -> DataFrame:
    """Domains whose last state by seq is open; of equal seqs any may count. Null states are not open."""
    return states.groupBy("domain").agg(F.max_by("state", "seq").alias("state")).where("state = 'open'").select("domain")


def retry_plan(failures: DataFrame, max_retries: int = 3) -> DataFrame:
    """(url, retries, message) of what is tried again, with kind and delay_ms (no jitter)."""
    c = U.failure_class(F.col("message"))
    return failures.withColumn("_c", c).where((F.col("retries") < max_retries) & F.col("_c.retryable")).select("url", "retries", F.col("_c.kind").alias("kind"), U.backoff_ms(F.col("retries"), F.col("_c.factor")).alias("delay_ms"))


def queue_lengths(queue: DataFrame) -> DataFrame:
    """(domain, queued) of urls, repeats counted; urls without a host, and null ones, are of the domain ''."""
    return queue.groupBy(U.link_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("queued"))


def event_metrics(events: DataFrame) -> DataFrame:
    """One row of (published, dropped, failed, total, success_rate) over (status); the rate is 1 without events."""
    n = lambda s: F.count_if(F.col("status") == s)
    total = F.count("*")
    return events.agg(n("published").alias("published"), n("dropped").alias("dropped"), n("failed").alias("failed"), total.alias("total"), F.when(total == 0, 1.0).otherwise(n("published") / total).alias("success_rate"))


def eta_seconds(elapsed, processed, remaining):
    """Column: elapsed / processed * remaining; null before the first."""
    return F.when(processed > 0, elapsed / processed * remaining)


#: Error categories by a part of the message, as it is written; the first that fits counts.
ERROR_KINDS = (
    ("file_not_found", "Failed to open file"), ("decompression_error", "Failed to decompress"), ("encoding_error", "Invalid UTF-8"), ("size_limit_exceeded", "too large"),
    ("permission_denied", "Permission denied"), ("index_error", "tantivy"),
)


def error_tally(errors: DataFrame) -> DataFrame:
    """(category, errors) of messages, one row for each category that occurs; null and unknown messages are 'other'. No rows without errors."""
    out = F.lit("other")
    for kind, part in reversed(ERROR_KINDS):
        out = F.when(F.col("message").contains(part), kind).otherwise(out)
    return errors.groupBy(out.alias("category")).agg(F.count("*").alias("errors"))
