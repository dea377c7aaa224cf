"""Event bus and ingestion as tables: bounded queues, batch results, pressure, retries and running statistics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Capacity of the bus, share of it from which it is overloaded; retries of an operation and their delays.
CAPACITY, OVERLOAD = 1000, 0.8
RETRIES, FIRST_DELAY_MS = 3, 10
TRANSIENT = ("lock", "busy", "timeout", "temporary")
#: Errors of a web search that are final, and those that may pass; others are final too.
PERMANENT_SEARCH_ERRORS = (
    "browser (closed|disconnected|crashed)", "page (closed|crashed)", "target (closed|crashed|destroyed)", "session (not found|closed|disconnected)", "no response from.*chromium",
    "channel (closed|disconnected|error)", "websocket (closed|error|disconnected)", "cdp.*(disconnect|closed)", "frame.*not found", "captcha",
)
TRANSIENT_SEARCH_ERRORS = (
    "stealth injection", "timeout|timed out", "network (error|timeout|unreachable)", "connection (refused|reset|closed)", "dns.*(fail|error|timeout)", "rate limit|too many requests",
    "(http[: ])?429", "temporarily unavailable",
)


def bounded(events: DataFrame, capacity: int = CAPACITY, mode: str = "drop_oldest") -> DataFrame:
    """Events (seq, ...) of one burst on a bus that nobody reads meanwhile, with what becomes of them as ``status``.

    drop_oldest: the last ``capacity`` by seq are published, earlier ones dropped; error: the first are published,
    later ones fail; block: all are published, as the publisher waits. Of equal seqs at the boundary all count as
    the one. A null seq is dropped. An empty table gives an empty one. The boundary is one top-k aggregate.
    """
    if mode not in ("drop_oldest", "block", "error"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "block":
        return events.withColumn("status", F.lit("published"))
    order = F.desc("seq") if mode == "drop_oldest" else F.asc("seq")
    edge = events.where("seq is not null").orderBy(order).limit(capacity).agg((F.min if mode == "drop_oldest" else F.max)("seq").alias("_edge"))
    inside = F.col("seq") >= F.col("_edge") if mode == "drop_oldest" else F.col("seq") <= F.col("_edge")
    other = "dropped" if mode == "drop_oldest" else "failed"
    return events.crossJoin(F.broadcast(edge)).withColumn("status", F.when(F.coalesce(inside, F.lit(False)), "published").otherwise(other)).drop("_edge")  # one row


def batch_result(events: DataFrame) -> DataFrame:
    """One row (total, published, failed, complete, success_rate) of events with a status; the rate, in percent, is 100 without events."""
    total, published, failed = F.count("*"), F.count_if(F.col("status") == "published"), F.count_if(F.col("status") != "published")
    return events.agg(total.alias("total"), published.alias("published"), failed.alias("failed"), (published == total).alias("complete"), F.when(total == 0, 100.0).otherwise(published / total * 100).alias("success_rate"))


def pressure(used: Column, capacity: int = CAPACITY) -> Column:
    """struct(pressure, overloaded): the share of the capacity in use, 1 at most."""
    share = F.least(F.lit(1.0), used / F.lit(float(capacity)))
    return F.struct(share.alias("pressure"), (share >= OVERLOAD).alias("overloaded"))


def is_transient(message: Column) -> Column:
    """Whether an operation that failed so is tried again; false for a null message."""
    m = F.lower(message)
    out = F.lit(False)
    for word in TRANSIENT:
        out = out | m.contains(word)
    return F.coalesce(out, F.lit(False))


def with_retries(apply: Callable[[], None], sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs an operation, again after 10, 20 and 40 ms while its error is transient; the number of retries it took."""
    for n in range(RETRIES + 1):
        try:
            apply()
            return n
        except Exception as e:
            if n == RETRIES or not any(w in str(e).lower() for w in TRANSIENT):
                raise
            sleep(FIRST_DELAY_MS * 2**n / 1000)
    return RETRIES


def search_retry(message: Column, attempt: Column) -> Column:
    """struct(retry, delay_ms) of a failed web search: 1000 * 2^attempt, without jitter, if the error may pass; else null."""
    m = F.lower(message)
    any_of = lambda patterns: m.rlike("|".join(f"(?:{p})" for p in patterns))
    again = F.coalesce(~any_of(PERMANENT_SEARCH_ERRORS) & any_of(TRANSIENT_SEARCH_ERRORS), F.lit(False))
    return F.struct(again.alias("retry"), F.when(again, 1000 * F.pow(F.lit(2.0), attempt)).alias("delay_ms"))


def due_retries(queue: DataFrame, breakers: DataFrame, now: float, delay_s: float = 300.0) -> DataFrame:
    """Rows of a retry queue (url, domain, ready_at, ...) that are due and whose domain's breaker lets them through.

    ``breakers``: (domain, state, opened_at); an open one lets through ``delay_s`` after it opened. Domains without
    a breaker are let through, and so are null ones. Repeated rows stay.
    """
    shut = breakers.where((F.col("state") == "open") & (F.lit(now) - F.col("opened_at") < delay_s)).select("domain").distinct()
    return queue.where(F.col("ready_at") <= now).join(shut, "domain", "left_anti")


def ingest_stats(operations: DataFrame) -> DataFrame:
    """One row about operations (status, retries, finished_at): counts, retries, the last end and the success rate (1 without finished ones)."""
    n = lambda s: F.count_if(F.col("status") == s)
    done = n("applied") + n("failed")
    return operations.agg(
        F.count("*").alias("total"), n("applied").alias("applied"), n("failed").alias("failed"), n("pending").alias("pending"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        F.max("finished_at").alias("last_at"), F.when(done == 0, 1.0).otherwise(n("applied") / done).alias("success_rate"),
    )
