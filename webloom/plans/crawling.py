"""Queries on crawl events: user_id plays the domain, 'error' a failure."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import bus, crawl, feed
from webloom.streaming import feeds

MESSAGES = ("Connection timed out", "HTTP 429 Too Many Requests", "404 not found", "chrome target closed", "failed to parse html", "no such thing")
#: Messages of an indexing run.
INDEX_ERRORS = ("Failed to open file a.md", "Failed to decompress b.gz: Permission denied", "Invalid UTF-8 in c", "d is too large", "Permission denied (os error 13)", "tantivy: lock", "invalid utf-8", "disk full")


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _outcomes(spark, d):
    return _events(spark, d).select(F.col("user_id").cast("string").alias("domain"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


def _failures(spark, d):
    pick = F.element_at(F.array(*(F.lit(m) for m in MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    return _events(spark, d).select(F.concat(F.lit("https://h"), F.col("user_id") % 9, F.lit(".example/"), "event_id").alias("url"), (F.col("event_id") % 5).cast("int").alias("retries"), pick.alias("message"))


def status_validate(spark, d):
    s = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 6) * 100)
    return _events(spark, d).select("event_id", U.status_check(s).alias("c")).select("event_id", "c.valid", "c.confidence")


def failure_classify(spark, d):
    return _failures(spark, d).select("url", U.failure_class(F.col("message")).alias("c")).select("url", "c.kind", "c.retryable", "c.factor")


def retry_backoff(spark, d):
    return crawl.retry_plan(_failures(spark, d))


def queue_lengths(spark, d):
    return crawl.queue_lengths(_failures(spark, d))


def error_tally(spark, d):
    """Categories of one message for each event."""
    pick = F.element_at(F.array(*(F.lit(m) for m in INDEX_ERRORS)), (F.col("event_id") % len(INDEX_ERRORS) + 1).cast("int"))
    return crawl.error_tally(_events(spark, d).select(pick.alias("message")))


def event_metrics(spark, d):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "dropped").otherwise("published")
    return crawl.event_metrics(_events(spark, d).select(kind.alias("status"))).withColumn("success_rate", F.round("success_rate", 6))


def event_filter(spark, d):
    return feeds.subscribe(_events(spark, d), (F.col("event_type") == "purchase") & (F.col("value") > 50)).select("event_id", "user_id")


def failure_streaks(spark, d):
    return crawl.consecutive_failures(_outcomes(spark, d))


def breaker_states(spark, d):
    return crawl.breaker_states(_outcomes(spark, d), threshold=2, delay_s=3600.0)


def breaker_summary(spark, d):
    return crawl.state_counts(crawl.breaker_states(_outcomes(spark, d), threshold=2, delay_s=3600.0))


def token_bucket(spark, d):
    return crawl.token_bucket(_outcomes(spark, d), 0.00001)


def change_feed_last(spark, d):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return feed.last_by_url(_events(spark, d).select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("url")))


def event_windows(spark, d):
    return feeds.windowed_counts(_events(spark, d)).select("start", "event_type", "events", F.round("value", 2).alias("value"))


def batch_publish(spark, d):
    """The events in one burst on a bus for 5,000 of them, errors in the way of none."""
    return bus.batch_result(bus.bounded(_events(spark, d).select(F.col("event_id").alias("seq")), 5000)).withColumn("success_rate", F.round("success_rate", 6))


def bus_overflow(spark, d):
    return bus.bounded(_events(spark, d).select(F.col("event_id").alias("seq")), 1000, "error").groupBy("status").agg(F.count("*").alias("events"))


def bus_pressure(spark, d):
    """How full a bus for 100 events is with each user's."""
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", bus.pressure(F.col("n"), 100).alias("p")).select("user_id", F.round("p.pressure", 6).alias("pressure"), "p.overloaded")


SEARCH_ERRORS = ("Page crashed", "HTTP 429", "DNS lookup failed", "captcha shown, rate limit", "connection reset by peer", "weird", "Temporarily unavailable", "CDP: disconnected")


def search_retries(spark, d):
    pick = F.element_at(F.array(*(F.lit(m) for m in SEARCH_ERRORS)), (F.col("event_id") % len(SEARCH_ERRORS) + 1).cast("int"))
    return _events(spark, d).select("event_id", bus.search_retry(pick, F.col("event_id") % 4).alias("r")).select("event_id", "r.retry", "r.delay_ms")


def retry_drain(spark, d):
    """Failures that are due at the last moment, but for users whose last two events failed within a day of it."""
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("domain"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("bad"))
    now = e.agg(F.max("ts")).first()[0] or 0.0
    last = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("ts", "seq", "bad")))), 1, 2)
    state = e.groupBy("domain").agg(last.alias("l")).select("domain", F.when((F.size("l") == 2) & F.forall("l", lambda x: x["bad"]), "open").otherwise("closed").alias("state"), F.col("l")[0]["ts"].alias("opened_at"))
    queue = e.where("bad").select(F.concat(F.lit("u"), "seq").alias("url"), "domain", (F.col("ts") + 3600.0).alias("ready_at"))
    return bus.due_retries(queue, state, now, 86400.0).select("url", "domain")


def ingest_stats(spark, d):
    e = _events(spark, d)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("applied")
    return bus.ingest_stats(e.select(status.alias("status"), (F.col("event_id") % 4).alias("retries"), F.col("event_id").alias("finished_at"))).withColumn("success_rate", F.round("success_rate", 6))


QUERIES = {f.__name__: f for f in (
    status_validate, failure_classify, retry_backoff, queue_lengths, error_tally, event_metrics, event_filter, failure_streaks, breaker_states, breaker_summary, token_bucket, change_feed_last, event_windows,
    batch_publish, bus_overflow, bus_pressure, search_retries, retry_drain, ingest_stats,
)}

FAIL = f"(SELECT 'https://h' || (user_id % 9) || '.example/' || event_id AS url, 'h' || (user_id % 9) || '.example' AS domain, CAST(event_id % 5 AS INT) AS retries, lower([{', '.join(repr(m) for m in MESSAGES)}][event_id % {len(MESSAGES)} + 1]) AS m FROM events)"


#: Failures by hand: kind, whether to retry, factor of the delay.
CLASSED = f"""(SELECT *, CASE
    WHEN contains(m, '429') OR contains(m, 'too many requests') OR contains(m, 'rate limit') THEN {{'k': 'rate_limited', 'again': true, 'f': 3.0::DOUBLE}}
    WHEN contains(m, 'timeout') OR contains(m, 'timed out') OR contains(m, 'connection refused') OR contains(m, 'connection reset') OR contains(m, 'dns') OR contains(m, 'network') OR contains(m, 'unreachable') OR contains(m, 'eof') THEN {{'k': 'network', 'again': true, 'f': 1.0::DOUBLE}}
    WHEN contains(m, 'browser') OR contains(m, 'page') OR contains(m, 'chrome') OR contains(m, 'cdp') OR contains(m, 'target') OR contains(m, 'session') THEN {{'k': 'browser', 'again': true, 'f': 1.5::DOUBLE}}
    WHEN contains(m, 'extract') OR contains(m, 'validation') OR contains(m, 'content') OR contains(m, 'html') OR contains(m, 'parse') OR contains(m, 'selector') THEN {{'k': 'content_extraction', 'again': false, 'f': 1.0::DOUBLE}}
    ELSE {{'k': 'unknown', 'again': true, 'f': 1.0::DOUBLE}} END AS c FROM {FAIL})"""
INDEX_FAIL = f"(SELECT [{', '.join(repr(m) for m in INDEX_ERRORS)}][event_id % {len(INDEX_ERRORS)} + 1] AS m FROM events)"
#: Outcomes of each domain in order, folded step by step from a state before the first.
STEPS = "e AS (SELECT CAST(user_id AS VARCHAR) AS domain, event_id AS seq, epoch(ts) AS moment, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
BREAKER = f"""{STEPS}, r AS (
  SELECT DISTINCT domain, 0::BIGINT AS n, NULL::BIGINT AS seq, 'closed' AS state, 0 AS fails, 0 AS wins, NULL::DOUBLE AS opened FROM e
  UNION ALL
  SELECT domain, n, seq, CASE WHEN ok AND half AND won >= 2 THEN 'closed' WHEN NOT ok AND now <> 'open' AND failed >= 2 THEN 'open' ELSE now END, failed, won, CASE WHEN NOT ok AND now <> 'open' AND failed >= 2 THEN moment ELSE opened END
  FROM (SELECT *, now = 'half_open' AS half, CASE WHEN ok AND now = 'half_open' THEN 1 ELSE 0 END + CASE WHEN now <> state THEN 0 ELSE wins END AS won, CASE WHEN ok THEN 0 ELSE fails + 1 END AS failed
    FROM (SELECT e.*, r.state, r.fails, r.wins, r.opened, CASE WHEN r.state = 'open' AND e.moment - r.opened >= 3600 THEN 'half_open' ELSE r.state END AS now FROM r JOIN e ON e.domain = r.domain AND e.n = r.n + 1))
)"""
BUCKET = f"""{STEPS}, r AS (
  SELECT DISTINCT domain, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::DOUBLE AS moment, 1.0::DOUBLE AS tokens, NULL::BOOLEAN AS allowed, NULL::DOUBLE AS retry_after FROM e
  UNION ALL
  SELECT domain, n, seq, moment, CASE WHEN had >= 1 - 1e-9::DOUBLE THEN had - 1 ELSE had END, had >= 1 - 1e-9::DOUBLE, CASE WHEN had >= 1 - 1e-9::DOUBLE THEN 0.0::DOUBLE ELSE (1 - had) / 0.00001::DOUBLE END
  FROM (SELECT e.*, CASE WHEN r.moment IS NULL THEN r.tokens ELSE least(1.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, e.moment - r.moment) * 0.00001::DOUBLE) END AS had FROM r JOIN e ON e.domain = r.domain AND e.n = r.n + 1)
)"""

ORACLE_SQL = {
    "batch_publish": """WITH r AS (SELECT row_number() OVER (ORDER BY event_id DESC) <= 5000 AS inside FROM events)
        SELECT count(*) AS total, count(*) FILTER (inside) AS published, count(*) FILTER (NOT inside) AS failed, bool_and(inside) AS complete, round(100.0 * count(*) FILTER (inside) / count(*), 6)::DOUBLE AS success_rate FROM r""",
    "bus_overflow": "SELECT CASE WHEN row_number <= 1000 THEN 'published' ELSE 'failed' END AS status, count(*) AS events FROM (SELECT row_number() OVER (ORDER BY event_id) AS row_number FROM events) GROUP BY 1",
    "bus_pressure": "SELECT user_id, round(least(1.0, count(*) / 100.0), 6)::DOUBLE AS pressure, count(*) >= 80 AS overloaded FROM events GROUP BY user_id",
    "search_retries": f"""WITH m AS (SELECT event_id, lower([{', '.join(repr(x) for x in SEARCH_ERRORS)}][event_id % {len(SEARCH_ERRORS)} + 1]) AS m FROM events), c AS (SELECT event_id,
        m IN ('http 429', 'dns lookup failed', 'connection reset by peer', 'temporarily unavailable') AS retry FROM m) SELECT event_id, retry, CASE WHEN retry THEN 1000.0 * pow(2, event_id % 4) END AS delay_ms FROM c""",
    "retry_drain": """WITH e AS (SELECT *, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), now AS (SELECT max(t) AS t FROM e),
        shut AS (SELECT user_id FROM e WHERE k <= 2 GROUP BY user_id HAVING count(*) = 2 AND bool_and(event_type = 'error') AND (SELECT t FROM now) - max(t) < 86400)
        SELECT 'u' || event_id AS url, CAST(user_id AS VARCHAR) AS domain FROM e WHERE event_type = 'error' AND t + 3600 <= (SELECT t FROM now) AND user_id NOT IN (SELECT user_id FROM shut)""",
    "ingest_stats": """SELECT count(*) AS total, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS applied, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS pending,
        CAST(sum(event_id % 4) AS BIGINT) AS retries, max(event_id) AS last_at, round(count(*) FILTER (event_type NOT IN ('error', 'signup')) / count(*) FILTER (event_type <> 'signup'), 6) AS success_rate FROM events""",
    "breaker_states": f"WITH RECURSIVE {BREAKER} SELECT domain, seq, state FROM r WHERE n > 0",
    "breaker_summary": f"WITH RECURSIVE {BREAKER} SELECT state, count(*) AS domains FROM (SELECT domain, arg_max(state, seq) AS state FROM r WHERE n > 0 GROUP BY domain) GROUP BY state",
    "token_bucket": f"WITH RECURSIVE {BUCKET} SELECT domain, seq, allowed, retry_after FROM r WHERE n > 0",
    "status_validate": "WITH s AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN (event_id % 6) * 100 END AS st FROM events) SELECT event_id, coalesce(st < 400, true) AS valid, CASE WHEN st >= 400 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM s",
    "failure_classify": f"SELECT url, c.k AS kind, c.again AS retryable, c.f AS factor FROM {CLASSED}",
    "retry_backoff": f"SELECT url, retries, c.k AS kind, CAST(least(30000.0, 1000 * pow(2, least(retries, 5)) * c.f) AS DOUBLE) AS delay_ms FROM {CLASSED} WHERE retries < 3 AND c.again",
    "queue_lengths": f"SELECT domain, count(*) AS queued FROM {FAIL} GROUP BY domain",
    "error_tally": f"""SELECT CASE WHEN m LIKE '%Failed to open file%' THEN 'file_not_found' WHEN m LIKE '%Failed to decompress%' THEN 'decompression_error' WHEN m LIKE '%Invalid UTF-8%' THEN 'encoding_error'
        WHEN m LIKE '%too large%' THEN 'size_limit_exceeded' WHEN m LIKE '%Permission denied%' THEN 'permission_denied' WHEN m LIKE '%tantivy%' THEN 'index_error' ELSE 'other' END AS category, count(*) AS errors FROM {INDEX_FAIL} GROUP BY 1""",
    "event_metrics": """SELECT count(*) FILTER (event_type NOT IN ('error', 'signup')) AS published, count(*) FILTER (event_type = 'signup') AS dropped, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total,
        round(count(*) FILTER (event_type NOT IN ('error', 'signup')) / count(*), 6) AS success_rate FROM events""",
    "event_filter": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 50",
    "failure_streaks": """WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
        SELECT CAST(user_id AS VARCHAR) AS domain, event_id AS seq, CAST(sum(CASE WHEN event_type <> 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS streak FROM r""",
    "change_feed_last": "SELECT max(event_id) AS seq, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'delete' ELSE 'upsert' END AS op, CAST(user_id AS VARCHAR) AS url FROM events GROUP BY user_id",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL",
}
