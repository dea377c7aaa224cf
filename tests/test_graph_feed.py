import pytest
from pyspark.sql import functions as F

from webloom.api import Corpora, CrawlOptions, InvalidOption, check_web_query
from webloom.operators import crawl, feed, links
from webloom.streaming import feeds

P, E = "url string, local_path string, domain string, saved_at timestamp", "source_url string, target_url string"


def test_link_graph(spark):
    pages, edges = spark.createDataFrame([], P), spark.createDataFrame([], E)
    saved = spark.createDataFrame([("https://e.com/1", "/o/1.html")], "url string, local_path string").withColumn("saved_at", F.current_timestamp())
    pages, edges = links.register(pages, edges, saved, spark.createDataFrame([("https://e.com/1", "https://e.com/2/"), ("https://e.com/1", "https://other.com"), ("https://e.com/1", "https://e.com/2")], E))
    assert links.counts(pages, edges).first()[:] == (1, 2)
    p2, e2 = links.register(pages, edges, saved, spark.createDataFrame([("https://e.com/1", "https://e.com/9")], E))
    assert links.counts(p2, e2).first()[:] == (1, 1) and links.outbound(e2, "https://e.com/1/").first().target_url == "https://e.com/9"
    assert links.inbound(edges, pages, "https://E.com/2").first()[:] == ("https://e.com/1", "/o/1.html")
    asked = spark.createDataFrame([("https://e.com/1#x",), ("https://no.com/",)], "url string")
    assert [r.url for r in links.existing(asked, pages).collect()] == ["https://e.com/1"]


def test_rewriting():
    known = {"https://e.com/b": "/o/e.com/b/index.html", "https://e.com/": "/o/e.com/index.html"}
    html, n = links.rewrite_html('<a class="x" href="/b#s">1</a><a href="/c">2</a><a href=\'https://e.com\'>3</a><a href="#t">4</a>', "https://e.com/a", "/o/e.com/a/index.html", known)
    assert html == '<a class="x" href="../b/index.html#s">1</a><a href="/c">2</a><a href=\'../index.html\'>3</a><a href="#t">4</a>' and n == 2
    md, n = links.rewrite_markdown("[t](/b) ![i](x.png)\n[r]: https://e.com/b\n<https://e.com/b>", "https://e.com/a", "/o/e.com/a/index.md", known)
    assert md == "[t](../b/index.md) ![i](x.png)\n[r]: ../b/index.md\n[index.md](../b/index.md)" and n == 3


def test_rewrite_links_by_join(spark):
    pages = spark.createDataFrame([("https://e.com/a", "/o/a/index.html", '<a href="/b">b</a>'), ("https://e.com/b", "/o/b/index.html", None)], "url string, local_path string, html string")
    edges = spark.createDataFrame([("https://e.com/a", "https://e.com/b")], E)
    got = {r.url: r for r in links.rewrite_links(pages, edges, pages.select("url", "local_path")).collect()}
    assert got["https://e.com/a"].text == '<a href="../b/index.html">b</a>' and got["https://e.com/a"].n_links == 1 and got["https://e.com/b"].text is None
    assert spark.range(1).select(links.rewrite_one_link(F.lit("[a](u) [b](u \"t\")"), "u", "r")).first()[0] == '[a](r) [b](r "t")'


def test_bfs(spark):
    edges = spark.createDataFrame([("https://s.com/", "https://s.com/1"), ("https://s.com/1", "https://s.com/2"), ("https://s.com/2", "https://s.com/3"), ("https://s.com/1", "https://s.com/"), ("https://s.com/", "https://s.com/2")], E)
    assert {(r.url[-1], r.depth) for r in crawl.bfs(edges, ["https://S.com"], 2).collect()} == {("/", 0), ("1", 1), ("2", 1), ("3", 2)}
    assert [r.depth for r in crawl.bfs(edges, ["https://s.com/"], 5, limit=2).collect()] == [0, 1]


def test_breaker_machine():
    b = crawl.Breaker(3, 2, 10.0)
    assert [b.record(False, t) for t in (0, 1, 2)] == ["closed", "closed", "open"] and not b.allows(5) and b.allows(12.0) and b.state == "half_open"
    assert b.record(False, 13) == "open" and b.allows(23.0)
    assert b.record(True, 24) == "half_open" and b.record(False, 25) == "half_open" and [b.record(True, 26), b.record(True, 27)][-1] == "closed"
    k = crawl.Bucket(1.0)
    assert k.take(0.0) == (True, 0.0) and k.take(0.5) == (False, 0.5) and k.take(1.0)[0] and crawl.Bucket(0).take(1) == (True, 0.0)
    half = crawl.Bucket(0.5)
    assert [half.take(t)[0] for t in (0, 1, 2, 4)] == [True, False, True, True]


def outcomes(spark):
    return spark.createDataFrame([(f"d{i % 3}", float(i), i, (i // 3) % 4 == 3) for i in range(60)], "domain string, ts double, seq long, ok boolean")


def test_folds_and_streams_agree(spark, tmp_path):
    o = outcomes(spark)
    batch = {(r.domain, r.seq): r.state for r in crawl.breaker_states(o, 3, 2, 5.0).collect()}
    bucket = {(r.domain, r.seq): r.allowed for r in crawl.token_bucket(o, 0.2).collect()}
    for i in range(3):
        o.where(f"seq >= {20 * i} and seq < {20 * i + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    s = feeds.stream(spark, str(tmp_path / "o"), "domain string, ts double, seq long, ok boolean")
    assert {(r.domain, r.seq): r.state for r in feeds.run_to_memory(feeds.breaker_stream(s, 3, 2, 5.0)).collect()} == batch
    assert {(r.domain, r.seq): r.allowed for r in feeds.run_to_memory(feeds.bucket_stream(s, 0.2)).collect()} == bucket
    assert {r.state for r in crawl.state_counts(crawl.breaker_states(o, 3, 2, 5.0)).collect()} <= {"open", "closed", "half_open"}
    streak = {r.seq: r.streak for r in crawl.consecutive_failures(o).collect()}
    assert streak[0] == 1 and streak[6] == 3 and streak[9] == 0
    assert crawl.breaker_states(o.where("false")).collect() == []


FEED = [(1, "upsert", "p1", "f1", "normal"), (2, "upsert", "p2", "f2", "normal"), (3, "delete", "p1", None, None), (4, "upsert", "p3", "f3", "high"), (5, "upsert", "p1", "f1b", "high"), (6, "optimize", None, None, None), (7, "delete", "p2", None, None), (8, "shutdown", None, None, None)]


def test_feed(spark):
    f = spark.createDataFrame(FEED, feeds.FEED)
    last = {(r.url, r.seq) for r in feed.last_by_url(f).collect()}
    assert last == {("p1", 5), ("p2", 7), ("p3", 4), (None, 6), (None, 8)}
    assert [r.seq for r in feed.priority(f).collect()][:4] == [3, 4, 5, 7] and feed.priority(f, force=True).first().seq == 6
    docs = spark.createDataFrame([("p1", "old"), ("p2", "old"), ("p9", "old")], "url string, text string")
    new = spark.createDataFrame([("p1", "new"), ("p3", "new")], "url string, text string")
    assert {tuple(r) for r in feed.apply_feed(docs, f, new).collect()} == {("p1", "new"), ("p3", "new"), ("p9", "old")}


def test_feed_stream(spark, tmp_path):
    for i, part in enumerate((FEED[:4], FEED[4:])):
        spark.createDataFrame(part, feeds.FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    table = feeds.VersionedTable(spark, str(tmp_path / "table"))
    q = feeds.apply_changes(feeds.stream(spark, str(tmp_path / "feed"), feeds.FEED), table, lambda u: u.select("url", "path"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r.url for r in table.read().collect()} == {"p1", "p3"} and table.version() == 1
    stats = feeds.progress_stats(q)
    assert stats["batches"] == 2 and stats["rows"] >= len(FEED) and stats["last_batch_ms"] > 0 and not stats["active"]


def test_windows_and_metrics(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(2).write.parquet(str(tmp_path / "e"))
    batch = feeds.windowed_counts(spark.read.schema(feeds.EVENT).parquet(str(tmp_path / "e")))
    got = feeds.run_to_memory(feeds.windowed_counts(feeds.stream(spark, str(tmp_path / "e"), feeds.EVENT, 10)), "complete")
    key = lambda r: (r.start, r.event_type, r.events)
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))
    assert crawl.event_metrics(spark.createDataFrame([], "status string")).first().success_rate == 1.0
    errs = spark.createDataFrame([("Failed to open file x",), ("Failed to decompress: gzip",), ("Invalid UTF-8 at 3",), ("4 MB is too large",), ("Permission denied",), ("tantivy: index broken",), ("?",), (None,), ("permission denied",)], "message string")
    kinds = ["file_not_found", "decompression_error", "encoding_error", "size_limit_exceeded", "permission_denied", "index_error"]
    assert {r.category: r.errors for r in crawl.error_tally(errs).collect()} == dict.fromkeys(kinds, 1) | {"other": 3}


def test_api(spark, tmp_path):
    html = lambda t, *refs: f"<title>{t}</title><h1>{t}</h1><p>words about {t}</p>" + "".join(f'<a href="{r}">x</a>' for r in refs)
    fetched = spark.createDataFrame([(1, "https://e.com/", html("home", "/a", "https://o.org/")), (2, "https://e.com/a", html("apples", "/b")), (3, "https://e.com/b", html("bears")), (4, "https://e.com/lost", html("lost")), (5, "https://o.org/", html("other"))], "page_id long, url string, html string")
    c, o = Corpora(spark, str(tmp_path)), CrawlOptions("e.com", str(tmp_path), max_depth=2)
    rows, meta = c.search(o, "words", fetched)
    assert meta.total_count == 3 and {r.title for r in rows.collect()} == {"home", "apples", "bears"}
    assert c.fetch(o, "https://e.com/a/").title == "apples" and c.status(o).pages == 3 and [m.start_url for m in c.list()] == ["https://e.com"]
    assert c.drop(o) and c.status(o) is None
    with pytest.raises(InvalidOption):
        c.search(o, "x")
    with pytest.raises(InvalidOption):
        CrawlOptions(" ", "x")
    with pytest.raises(InvalidOption):
        check_web_query("é" * 501)
    assert check_web_query(" a ") == "a"
