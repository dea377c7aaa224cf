"""Bounded buses, retries, the life of saved indexes, caches of pages, and what saving a page sets off."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.api import Corpora, CrawlOptions, InvalidOption, Registry
from webloom.functions import text as X
from webloom.operators import bus, links, pages, search
from webloom.sources import crawl_output


def test_bounded_bus(spark):
    events = spark.createDataFrame([(i,) for i in [5, 1, 4, 2, 3, None]], "seq long")
    status = lambda mode, n: {r.seq: r.status for r in bus.bounded(events, n, mode).collect()}
    assert status("drop_oldest", 2) == {1: "dropped", 2: "dropped", 3: "dropped", 4: "published", 5: "published", None: "dropped"}
    assert status("error", 2) == {1: "published", 2: "published", 3: "failed", 4: "failed", 5: "failed", None: "failed"}
    assert set(status("block", 1).values()) == {"published"} and bus.bounded(events.where("false"), 2).collect() == []
    with pytest.raises(ValueError):
        bus.bounded(events, 1, "other")
    none = bus.batch_result(events.where("false").withColumn("status", F.lit("published"))).first()
    assert (none.total, none.success_rate) == (0, 100.0)
    one = bus.batch_result(bus.bounded(events, 3)).first()
    assert (one.total, one.published, one.failed, one.complete, one.success_rate) == (6, 3, 3, False, 50.0)
    assert [tuple(r.p) for r in spark.range(3).select(bus.pressure(F.col("id") * 800, 1000).alias("p")).orderBy("p").collect()] == [(0.0, False), (0.8, True), (1.0, True)]


def test_retries(spark):
    calls, slept = [], []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("Index is LOCKed")

    assert bus.with_retries(busy, slept.append) == 2 and slept == [0.01, 0.02]
    for text, n in (("timeout", 4), ("no such thing", 1)):
        calls.clear()

        def fail(text=text):
            calls.append(1)
            raise OSError(text)

        with pytest.raises(OSError):
            bus.with_retries(fail, slept.append)
        assert len(calls) == n
    got = spark.createDataFrame([("Timed out", 2), ("page closed, timeout", 0), ("x", 1), (None, 1)], "m string, a int").select(bus.search_retry(F.col("m"), F.col("a")).alias("r"), bus.is_transient(F.col("m")).alias("t")).collect()
    assert [(x.r.retry, x.r.delay_ms, x.t) for x in got] == [(True, 4000.0, False), (False, None, True), (False, None, False), (False, None, False)]
    queue = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0), ("c", "z", 1.0), ("d", "w", 9.0), ("e", None, 1.0)], "url string, domain string, ready_at double")
    breakers = spark.createDataFrame([("x", "open", 4.0), ("y", "open", 1.0), ("z", "half_open", 4.0)], "domain string, state string, opened_at double")
    assert sorted(r.url for r in bus.due_retries(queue, breakers, 5.0, 3.0).collect()) == ["b", "c", "e"]


def test_index_lifecycle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "u1", "p1", "Apple pie", "one two"), (2, "u2", "p2", "Pear", "two three")], "doc_id long, url string, path string, title string, content string")
    at, fields = str(tmp_path / "ix"), {"title": "exact", "content": "exact"}
    assert search.validate(spark, at) is None and search.recover(spark, at) is None
    search.open_or_build(spark, at, docs, fields)
    assert search.validate(spark, at) == 2
    stats = search.file_stats(spark, at)
    assert stats.num_documents == 2 and stats.files > 3 and stats.bytes > 0 and stats.last_change > 0
    spark.read.parquet(f"{at}/postings").drop("positions").write.parquet(f"{at}/other")
    spark.range(1).write.mode("overwrite").parquet(f"{at}/lengths")
    assert search.validate(spark, at) is None
    assert search.open_or_build(spark, at, docs, fields).lengths.count() == 4 and search.validate(spark, f"{at}.backup") is None and search.validate(spark, at) == 2
    search.register_analyzer("letters", lambda c: F.split(c, ""))
    with pytest.raises(ValueError):
        search.register_analyzer("exact", X.exact_tokens)
    assert search.build(docs, {"title": "letters"}).postings.where("term = 'p'").count() == 1
    del search.ANALYZERS["letters"]


def test_stop_words_fill_several_files(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("u").alias("url"), F.lit("p").alias("path"), F.lit("").alias("title"), F.lit("the").alias("content"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search.build(docs, {"content": "exact"}).save(str(tmp_path / "ix"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "ix" / "postings" / "field=content").glob("*.parquet"))) > 1


def test_engine_cache_is_bounded(spark, tmp_path, monkeypatch):
    corpora = Corpora(spark, str(tmp_path))
    monkeypatch.setattr(search, "open_or_build", lambda *a: object())
    monkeypatch.setattr(Corpora, "at", lambda self, o: o)
    (tmp_path / "documents").mkdir()
    monkeypatch.setattr(type(spark), "read", property(lambda self: type("R", (), {"parquet": lambda s, p: None})()))

    class O(str):
        stemming = True

    first = corpora.index(O("0"))
    assert corpora.index(O("0")) is first
    for k in range(1, 6):
        corpora.index(O(str(k)))
    assert list(corpora._open) == list("12345") and corpora.index(O("0")) is not first


def test_caches_and_sinks(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    saved = spark.createDataFrame([("u", "abc", day), ("u", "abd", day + dt.timedelta(days=2)), ("v", None, day), ("w", "x", None)], "url string, content string, saved_at timestamp")
    cache = pages.with_cache(saved)
    assert {r.url: r.expires_at for r in cache.collect() if r.url == "v"} == {"v": day + dt.timedelta(days=7)}
    wanted = spark.createDataFrame([("u",), ("u",), ("v",), ("w",), ("z",)], "url string")
    at = lambda n: {r.url: r.etag for r in pages.cached_etags(cache, wanted, F.lit(day + dt.timedelta(days=n))).collect()}
    tag = {r.content: r.etag for r in cache.collect()}
    assert at(1) == at(8) == {"u": tag["abd"]} and at(10) == {}
    crawl_output.write_html(spark.createDataFrame([("https://a.com/x", "<p>"), ("bad", None)], "url string, html string"), str(tmp_path / "html"))
    assert [(r.url, r.domain) for r in spark.read.parquet(str(tmp_path / "html")).collect()] == [("https://a.com/x", "a.com")]
    docs = spark.createDataFrame([("a.com", "https://a.com/x", "p", "# m", "e")], "domain string, url string, path string, markdown string, etag string")
    for k in range(2):
        crawl_output.write_markdown(docs, str(tmp_path / "md"), str(tmp_path / "feed"), k)
    assert spark.read.parquet(str(tmp_path / "md")).count() == 1 and sorted(r.seq for r in spark.read.parquet(str(tmp_path / "feed")).collect()) == [0, 1]


def test_on_page_saved(spark):
    known = spark.createDataFrame([("https://e.com/a", "/a", "e.com", None), ("https://e.com/b", "/b", "e.com", None)], "url string, local_path string, domain string, saved_at timestamp")
    edges = spark.createDataFrame([("https://e.com/a", "https://e.com/c"), ("https://e.com/c", "https://e.com/a"), ("https://e.com/x", "https://e.com/c")], "source_url string, target_url string")
    saved = spark.createDataFrame([("https://e.com/c#f", "/c")], "url string, local_path string").withColumn("saved_at", F.lit("2024-01-01").cast("timestamp"))
    fresh = spark.createDataFrame([("https://e.com/c", "https://e.com/b/"), ("https://e.com/c", "https://e.com/c"), ("https://e.com/c", "https://e.com/lost")], "source_url string, target_url string")
    p, e, out, back = links.on_page_saved(known, edges, saved, fresh)
    assert p.count() == 3 and e.count() == 5
    assert sorted((r.target_url, r.local_path) for r in out.collect()) == [("https://e.com/b", "/b"), ("https://e.com/c", "/c")]
    assert sorted((r.source_url, r.targets) for r in back.collect()) == [("https://e.com/a", ["https://e.com/c"]), ("https://e.com/c", ["https://e.com/c"])]


def test_options_and_registry(spark, tmp_path):
    html = lambda t, *refs: f"<title>{t}</title><nav>menu</nav><main><h1>{t}</h1><p>words</p></main>" + "".join(f'<a href="{r}">x</a>' for r in refs)
    fetched = spark.createDataFrame([(1, "https://e.com/", html("home", "https://s.e.com/a", "https://o.org/")), (2, "https://s.e.com/a", html("sub")), (3, "https://o.org/", html("other"))], "page_id long, url string, html string")
    urls = lambda root, **kw: (o := CrawlOptions("https://e.com/", str(tmp_path), **kw), Corpora(spark, str(tmp_path / root)))
    for root, kw, want in (("a", {}, {"https://e.com/"}), ("b", {"allow_subdomains": True}, {"https://e.com/", "https://s.e.com/a"}), ("c", {"allow_external_domains": True, "content_selector": "main", "save_raw_html": True, "save_json": True}, {"https://e.com/", "https://s.e.com/a", "https://o.org/"})):
        o, corpora = urls(root, **kw)
        corpora.build(fetched, o)
        docs = spark.read.parquet(f"{corpora.at(o)}/documents").collect()
        assert {r.url for r in docs} == want and all("menu" not in r.raw for r in docs if "content_selector" in kw)
    assert spark.read.parquet(f"{corpora.at(o)}/html").count() == 3 and spark.read.json(f"{corpora.at(o)}/json").count() == 3
    for bad in ({"rate_rps": -1}, {"event_capacity": 0}, {"max_page_retries": -1}, {"compression": "rar"}):
        with pytest.raises(InvalidOption):
            CrawlOptions("e.com", "x", **bad)
    r = Registry()
    r.add("k", o)
    with pytest.raises(InvalidOption):
        r.add("k", o)
    r.add("m", o)
    assert r.get("k", "0") is o and r.of("k") == [o] and r.kill(spark, "k", "0") and not r.kill(spark, "k", "0") and r.close(spark, "m") == 1 and r.of("m") == []
