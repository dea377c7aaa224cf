import pytest
from pyspark.sql import functions as F

from webloom.functions import urls as U


def values(spark, fn, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, u string")
    return [r.v for r in df.select("i", fn(F.col("u")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    """Fragment and user go, a default port goes, one slash at the end of a longer path goes; query and other ports stay."""
    cases = {
        "HTTPS://Shop.TEST/Cart/": "https://shop.test/Cart", "http://wiki.test:80": "http://wiki.test/", "http://wiki.test:443/x": "http://wiki.test:443/x", "https://wiki.test:443?p=2": "https://wiki.test/?p=2",
        "https://u@wiki.test:9/a#b?c": "https://wiki.test:9/a", "http://wiki.test/a//#z": "http://wiki.test/a/", "http://wiki.test/?q=a/#z": "http://wiki.test/?q=a/", "//Wiki": "//wiki", "": "",
    }
    assert values(spark, U.normalize_url, cases) == list(cases.values())
    from webloom.operators.links import normalized

    assert [normalized(u) for u in cases] == list(cases.values())


def test_domains(spark):
    """The link graph's host is parsed; the rate limiter's is cut out of the text, before letters are lowered."""
    assert values(spark, U.link_domain, ["ftp://Files.Test:21/a?b", "https://u:p@h.test", "mailto", ""]) == ["files.test", "h.test", "", ""]
    assert values(spark, U.rate_domain, ["ftp://www.Files.Test:21/a", "Files.Test#www.", "http://WWW.files.test?x", "www.www.files.test"]) == ["files.test", "files.test", "www.files.test", "www.files.test"]
    assert values(spark, U.breaker_domain, ["http://files.test:1/x", "//files.test"]) == ["files.test", None]
    assert values(spark, U.cache_key, ["http://files.test/a/?b=c", "http://files.test:81", "a b"]) == ["http://files.test/a", "http://files.test/", None]


@pytest.mark.parametrize("start, url, ok", [
    ("https://e.com/docs", "https://e.com/docs", True), ("https://e.com/docs", "https://e.com/docs/", True), ("https://e.com/docs", "https://e.com/docs/api?x=1#y", True), ("https://e.com/doc", "https://e.com/docs", False),
    ("https://e.com/docs", "http://e.com/docs/a", False), ("https://e.com/docs", "https://sub.e.com/docs", False), ("https://e.com", "https://e.com/any/path", True), ("https://e.com/", "https://e.com", True), ("https://e.com/", "not a url", False), ("https://e.com/docs", "https://e.com/other", False),
])
def test_scope(spark, start, url, ok):
    assert spark.range(1).select(U.in_scope(F.lit(url), start)).first()[0] is ok


def test_exclusion_allowed_and_status(spark):
    assert spark.range(1).select(U.in_scope(F.lit("https://e.com/a/b.pdf"), "https://e.com/", None, ["*.pdf"]), U.in_scope(F.lit("https://e.com/a"), "https://e.com/", ["other.org"])).first()[:] == (False, False)
    got = spark.createDataFrame([(404,), (500,), (200,), (301,), (None,)], "s int").select(U.status_check(F.col("s")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [(False, 0.95), (False, 0.95), (True, 1.0), (True, 1.0), (True, 1.0)]


def test_paths(spark):
    m = lambda u: U.mirror_path(u, "/out", "index.md.gz")
    assert values(spark, m, ["https://e.com/", "https://e.com/a/b/"]) == ["/out/e.com/index.md.gz", "/out/e.com/a/b/index.md.gz"]
    assert values(spark, lambda p: U.url_from_index_path(p, "/out"), ["/out/e.com/index.md.gz", "/out/e.com/a/b/index.md", "/out/index.md.gz", "/out/nodot/a/index.md.gz", "/out/-e.com/index.md.gz", "/out/e.com/a..b/c/index.md.gz"]) == ["https://e.com/", "https://e.com/a/b/", None, None, None, "https://e.com/c/"]
    assert values(spark, U.valid_domain, ["a.b", "", "ab", ".a.b", "a.b-", "a_b.c", "x" * 252 + ".y"]) == [True, False, False, False, False, False, False]
    pair = spark.createDataFrame([("https://e.com/a/b", "../c?q=1", "/o/a/x.html", "/o/b/y.html"), (None, None, None, None)], "b string, r string, f string, t string")
    assert [tuple(r) for r in pair.select(U.resolve_url("b", "r"), U.relative_path("f", "t")).collect()] == [("https://e.com/c?q=1", "../b/y.html"), (None, None)]


def test_failures_backoff_and_headers(spark):
    msgs = ["HTTP 429", "dns lookup", "chrome crashed", "parse error", "weird", None]
    got = [(r.kind, r.retryable, r.factor) for r in values(spark, U.failure_class, msgs)]
    assert got == [("rate_limited", True, 3.0), ("network", True, 1.0), ("browser", True, 1.5), ("content_extraction", False, 1.0), ("unknown", True, 1.0), ("unknown", True, 1.0)]
    ms = spark.createDataFrame([(0, 1.0), (3, 1.5), (9, 3.0)], "r int, f double").select(U.backoff_ms(F.col("r"), F.col("f")).alias("b")).collect()
    assert [x.b for x in ms] == [1000.0, 12000.0, 30000.0]
    long = "text/html; " + "x" * 600 + "; charset=utf-8"
    assert values(spark, U.content_type_checked, ["text/html", long]) == ["text/html", "text/html; charset=utf-8"]
    assert values(spark, U.strip_weak_etag, ['W/"a"', '"a"']) == ['"a"', '"a"']


def test_parts(spark):
    u = F.lit("https://me@Host.test:8443/a/b?q=1#f")
    got = spark.range(1).select(
        U.userinfo(u), U.with_parts(u), U.with_parts(u, port=F.lit(443), user=F.lit("")), U.with_parts(u, path=F.lit(""), query=F.lit("x=2"), fragment=F.lit("")),
        U.with_parts(F.lit("nope"), path=F.lit("x")), U.with_parts(u, host=F.lit(None).cast("string")), U.path_segments(u), U.path_segments(F.lit("http://h")),
    ).first()
    assert tuple(got) == ("me@", "https://me@host.test:8443/a/b?q=1#f", "https://host.test/a/b?q=1#f", "https://me@host.test:8443/?x=2", None, None, ["a", "b"], [""])
    with pytest.raises(ValueError):
        U.with_parts(u, color=F.lit("x"))
