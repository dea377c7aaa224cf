from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom import plans
from webloom.functions import text as X
from webloom.functions.porter2 import stem
from webloom.operators import search as S

FIELDS = {"title": "content", "content": "content", "url": "exact", "path": "exact", "raw": "whitespace"}


@pytest.fixture(scope="module")
def ix(spark):
    rows = [
        (1, "https://a.com/1", "/a/1", "Rust guide", "The quick brown fox runs. Running foxes are quick.", "a.com", "0"), (2, "https://a.com/2", "/a/2", "Python", "A brown quick dog and the fox", "a.com", "0"),
        (3, "https://b.com/3", "/b/3", "Rust and Python", "Nothing here but <tags> & cats", "b.com", "1"), (4, "https://b.com/4", "/a/1", "Copy", "quick brown fox again", "b.com", "1"), (5, "https://c.com/5", "/c/5", None, None, "c.com", "0"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, url string, path string, title string, content string, domain string, crawl_id string").withColumn("raw", F.col("content"))
    return S.build(docs, FIELDS, stem=True)


def ids(ix, text, **kw):
    return {r.doc_id for r in S.SearchQuery(text, **kw).hits(ix).collect()}


@pytest.mark.parametrize("text, kind, field, value, distance", [
    ("simple text search", "text", None, "simple text search", 0), ('"exact phrase"', "phrase", None, "exact phrase", 0), ('""', "text", None, '""', 0), ("title:hello world", "field", "title", "hello world", 0),
    ("url:https://example.com:8080", "field", "url", "https://example.com:8080", 0), ("title:hello AND content:world", "field", "title", "hello AND content:world", 0), ("title:search~2", "field", "title", "search~2", 0),
    ("test~", "fuzzy", None, "test", 1), ("test~2", "fuzzy", None, "test", 2), ("test~5", "fuzzy", None, "test", 3), ("test~invalid", "fuzzy", None, "test", 1), ("hello AND (world OR universe)", "boolean", None, None, 0),
    ("NOT deprecated", "text", None, "NOT deprecated", 0), ('"hello AND world"', "phrase", None, "hello AND world", 0),
])
def test_types(text, kind, field, value, distance):
    q = S.parse(text)
    assert (q.kind, q.field, q.distance) == (kind, field, distance) and (value is None or q.value == value)


def test_queries(ix):
    assert ids(ix, "fox") == {1, 2, 4} and ids(ix, "running") == {1} and ids(ix, '"quick brown fox"') == {1, 4}
    assert ids(ix, "quick AND dog") == {2} and ids(ix, "fox NOT dog") == {1, 4} and ids(ix, "(dog OR cats) AND python") == {2, 3} and ids(ix, "rust AND (") == {1, 2, 3}
    assert ids(ix, "title:rust") == {1, 3} and ids(ix, "url:a") == {1, 2} and ids(ix, "markdown:<tags>") == {3}
    assert ids(ix, "fxo~1") == {1, 2, 4} and ids(ix, "quack~1") == {1, 2, 4} and ids(ix, "zzzz~2") == set()
    assert ids(ix, "fox", domain="b.com") == {4} and ids(ix, "fox", crawl_id="0") == {1, 2} and ids(ix, "") == set()
    with pytest.raises(ValueError, match="Unknown field"):
        ids(ix, "nope:x")


def test_results_paging_and_excerpts(ix):
    out, meta = S.SearchQuery("quick fox", limit=2).run_with_metadata(ix)
    rows = out.collect()
    assert meta.total_count == 3 and meta.has_more is False or meta.next_offset == 2
    assert len({r.path for r in rows}) == len(rows) == 2 and rows[0].score >= rows[1].score and "<b>" in rows[0].excerpt
    assert "&lt;tags&gt; &amp; <b>cats</b>" in S.search(ix, "cats").first().excerpt
    assert S.search(ix, "cats", highlight=False).first().excerpt.startswith("Nothing here")


def test_boost_prefers_titles(ix):
    assert S.SearchQuery("rust guide").run(ix).first().url == "https://a.com/1"


def test_saved_index(spark, ix, tmp_path):
    ix.save(str(tmp_path))
    again = S.load(spark, str(tmp_path), FIELDS, True)
    assert ids(again, "fox") == {1, 2, 4}
    plan = again.postings.where("field = 'title' and term = 'rust'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rust)]" in plan and "PartitionFilters: [isnotnull(field" in plan


def test_postings_are_made_where_the_texts_are(spark, ix):
    """Against a plain count, without a shuffle or lists of words as Python objects; across slices of a batch."""
    plan = ix.postings._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan and "MapInArrow" in plan
    texts = [None, "", "...", *(f"Runs a{i % 7} running b run {'x ' * (i % 5)}" for i in range(S.SLICE + 30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string").coalesce(1)
    for kind, stemming in (("exact", False), ("content", True)):
        want = {}
        for i, t in enumerate(texts):
            for pos, w in enumerate((t or "").replace(".", " ").lower().split()):
                want.setdefault((i, stem(w) if stemming else w), []).append(pos)
        got = S.build(docs, {"content": kind}, stem=stemming)
        rows = got.postings.collect()
        assert {(r.doc_id, r.term): r.positions for r in rows} == want and len(rows) == len(want) and all(r.tf == len(r.positions) and r.field == "content" for r in rows)
        lengths = {i: sum(len(p) for (j, _), p in want.items() if j == i) for i in {i for i, _ in want}}
        assert {r.doc_id: r.length for r in got.lengths.collect()} == lengths


def test_saved_lengths_are_those_of_the_texts(spark, ix, tmp_path):
    ix.save(str(tmp_path))
    key = lambda df: sorted((r.field, r.doc_id, r.length) for r in df.collect())
    assert key(S.load(spark, str(tmp_path), FIELDS, True).lengths) == key(ix.lengths) and not (tmp_path / "unsorted").exists()


def test_fragments():
    text = "alpha " * 60 + "beta beta " * 3 + "alpha " * 60
    got = S.best_fragment(text, {"beta": 0.5, "alpha": 0.01})
    assert got.count("<b>beta</b>") == 6 and len(got.replace("<b>", "").replace("</b>", "").encode()) <= 260
    assert S.best_fragment("none here", {"x": 1.0}) is None


def test_analyzers(spark):
    df = spark.createDataFrame([("Das Café, 42 ﬁne-X\n",), ("",), (None,)], "t string")
    assert df.select(X.exact_tokens(F.col("t"))).first()[0] == ["das", "café", "42", "ﬁne", "x"]
    assert df.select(X.ascii_tokens(F.col("t"))).first()[0] == ["das", "42", "x"]
    assert df.select(X.whitespace_tokens(F.col("t"))).first()[0] == ["Das", "Café,", "42", "ﬁne-X"]
    assert spark.range(1).select(X.ngram_tokens(F.lit("ABC"))).first()[0] == ["ab", "abc", "bc"]
    assert [r[0] for r in df.select(X.word_count(F.col("t"))).collect()] == [4, 0, 0]
    assert spark.range(1).select(X.truncate_boundary(F.lit("one two three"), 9), X.truncate_boundary(F.lit("abcdef"), 3), X.escape_html(F.lit("<a&b>"))).first()[:] == ("one two", "abc", "&lt;a&amp;b&gt;")


def test_ngrams_compute_their_text_once(spark, tmp_path):
    titles = ["aB\U0001f600b\U0001f600", "Caf\u00e9 caf\u00e9", "x", "", None]
    rows = [(i, "u", t and f"<title>{t}</title>" + "<p>body</p>" * 50) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = plans.QUERIES["tokens_ngram"](spark, str(tmp_path))
    lowered = [t.lower() for t in titles if t]
    assert {r.token: r.n for r in got.collect()} == Counter(t[i : i + n] for t in lowered for n in (2, 3, 4) for i in range(len(t) - n + 1))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1  # not once for every n-gram
    df = spark.createDataFrame([("\U0001f600\nab",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(X.ngram_tokens(F.col("t"), 3, 3)).collect()] == [["\U0001f600\na", "\nab"], ["abc"], []]


@pytest.mark.parametrize("word, want", [
    ("running", "run"), ("generously", "generous"), ("consistency", "consist"), ("knightly", "knight"), ("happiness", "happi"), ("cries", "cri"), ("ties", "tie"), ("hoping", "hope"), ("hopping", "hop"), ("agreed", "agre"),
    ("skies", "sky"), ("dying", "die"), ("news", "news"), ("relational", "relat"), ("kiwis", "kiwi"), ("gas", "gas"), ("by", "by"), ("communication", "communic"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_distance():
    assert X.osa("ab", "ba", 2) == 1 and X.osa("kitten", "sitting", 3) == 3 and X.osa("abc", "xyz", 1) == 2 and X.osa("", "a", 1) == 1
