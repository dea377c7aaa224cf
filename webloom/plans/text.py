"""Queries on tokens, postings and search over the documents that pages become."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.operators import feed, pages, search
from webloom.session import shared_dir

WORDS = ("the", "and", "was")
PHRASE = "of the"


def _documents(spark, d, *cols):
    return spark.read.parquet(f"{d}/documents.parquet").select(*cols)


def search_docs(spark, d):
    """The pages converted to Markdown, and from that to title and plain text.

    Conversion is slow for its bytes, and files compress well: pages are dealt out, so that few files are no few tasks.
    """
    own = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")
    return pages.documents(own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id"))


def _index(spark, d, kind="exact"):
    """The index over the pages, built once a session, saved in the shared folder and read by pushed filters from then on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/pages.parquet")
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    fields = {"title": kind, "content": kind}
    key = hashlib.sha256(f"{spark.sparkContext.applicationId} {d} {kind} {changed}".encode()).hexdigest()[:24]
    at = f"{shared_dir(spark)}/index-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/lengths/_SUCCESS")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):  # the lengths are written last
        fs.deleteOnExit(done.getParent().getParent())
        return search.build_saved(spark, at, search_docs(spark, d), fields, stem=kind == "content")
    return search.load(spark, at, fields, stem=kind == "content")


def _hits(spark, d, text, **kw):
    return search.SearchQuery(text, highlight=False, **kw).hits(_index(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


def tokens_exact(spark, d):
    return _documents(spark, d, F.explode(X.exact_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def tokens_whitespace(spark, d):
    return _documents(spark, d, F.explode(X.whitespace_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def tokens_ngram(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select(F.explode(X.ngram_tokens(F.regexp_extract("html", "<title>(.*?)</title>", 1))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def tokens_stemmed(spark, d):
    flat = _documents(spark, d, F.explode(X.ascii_tokens(F.col("text"))).alias("term"))
    return flat.groupBy("term").agg(F.count("*").alias("k")).groupBy(X.stemmed("term").alias("term")).agg(F.sum("k").alias("n"))


def term_df(spark, d):
    return _documents(spark, d, "doc_id", F.explode(F.array_distinct(X.exact_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def word_count(spark, d):
    return _documents(spark, d, "doc_id", X.word_count(F.col("text")).alias("words"))


def search_text(spark, d):
    """The best ten pages for common words by BM25 over titles (boost 2) and contents."""
    ix = _index(spark, d)
    hits = search.SearchQuery(" ".join(WORDS), highlight=False).hits(ix)
    return search.page(hits.withColumn("score", F.round("score", 6)), 10, 0).select("path", "url", "score")


def search_scores(spark, d):
    return _hits(spark, d, " ".join(WORDS))


def search_phrase(spark, d):
    return _hits(spark, d, f'"{PHRASE}"')


def search_boolean(spark, d):
    return _hits(spark, d, "the AND was NOT edst")


def search_boolean_or(spark, d):
    return _hits(spark, d, "(edst OR hehe) AND the")


def search_field(spark, d):
    return _hits(spark, d, "title:the")


def search_fuzzy(spark, d):
    return _hits(spark, d, "theth~1")


def search_filtered(spark, d):
    return _hits(spark, d, " ".join(WORDS), domain="spam-farm.example.org")


def search_page2(spark, d):
    ix = _index(spark, d)
    hits = search.SearchQuery(" ".join(WORDS), highlight=False).hits(ix)
    return search.page(hits.withColumn("score", F.round("score", 6)), 10, 10).select("path", "url", "score")


def search_total(spark, d):
    return search.SearchQuery(" ".join(WORDS), highlight=False).hits(_index(spark, d)).agg(F.count("*").alias("total"))


def search_excerpts(spark, d):
    return search.SearchQuery("the was", limit=10).run(_index(spark, d))


def search_stemmed(spark, d):
    ix = _index(spark, d, "content")
    return search.SearchQuery("things nations", limit=10).run(ix)


def dedupe_by_path(spark, d):
    rows = _documents(spark, d, F.col("source").alias("path"), F.concat(F.lit("u"), "doc_id").alias("url"), F.col("n_chars").cast("double").alias("score"))
    return search.dedupe_by_path(rows)


def upsert_docs(spark, d):
    old = _documents(spark, d, F.concat(F.lit("u"), "doc_id").alias("url"), "n_chars")
    new = _documents(spark, d, "doc_id", "n_chars").where("doc_id % 7 = 0").select(F.concat(F.lit("u"), F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1_000_000)).alias("url"), (-F.col("n_chars")).alias("n_chars"))
    return feed.upsert(old, new)


def delete_docs(spark, d):
    old = _documents(spark, d, F.concat(F.lit("u"), "doc_id").alias("url"), "n_chars")
    return feed.delete(old, _documents(spark, d, "doc_id").where("doc_id % 5 = 0").select(F.concat(F.lit("u"), "doc_id").alias("url")))


def index_stats(spark, d):
    return feed.index_stats(_documents(spark, d, X.word_count(F.col("text")).alias("word_count"), F.octet_length("text").alias("file_size")))


QUERIES = {f.__name__: f for f in (
    tokens_exact, tokens_whitespace, tokens_ngram, tokens_stemmed, term_df, word_count, search_text, search_scores, search_phrase, search_boolean, search_boolean_or, search_field, search_fuzzy,
    search_filtered, search_page2, search_total, search_excerpts, search_stemmed, dedupe_by_path, upsert_docs, delete_docs, index_stats,
)}

from .web import HOST, LINES, PATH, TITLE  # noqa: E402

MPATH = f"'/data/' || {HOST} || CASE WHEN regexp_replace({PATH}, '^/+|/+$', '', 'g') <> '' THEN '/' || regexp_replace({PATH}, '^/+|/+$', '', 'g') ELSE '' END || '/index.md.gz'"
TOK = r"[\p{L}\p{N}]+"
BASE = f"""{LINES}, docs AS (SELECT page_id AS doc_id, url, {MPATH} AS path, {TITLE} AS title, content, regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*)', 1) AS domain FROM md),
  lists AS (SELECT 'title' AS f, doc_id, regexp_extract_all(lower(title), '{TOK}') AS t FROM docs UNION ALL SELECT 'content', doc_id, regexp_extract_all(lower(content), '{TOK}') FROM docs),
  len AS (SELECT f, doc_id, len(t) AS length FROM lists WHERE len(t) > 0), st AS (SELECT f, count(*) AS n, avg(length) AS mean FROM len GROUP BY f),
  tok AS (SELECT f, doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM lists), tf AS (SELECT f, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
  df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY ALL),
  sc AS (SELECT f, doc_id, term, (CASE f WHEN 'title' THEN 2.0 ELSE 1.0 END) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS s
    FROM tf JOIN df USING (f, term) JOIN len USING (f, doc_id) JOIN st USING (f))"""
IN = "(" + ", ".join(f"'{w}'" for w in WORDS) + ")"
RANKED = f"r AS (SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN {IN} GROUP BY doc_id), h AS (SELECT path, url, score FROM r JOIN docs USING (doc_id))"


def _page(offset: int) -> str:
    return f"""WITH {BASE}, {RANKED}, top AS (SELECT * FROM h ORDER BY score DESC, path, url LIMIT 30 OFFSET {offset}),
  one AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, url) AS k FROM top) SELECT path, url, score FROM one WHERE k = 1 ORDER BY score DESC, path LIMIT 10"""


def _leaf(w: str) -> str:
    return f"max(CASE WHEN term = '{w}' THEN 1 ELSE 0 END)"


ORACLE_SQL = {
    "tokens_exact": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOK}')) AS token FROM documents) GROUP BY token",
    "tokens_whitespace": r"SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \t-\r]+')) AS token FROM documents) WHERE token <> '' GROUP BY token",
    "tokens_ngram": """WITH t AS (SELECT lower(regexp_extract(html, '<title>(.*?)</title>', 1)) AS t FROM pages), g AS (SELECT substr(t, i, n) AS token, i, n, length(t) AS l
        FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM t), range(2, 5) x(n)) SELECT token, count(*) AS n FROM g WHERE i + n - 1 <= l GROUP BY token""",
    "term_df": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOK}'))) AS term FROM documents) GROUP BY term",
    "word_count": r"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS words FROM documents",
    "search_text": _page(0),
    "search_page2": _page(10),
    "search_scores": f"WITH {BASE}, {RANKED} SELECT doc_id, score FROM r",
    "search_total": f"WITH {BASE}, {RANKED} SELECT count(*) AS total FROM r",
    "search_filtered": f"WITH {BASE}, {RANKED} SELECT doc_id, score FROM r JOIN docs USING (doc_id) WHERE domain = 'spam-farm.example.org'",
    "search_field": f"WITH {BASE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE f = 'title' AND term = 'the' GROUP BY doc_id",
    "search_boolean": f"WITH {BASE} SELECT doc_id, round(sum(CASE WHEN term IN ('the', 'was') THEN s ELSE 0 END), 6) AS score FROM sc WHERE term IN ('the', 'was', 'edst') GROUP BY doc_id HAVING {_leaf('the')} = 1 AND {_leaf('was')} = 1 AND {_leaf('edst')} = 0",
    "search_boolean_or": f"WITH {BASE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('the', 'edst', 'hehe') GROUP BY doc_id HAVING ({_leaf('edst')} = 1 OR {_leaf('hehe')} = 1) AND {_leaf('the')} = 1",
    "search_phrase": f"""WITH {BASE}, ph AS (SELECT a.f, a.doc_id, count(*) AS tf FROM tok a JOIN tok b ON a.f = b.f AND a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY ALL),
        idf AS (SELECT f, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df JOIN st USING (f) WHERE term IN ('of', 'the') GROUP BY f)
        SELECT doc_id, round(sum((CASE f WHEN 'title' THEN 2.0 ELSE 1.0 END) * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM ph JOIN idf USING (f) JOIN len USING (f, doc_id) JOIN st USING (f) GROUP BY doc_id""",
    "search_fuzzy": f"WITH {BASE} SELECT doc_id, CAST(count(DISTINCT f) AS DOUBLE) AS score FROM tf WHERE damerau_levenshtein(term, 'theth') <= 1 GROUP BY doc_id",
    "dedupe_by_path": "SELECT path, url, score FROM (SELECT source AS path, 'u' || doc_id AS url, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, 'u' || doc_id) AS k FROM documents) WHERE k = 1",
    "upsert_docs": """WITH new AS (SELECT 'u' || (doc_id + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1000000 END) AS url, -n_chars AS n_chars FROM documents WHERE doc_id % 7 = 0)
        SELECT 'u' || doc_id AS url, n_chars FROM documents WHERE 'u' || doc_id NOT IN (SELECT url FROM new) UNION ALL SELECT * FROM new""",
    "delete_docs": "SELECT 'u' || doc_id AS url, n_chars FROM documents WHERE doc_id % 5 <> 0",
    "index_stats": r"SELECT count(*) AS num_documents, CAST(coalesce(sum(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''))), 0) AS BIGINT) AS words, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes FROM documents",
}
