"""Queries on pages and their link graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import codelang, mdtext
from webloom.functions import urls as U
from webloom.operators import crawl, links, pages

START, EXCLUDE = "https://blog.tiontion.example.com/en", ["*/en/9*", "page="]
ALLOWED = ["example.com"]


def _pages(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select(*(cols or ("page_id", "url")))


# SQL twins of the URL functions.
SCH, AUT = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))", "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
HOST = f"lower(regexp_replace(regexp_replace({AUT}, '^.*@', ''), ':[0-9]*$', ''))"
PORT0 = f"regexp_extract({AUT}, ':([0-9]+)$', 1)"
PORT = f"(CASE WHEN {SCH} = 'http' AND {PORT0} = '80' OR {SCH} = 'https' AND {PORT0} = '443' THEN '' ELSE {PORT0} END)"
PATH = "(CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END)"
QUERY = r"(CASE WHEN regexp_matches(url, '^[^?#]*\?') THEN '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) ELSE '' END)"
FRAG = "(CASE WHEN contains(url, '#') AND NOT url LIKE '%#' THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END)"
ORIGIN = f"{SCH} || '://' || {HOST} || CASE WHEN {PORT} = '' THEN '' ELSE ':' || {PORT} END"
NORM = f"(CASE WHEN {HOST} <> '' THEN {ORIGIN} || CASE WHEN {PATH} <> '/' THEN regexp_replace({PATH}, '/$', '') ELSE {PATH} END || {QUERY} ELSE lower(url) END)"
N_PAGES = f"norm AS (SELECT page_id, {NORM} AS url, {HOST} AS host FROM pages)"
EDGES = f"{N_PAGES}, edges AS (SELECT DISTINCT a.url AS source_url, b.url AS target_url FROM norm a, range(1, 4) k(k), (SELECT count(*) AS n FROM pages) c JOIN norm b ON b.page_id = (a.page_id * 7 + k.k) % c.n)"


def url_normalize(spark, d):
    return _pages(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


def url_domain_variants(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.link_domain(u).alias("link_domain"), U.rate_domain(u).alias("rate_domain"), U.breaker_domain(u).alias("breaker_domain"), U.index_domain(u).alias("index_domain"))


def url_keys(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.cache_key(u).alias("cache_key"), U.download_key(u).alias("download_key"), U.output_dir(u).alias("output_dir"), U.html_path_to_markdown(U.path(u)).alias("md_path"), U.fragment(u).alias("fragment"))


def mirror_path(spark, d):
    p = U.mirror_path(F.col("url"), "/out", "index.md.gz")
    return _pages(spark, d).select("page_id", p.alias("mirror"), U.uri_from_path(p, "/out").alias("uri"), U.url_from_index_path(p, "/out").alias("index_url"))


def scope_filter(spark, d):
    start = "https://blog.ththan.example.net/en"
    return _pages(spark, d).select("page_id", U.in_scope(F.col("url"), start, ["example.net"], EXCLUDE).alias("in_scope"), U.in_scope(F.col("url"), "http://blog.ththan.example.net/").alias("root_scope"))


def exclude_patterns(spark, d):
    return _pages(spark, d).select("page_id", U.excluded(F.col("url"), EXCLUDE).alias("excluded"), U.is_valid_url(F.col("url")).alias("valid"))


def url_parts(spark, d):
    """URLs with other parts: to plain http, to one host and port, one more part of the path, another query, no fragment."""
    u, lit = F.col("url"), F.lit
    return _pages(spark, d).select(
        "page_id", U.with_parts(u, scheme=lit("http"), port=lit("80")).alias("plain"), U.with_parts(u, host=lit("Mirror.test"), port=lit(8080), user=lit("me:x")).alias("mirrored"),
        U.with_parts(u, path=F.concat(U.path(u), lit("more")), query=lit(""), fragment=lit("top")).alias("further"), F.size(U.path_segments(u)).alias("segments"),
    )


def pages_by_domain(spark, d):
    return _pages(spark, d).groupBy(U.link_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


def extract_links(spark, d):
    return pages.page_links(_pages(spark, d, "page_id", "url", "html")).select("page_id", "target")


def external_links(spark, d):
    got = pages.extract_pages(_pages(spark, d, "page_id", "url", "html"))
    return got.select("page_id", F.size("links").alias("links"), F.size(F.filter("links", lambda x: x["is_external"])).alias("external"))


def page_metadata(spark, d):
    got = pages.extract_pages(_pages(spark, d, "page_id", "url", "html"))
    return got.select("page_id", F.col("metadata.title").alias("title"), F.col("metadata.language").alias("language"), F.size("headings").alias("headings"), F.col("security.https").alias("https"), F.size("resources.scripts").alias("scripts"))


def heading_ordinals(spark, d):
    got = pages.extract_pages(_pages(spark, d, "page_id", "url", "html"))
    return got.select("page_id", F.explode("headings").alias("h")).select("page_id", "h.level", "h.text", F.concat_ws(".", F.transform("h.ordinal", lambda x: x.cast("string"))).alias("ordinal"))


def html_to_markdown(spark, d):
    return pages.to_markdown(_pages(spark, d, "page_id", "url", "html"))


def page_documents(spark, d):
    return pages.documents(_pages(spark, d, "page_id", "url", "html")).select("doc_id", "url", "title", "snippet", "word_count", "file_size", "path", "domain")


def markdown_plaintext(spark, d):
    return pages.documents(_pages(spark, d, "page_id", "url", "html")).select("doc_id", "content", "word_count")


def code_language(spark, d):
    """Documents as if they were code: which look like a language."""
    @F.pandas_udf("string")
    def guess(text: pd.Series) -> pd.Series:
        return text.map(lambda t: (codelang.infer(t) or (None,))[0])

    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", guess("text").alias("language"))


def snippets(spark, d):
    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(mdtext.snippet)

    # More characters than the limit has bytes: what follows changes nothing and stays in the JVM.
    begin = F.substring("text", 1, mdtext.SNIPPET_BYTES + 1)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", cut(begin).alias("snippet"))


def content_etag(spark, d):
    return _pages(spark, d, "page_id", "html").select("page_id", pages.etag("html").alias("etag"))


# --- link graph: page i links to pages (7 i + k) mod n, k = 1, 2, 3 ------------------------------------------------


def _graph(spark, d):
    p = _pages(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("url"), U.link_domain(F.col("url")).alias("domain"))
    n = p.count()
    out = p.select(F.col("url").alias("source_url"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "page_id").withColumn("to", (F.col("page_id") * 7 + F.col("k")) % n)
    edges = out.join(p.select(F.col("page_id").alias("to"), F.col("url").alias("target_url")), "to").select("source_url", "target_url").distinct()
    known = p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.first("domain").alias("domain")).select("url", F.concat(F.lit("/out/"), "page_id", F.lit("/index.html")).alias("local_path"), "domain", F.lit(None).cast("timestamp").alias("saved_at"))
    return known, edges


def _first(spark, d):
    return _pages(spark, d).where("page_id = 10").first()["url"]


def link_counts(spark, d):
    return links.counts(*_graph(spark, d))


def inbound_links(spark, d):
    p, e = _graph(spark, d)
    return links.inbound(e, p, _first(spark, d))


def outbound_links(spark, d):
    return links.outbound(_graph(spark, d)[1], _first(spark, d))


def filter_existing(spark, d):
    p, _ = _graph(spark, d)
    asked = _pages(spark, d).select(F.concat("url", F.lit("#x")).alias("url")).unionByName(spark.createDataFrame([("https://nowhere.example/",)], "url string"))
    return links.existing(asked, p)


def frontier_anti(spark, d):
    """Link targets that are not visited yet; visited are the pages with an even id, as a crawl under way has them."""
    p, e = _graph(spark, d)
    seen = _pages(spark, d).where("page_id % 2 = 0").select(U.normalize_url(F.col("url")).alias("url"))
    return crawl.unvisited(e.select(F.col("target_url").alias("url")).distinct(), seen)


def bfs_depth(spark, d):
    return crawl.bfs(_graph(spark, d)[1], [_first(spark, d)], 3)


def link_register(spark, d):
    p, e = _graph(spark, d)
    url = _first(spark, d)
    saved = spark.createDataFrame([(url, "/new/index.html")], "url string, local_path string").withColumn("saved_at", F.lit("2024-01-01").cast("timestamp"))
    fresh = spark.createDataFrame([(url, "https://nowhere.example/"), (url, "https://nowhere.example"), (url, url)], "source_url string, target_url string")
    return links.register(p, e, saved, fresh)[1]


def link_fan_out(spark, d):
    p, e = _graph(spark, d)
    got = links.to_rewrite(e, p, _pages(spark, d).select("url").unionByName(spark.createDataFrame([("https://nowhere.example/",)], "url string")))
    return got.select("source_url", F.size("targets").alias("targets"))


def link_rewrite(spark, d):
    p, e = _graph(spark, d)
    pairs = p.join(e, F.col("url") == F.col("source_url")).groupBy("url", "local_path").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_set("target_url")), lambda t: F.concat(F.lit('<a href="'), t, F.lit('">x</a>')))).alias("html"))
    return links.rewrite_links(pairs, e, p).select("url", "n_links", "text")


def page_saved(spark, d):
    """Pages whose files link to one just saved, which links to itself and to two others, and those it links to."""
    p, e = _graph(spark, d)
    url = _first(spark, d)
    saved = spark.createDataFrame([(url, "/new/index.html")], "url string, local_path string").withColumn("saved_at", F.lit("2024-01-01").cast("timestamp"))
    other = _pages(spark, d).where("page_id = 20").first()["url"]
    fresh = spark.createDataFrame([(url, url), (url, other), (url, "https://nowhere.example/")], "source_url string, target_url string")
    _, _, out, back = links.on_page_saved(p, e, saved, fresh)
    return back.select(F.lit("in").alias("side"), F.col("source_url").alias("url")).unionByName(out.select(F.lit("out").alias("side"), F.col("target_url").alias("url")))


def valid_outlinks(spark, d):
    return pages.valid_outlinks(_pages(spark, d, "page_id", "url", "html"), "https://blog.tionsh.example.net/")


QUERIES = {f.__name__: f for f in (
    url_normalize, url_domain_variants, url_keys, url_parts, mirror_path, scope_filter, exclude_patterns, pages_by_domain, extract_links, external_links, page_metadata, heading_ordinals, html_to_markdown,
    page_documents, markdown_plaintext, code_language, snippets, content_etag, link_counts, inbound_links, outbound_links, filter_existing, frontier_anti, bfs_depth, link_register,
    link_fan_out, link_rewrite, page_saved, valid_outlinks,
)}

FIRST = f"(SELECT {NORM} FROM pages WHERE page_id = 10)"
MIRROR = f"'/out/' || {HOST} || CASE WHEN regexp_replace({PATH}, '^/+|/+$', '', 'g') <> '' THEN '/' || regexp_replace({PATH}, '^/+|/+$', '', 'g') ELSE '' END || '/index.md.gz'"
EXCL = "(contains(url, '*/en/9*') OR regexp_matches(url, '^.*/en/9.*$') OR contains(url, 'page=') OR regexp_matches(url, '^page=$'))"


def _scope(scheme: str, host: str, base: str) -> str:
    return f"{SCH} = '{scheme}' AND {HOST} = '{host}' AND (regexp_replace({PATH}, '/+$', '') = '{base}' OR starts_with({PATH}, '{base}/'))"

#: The pages' HTML by hand, without a parser: blocks after the navigation, each on a line; a line that ends like a table row is one.
LINES = r"""b AS (
  SELECT page_id, url, string_split_regex(regexp_replace(regexp_extract(html, '(?s)</nav>(.*?)(?:<footer>|$)', 1), '(?s)<!--.*?-->', '', 'g'), '</?(?:div|article|p|br)[^>]*>') AS parts FROM pages
), u AS (
  SELECT page_id, url, unnest(parts) AS x, generate_subscripts(parts, 1) AS k FROM b
), t AS (
  SELECT page_id, url, k, CASE WHEN x LIKE '<h1>%' THEN '# ' WHEN x LIKE '<b>%' THEN '**' ELSE '' END AS mark,
    trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '</?(?:h1|b)>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS y FROM u
), blocks AS (
  SELECT page_id, url, k, y, mark, mark || replace(y, '*', '\*') || CASE WHEN mark = '**' THEN mark ELSE '' END AS z FROM t WHERE y <> ''
), lines AS (
  SELECT *, CASE WHEN is_row THEN '| ' || array_to_string(cells, ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(cells)) ELSE z END AS line,
    replace(CASE WHEN is_row THEN replace(array_to_string(cells, ' '), '**', '') ELSE regexp_replace(replace(z, '**', ''), '^# ', '') END, '\*', '\') AS plain
  FROM (SELECT *, z LIKE '%|%|' AS is_row, list_filter(list_transform(string_split(z, '|'), lambda w: trim(w)), lambda w: w <> '') AS cells FROM blocks)
), md AS (
  SELECT p.page_id, p.url, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY k), '') AS markdown, trim(regexp_replace(coalesce(string_agg(plain, ' ' ORDER BY k), ''), '\s+', ' ', 'g')) AS content,
    arg_min(y, k) FILTER (mark = '# ' AND NOT is_row) AS header, arg_min(regexp_replace(y, '\*+', ' ', 'g'), k) FILTER (strlen(line) > 3 AND NOT is_row) AS first_line
  FROM pages p LEFT JOIN lines USING (page_id) GROUP BY 1, 2
)"""
WORDS = r"len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> ''))"
TITLE = r"CASE WHEN header IS NOT NULL THEN header WHEN first_line IS NULL THEN 'Untitled' WHEN length(first_line) <= 80 THEN first_line ELSE rtrim(coalesce(nullif(regexp_extract(left(first_line, 77), '^(.*)[ ,;:-]', 1), ''), left(first_line, 77))) || '...' END"


def _snippet(text: str) -> str:
    """By the bytes of prefixes: sentences, else words, else the characters that begin before byte 197."""
    fits = f"left({text}, CAST(list_max(list_filter(range(0, 201), lambda n: strlen(left({text}, CAST(n AS INT))) <= 200)) AS INT))"
    begun = f"left({text}, CAST(list_max(list_filter(range(0, 198), lambda n: n = 0 OR strlen(left({text}, CAST(n - 1 AS INT))) < 197)) AS INT))"
    sentences, words = r"(?s)^.*(?:\.\.\.|…|[.!?][\"'')\]]|[.!?][ \n])", r"(?s)^.*[ \t\n\r.,;:!?\-–—_/\\|()\[\]{}<>\"''`]"
    return f"""CASE WHEN {text} IS NULL THEN '' WHEN strlen({text}) <= 200 THEN {text}
      WHEN regexp_matches({fits}, '{sentences}') THEN regexp_replace(regexp_extract({fits}, '{sentences}', 0), '[ \\n]$', '')
      WHEN regexp_extract({fits}, '{words}', 0) NOT IN ('', {fits}) THEN regexp_extract({fits}, '{words}', 0) || '...'
      ELSE {begun} || '...' END"""


ORACLE_SQL = {
    "url_normalize": f"SELECT page_id, {NORM} AS normalized FROM pages",
    "url_domain_variants": f"""SELECT page_id, {HOST} AS link_domain, lower(regexp_replace(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#:]*)', 1), '^www\\.', '')) AS rate_domain,
        nullif({HOST}, '') AS breaker_domain, regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*)', 1) AS index_domain FROM pages""",
    "url_keys": f"""SELECT page_id, CASE WHEN {HOST} <> '' THEN {SCH} || '://' || {HOST} || CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END END AS cache_key,
        CASE WHEN {HOST} <> '' THEN {ORIGIN} || regexp_replace({PATH}, '/+$', '') || {QUERY} ELSE url END AS download_key, replace({HOST}, '..', '_') AS output_dir,
        replace(replace({PATH}, '/index.html', '/index.md'), '.html', '.md') AS md_path, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""",
    "url_parts": f"""SELECT page_id, 'http://' || {HOST} || {PATH} || {QUERY} || {FRAG} AS plain, {SCH} || '://me:x@mirror.test:8080' || {PATH} || {QUERY} || {FRAG} AS mirrored,
        {SCH} || '://' || {HOST} || CASE WHEN {PORT} = '' THEN '' ELSE ':' || {PORT} END || {PATH} || 'more#top' AS further, len(string_split({PATH}, '/')) - 1 AS segments FROM pages""",
    "mirror_path": f"""SELECT page_id, {MIRROR} AS mirror, 'https://' || regexp_replace(substr({MIRROR}, 6), '/[^/]*$', '') AS uri,
        'https://' || regexp_replace(substr({MIRROR}, 6), '/[^/]*$', '') || '/' AS index_url FROM pages""",
    "scope_filter": f"""SELECT page_id, {_scope("https", "blog.ththan.example.net", "/en")} AND NOT {EXCL} AS in_scope, {_scope("http", "blog.ththan.example.net", "")} AS root_scope FROM pages""",
    "exclude_patterns": f"SELECT page_id, {EXCL} AS excluded, {SCH} IN ('http', 'https') AND {HOST} <> '' AS valid FROM pages",
    "pages_by_domain": f"SELECT {HOST} AS domain, count(*) AS pages FROM pages GROUP BY 1",
    "extract_links": f"SELECT DISTINCT page_id, {SCH} || '://' || {AUT} || href AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM pages)",
    "page_metadata": f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS headings, {SCH} = 'https' AS https,
        len(regexp_extract_all(html, '<script[^>]* src=')) AS scripts FROM pages""",
    "external_links": f"SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS links, len(list_filter(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda x: contains(x, '://') AND lower(regexp_extract(x, '://([^/:?#]*)', 1)) <> {HOST})) AS external FROM pages",
    "heading_ordinals": f"WITH {LINES} SELECT page_id, 1 AS level, y AS text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS VARCHAR) AS ordinal FROM blocks WHERE mark = '# '",
    "html_to_markdown": f"WITH {LINES} SELECT page_id, url, markdown FROM md",
    "page_documents": f"WITH {LINES} SELECT page_id AS doc_id, url, {TITLE} AS title, {_snippet('content')} AS snippet, {WORDS} AS word_count, strlen(markdown) AS file_size, replace({MIRROR}, '/out/', '/data/') AS path, regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*)', 1) AS domain FROM md",
    "markdown_plaintext": f"WITH {LINES} SELECT page_id AS doc_id, content, {WORDS} AS word_count FROM md",
    "snippets": f"SELECT doc_id, {_snippet('text')} AS snippet FROM documents",
    "link_counts": f"WITH {EDGES} SELECT (SELECT count(DISTINCT url) FROM norm) AS pages, (SELECT count(*) FROM edges) AS links",
    "inbound_links": f"WITH {EDGES} SELECT source_url AS url, '/out/' || (SELECT min(page_id) FROM norm WHERE norm.url = source_url) || '/index.html' AS local_path FROM edges WHERE target_url = {FIRST}",
    "outbound_links": f"WITH {EDGES} SELECT target_url FROM edges WHERE source_url = {FIRST}",
    "filter_existing": f"WITH {N_PAGES} SELECT DISTINCT url FROM norm",
    "frontier_anti": f"WITH {EDGES} SELECT DISTINCT target_url AS url FROM edges WHERE target_url NOT IN (SELECT url FROM norm WHERE page_id % 2 = 0)",
    "bfs_depth": f"""WITH RECURSIVE {EDGES}, walk(url, depth) AS (SELECT {FIRST}, 0 UNION SELECT e.target_url, w.depth + 1 FROM walk w JOIN edges e ON e.source_url = w.url WHERE w.depth < 3)
        SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
    "link_register": f"WITH {EDGES} SELECT source_url, target_url FROM edges WHERE source_url <> {FIRST} UNION ALL SELECT {FIRST}, 'https://nowhere.example/' UNION ALL SELECT {FIRST}, {FIRST}",
    "link_fan_out": f"WITH {EDGES} SELECT source_url, count(DISTINCT target_url) AS targets FROM edges WHERE target_url IN (SELECT url FROM norm) GROUP BY source_url",
    "page_saved": f"""WITH {EDGES}, after AS (SELECT * FROM edges WHERE source_url <> {FIRST} UNION SELECT {FIRST}, {FIRST} UNION SELECT {FIRST}, (SELECT {NORM} FROM pages WHERE page_id = 20))
        SELECT DISTINCT 'in' AS side, source_url AS url FROM after WHERE target_url = {FIRST} UNION ALL SELECT DISTINCT 'out', target_url FROM after WHERE source_url = {FIRST}""",
    "valid_outlinks": f"SELECT DISTINCT page_id, {SCH} || '://' || {AUT} || href AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM pages WHERE {SCH} = 'https' AND {HOST} = 'blog.tionsh.example.net')",
    "link_rewrite": f"""WITH {EDGES}, own AS (SELECT url, min(page_id) AS id FROM norm GROUP BY url)
        SELECT e.source_url AS url, count(*) AS n_links, string_agg('<a href="' || CASE WHEN e.source_url = e.target_url THEN '' ELSE '../' || t.id || '/' END || 'index.html">x</a>', ' ' ORDER BY e.target_url) AS text
        FROM edges e JOIN own t ON t.url = e.target_url GROUP BY e.source_url""",
}
