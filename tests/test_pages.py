import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.functions import codelang, extract, mdtext
from webloom.functions.dom import parse
from webloom.functions.markdown import Options, html_to_markdown
from webloom.operators import pages

MD = {
    "<h2>Title <a class='anchor' href='#t'>#</a></h2>": "## Title",
    "<p>a <b>b</b> <i>c</i> <del>d</del> <mark>e</mark> <kbd>K</kbd></p>": "a **b** *c* ~~d~~ **e** `K`",
    "<ul><li>one<ul><li>two</li></ul></li><li>three</li></ul>": "- one\n  - two\n- three",
    "<ol start='4'><li>a</li><li>b</li></ol>": "4. a\n5. b",
    "<blockquote><p>x</p><p>y</p></blockquote>": "> x\n>\n> y",
    "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>": "| A | B |\n|---|---|\n| 1 | 2 |",
    "<pre><code class='language-rust'>fn main() {\n    let x = 1;\n}</code></pre>": "```rust\nfn main() {\n    let x = 1;\n}\n```",
    "<p>1. not * a _list_</p>": "1\\. not \\* a \\_list\\_",
    "<div class='cookie-banner'>x</div><p>y</p><footer>z</footer>": "y",
    "<div class='admonition warning'><p>Careful now</p></div>": "> **Warning:** Careful now",
    "<aside><p>Note</p> Read this</aside>": "> **Note:** Read this",
    "<img src='a.png' alt='pic'><picture><source srcset='x'><img src='b.png'></picture>": "![pic](a.png)![](b.png)",
    "<p>line<br>next</p><hr><p>after</p>": "line  \nnext\n\n* * *\n\nafter",
    "<details><summary>More</summary><p>t</p></details>": "### More\n\nt",
    "<nav><a href='/a'>A</a><a href='/b'>B</a></nav>": "[A](/a)\n[B](/b)",
    "<dl><dt>T</dt><dd>D</dd></dl>": "T\n: D",
    "<p><abbr title='Long'>L</abbr> H<sub>2</sub> <ruby>漢<rt>kan</rt></ruby></p>": "L (Long) H<sub>2</sub> 漢(kan)",
    "<p><i>a</i><em>b</em></p>": "*ab*",
    "<span style='font-weight:bold'>x</span> <code>a`b</code>": "**x** ``a`b``",
    "<p>open <b>never closed<p>next</p>": "open **never closed**\n\nnext",
    "<p aria-label='main email'>kept as paragraphs are no widgets</p>": "kept as paragraphs are no widgets",
    "<div aria-label='main'>over-matched</div>": "",
}


@pytest.mark.parametrize("html", MD)
def test_markdown(html):
    assert html_to_markdown(html) == MD[html]


def test_markdown_options_links_and_fences():
    html = "<p><a href='/x'>t</a> <a href='#f'>f</a> <a href='https://o.org/'>o</a> <img src='i.png' alt='i'></p>"
    assert html_to_markdown(html, Options(base_url="https://e.com/d/")) == "[t](https://e.com/x) [f](#f) [o](https://o.org/) ![i](i.png)"
    assert html_to_markdown(html, Options.text_only()).strip() == "t f o"
    assert html_to_markdown("<pre>a ``` b</pre>") == "````\na ``` b\n````"
    assert html_to_markdown("<x-a>v</x-a>", Options(handlers={"x-a": lambda c, n: f"<{c.children(n)}>"})) == "<v>"
    assert html_to_markdown(None) == html_to_markdown("") == ""
    assert len(html_to_markdown("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_table_formatter_quirks():
    from webloom.functions.markdown import format_tables, is_separator_row, normalize_lines

    assert format_tables("| a | b |\n| --- | --- |\n| 1 |  | 3 |") == "| a | b |\n|---|---|\n| 1 | 3 |"
    assert is_separator_row("|  |  |") and is_separator_row("|---|:-:|") and not is_separator_row("| a |")
    assert normalize_lines("a\n\n\n\n\n# h\n<!-- c -->\n-\n```\n# x\n~~~\ny") == "a\n\n\n# h\n\n```\n# x\n~~~\ny"


def test_headings_links_metadata():
    html = """<html lang=en><head><title> A  B </title><meta name=description content=d1><meta name=description content=d2><meta property=og:author content=o><meta name=keywords content="a, b,,c">
    <link rel=canonical href="/c"><link rel=stylesheet href=s.css><meta http-equiv="Content-Security-Policy" content="x"></head><body><h1 id=a>One</h1><h2>Two</h2><h3>Three</h3><h2>Four</h2><h1>Five</h1>
    <a href="/p#x">P</a><a href="/p#x">again</a><a href="https://o.org:8080/">O</a><a href="mailto:x@y">m</a><a href="#top">t</a><script src=j.js defer></script><img src=i.PNG width=10><video><source src=v.mp4></video>
    <button disabled onclick="f()">B</button><input type=text minlength=2 maxlength=x required><div role=tab>t</div></body></html>"""
    p = extract.page(html, "https://e.com/d/")
    assert [h["ordinal"] for h in p["headings"]] == [[1], [1, 1], [1, 1, 1], [1, 2], [2]] and p["headings"][0]["id"] == "a"
    m = p["metadata"]
    assert (m["title"], m["description"], m["author"], m["keywords"], m["canonical"], m["language"]) == ("A B", "d2", "o", ["a", "b", "c"], "https://e.com/c", "en")
    assert [(x["url"], x["is_external"]) for x in p["links"]] == [("https://e.com/p#x", False), ("https://o.org:8080/", True), ("https://e.com/d/#top", False)]
    assert p["security"]["https"] and p["security"]["csp"] == "x" and p["security"]["x_frame_options"] == ""
    assert p["resources"]["images"][0]["format"] == "png" and p["resources"]["media"][0]["url"] == "https://e.com/d/v.mp4" and p["resources"]["scripts"][0]["defer"]
    kinds = {e["tag"]: e for e in p["interactive"] if e["tag"] != "a"}
    assert kinds["button"]["kind"] == "button" and kinds["button"]["handlers"] == ["onclick"] and kinds["input"]["validation"]["min_length"] == 2 and kinds["input"]["validation"]["max_length"] is None and kinds["div"]["kind"] == "clickable"
    html = "<a href=' https://a.com/x '>1</a><a href=/relative/page>2</a><a href=sibling.html>3</a><a href='javascript:x'>4</a><a href='mailto:a'>5</a><a href='#s'>6</a><a href=''>7</a><a href=/relative/page>8</a>"
    assert extract.static_links(parse(html), "https://e.com/d/") == ["https://a.com/x", "https://e.com/relative/page", "https://e.com/d/sibling.html"]


@pytest.mark.parametrize("code, lang", [
    ("fn main() {\n    let mut x = vec![1];\n    println!(\"{}\", x[0]);\n}", "rust"), ("def f(x):\n    return self.x\n\nif __name__ == '__main__':\n    print(f(1))", "python"), ("package main\n\nimport (\n\t\"fmt\"\n)\n\nfunc main() {\n\tx := 1\n\tfmt.Println(x)\n}", "go"),
    ("SELECT a FROM t WHERE b = 1 ORDER BY c", "sql"), ('{"a": 1, "b": [true]}', "json"), ("<!DOCTYPE html><html></html>", "html"), ("#!/bin/bash\necho hi", "bash"), ("[package]\nname = \"x\"\nversion = \"1\"", "toml"), (".a {\n  color: #fff;\n  margin: 0 2px;\n}", "css"),
    ("public class A {\n  public static void main(String[] a) { System.out.println(1); }\n}", "java"), ("plain words, nothing else", None), ("x", None),
])
def test_code_language(code, lang):
    assert (codelang.infer(code) or (None,))[0] == lang


@pytest.mark.parametrize("code, lang", [
    ("[dependencies]\nserde = 1", "toml"), ("---\nname: x\nage: 1", "yaml"), ('[\n{"a": 1}\n]', "json"), ("FROM debian\nRUN make\nCOPY . /x", "dockerfile"), ("#!/usr/bin/ruby\nx = 1", "ruby"), ("#!/bin/sh\nls", "sh"),
    ("// entry\npackage main\nfunc f() {}", "go"), ("<html lang='en'>x", "html"), ("impl Shape for Square", "rust"), ("x.unwrap_or_else(|| y)?;\nlet z: Arc<Mutex<u8>>;", "rust"), ("SELECT COALESCE(a, 0) FROM t", "sql"),
])
def test_code_language_stages(code, lang):
    assert (codelang.infer(code) or (None,))[0] == lang


def test_code_patterns_are_whole():
    sizes = {lang: sum(map(len, kinds.values())) for lang, kinds in codelang.PATTERNS.items()}
    assert len(sizes) == 19 and sum(sizes.values()) == 1353 and (sizes["rust"], sizes["sql"], sizes["json"]) == (96, 80, 24)


def test_code_hints():
    assert codelang.from_class("hljs language-js x") == "js" and codelang.from_class("brush: sql") == "sql" and codelang.from_class("plain") is None
    assert not codelang.hint_holds("rust", "stack backtrace:\n  x") and codelang.hint_holds("rust", "fn main() {}")


def test_markdown_text():
    assert mdtext.title("<!-- c -->\n```\n# no\n```\n# Real `code` **b**") == "Real code b"
    assert mdtext.title("Set\n===\ntext") == "Set" and mdtext.title("") == mdtext.title(None) == "Untitled" and mdtext.title("# [Guide](x) to y") == "to y"
    assert mdtext.title("word " * 30).endswith("...") and len(mdtext.title("word " * 30)) <= 80
    md = "# H\n\nSome **bold** and [link](u) ![i](j) `c`.\n\n- item\n1. num\n> quote\n\n---\n| a | b |\n|---|---|\n| 1 | 2 |\n\n~~~\n# code *x*\n~~~\n<div>\nin <b>html</b>\n</div>\nend &amp; ~~x~~"
    assert mdtext.plain_text(md) == "H Some bold and link i c. item num quote a b 1 2 # code *x* in html end & x"
    assert mdtext.snippet("é" * 150) == "é" * 99 + "..." and mdtext.snippet("short") == "short" and mdtext.snippet(None) == ""
    assert mdtext.snippet('a "b." ' + "x" * 300) == 'a "b."' and mdtext.snippet("a.b " + "x" * 300) == "a.b ..." and mdtext.snippet("y… a, " + "x" * 300) == "y…" and mdtext.snippet("x" * 199 + " y") == "x" * 197 + "..."
    assert mdtext.snippet("One. " + "x" * 300) == "One." and mdtext.snippet("words " * 60).endswith("words ...")
    assert mdtext.fix_bold_spacing("a ** b ** c") == "a  **b**  c"


def test_page_operators(spark):
    p = spark.createDataFrame([(1, "https://e.com/a", "<title>T</title><h1>Head</h1><p>Body <a href='/b'>b</a></p>"), (2, "https://e.com/b", None)], "page_id long, url string, html string")
    docs = {r.doc_id: r for r in pages.to_documents(pages.to_markdown(p)).collect()}
    assert (docs[1].title, docs[1].content, docs[1].path, docs[1].domain, docs[1].word_count) == ("Head", "Head Body b", "/data/e.com/a/index.md.gz", "e.com", 3)
    assert docs[2].title == "Untitled" and docs[2].content == ""
    assert pages.page_links(p).collect()[0].target == "https://e.com/b"
    assert pages.extract_pages(p).where("page_id = 1").first().metadata.title == "T"
    assert pages.extract_pages(p.where("false")).collect() == []
    tags = p.select(pages.etag(F.col("html")).alias("e")).collect()
    assert tags[0].e.startswith('"') and tags[1].e is None


def test_inlining(spark):
    html = '<link rel="stylesheet" href="/s.css"><img src="a.png"><img src="b.svg"><img src="c.png">'
    p = spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string")
    d = spark.createDataFrame([(1, "css", "https://e.com/s.css", "p{}"), (1, "images", "https://e.com/a.png", "data:x"), (1, "svg", "https://e.com/b.svg", "<svg/>")], "page_id long, kind string, url string, body string")
    r = pages.inline_resources(p, d).first()
    assert r.html == '<style>p{}</style><img src="data:x"><svg/><img src="c.png">' and r.successes == 3 and r.failures == ["https://e.com/c.png"]
    assert extract.image_type(b"\x89PNG\r\n\x1a\n..") == "image/png" and extract.image_type(b"RIFF1234WEBP") == "image/webp" and extract.image_type(b"no") is None


def test_crawl_output(spark, tmp_path):
    from webloom.sources.crawl_output import Limits, Manifest, decompressed, discover, read_markdown

    files = {"example.com": "# Home", "example.com/docs": "# Docs", "example.com/docs/api": "# API", "blog.example.com": "# Blog", "blog.example.com/2024/01/post1": "# Post", "test.com/page": "# Page"}
    for at, text in files.items():
        (tmp_path / at).mkdir(parents=True, exist_ok=True)
        (tmp_path / at / "index.md.gz").write_bytes(gzip.compress(text.encode()))
    for at, raw in (("corrupted.com", b"\x1f\x8b\xff\xff\xff\xff"), ("x.com/node_modules", gzip.compress(b"no")), ("x.com/.git", gzip.compress(b"no")), ("empty.com", b"")):
        (tmp_path / at).mkdir(parents=True, exist_ok=True)
        (tmp_path / at / "index.md.gz").write_bytes(raw)
    found = discover(spark, str(tmp_path))
    assert found.count() == 7
    good, bad = read_markdown(found)
    assert {r.url for r in good.collect()} == {f"https://{k}/" for k in files} and [r.url for r in bad.collect()] == ["https://corrupted.com/"]
    assert decompressed(b"a" * 25_000_000)[1].startswith("size limit") and decompressed(gzip.compress(b"\0" * 1_000_000))[1].startswith("ratio")
    assert decompressed(gzip.compress(b"sentence. " * 300), Limits(max_ratio=1000.0))[0] == "sentence. " * 300 and decompressed(b"\xff\xfe")[1].startswith("utf-8")
    text = "é" * 9000
    assert decompressed(gzip.compress(text.encode()), Limits(max_ratio=1e6))[0] == text
    m = Manifest("7", "https://e.com", "completed", 3)
    m.save(spark, str(tmp_path / "m"))
    assert Manifest.load(spark, str(tmp_path / "m")).pages == 3 and Manifest.load(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("html, md", [
    ("<div class='alert alert-info-x'><p>a</p></div>", "> **Info:** a"), ("<div class='callout tip big'>a</div>", "> **Tip:** a"), ("<div class='callout big tip'>a</div>", "> **Note:** a"),
    ("<div class='markdown-alert markdown-alert-warning'><p>one</p><p>two</p></div>", "> **Warning:** one\n> \n> two"), ("<section><b>Caution</b><p>no *marks*</p></section>", "> **Caution:** no *marks*"),
    ("<div><b>Cautions</b> x</div>", "**Cautions** x"), ("<h2>A <a class=hash-link href='#a'>link</a>B</h2>", "## A B"), ("<h2>A<a href='#a'> Navigate  to header </a></h2>", "## A"),
    ("<h3><div class=heading-wrapper>In<a href='#i'>#</a></div></h3>", "### In"), ("<code><b>fn</b><i>main</i></code>", "`fn main`"), ("<code><b>a</b><i>(b)</i></code>", "`a(b)`"),
    ("<code><b>世</b><i>界a</i><u>b</u></code>", "`世界a b`"), ("<pre><code>x<div>y</div><span>z</span></code></pre>", "```\nx\ny z\n```"),
])
def test_admonitions_headings_and_spacing(html, md):
    assert html_to_markdown(html).strip("\n") == md


@pytest.mark.parametrize("hint, code, holds", [
    ("rust", "thread 'main' panicked at x", False), ("text", "stack backtrace:", True), ("bash", '[package]\nname = "x"', False), ("toml", '[package]\nname = "x"', True),
    ("python", '{"a": 1}', False), ("json", '{"a": 1}', True), ("yaml", "pub struct A {\n  x: u8,\n}", False), ("yaml", "a: b", True), ("sql", "npm install x", False), ("bash", "Get-Item x", False),
])
def test_hints_that_contents_contradict(hint, code, holds):
    from webloom.functions.codelang import hint_holds

    assert hint_holds(hint, code) is holds


def test_page_that_cannot_be_converted(spark, monkeypatch):
    from webloom.functions.markdown import bare_markdown
    from webloom.operators import pages

    assert bare_markdown("<script>x</script><h1>A &amp; B</h1><p>c<b>d</b><br>*e*</p><!-- f -->") == "A & B\n\ncd\n\n\\*e\\*" and bare_markdown(None) == ""
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    got = pages.to_markdown(spark.createDataFrame([(1, "https://e.com/", deep), (2, "https://e.com/2", "<p>y</p>"), (3, None, None)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.markdown) for r in got) == [(1, "x"), (2, "y"), (3, "")]


def test_literals_of_patterns_are_in_every_match():
    """Scores with the literals as a filter are those without it, on texts that the patterns themselves are made of."""
    from webloom.functions.language_patterns import PATTERNS

    assert [codelang.literal(p) for p in (r"\bfn\s+main\(", r"(?i)select", r"a+bc?d", r"(?:impl|trait) x", r"(foo)bar", r"[ab]", r"x{2,}yz")] == ["main(", "", "a", " x", "foobar", "", "yz"]
    plain = [re.sub(r"\[sS]\+?|\[.*?\]|[()\^$?*+|]", " ", p) for kinds in PATTERNS.values() for own in kinds.values() for p in own]
    r = random.Random(4)
    for _ in range(60):
        text = "\n".join(r.choice(plain) for _ in range(40))
        want = {}
        for lang, kinds in PATTERNS.items():
            total = sum(codelang.WEIGHTS[kind] * (1 + (n - 1) // 2) for kind, own in kinds.items() for p in own if (n := min(5, len(re.findall(p, text)))))
            if total > 0:
                want[lang] = total
        assert codelang.scores(text) == want


def test_unterminated_references():
    """As the HTML standard has it: a reference without a semicolon counts before a tag."""
    assert html_to_markdown("<h1>a&amp;&amp</h1>") == "# a&&" and extract.page("<title>a&amp</title>", "https://a.test/")["metadata"]["title"] == "a&"


def test_code_patterns_are_searched_where_they_can_match():
    def brute(code):
        out = {}
        for lang, kinds in codelang.PATTERNS.items():
            hits = [(codelang.WEIGHTS[k], min(5, len(list(re.finditer(p, code))))) for k, ps in kinds.items() for p in ps]
            if (n := sum(w * (1 + (n - 1) // 2) for w, n in hits if n)) > 0:
                out[lang] = n
        return out

    prose = "This is a plain text of some words, which go on and on. " * 40
    assert len(codelang.candidates(prose)) < 100 < len(codelang.table().patterns)
    for code in (prose, "\u017felect a FROM b; \u0130NSERT INTO c", "let let let a = 1; int int\nint x", "fn main() {\n    let mut x: u32 = 1; # a\n}", "#a\n#b", "###", ""):
        assert codelang.scores(code) == brute(code) and list(codelang.scores(code)) == list(brute(code))


def test_snippets_send_only_beginnings_to_python(spark):
    from webloom.plans import web

    assert "substring(text" in web.snippets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_documents_in_one_pass_and_slices(spark):
    from webloom.plans import text

    rows = [(i, f"https://e.com/{i}", f"<h1>T{i}</h1><p>a  \u00a0b {i}\u200b</p>") for i in range(300)]
    p = spark.createDataFrame([*rows, (300, None, None)], "page_id long, url string, html string").coalesce(1)
    assert sorted(pages.documents(p).collect()) == sorted(pages.to_documents(pages.to_markdown(p)).collect())
    plan = text.search_docs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan and plan[plan.index("== Physical Plan") :].count("MapInArrow") == 1
