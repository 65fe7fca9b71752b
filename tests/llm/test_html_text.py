import html
import re

from clausework.llm.html_text import distinct_pages, extract, main_text, op8_html_text, parse


def plain(page):
    """Text of the article element by regular expressions, for the pages of the tables."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page or "", re.S)
    if not inner:
        return ""
    text = re.sub(r"</?b>", "", inner[1])
    return " ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", " ", text)).split())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op8_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html)
        assert r.n_chars == len(r.text)


def page(i, menu="Home About", extra="", article=True):
    body = f"<h1>Story {i} &amp; more</h1><p>First&nbsp;<b>bo</b>ld {i}<br>line<p>Second\n  par {i}"
    wrap = "article" if article else "div class=x"
    return (
        f"<html><head><title>T{i}</title><script>if(a<b){{'</p>'}}</script></head><body><header>Site</header><div class=top><p>{menu}</p></div>{extra}"
        f"<{wrap}>{body}<div class='comments'><p>Nice {i}!</p></div></{wrap.split()[0]}><div id=\"cookie-notice\">We use cookies</div>"
        f"<div><p>Always the same line</p></div><form>Search {i}</form><footer>&copy; {i}</footer></body></html>"
    )


def want(i):
    return f"Story {i} & more First bold {i} line Second par {i}"


def test_elements():
    assert main_text(page(1), set()) == want(1)
    assert main_text("", set()) == "" and main_text("just text &lt;b&gt; 1 < 2", set()) == "just text <b> 1 < 2"
    assert main_text("<p>a<!-- x <p> --><p title='>'>b<style>p{}</style>", set()) == "a b"
    assert main_text("<article>a<article class=comment>c</article></article>", set()) == "a"
    assert main_text("<script>never closed", set()) == ""
    assert len(parse("<p>" * 3000 + "x")[0]) == 1


def test_template_without_semantic_elements(spark):
    rows = [(i, f"http://h.example/{i}", page(i, article=False)) for i in range(12)] + [(50, "http://other.example/", page(50, article=False))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == want(i)
    assert "Always the same line" in got[50]  # one page makes no template


def test_copies_stay_whole(spark):
    rows = [(i, "http://h.example/", page(7 if i < 4 else i)) for i in range(10)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == want(7 if i < 4 else i) for i in range(10))


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, None, "", "x"), (1, "u://h", "<p>" + "long " * 60_000, "x"), (1, "u://h", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "html", "text"]
    assert sorted(len(r.text) for r in got.collect()) == [0, 0, 1, 299_999]
    assert extract(df.where("false")).count() == 0
    by_shuffle = extract(df, broadcast_tokens=-1)
    assert by_shuffle.count() == 4


def test_only_copies_make_no_template(spark):
    """Hosts of 5 equal pages in 5 and of 9 in 10 lose nothing, and a paragraph of the article on every page stays."""
    bare = lambda i: f"<html><body><div><h1>Story {i}</h1><p>First {i}</p><p>Second {i}</p></div></body></html>"
    rows = [(i, "http://five.example/", page(7)) for i in range(5)] + [(10 + i, "http://bare.example/", bare(7)) for i in range(5)]
    rows += [(20 + i, None, bare(7 if i < 9 else i)) for i in range(10)] + [(40 + i, "http://same.example/", page(i).replace("</h1>", "</h1><p>On every page</p>")) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert all(got[i] == want(7) for i in range(5))
    assert all(got[10 + i] == "Story 7 First 7 Second 7" for i in range(5))
    assert all(got[20 + i] == "Story {0} First {0} Second {0}".format(7 if i < 9 else i) for i in range(10))
    assert all(got[40 + i] == want(i).replace("more ", "more On every page ", 1) for i in range(8))


def test_distinct_pages(spark):
    df = spark.createDataFrame([("h", "a"), ("h", "a"), ("g", "a"), ("h", "b"), ("h", None), ("h", "")], "host string, html string")
    for most in (100, -1):
        got = distinct_pages(df, "host", "html", broadcast_copies=most).collect()
        assert sorted((r.host, r.html) for r in got) == [("g", "a"), ("h", ""), ("h", "a"), ("h", "b")]


def test_long_odd_pages():
    """Unclosed tags, raw elements and very deep pages take time and memory in proportion to their length."""
    from time import process_time

    began = process_time()
    assert main_text("<a " * 300_000, set()) == ("<a " * 300_000).strip()
    assert main_text("<script " * 100_000, set()) == ("<script " * 100_000).strip()
    assert main_text("<p>kept" + "<a x=\">\"" * 50_000, set()).startswith("kept")
    assert main_text("x<script>" + "</script " * 100_000, set()) == "x"
    assert main_text("<div>" * 100_000 + "deep" + "</div>" * 50_000 + "</span></section>" * 50_000 + "more", set()) == "deep more"
    assert main_text("<!-- " * 100_000, set()) == ("<!-- " * 100_000).strip() and main_text("a<!-- " * 100_000 + ">", set()) == "a"
    assert process_time() - began < 20


def test_odd_markup():
    assert main_text("<p title=it's>one</p><p>don't</p>", set()) == "one don't"
    assert main_text("<p title=\"a>b\" class='c>d'>x</p><img alt=\"never closed>y<p>z", set()) == "x y z"
    assert main_text("<article><p>E = <math><mi>m</mi></math> <object>plan</object></p><noscript><p>Turn it on</p></noscript></article>", set()) == "E = m plan"


def test_template_decides_on_pages_without_telling_elements(spark):
    """Divisions only, names that tell nothing: what stands at the same place of most different pages of a host is its template, found here by counting."""
    from collections import Counter

    bits = ["Start", "About us", "Write to us", "Weather: fair", "All rights reserved", "Made with care"]

    def bare(i, host):
        top = "".join(f"<div class=b><span>{b} {host}</span></div>" for b in bits[:3])
        story = "".join(f"<div class=c>Part {k} of story {i} at {host}</div>" for k in range(i % 5 + 2))
        return f"<html><body><div class=a>{top}</div><div class=a>{story}</div><div class=a>" + "".join(f"<div class=d>{b} {host}</div>" for b in bits[3:]) + "</div></body></html>"

    rows = [(h * 100 + i, f"http://h{h}.example/{i}", bare(i, h)) for h in range(3) for i in range(20)]
    rows += [(h * 100 + 50 + i, f"http://h{h}.example/copy", bare(1, h)) for h in range(3) for i in range(30)]
    texts = {i: [re.sub(r"<[^>]*>", "", t) for t in re.findall(r"<div class=[bcd]>(.*?)</div>", page)] for i, _, page in rows}
    found = {h: Counter(t for page in {page for i, _, page in rows if i // 100 == h} for t in set(re.findall(r">([^<>]+)<", page))) for h in range(3)}
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        assert got[i] == " ".join(t for t in texts[i] if found[i // 100][t] < 16)
        assert got[i] != main_text(page, set())  # every page changes without the template


def test_names_of_articles(spark):
    """An article element is one whatever it is called, unless it is a reader's comment; the same names still mark other elements."""
    page = "<p>before</p><article {0}><p>The text.</p><div class='share'>share it</div></article>"
    rows = [(i, "http://a/", page.format(n)) for i, n in enumerate(['class="post ad-free"', 'id="social-history"', 'class="notice widget"', ""])] + [(9, "http://a/", "<article>Text.</article><article class='comment even'>I like it</article>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict.fromkeys(range(4), "The text."), 9: "Text."}
