"""Main text of pages, and the wrappers it rests on."""

from __future__ import annotations

import json

import pytest

from flowguard.llm import markup, wrappers

PAGE = ('<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>m</li><li>n</li></ul></nav>'
        '<!-- ad --><div class="ad">Buy</div><article><h1>T</h1><p><b>One &amp; two.<br>x<p>Th&eacute;   ree\n</p>%s</article><footer>&copy; f</footer>')

CASES = [
    (PAGE % "", "T\n\nOne & two. x\n\nThé ree"),
    (PAGE % "<aside>s</aside><div class='comments'><article>c</article></div><form>f<input></form><p>end", "T\n\nOne & two. x\n\nThé ree\n\nend"),
    ("<article>a&lt;b&gt; &amp;lt; c&nbsp;d</article>", "a<b> &lt; c d"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul></article>", "1\n\n2\n\n3\n\nx\n\ny"),
    ("<article><p>a</p>loose<p>b<!-- c --> d</p><pre> k\n l </pre></article>", "a\n\nloose\n\nb d\n\nk l"),
    ("<article><p>unclosed <i>inline <p>next", "unclosed inline\n\nnext"),
    ("<main><p>m</p></main><p>out</p>", "m"),
    ("<div id=content><p>long long long text here</p><p>more text of it</p></div><div id=sidebar>side</div>", "long long long text here\n\nmore text of it"),
    ("just text", "just text"),
    ("", ""),
    (None, ""),
    ("<script>only", ""),
    ("<article>1 < 2 and a<b", "1 < 2 and a"),
    ("<article><p>x</p></article><article><p>y</p></article>", "x\n\ny"),
    ("<article><![CDATA[raw & data]]></article>", "raw & data"),
    ("<article><div class='cookie-notice'>c</div><div class=adventure>kept</div><section id=share-bar>s</section></article>", "kept"),
    ("<div id=post-17><p>kept</p><div class=commentList>c</div><div class='ad2 x'>a</div></div><div class=footerBox>f</div>", "kept"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ("<article title='a > b'><p title=\"x>y\">q</p></article>", "q"),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_text_of_a_page(spark, number):
    page, want = CASES[number]
    rows = spark.createDataFrame([(1, "http://h.com/1", page)], "page_id long, url string, html string")
    row = wrappers.extract_pages(rows).first()
    assert (row.text, row.n_chars) == (want, len(want))


def test_all_pages_of_a_host_share_a_wrapper(spark):
    rows = [(i, f"http://h.com/{i}", PAGE % ("<p>p</p>" * (i % 4) + ("<ul><li>a</ul>" if i % 5 == 0 else ""))) for i in range(40)]
    rows += [(100, None, "<div><p>a b c</p></div>"), (101, "http://empty.com/", None), (101, "http://empty.com/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosted = frame.selectExpr("coalesce(regexp_extract(url, '//([^/]*)', 1), '') as host", "html")
    for fan in (2, 64):
        found = {r.host: r for r in wrappers.infer(hosted, fan=fan).collect()}
        assert found["h.com"].pages == 40 and found["h.com"].paths == ["html>body>article"]
        assert "<article><h1>#</h1>(<p>#</p>)+(<ul>(<li>#</li>)" in found["h.com"].expression.replace("*", "+") or "(<ul>" in found["h.com"].expression
        assert "empty.com" not in found
    texts = {r.page_id: r.text for r in wrappers.extract_pages(frame).collect()}
    assert texts[3] == "T\n\nOne & two. x\n\nThé ree\n\np\n\np\n\np" and texts[100] == "a b c" and texts[101] == ""
    assert len(texts) == 42


def test_numbered_ids_do_not_part_the_pages_of_a_host(spark):
    rows = [("h", f"<div id=post-{i} class='css-{i}x'><p id=p{i}>text {i}</p></div><div class='side bar{i}'>s</div>") for i in range(50)]
    row = wrappers.infer(spark.createDataFrame(rows, "host string, html string")).first()
    assert (row.pages, row.expression, row.paths) == (50, "<div.post><p>#</p></div><div>#</div>", ["div.post"])


def test_templates_of_one_host_keep_their_whole_articles(spark):
    plain = "<html><body><div><h1>Head {0}</h1><p>one long paragraph of the article number {0}</p><ul><li>item</li></ul><blockquote>quote</blockquote></div></body></html>"
    whole = "Head {0}\n\none long paragraph of the article number {0}\n\nitem\n\nquote"
    cases = [("<html><body><article><p>a {0}</p></article><p>out</p></body></html>", "a {0}"), ("<html><body><main><p>m {0}</p></main><p>out</p></body></html>", "m {0}"),
             ("<html><body><div id=entry-{0}><p>d {0}</p></div><p>out</p></body></html>", "d {0}"), (plain, whole),
             ("<html><body class='has-sidebar'><article class='post comments-open'><p>b {0}</p><article class=comment>c</article></article></body></html>", "b {0}")]
    rows = [(10 * k + i, host, page.format(i)) for k, (page, _) in enumerate(cases) for i in range(3) for host in ("http://mixed.com/",)]
    rows += [(100, "http://plain.com/", plain.format(1)), (101, "http://plain.com/", plain.format(2)), (102, "http://class.com/", cases[4][0].format(0))]
    found = {r.page_id: r.text for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: t for i, t in found.items() if i < 100} == {10 * k + i: want.format(i) for k, (_, want) in enumerate(cases) for i in range(3)}
    assert (found[100], found[101], found[102]) == (whole.format(1), whole.format(2), "b 0")


def test_alignment_generalises():
    shape = lambda page: wrappers.shape(markup.parse(page))
    a, b = shape("<div><p>x</p><p>y</p></div>"), shape("<div><h2>t</h2><p>x</p></div>")
    merged = wrappers.align(a, b)
    assert wrappers.expression(merged) == "<div>(<h2>#</h2>)?(<p>#</p>)+</div>"
    assert wrappers.align(merged, a) == merged and wrappers.align(merged, b) == merged
    assert wrappers.expression(shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"
    assert wrappers.expression(wrappers.align(shape("<ul><li>a<li>b</ul>"), shape("<p>x"))) == "(<ul>(<li>#</li>)+</ul>)?(<p>#</p>)?"


def test_long_irregular_pages_align_within_bounds():
    a = [["e", f"x{i}", []] for i in range(700)]
    b = [["e", f"y{i}", []] for i in range(700)]
    merged = wrappers.align(a, b)
    assert len(merged) == 1400 and all(n[0] == "?" for n in merged)


def test_deep_and_broken_pages(spark):
    deep = "<article>" + "<div>" * 5000 + "core" + "</div>" * 5000 + "<p>after</p></article><footer>f</footer>"
    odd = ["<" * 3000, "<a " + "x='" * 2000, "</p>" * 2000, "<article>" + "<p>w" * 20_000, deep, "<!--" * 500, "&#x110000; &#0; &bogus; &amp"]
    rows = spark.createDataFrame([(i, "http://h.com", p) for i, p in enumerate(odd)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in wrappers.extract_pages(rows).collect()}
    assert found[4] == "core\n\nafter" and found[3].count("w") == 20_000 and len(found) == len(odd)
    assert json.dumps(found)


def test_pages_of_nothing_and_clashing_columns(spark):
    assert wrappers.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    row = wrappers.extract_pages(spark.createDataFrame([("http://a.com", "<p>x", 5, "h", "w")], "url string, html string, text int, host string, wrapper string")).first()
    assert (row.text, row.n_chars, row.host, row.wrapper) == ("x", 1, "h", "w")
