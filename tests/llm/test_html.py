"""Main text of pages, with and without site templates."""

from __future__ import annotations

import html
import re

import pytest

from tidemark.llm import html_main as hm


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b &amp; c<br>d", "a\nb & c d"),
    ("<nav>menu</nav><article><h1>T</h1><div class='ad'>buy</div><p>x <b>y</b>\n z</p><script>var a='</p>';</script></article><footer>f</footer>", "T\nx y z"),
    ("<header>h</header><div id=main><p>one</p></div><aside>s</aside><form>q<input></form><div class='comment-list'>c</div>", "one"),
    ("<ul><li>a<li>b</ul>", "a\nb"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("a < b and c > d", "a < b and c > d"), ("<p>cut <a href='x", "cut"), ("<p>a<!-- <p>b --></p>c", "a\nc"),
    ("<article><header><h1>Kept</h1></header>t</article>", "Kept\nt"), ("&#233;&eacute;&nbsp;x", "éé x"), ("<div>" * 20_000 + "deep", "deep"),
    ('<body class="has-sidebar"><article><p>Hello world</p></article></body>', "Hello world"), ('<body class="sidebar"><article class="post no-sidebar menu"><p>x</p></article></body>', "x"),
    ('<article><h2 id="related-work">Related work</h2><section id="social-impact"><p>a</p></section><p class="notice">b</p></article>', "Related work\na\nb"),
    ("<article><p>x <math><mi>y</mi></math> <audio>z</audio><canvas>c</canvas></p><noscript>n</noscript><object>o</object></article>", "x y zc\nno"),
    ("<article>" + "<div>" * 450 + "<nav>menu</nav>text", "text"), ("<p>" + "<b>" * 5000 + "t<p>u" + "</i>" * 5000, "t\nu"), ("<li><ul>" + "<div>" * 3000 + "<li>x</li>" * 3000, "\n".join("x" * 3000)),
    ("<article><p>a</p><article class='comment'><p>no</p></article></article>", "a"), ("<article><p>a</p></article><article class=comment>no</article>", "a"), ("<article class='comment'>alone</article>", "alone"),
    ("<form><article>inside</article></form>", "inside"), ("<div hidden>h</div><p>v</p>", "v"), ("<main><p>m</p></main><p>n</p>", "m"), ("<article>a</article> <p>b</p> <article>c</article>", "a\nc"),
])
def test_structure(page, want):
    assert hm.main_text(page) == want


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, hash string, _host string")


def plain_counts(rows, cfg):
    """host to its templates, counted page by page."""
    pages: dict = {}
    for _, url, text, *_ in rows:
        m = re.match(r"https?://([^/]+)", url or "")
        if m:
            page, _, subtrees = hm.page_parts(text)
            pages.setdefault(m[1].lower(), {})[page] = {h for h, *_ in subtrees}
    out = {}
    for host, own in pages.items():
        n: dict = {}
        for hashes in own.values():
            for h in hashes:
                n[h] = n.get(h, 0) + 1
        out[host] = frozenset(h for h, c in n.items() if c >= cfg.least_pages and (c >= cfg.enough_pages or c >= cfg.least_share * len(own)))
    return out


def test_templates_alone_give_the_article(spark):
    """No article tags, no telling names: what recurs goes, what is a page's own stays."""
    top = "<div><div><b>Site {h}</b></div><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></div>"
    side = "<div><h3>Most read</h3><p>one of {h}</p><p>two</p></div>"
    low = "<table><tr><td>All rights of {h}</td></tr></table><p>Write to us</p>"
    rows = []
    for k in range(90):
        h = f"s{k % 2}.org"
        body = f"<div><h1>Story {k}</h1><p>It was told by {k}.</p><div><p>and again {k}</p></div></div>"
        rows.append((k, f"http://{h}/{k}", top.format(h=h) + body + (side.format(h=h) if k % 10 < 2 else "") + low.format(h=h), "x", "y"))
    rows += [(100, None, low.format(h="s0.org"), "x", "y"), (101, "::bad", None, "x", "y"), (102, "http://one.org/", low.format(h="s0.org"), "x", None), rows[0]]
    out = {r.page_id: r for r in hm.extract(pages_of(spark, rows)).collect()}
    assert all(out[k]._text == f"Story {k}\nIt was told by {k}.\nand again {k}" and out[k]._n_lost >= 5 for k in range(90))
    assert out[100]._text == out[102]._text == "All rights of s0.org\nWrite to us" and out[101]._text == "" and out[0].hash == "x" and out[0]._host == "y"
    cfg = hm.TemplateConfig()
    known = plain_counts(rows, cfg)
    for k, url, text, *_ in rows:
        assert out[k]._text == hm.main_text(text, known.get((url or "").split("/")[2] if k != 101 and url else None, frozenset()))
    # a part on few of a large host's pages is a template by its absolute count
    few = hm.TemplateConfig(least_share=0.5, enough_pages=9, broadcast_pages=0, hot_subtrees=1)
    assert {r.page_id: r._text for r in hm.extract(pages_of(spark, rows), few).collect()} == {k: r._text for k, r in out.items()}
    assert hm.extract(pages_of(spark, [])).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, f"http://h.org/{k}", "<div><p>one story</p></div>", "x", "y") for k in range(20)]
    assert all(r._text == "one story" for r in hm.extract(pages_of(spark, rows)).collect())


def test_article_sentences_stay_though_they_recur(spark):
    rows = [(k, f"http://h.org/{k}", f"<article><p>same opening line</p><p>page {k}</p><div class=x>Share this <i>now</i></div></article>", "x", "y") for k in range(20)]
    assert all(r._text == f"same opening line\npage {r.page_id}" for r in hm.extract(pages_of(spark, rows)).collect())


def plain_article(page: str) -> str:
    """The article of a simple page by cutting strings."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|ul|li|div)>", re.sub(r"<br>", " ", re.sub(r"<!--.*?-->|</?b>|</?a[^>]*>", "", inner)))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_query_against_cut_strings(spark, sf_dir):
    import __spark_entry__

    rows = __spark_entry__.queries()["op7_main_text"](spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        assert r.n_chars == len(r.text)
        if not r.n_template_blocks:
            assert r.text == plain_article(pages[r.page_id])
