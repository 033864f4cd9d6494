"""Main text of pages, and templates that recur across a host."""

import random

import pytest

from findspan.llm import webtext

ARTICLE = "<article><h1>T</h1><p>Own {n} words.</p><div class='box2'><p>Join us</p></div><p>Shared line</p></article>"


def test_extract_parts():
    page = (
        '<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>'
        '<nav><ul><li>Menu</ul></nav><div class="wrap sidebar"><article><header><h1>T &amp; x</h1><span>by me</span></header>'
        '<p>one<b> two</p>three<ul><li>a<li>b</ul><script>if (a<b) "</p>"</script><div id="comments"><p>bad</p></div>'
        '<span class="ad">x<span>y</span></span> tail&nbsp;end<!-- no --><p hidden>gone<p>l1<br>l2\n l3</article></div>'
        "<aside>s</aside><form><input>f</form><footer>c</footer>"
    )
    assert webtext.extract(page) == "T & x\none two\nthree\na\nb\ntail end\nl1 l2 l3"
    assert webtext.extract("<p>a<p>b<div>c<br>d</div><script>if(a<b)</script>&lt;e&gt;") == "a\nb\nc d\n<e>"
    assert webtext.extract("") == "" and webtext.extract("plain < text") == "plain < text"
    assert webtext.extract("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


@pytest.mark.parametrize(("page", "text"), [
    ('<article><h2 id="related-work">Related work</h2><p>x</p></article>', "Related work\nx"),
    ('<article><p>a</p><section id="social-history"><h2>Social history</h2><p>b</p></section></article>', "a\nSocial history\nb"),
    ('<article><p class="share-price">12 euros</p></article>', "12 euros"),
    ('<div class="layout no-sidebar"><p>Text</p></div>', "Text"),
    ('<div id="page" class="has-header"><p>Text</p></div>', "Text"),
    ("<article><p>" + "long " * 50 + "</p></article><article><p>short one</p></article>", ("long " * 50).strip() + "\nshort one"),
    ("<article><p>Let <math>x</math> be.</p></article>", "Let x be."),
    ('<article><p class="ad">buy</p><div class="related">more</div><p>t <span class="share-count">9</span></p></article>', "t"),
    ('<p>Own text</p><div class="comments"><p>a reader says very much more than the article</p></div>', "Own text"),
    ('<div class="sidebar-layout"><p>all of the text</p></div><div class="sidebar"><p>menu</p></div>', "all of the text"),
    ('<article><div class="related" id="related">Related</div><section id="related"><h3>Other</h3></section>z</article>', "z"),
])
def test_what_names_say(page, text):
    assert webtext.extract(page) == text


def test_templates_equal_a_plain_count(spark):
    """Subtrees on at least eight pages of a host with different main texts, counted in one dictionary."""
    rng = random.Random(12)
    boxes = [f"<div><p>box {k}</p><ul><li>{k}</ul></div>" for k in range(12)]
    rows = []
    for n in range(120):
        own = f"<p>Page {n % 70} tells {rng.random() if n % 3 else 0}</p>"
        rows.append((n, f"http://{'ab'[n % 2]}.example/{n}", "<div>" + own + "".join(rng.sample(boxes, rng.randint(0, 5))) + "</div>"))
    seen = {}
    for _, url, page in rows:
        main, found = webtext.subtrees(page)
        for digest in found:
            seen.setdefault((url[7], digest), set()).add(main)
    want = {n: webtext.extract(page, frozenset(d for (h, d), mains in seen.items() if h == url[7] and len(mains) >= 8)) for n, url, page in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in webtext.extract_main_text(pages).collect()}
    assert got == want and any("box" not in t for t in got.values())


def test_templates_of_a_host_go_and_copies_are_no_template(spark):
    rows = [(n, f"http://a.example/{n}", ARTICLE.format(n=n)) for n in range(12)]
    rows += [(100 + n, f"http://b.example/{n}", ARTICLE.format(n=0)) for n in range(12)]  # copies of one page
    rows += [(200 + n, f"http://c.example/{n}", f"<div>top bar</div><p>Text {n}</p><div>bottom</div>") for n in range(9)]
    rows += [(300, None, None), (301, "no host", ""), (302, "http://a.example/x", "<p>" + "long " * 50_000), (300, None, None), (None, None, "k")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = {}
    for r in webtext.extract_main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert all(got[n][0].text == f"T\nOwn {n} words.\nShared line" for n in range(12))
    assert all(got[100 + n][0].text == "T\nOwn 0 words.\nJoin us\nShared line" for n in range(12))
    assert all(got[200 + n][0].text == f"Text {n}" for n in range(9))
    assert len(got[300]) == 2 and got[300][0].text == "" and got[301][0].text == "" and got[None][0].text == "k"
    assert got[302][0].n_chars == 5 * 50_000 - 1
    assert webtext.extract_main_text(pages.limit(0)).count() == 0
