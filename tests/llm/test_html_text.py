"""Main text of planted layouts, tree matching, wrappers, hard pages."""

import itertools
import random

import pytest

from boxlore.llm import html_text, queries
from boxlore.llm.html_tree import Page, align, numbered
from tests.llm.helpers import SF, by, saved


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def text(source):
    return html_text.content(Page(source), None, set(), None)


MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>"


@pytest.mark.parametrize("source, want", [
    ("", ""), ("<p>", ""), ("just text &amp; more", "just text & more"), ("<p>one<p>two", "one\n\ntwo"),
    (f"<body>{MENU}<article><h1>T</h1><p><b>a\n b<br>c<p>d</article><footer>f</footer>", "T\n\na b c\n\nd"),
    ("<article><p>x<script>var t='</p>';</script> y</p><style>p{}</style><form><p>no</p></form></article>", "x y"),
    ("<main><header><h1>T</h1><p>by me</p></header><p>x</p><aside>s</aside></main><p>outside</p>", "T\n\nx"),
    ("<header>h</header><div class='cookie-notice'>c</div><div id=content><p>long text here</p><p>more</p></div>", "long text here\n\nmore"),
    ("<article><p>x</p><section id='comments'><article class=comment><p>first!</p></article></section></article>", "x"),
    ("<article><p>1 &lt; 2 &#8217;&nbsp; &eacute;<!-- no > <p>no --></p><div hidden>h</div>", "1 < 2 ’ é"),
    ("<body class='with-sidebar menu'><article><table><tr><td>a<td>b</table></article>", "a\n\nb"),
    ("<article><ul><li>one<li>two</ul></article><div class=ad>buy</div>", "one\n\ntwo"),
    ("<title>t</title><head><p>no</head><body><article>" + "<div>" * 5000 + "deep", "deep"),
    ("<article><p>x</article", "x"),
])
def test_layouts(source, want):
    assert text(source) == want


def brute(a, b):
    """Largest order-keeping match of two trees, by trying every pairing of children."""
    if a[0] != b[0]:
        return 0
    best = 0
    for k in range(min(len(a[1]), len(b[1])) + 1):
        for xs in itertools.combinations(a[1], k):
            for ys in itertools.combinations(b[1], k):
                parts = [brute(x, y) for x, y in zip(xs, ys)]
                best = max(best, sum(parts) if all(parts) else 0)
    return 1 + best


def test_simple_tree_matching():
    chance = random.Random(5)

    def tree(depth):
        return chance.choice("ab"), tuple(tree(depth - 1) for _ in range(chance.randint(0, 3) if depth else 0))

    for _ in range(300):
        a, b = tree(3), tree(3)
        pairs = align(a, b)
        assert len(pairs) == brute(a, b)
        assert all(numbered(a)[x][0] == numbered(b)[y][0] for x, y in pairs.items())
        assert sorted(pairs.values()) == [pairs[x] for x in sorted(pairs)]


def test_template_is_learned_per_host(spark, tmp_path):
    """No tag or class tells the template; only other pages of the host do."""
    rows, want = [], {}
    for k in range(12):
        body = [f"Article {k} paragraph {j} with words of its own {k * j}." for j in range(4)]
        rows.append((k, "http://one.example/p", "<div>Welcome to our pages, dear reader, here and always, every day!</div><div><div>"
                     + "".join(f"<p>{b}</p>" for b in body) + "<p>All rights reserved by us.</p></div></div>"))
        want[k] = "\n\n".join(body)
    rows += [(100 + k, "http://copies.example/", "<div><p>The same article on each page.</p></div>") for k in range(12)]
    rows += [(200, "http://alone.example", "<div><p>All rights reserved by us.</p></div>"), (201, None, None), (202, "", "<p>x</p>")]
    got = by(queries.op9_html(spark, saved(spark, tmp_path, pages=pages_of(spark, rows))), "page_id")
    assert {k: got[k].text for k in want} == want
    assert {got[100 + k].text for k in range(12)} == {"The same article on each page."}
    assert got[200].text == "All rights reserved by us." and got[201].text == "" and got[202].text == "x"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_table(spark, tmp_path):
    got = queries.op9_html(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.text and "<" not in r.text for r in got)
    assert queries.op9_html(spark, saved(spark, tmp_path, pages=pages_of(spark, []))).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    pages = pages_of(spark, [(1, "http://a/", "<p>x</p>")] * 2).withColumnsRenamed({"page_id": "host", "html": "text"})
    got = html_text.extract(pages, "host", "url", "text")
    assert [(r.host, r.text) for r in got.selectExpr("host", "text").collect()] == [(1, "x")] * 2


PARAGRAPHS = "".join(f"<p>Paragraph {k} with running text that goes on for a while.</p>" for k in range(5))


@pytest.mark.parametrize("wrapper", ["<div class='page has-sidebar'>", "<div id='search-page'>", "<section class='content with-banner'>"])
def test_words_of_a_wrapper_do_not_drop_the_page(wrapper):
    source = f"<body>{wrapper}<div class='nav'><a href=x>Home</a></div>{PARAGRAPHS}<div class='sidebar'>beside it</div></div></body>"
    text = html_text.content(Page(source), None, set(), None)
    assert text.count("Paragraph") == 5 and "Home" not in text and "beside" not in text


def test_teasers_inside_main_are_not_the_article():
    teaser = "<article><h3>Another one</h3><p>Short.</p></article>"
    assert html_text.content(Page(f"<main>{PARAGRAPHS}{teaser}</main>"), None, set(), None).count("Paragraph") == 5
    inside = html_text.content(Page(f"<main><p>lead</p><article>{PARAGRAPHS}</article></main>"), None, set(), None)
    assert inside.count("Paragraph") == 5
