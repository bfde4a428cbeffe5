"""Main text of web pages: single pages with known articles, site templates, edge cases, and the check SQL."""

import duckdb
import pytest

from sextant.llm import page_text
from sextant.llm.page_text import Judged
from sextant.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string, text string"


def text(source):
    return "\n\n".join(Judged(source).blocks())


@pytest.mark.parametrize(
    "source, expected",
    [
        (None, ""),
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<p>a<p>b</p>c", "a\n\nb\n\nc"),
        ("<article><h1>T &lt;x&gt;</h1><p><b>one<br><p>two&nbsp;three</article><p>after", "T <x>\n\none\n\ntwo three"),
        ("<nav>menu</nav><header>top</header><p>body text</p><footer>end</footer>", "body text"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>x</p></article>", "Title\n\nx"),
        ("<article><p>x</p><section id='comments'><p>nice</p></section></article>", "x"),
        ("<article><p>x</p></article><article class='comment'><p>nice</p></article>", "x"),
        ("<div class='cookie-notice'>ok?</div><div class='post'><p>x</p></div>", "x"),
        ("<div class='has-sidebar'><main><p>x</p></main><div class=sidebar>y</div></div>", "x"),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> -->", "x"),
        ("<p>a < b and c</p>", "a < b and c"),
        ("<p title='a > b'>x</p><p title=\"unclosed>y</p>", "x\n\ny"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\n\ntwo\n\na\n\nb\n\nc"),
        ("<ul><li><a href=/1>One page</a><li><a href=/2>Two</a></ul><p>x</p>", "x"),
        ("<form><input value=q><label>find</label></form><p>x</p><button>go</button>", "x"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<p>x</p><script>never closed", "x"),
        ("<article><div>in<span>line</span> words</div></article>", "inline words"),
        ("<p>" + "long " * 200_000 + "</p>", ("long " * 200_000).strip()),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ],
)
def test_pages(source, expected):
    assert text(source) == expected


def site(n):
    """Pages of one host without a marked article, in a frame that no name gives away."""
    for k in range(n):
        own = f"<div class='x9'><p>Article {k} says {k * 7} things about {k * 13}.</p><p>Second part {k}.</p></div>"
        frame = "<div class='q1'><span>The Daily Example</span> best of the web</div>"
        offer = f"<div class='q2'><p>Buy the book today, offer {'A'}.</p></div>"
        yield k, f"https://site.example/{k}", f"<html><body>{frame}{own}{offer}</body></html>", "clash"


def test_site_templates_are_deleted(spark):
    copied = [(1000 + k, f"http://copies.example/{k}", "<body><div><p>The same story, told again.</p></div></body>", "") for k in range(30)]
    few = [(2000, "https://site.example.org/1", "<div class='q1'><span>The Daily Example</span> best of the web</div>", "")]
    pages = [*site(30), *copied, *few]
    found = {r.page_id: r for r in page_text.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert len(found) == len(pages)
    for k in range(30):
        assert found[k].text == f"Article {k} says {k * 7} things about {k * 13}.\n\nSecond part {k}."
        assert found[1000 + k].text == "The same story, told again."
    assert found[2000].text == "The Daily Example best of the web"


def test_passages_quoted_in_articles_stay(spark):
    quoted = "<p>A passage that every article of this host quotes in full.</p>"
    pages = [(k, f"http://h.example/{k}", f"<article><p>Own text {k} of some length.</p>{quoted}</article>", "") for k in range(30)]
    for r in page_text.extract(spark.createDataFrame(pages, SCHEMA)).collect():
        assert r.text == f"Own text {r.page_id} of some length.\n\nA passage that every article of this host quotes in full."
        assert r.n_chars == len(r.text)


def test_edges(spark):
    rows = [(None, None, None, ""), (1, "x", "", ""), (1, "x", "", ""), (2, "http://A/b", "<p>é 👩</p>", "")]
    found = page_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "é 👩", 3)]
    assert page_text.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_check_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet')")
    expected = sorted(duck.execute(ORACLES["op13_html_extraction"]).fetchall())
    rows = QUERIES["op13_html_extraction"](spark, folder).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in rows) == expected
