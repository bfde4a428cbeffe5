"""Templates of a site go first: neither a mark nor a name keeps what recurs on a host's pages."""

from sextant.llm import page_text

SCHEMA = "page_id long, url string, html string, text string"


def _texts(spark, pages):
    rows = [(k, f"https://site.example/{k}", f"<html><body>{body}</body></html>", "") for k, body in enumerate(pages)]
    return {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_recurring_teaser_article_is_deleted(spark):
    teaser = "<article><h2>Editor's choice</h2><p>The one story that all pages of this site show.</p></article>"
    own = "<article><h1>Title {0}</h1><p>Text {0} of the page has {0} words of its own.</p></article>"
    found = _texts(spark, [own.format(k) + teaser for k in range(30)] + [teaser])
    for k in range(30):
        assert found[k] == f"Title {k}\n\nText {k} of the page has {k} words of its own."
    # Where it is all that is marked, it is the article.
    assert found[30] == "Editor's choice\n\nThe one story that all pages of this site show."


def test_recurring_box_named_like_an_article_does_not_hide_it(spark):
    box = "<div class='entry'><span>Popular today</span> a story everyone reads</div>"
    found = _texts(spark, [f"{box}<div class='x9'><p>Own text {k} says {k * 7} things.</p></div>" for k in range(30)])
    assert found == {k: f"Own text {k} says {k * 7} things." for k in range(30)}


def test_mirrored_articles_are_no_templates(spark):
    mirrored = "<nav>Menu</nav><article><h1>The story</h1><p>Told again on each of these pages.</p></article>"
    assert set(_texts(spark, [mirrored + f"<!-- {k} -->" for k in range(30)]).values()) == {
        "The story\n\nTold again on each of these pages."
    }
