"""Words of class, id and role on wrappers of the article: evidence that the tree has to confirm."""

import pytest

from keydrift.llm import html_text

WRAPPERS = ["single has-sidebar", "no-comments", "content with-sidebar", "search-results", "post social"]


@pytest.mark.parametrize("words", WRAPPERS)
def test_wrappers_of_an_article_stay(words):
    for page in (
        f"<body class='{words}'><article><p>text</p></article></body>",
        f"<body><div class='{words}'><div><main><p>text</p></main></div></div></body>",
        f"<body><article class='{words}'><p>text</p></article></body>",
        f"<html class='{words}'><body id='sidebar' role='search'><p>text</p></body></html>",
    ):
        for named in (None, set(), {f">body>div.{'.'.join(sorted(words.split()))}"}):
            assert html_text.Page(page).text(set(), named) == "text"


def test_named_branches_beside_an_article():
    def text(html):
        return html_text.Page(html).text(set(), set())

    assert text("<div class=ad>buy</div><article><p>long text</p></article>") == "long text"
    # teasers are articles too: the longer branch is not given up for them
    assert text("<div class='post social'><p>long text</p></div><article>ad</article>") == "long text\nad"
    assert text("<article><p>long text</p><div class=share-note>more</div></article>") == "long text\nmore"
    assert text("<p>a <span class=social>b <b>c</b></span> d</p>") == "a b c d"


def test_tree_confirms_names(spark):
    rows = []
    for k in range(40):
        wrapped = f"<div class='content with-sidebar'><p>Own text {k} of page</p></div>"
        # eight of these on the host: too many for CUT, not for a branch that a word names
        rows.append((k, f"http://one.org/{k}", f"<body>{wrapped}<div class='sidebar'><p>Teaser {k % 4}</p></div><div class=x><p>Line {k % 4}</p></div></body>"))
    rows.append((100, "http://two.org/", "<body class='has-sidebar'><div class='post social'><p>once</p></div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_text.extracted(pages).collect()}
    assert text[6] == "Own text 6 of page\nLine 2" and text[100] == "once"


def test_readers_comments_go_wherever_they_stand(spark):
    def text(html):
        return html_text.Page(html).text(set(), set())

    long = "<p>" + "I think otherwise. " * 40 + "</p>"
    assert text(f"<article><p>own</p><section class=comments>{long}</section><p>end</p></article>") == "own\nend"
    assert text(f"<body><p>own</p><div class='Comments'>{long}</div></body>") == "own"
    assert text(f"<article><p>own</p></article><div id=comments>{long}</div>") == "own"
    assert text(f"<article><p>own</p></article><ol class='commentlist x'><li><article class='comment-body'>{long}</article></li></ol>") == "own"
    # a word among others, and what holds the article
    assert text("<div class='no-comments'><p>own</p></div>") == text("<body class=comments><p>own</p></body>") == "own"
    assert text("<div class=comments><article><p>own</p></article></div>") == "own"
    rows = [(k, f"http://one.org/{k}", f"<body><div class=post><p>Text {k}</p></div><div class=comments><p>Mine {k}</p></div></body>") for k in range(12)]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Text {k}" for k in range(12)}


def test_open_quotes_cost_no_more_than_the_text():
    import time

    start = time.perf_counter()
    for piece in ('<a "', "<a '", "<a b=\"c\" '"):
        html_text.Page(piece * 50_000)
    assert time.perf_counter() - start < 5
