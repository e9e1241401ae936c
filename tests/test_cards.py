"""Cards of pages: nested, unclosed, hidden and broken markup; time in proportion to the page."""

import time

import pytest

from folioforge.sources.cards import cards, listed_papers, page_cards


def told(page):
    return [(c.number, c.parent.number if c.parent else -1, c.title, c.arxiv_id, c.code_url, c.abstract) for c in cards(page)]


def test_nested_cards_hand_their_fields_on():
    page = '<article><p>First<a href="https://arxiv.org/abs/2301.00001v2">x</a><div class="paper-card"><h2>In<b>ner</b></h2><a href=https://arxiv.org/pdf/2302.12345>p</a><a href="https://github.com/a/b">Code</a></div><h3>Late</h3></article><h2>Outside</h2>'
    assert told(page) == [(0, -1, "In", "2301.00001", "https://github.com/a/b", "First"), (1, 0, "In", "2302.12345", "https://github.com/a/b", "")]


def test_unclosed_elements_end_with_the_one_around():
    assert told('<section><div class="card"><h2>A</section><a href="https://arxiv.org/abs/2301.00001">') == [(0, -1, "A", "", "", "")]
    assert told("<div class=card><p>one<p>two<div class=card><h2>t")[1:] == [(1, 0, "t", "", "", "")]
    assert told("<ul><li><div class=card><ul><li>x<li>y</ul><h3>still in</h3></div></ul>") == [(0, -1, "still in", "", "", "")]
    assert told("<article></b></i><h3>kept</h3></article></article></div>") == [(0, -1, "kept", "", "", "")]


def test_what_is_no_markup():
    page = """<!-- <article><h2>no</h2></article> --><script>var x = "<article><h2>no</h2>"</script><style><div class=card></style><title><article></title><article title='a > b "' data-x="<h2>"><h2>1 < 2 &amp; 3 &gt; 2</h2></article><!-- never closed <article>"""
    assert told(page) == [(0, -1, "1", "", "", "")] and cards("") == [] and cards("<") == [] and cards("no markup") == []
    assert told("<ARTICLE><H2>&lt;T&gt;</H2><A HREF='https://arxiv.org/abs/2301.00001'>x</A>") == [(0, -1, "<T>", "2301.00001", "", "")]
    assert told("<div class='big paper'><a href='/papers/1'>by link</a>") == [(0, -1, "by link", "", "", "")]


def test_identifiers_and_lines_in_text():
    (c,) = cards("<article>see arXiv:2301.00007v3 for more<b>short</b>a second line of text<i>a second line of text</i>a third line here<u>a fourth one, too many</u>")
    assert c.text_id == "2301.00007" and c.arxiv_id == "" and c.lines == ["see arXiv:2301.00007v3 for more", "a second line of text", "a third line here"]


@pytest.mark.parametrize("page", ['<div class="card">', "<b>", "</i>", "<!--", '<a "', "<a '", "<script>", "<", "<li>", "<p>x", '<article>x 2301.00001 and so on<a href="arxiv 2301.00001">', "<table><td>"])
def test_time_grows_with_the_page(page):
    began = time.time()
    cards("<article>" + page * 60_000)
    assert time.time() - began < 4


def test_table_of_pages(spark):
    rows = [(1, "<article><h2>A</h2><a href='https://arxiv.org/abs/2301.00001'>x</a></article><article>none</article>"), (2, None), (3, ""), (None, "<div class=card>"), (1, "<article>")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 as title", "2 as card")
    got = page_cards(df)
    assert sorted(((r.page_id or 0), r.card, r.title) for r in got.collect()) == [(0, 0, ""), (1, 0, ""), (1, 0, "A"), (1, 1, "")]
    assert [r.source_url for r in listed_papers(got).collect()] == ["https://arxiv.org/abs/2301.00001"]
    assert page_cards(df.limit(0)).collect() == []
