"""Main text of malformed pages, in time that grows with the page, and of pages without article elements."""

from __future__ import annotations

import os
import random
import re
import time

import pytest

from tidemill.llm import html_text
from tidemill.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>x <![foo[ bar ]]> y</p>", "x y"),
        ("<![ x", ""),
        ("<p>k</p><![if lt IE 9]><p>a</p><![endif]>", "k\n\na"),
        ("<p>a <!-- c", "a"),
        ("<p>a <!-- c --> b", "a b"),
        ("<p>a <!foo> b <?php echo 1 ?> c", "a b c"),
        ("x < y and <3", "x < y and <3"),
        ('<p><a href="x>y</a> z</p>', "y z"),
        ('<p class=ad"b>t</p>', "t"),
        ("<p>a<b<c>d</p>", "ad"),
        ("<p>one</ p>two</p>", "onetwo"),
        ('<script>if (a<b) "</p>"</script>k<style>a<b', "k"),
        ("<P TITLE='a > b'>ok</P>", "ok"),
        ("<p>text <b unclosed", "text"),
        ("&lt;b&gt; &amp &#233;", "<b> & é"),
    ],
)
def test_malformed_markup(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a b='", "<!-- ", "<![", "<![foo[", "<", "</", "</a ", "<script>", "<!x", '<a "', "&#", "<div a=b "])
def test_time_grows_with_the_page(piece):
    took = []
    for size in (250_000, 1_000_000):
        began = time.process_time()
        html_text.main_text(piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < max(2.5, 8 * took[0])


def test_one_bad_page_stops_no_other(spark):
    rows = [(1, "u", "<p>x <![foo[ bar ]]> y</p>"), (2, "v", "<p>good words</p>"), (3, "w", "<a " * 100_000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: "x y", 2: "good words", 3: ""}


def test_random_cuts_leave_no_tag_in_the_text():
    r = random.Random(4)
    page = '<html><body><div class="ad">buy</div><article><h1>Head</h1><p>Some <a href="/x">words</a> of text.</p><!-- note --></article></body></html>'
    for _ in range(500):
        a, b = sorted(r.sample(range(len(page)), 2))
        text = html_text.main_text(page[:a] + page[b:])
        assert not re.search(r"</?[a-z]+>|<!--", text), page[:a] + page[b:]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("instead", ["div", "section", "td"])
def test_pages_without_article_elements(spark, instead):
    """The ratio of text to tags alone finds most of what an article element would have told, and little else."""
    kept = words = more = 0
    for row in table(spark, SF, "pages").select("html").collect():
        want = html_text.main_text(row.html).split()
        html = re.sub(r"<(/?)(article|main)\b[^>]*>", rf"<\1{instead}>", row.html)
        got = html_text.main_text(html).split()
        common = len(set(want) & set(got))
        kept, words, more = kept + common, words + len(set(want)), more + len(set(got)) - common
    assert kept / words > 0.97 and more / words < 0.05, (kept / words, more / words)
