"""Rendering: layouts by hand, and all visible words against the standard parser."""

import re
from html.parser import HTMLParser

from tidepanel.llm.html_text import HIDDEN, VOID, extract, parse, render


def text_of(page):
    return render(parse(page))


class Plain(HTMLParser):
    """Every piece of text outside hidden elements, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN and tag not in VOID:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_pages_keep_all_visible_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for page in pages.collect():
        plain = Plain()
        plain.feed(page.html)
        plain.close()
        squeeze = lambda t: re.sub(r"\s+", "", t)
        unmarked = re.sub(r"(?m)^ *(?:- |\d+\. )", "", got[page.page_id])
        want = re.sub(r"(?m)^ *(?:- |\d+\. )", "", "".join(plain.words))
        assert squeeze(unmarked).replace("-", "") == squeeze(want).replace("-", ""), page.page_id


def test_blocks_lists_and_tables():
    assert text_of("<p>a<p>b <b>c</b>\n d<div>e</div>f") == "a\n\nb c d\n\ne\nf"
    assert text_of("<ul><li>a<li>b<ol><li>c<li>d</ol><li>e</ul>z") == "- a\n- b\n  1. c\n  2. d\n- e\n\nz"
    assert text_of("<table><tr><th>name<th>n<tr><td>ab<td>1<tr><td>c</table>x") == "name  n\nab    1\nc\n\nx"
    assert text_of("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>") == "wide     z\na     b  c"
    assert text_of("<pre>\n a\n  b </pre>c<br>d") == " a\n  b\n\nc\nd"
    assert text_of("a<!-- x --><script>var t='</p>';</script>b&amp;c &lt; d") == "ab&c < d"


def test_visibility():
    page = ("<html><head><title>t</title></head><p hidden>a</p><p style='color:red; display : none'>b</p><p style=visibility:hidden>c</p>"
            "<template>d</template><noscript>e</noscript><dialog>f</dialog><dialog open>g</dialog><input type=hidden value=h>i")
    assert text_of(page) == "g\ni"
    assert text_of("<head><meta charset=utf-8>text at once") == "text at once"


def test_broken_and_extreme_pages(spark):
    assert text_of("<div>" * 50000 + "deep") == "deep"
    assert text_of("a < b <c") == "a < b"
    assert text_of("</p></div>x</b>") == "x"
    assert text_of("<li>x<td>y") == "- xy"
    assert "x" * 100000 in text_of("<table><tr><td>" + "x" * 100000 + "<td>b<tr><td>c<td>d</table>")
    rows = [(None, None, None, 1), (1, "u", "", 1), (1, "u", "<p>a", 1), (1, "u", "<p>a", 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [tuple(r) for r in got] == [(None, None, "", 0), (1, "u", "", 0), (1, "u", "a", 1), (1, "u", "a", 1)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_hostile_numbers():
    long = "1" * 5000
    assert text_of(f"<table><tr><td colspan={long}>a<td>b<tr><td>c</table>").splitlines()[1] == "c"
    assert text_of(f"<table><tr><td colspan={'0' * 5000}2>a<td>b</table>") == text_of("<table><tr><td colspan=2>a<td>b</table>")
    assert text_of(f"<p>x&#{long};y&#x{long};&#00065;<title>&#{long}</title><textarea>&#{long};</textarea>").startswith("x�y�A")
    assert text_of(f'<a title="&#{long};" href="&#{long};">z</a>') == "z"
