"""Odd pages: in bounded time, and without losing text of articles."""

from __future__ import annotations

import time

import pytest

from fieldtrace.llm import html

SIZE = 2_000_000
ODD = {
    "tags that never end": "<a ", "tags that end once, far behind": "<a ", "nested blocks": "<div>", "quotes that pair up wrongly": '<a "<" ', "single quotes": "<a '<\" ",
    "raw elements that never end": "<svg> ", "end tags that never end": "</title <title ", "declarations that never end": "<! ", "names": "<a",
}


@pytest.mark.parametrize("kind", ODD)
def test_megabytes_of_odd_tags(kind):
    page = ODD[kind] * (SIZE // len(ODD[kind])) + (' " >' if "far behind" in kind else "")
    began = time.process_time()
    html.parse(page)
    assert time.process_time() - began < 25  # 1 to 8 s; by the square it would be hours


def test_blocks_that_close_in_order_and_out_of_it():
    page = "<div>" * 200_000 + "deep" + "</div>" * 200_000 + "<p>after"
    assert html.extract(page, html.infer([page])) == "deep\n\nafter"
    page = "<ul><li>a<li>b<p>c</ul>d</p></li><table><tr><td>e<td>f<tr><td>g</table>h"
    assert html.extract(page, html.infer([page])) == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng\n\nh"


@pytest.mark.parametrize(("page", "want"), [
    ('<article><p class="search">About search</p><p class="form">x</p><section class="discussion"><h2>Discussion</h2><p>Results show</p></section><p class="legal">..</p></article>', "About search\n\nx\n\nDiscussion\n\nResults show\n\n.."),
    ("<article><p>Energy <math><mi>E</mi></math> is</p><address>Rue 1</address></article>", "Energy E is\n\nRue 1"),
    ('<article><header><h1>T</h1></header><p>a</p><div class="comments"><p>no</p></div><section id="comment-list">no</section><aside>no</aside><div class="ad">no</div><form>no</form></article>', "T\n\na"),
    ("<article><p>1 < 2 & 3 > 2 <b>so</b> &lt;i&gt; it is</p></article>", "1 < 2 & 3 > 2 so <i> it is"),
    ("<p>a <b it is", "a <b it is"),
    ("<p title='>'>a<p title=\"x>y\">b", "a\n\nb"),
    ("<p>a<!-- <p>no</p> -->b<!--> c", "ab"),
    ("<p>a<script>if (x < 1) { y('</p>') }</script>b<style>p{}</style>", "ab"),
    (None, ""), ("", ""), ("<", "<"), ("<>", "<>"), ("&amp;", "&"),
])
def test_text_that_stays(page, want):
    assert html.extract(page, html.infer([page])) == want


def test_a_paragraph_that_all_pages_of_a_host_share_stays_in_the_article(spark):
    page = lambda i: f"<div>News of the day</div><article><h1>Dish {i}</h1><p>Ingredients for four people:</p><p>{i} eggs and {i + 1} onions</p></article><div>Old address {i % 2}</div>"
    for n in (1, 4, 5, 12):
        rows = [(i, "http://x.example/a", page(i)) for i in range(n)]
        got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {i: f"Dish {i}\n\nIngredients for four people:\n\n{i} eggs and {i + 1} onions" for i in range(n)}
