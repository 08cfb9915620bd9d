"""Element trees, selectors, and what articles, their lists and redirects say."""

import pytest
from pyspark.sql import functions as F

from lodeworks.sources import articles
from lodeworks.sources.html_tree import Selector, first_text, select, tree

LIST = """<ul><li id="sogou_vr_11002601_box_0"><h3><a target="_blank" href="/link?url=abc&amp;type=2">机器 文章</a></h3><p class="txt-info">摘要 <em>AI</em></p><span class="all-time-y2">机器</span>
<span class="s2"><script>document.write(timeConvert('1494483651'))</script></span></li>
<li id="sogou_vr_11002601_box_1"><h3><a target="_blank" href="http://x.example/l">B</a></h3><span class="s2"><script>timeConvert('-5')</script></span></li><li id="else"><h3>no</h3></li></ul>"""


def test_tree_and_selectors():
    root = tree('<div id=a class="x y"><p>one<p>two <b>three</b><br>four</div><ul><li>l1<ul><li>l2</ul><li>l3</ul></i><table><tr><td>c1<td>c2<tr><td>c3</table><img src=i><p>é &amp; &#39;')
    texts = lambda **s: [e.text() for e in select(root, Selector(**s))]
    assert texts(tag="p") == ["one", "two three four", "é & '"]
    assert texts(tag="li") == ["l1 l2", "l2", "l3"]
    assert texts(tag="td") == ["c1", "c2", "c3"] and texts(tag="tr") == ["c1 c2", "c3"]
    assert texts(tag="b", within=Selector(cls="y")) == ["three"] and texts(tag="b", within=Selector(tag="ul")) == []
    assert texts(cls="x") == texts(id="a") == texts(id_start="a") == ["one two three four"]
    assert texts(attr=("src", "i")) == [""] and first_text(root, Selector(tag="none")) == ""


@pytest.mark.parametrize("html", ["", None, "<", "<div", "</div></p>", "<a><b></a></b>", "<!-- x", "<script>if (a < b) '</p>'</script>x", "<li>" * 3000, "<div>" * 5000 + "deep"])
def test_odd_pages(html):
    assert isinstance(tree(html).text(), str)


def test_lists(spark):
    rows = spark.createDataFrame([(1, 1, LIST), (1, 2, None), (2, 1, "<p>none</p>")], "search_id long, page long, html string")
    got = [tuple(r) for r in articles.search_results(rows).orderBy("search_id", "page", "pos").collect()]
    assert got == [(1, 1, 0, "机器 文章", "摘要 AI", "机器", "2017-05-11 06:20:51", "https://weixin.sogou.com/link?url=abc&type=2"), (1, 1, 1, "B", "", "", "", "http://x.example/l")]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("var url = ''; url += 'https://mp.weixin.qq.com/s?src=11@'; url += '&timestamp=123';", "https://mp.weixin.qq.com/s?src=11&timestamp=123"),
        ("url += 'https://mp.weixin.qq.com/s?src=11脳tamp=5'", "https://mp.weixin.qq.com/s?src=11&timestamp=5"),
        ("url += 'https://other/' <a href=\"https://mp.weixin.qq.com/s?a=1&amp;b=2\">", "https://mp.weixin.qq.com/s?a=1&b=2"),
        ("url = 'x' url + 'y'", None),
        (None, None),
    ],
)
def test_redirects(spark, html, expected):
    row = spark.createDataFrame([(html,)], "html string").select(articles.redirect_target(F.col("html")).alias("u")).first()
    assert row["u"] == expected


def test_bodies(spark):
    pages = [("a", '<div id="js_content"><p>第一段</p><p>第二段 很长</p></div>'), ("b", '<div id="js_content"> </div><i class="q rich_media_content">r</i>'), ("c", '<div id="page-content">p</div>'), ("d", "<p id='page-content'>x</p>"), ("e", None)]
    got = {r["url"]: r["content"] for r in articles.article_bodies(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got == {"a": "第一段 第二段 很长", "b": "r", "c": "p", "d": None, "e": None}
