"""Golden rows of keyed merges, parsers and rules that SQL does not express."""

from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import rules
from lodeworks.operators import artifacts, entities
from lodeworks.sources import more_payloads


def test_recency_refreshes_only_what_is_held(spark):
    log = [(1, i, *x) for i, x in enumerate([("put", "a"), ("put", "b"), ("get", "a"), ("put", "c"), ("get", "b"), ("get", "c"), ("put", "a")])]
    log += [(2, 0, "get", "x"), (2, 1, "put", "x")]
    got = {}
    for r in entities.recently_used(spark.createDataFrame(log, "cache_id long, seq long, op string, key string"), 2).orderBy("place").collect():
        got.setdefault(r["cache_id"], []).append(r["key"])
    held: OrderedDict[str, None] = OrderedDict()
    for _, _, op, key in log[:7]:
        if op == "put" or key in held:
            held.pop(key, None)
            held[key] = None
            if len(held) > 2:
                held.popitem(last=False)
    assert got == {1: list(reversed(held)), 2: ["x"]}


@pytest.mark.parametrize(
    "raw, sections, valid",
    [
        ('```json\n{"sections":[{"anchor_id":"c1","heading":"A","confidence":2}]}\n```', [("c1", "A", 1.0)], True),
        ('{"s":[{"a":"c1","h":"A","c":"0.5"}]}', [("c1", "A", 0.5)], True),
        ('{"s":[["c1","A",-3],["c2"]]}', [("c1", "A", 0.0), ("c2", None, 0.0)], True),
        ("{broken", [], False),
        ("[1]", [], False),
        (None, [], False),
        ('{"s":' + str([["c", "h", 1]] * 20).replace("'", '"') + "}", [("c", "h", 1.0)] * 8, True),
    ],
)
def test_chunk_output_dialects(raw, sections, valid):
    out = more_payloads.chunk_output(raw)
    assert out["valid"] == valid and [(s["anchor_id"], s["heading"], s["confidence"]) for s in out["sections"]] == sections


def test_article_list(spark):
    html = '<div><h3><a href="/x?a=1">One <em>two</em></a></h3><p> sum <b>ma</b>ry</p><h3>no link</h3><h3><a href="https://b.example">B</a></h3></div>'
    rows = more_payloads.article_lists(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "https://l.example/").collect()
    assert [(r["page_id"], r["pos"], r["url"], r["title"], r["summary"]) for r in rows] == [(1, 0, "https://l.example/x?a=1", "One two", "sum mary"), (1, 1, "https://b.example", "B", "")]


def test_box_groups_accumulate(spark):
    rows = [(1, 1, i, 9, 9, float(x), 0.0, 10.0, 10.0) for i, x in enumerate([0, 40, 80, 300, 310, 900])]
    got = artifacts.group_boxes(spark.createDataFrame(rows, "doc_id long, page int, image_index int, width int, height int, x double, y double, w double, h double")).orderBy("group").collect()
    assert [(r["members"], r["x"], r["right"]) for r in got] == [(3, 0.0, 90.0), (2, 300.0, 320.0)]


def test_markdown_escapes_and_pads(spark):
    df = spark.createDataFrame([([["a|b", "c"], ["x\ny"]],)], "t array<array<string>>")
    assert df.select(artifacts.table_markdown(F.col("t")).alias("m")).first()["m"] == "| a\\|b | c |\n|---|---|\n| x y |  |\n"


@pytest.mark.parametrize("url, public", [("http://0.0.0.0", False), ("http://100.128.0.1", True), ("http://[fd00::1]/", False), ("https://EXAMPLE.com", True), ("mailto:x", False), ("", False)])
def test_url_policy(spark, url, public):
    assert spark.createDataFrame([(url,)], "u string").select(rules.is_public_url(F.col("u")).alias("p")).first()["p"] is public
