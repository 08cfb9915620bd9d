"""Golden rows for what SQL does not express, and edge cases of the functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.functions import urls as U
from lodeworks.operators import artifacts, audit, documents, ranking, sources_ops, structure
from lodeworks.sources import payloads, tables


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, norm", [("A-b  C", "a b c"), ("Éa_ẞ!", "Éa ẞ"), (" x　y ", "x y"), ("", ""), (None, None), ("日本 語", "日本 語")])
def test_normalize_title(spark, raw, norm):
    assert one(spark, raw, T.normalize_title) == norm


def test_tokens_count_bytes(spark):
    assert one(spark, "né a the paper of net net", T.meaningful_tokens) == ["né", "net", "net"]


@pytest.mark.parametrize("url, host", [("https://WWW.www.A.example:8/x", "a.example"), ("a.example./p", "a.example"), ("http://u:p@b.example", "b.example"), ("", None), (None, None), ("http://c.example/p q", "c.example")])
def test_host(spark, url, host):
    assert one(spark, url, U.host_for_match) == host


def test_decode_entities_once(spark):
    assert one(spark, "&amp;lt; &lt;&#39;&quot;&unknown;", T.decode_entities) == "&lt; <'\"&unknown;"


def test_truncate_counts_code_points(spark):
    t = one(spark, "🎉🎉é", lambda c: T.truncate(c, 2))
    assert (t["content"], t["original_length"], t["truncated"]) == ("🎉🎉", 3, True)


def plain_budget(session, answer, sources, budget):
    weight = lambda s: 64 + sum(len(s[c] or "") for c in sources_ops.SOURCE)
    sources = [dict(s) for s in sources]
    total = len(answer or "") + sum(map(weight, sources))
    if total <= budget:
        return sources, total, False
    for i in reversed(range(len(sources))):
        if total <= budget:
            break
        s, tail = sources[i], f": response budget reached - full text via web_fetch(\"{sources[i]['url'] or ''}\") or get_sources(session_id=\"{session}\", offset={i}, limit=1)]_"
        n, omit, cut = len(s["content"] or ""), "_[inline content omitted" + tail, "_[truncated" + tail
        if n == 0 or n <= len(omit):
            continue
        over = total - budget
        if n > over + len(cut) + 2:
            s["content"] = s["content"][: n - over - len(cut) - 2] + "\n\n" + cut
            total = budget
        else:
            s["content"] = omit
            total += len(omit) - n
    while total > budget and len(sources) > 1:
        total -= weight(sources.pop())
    return sources, total, True


@pytest.mark.parametrize("budget", [0, 150, 700, 1499, 1500, 1501, 4000, 10**6])
def test_budget_equals_plain_restatement(spark, budget):
    rows = []
    for k in range(6):
        sources = [{"url": f"https://x.example/{k}/{i}", "provider": "p", "title": None if i % 2 else "t" * i, "description": None, "published_date": None, "content": None if i == 3 else "é" * (i * 97 * (k + 1) % 900)} for i in range(k + 1)]
        rows.append((f"s{k}", None if k == 2 else "a" * 50 * k, sources))
    kind = "session_id string, answer string, sources array<struct<" + ", ".join(f"{c}: string" for c in sources_ops.SOURCE) + ">>"
    got = {r["session_id"]: r for r in sources_ops.apply_budget(spark.createDataFrame(rows, kind), budget).collect()}
    for session, answer, sources in rows:
        kept, total, truncated = plain_budget(session, answer, sources, budget)
        r = got[session]
        assert ([s.asDict() for s in r["sources"]], r["total"], r["truncated"]) == (kept, total, truncated)


def test_merge_papers_is_order_dependent(spark):
    from lodeworks.plans.retrieval import merge_papers

    rows = {(r["query_id"], r["key"]): r for r in merge_papers(spark, "").collect()}
    deep = rows[1, "doi:10.1/a"]
    # The same title within two years joins although the DOIs differ; the later title, six years on, stays apart.
    assert (deep["n_merged"], deep["citations"], deep["openalex"]) == (2, 9, "W7")
    assert rows[1, "openalex:w9"]["n_merged"] == 1
    assert rows[1, "arxiv:2001.00001"]["n_merged"] == 2 and rows[1, "arxiv:2001.00001"]["year"] == 2020
    # No title: keys decide; a shared identifier merges whatever the case.
    assert rows[2, "semantic:s2"]["n_merged"] == 2 and rows[2, "title::"]["n_merged"] == 1
    assert deep["rrf"] == pytest.approx(2 / 61)


def test_merged_papers_take_what_they_lack(spark):
    """Sources and materials grow by new URLs, counts by the larger, all else stays with the first that has it."""
    link = lambda *urls: [{"url": u, "provider": f"p{i}"} for i, u in enumerate(urls)]
    kind = "query_id long, list_no int, position int, title string, year long, doi string, arxiv string, semantic string, openalex string, citations long, authors array<string>, venue string, abstract string, open_access boolean, references long, sources array<struct<url: string, provider: string>>, materials array<struct<url: string, provider: string>>"
    rows = [
        (1, 0, 0, "Lode Bodies", None, None, None, None, None, 3, [], None, "first", None, None, link("a", "b"), None),
        (1, 1, 0, "lode bodies!", 2020, "10.5555/l", None, None, None, None, ["Ann"], "V", "second", False, 7, link("b", "c", "c"), link("m")),
        (1, 1, 1, "Other", 2001, "10.5555/L", None, None, "W1", 9, ["Bob"], None, None, True, 2, link("d"), []),
        (1, 2, 0, "Lode Bodies", 2022, None, "x", None, None, 2, ["Cy"], "W", None, True, 9, None, link("m", "n")),
    ]
    got = {r["first_seen"]: r for r in ranking.merge_papers(spark.createDataFrame(rows, kind)).collect()}
    e = got[0]
    assert (e["year"], e["doi"], e["arxiv"], e["citations"], e["references"], e["authors"], e["venue"], e["abstract"], e["open_access"], e["n_merged"]) == (2020, "10.5555/l", "x", 3, 9, ["Ann"], "V", "first", False, 3)
    assert [s["url"] for s in e["sources"]] == ["a", "b", "c"] and [m["url"] for m in e["materials"]] == ["m", "n"]
    assert got[1]["title"] == "Other" and [s["url"] for s in got[1]["sources"]] == ["d"] and got[1]["key"] == "doi:10.5555/l"


def test_duplicates_in_a_list_add_again(spark):
    lists = spark.createDataFrame([(1, "a", 0, 0), (1, "a", 0, 1), (1, "b", 1, 0)], "query_id int, key string, list_no int, position int")
    got = {r["key"]: r["rrf"] for r in ranking.fuse(lists).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 62) and got["b"] == pytest.approx(1 / 61)


def test_redaction_at_any_depth(spark):
    raw = json.dumps({"a": {"Access-Key": 1, "b": [{"My_Token": "x", "n": None}]}, "ok": "é"})
    got = spark.createDataFrame([(raw,), ("{broken",), (None,)], "x string").select(audit.redact_json(F.col("x")).alias("y")).collect()
    assert json.loads(got[0]["y"]) == {"a": {"Access-Key": "***", "b": [{"My_Token": "***", "n": None}]}, "ok": "é"}
    assert got[1]["y"] == "{broken" and got[2]["y"] is None


def test_last_error_is_by_sequence_even_if_null(spark):
    rows = [(1, "t", False, 50, "timeout"), (2, "t", False, 10, None), (3, "t", True, 5, None)]
    r = audit.tool_stats(spark.createDataFrame(rows, "seq long, tool string, ok boolean, at_ms long, error_kind string")).first()
    assert (r["last_failure_ms"], r["last_error_kind"], r["last_success_ms"]) == (10, None, 5)


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("exam-\nple text\nmore", "example text more"),
        ("a-\nb-\nc", "ab- c"),
        ("inter- \t\n  national rules", "international rules"),
        ("one -\ntwo", "one - two"),
        ("end-\nNext", "end- Next"),
        ("sep\u2028inside\fline\x85end", "sep\u2028inside\fline\x85end"),
        ("one.\ntwo", "one.\n\ntwo"),
        ("Head:\nx\n\ny", "Head:\n\nx\n\ny"),
        ("# t\nbody\n| a |\nend", "# t\n\nbody\n\n| a |\n\nend"),
        ("777\nx.\n777\ny.\n777", "x.\n\ny."),
        ("", ""),
        (None, ""),
    ],
)
def test_clean(raw, cleaned):
    assert documents.clean(raw)[0] == cleaned


def test_light_mode():
    assert documents.clean("a  \n\n\n\nb\n\n", "light")[0] == "a\n\nb"
    assert documents.clean("\n\n\na-  \nbc\n\n\n", "light")[0] == "\nabc"
    assert documents.clean("Journal of Tests\nx\nJournal  of Tests\ny\nJournal of Tests\nz", "light") == ("x\ny\nz", 1)
    assert [documents.text_mode(m) for m in (None, "", "Clean", "none", "raw", "light")] == ["clean", "clean", "clean", "raw", "raw", "light"]
    with pytest.raises(ValueError):
        documents.text_mode("heavy")


def test_reference_tail():
    assert documents.reference_tail("a\nReference x\nREFERENCES\ninter-\nnational\n\n\nend  \n") == "\nREFERENCES\ninternational\n\nend"
    assert documents.reference_tail("References\nat once") == "" == documents.reference_tail(None)
    assert len(documents.reference_tail("\nreferences" + "y" * 40_000)) == 30_000


def test_chunks_cover_and_overlap():
    text = "\n\n".join(f"para {i} " + "é" * (i * 13 % 90) for i in range(60))
    raw = text.encode()
    got = list(documents.chunk_text(text, 500, 60))
    assert got[0][1] == 0 and got[-1][2] == len(raw)
    for a, b in zip(got, got[1:]):
        assert b[1] <= a[2] and b[2] > a[2] and a[2] - b[1] <= 63
    for c in got:
        raw[c[1] : c[2]].decode()
        assert c[3] == raw[: c[1]].count(b"\n") + 1
    assert not list(documents.chunk_text("", 500, 60)) and len(list(documents.chunk_text("x" * 9000, 500, 60))) == 1


def test_anchored_lines():
    ((number, start, end, first, last, body, anchors),) = documents.chunk_text(" x\n\ny\nx\n", 500, 60)
    assert (number, start, end, first, last) == (0, 0, 8, 1, 4) and body == " x\n\ny\nx\n"
    assert anchors == [(1, 0, 2, "x"), (3, 4, 5, "y"), (4, 6, 7, "x")]


def plain_fnv1a(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h


def test_anchors_of_documents(spark):
    texts = ["a", "", "é" * 300, "abc", "b" * 240, "a"]
    assert documents.fnv1a(texts).tolist() == [plain_fnv1a(t) for t in texts] and documents.fnv1a(["a"]).tolist() == [0xAF63DC4C8601EC8C] and len(documents.fnv1a([])) == 0
    docs = spark.createDataFrame([("k", " x\n\ny\nx\n"), ("empty", ""), ("null", None)], "name string, text string")
    rows = documents.anchors_of(documents.chunks(docs, key="name"), "name").collect()
    assert [(r["name"], r["chunk_id"], r["anchor_id"], r["line"], r["byte_start"], r["byte_end"], r["excerpt"]) for r in rows] == [("k", "chunk_0000", f"c0000_{plain_fnv1a(t):010x}", n, a, b, t) for n, a, b, t in [(1, 0, 2, "x"), (3, 4, 5, "y"), (4, 6, 7, "x")]]


def test_chunks_restated():
    """Blank paragraphs count, numbers start at 0, a window begins on a character, anchors are those of whole lines of the text."""
    text = "aaaa\n\n  \n\nbébé\n\n" + "c" * 12
    assert documents.paragraph_spans(text.encode()) == [(0, 4), (6, 8), (10, 16), (18, 30)] and documents.paragraph_spans(b"\n\n") == [(0, 2)] and documents.paragraph_spans(b"") == [(0, 0)]
    assert [(n, a, b, f, l) for n, a, b, f, l, _, _ in documents.chunk_text(text, 16, 2)] == [(0, 0, 16, 1, 5), (1, 14, 30, 5, 7)]
    got = list(documents.chunk_text(text, 16, 2))
    assert [x[3] for x in got[1][6]] == ["bébé", "c" * 12] and got[1][5] == "é\n\n" + "c" * 12


@pytest.mark.parametrize(
    "body, expected",
    [
        ('data: {"delta":"a"}\n\ndata: {"delta":"b"}\n\ndata: [DONE]\n\ndata: {"delta":"c"}\n\n', ("done", "ab", None)),
        ('event: r.failed\ndata: {"response":{"error":{"message":"m"}}}\n\n', ("failed", "", "m")),
        ('data: not json\r\n\r\ndata: {"choices":[{"delta":{"content":"é"}}]}\r\n\r\n', ("incomplete", "é", None)),
        ("", ("incomplete", "", None)),
    ],
)
def test_event_streams(body, expected):
    assert payloads.fold_events(body) == expected


def test_feed(spark):
    from lodeworks.plans.payloads import feed

    rows = feed(spark, "").orderBy("pos").collect()
    assert [(r["title"], r["year"], r["authors"], r["categories"]) for r in rows] == [("One two", 2017, "A; B", "cs.CL cs.LG"), ("Three", 2020, "C", "cs.DS")]


def test_cache_put_keeps_created_at(spark):
    kind = "cache_key string, created_at long, updated_at long, v int"
    old = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 2, 2)], kind)
    new = spark.createDataFrame([("b", None, None, 9), ("c", None, None, 3)], kind)
    got = {r["cache_key"]: (r["created_at"], r["updated_at"], r["v"]) for r in tables.put_entries(old, new, 7).collect()}
    assert got == {"a": (1, 1, 1), "b": (2, 7, 9), "c": (7, 7, 3)}


def test_writes(spark, tmp_path):
    df = spark.range(3)
    tables.write_once(df, str(tmp_path / "x"))
    with pytest.raises(Exception):
        tables.write_once(df, str(tmp_path / "x"))
    for _ in range(2):
        tables.append_jsonl(df, str(tmp_path / "y"))
    assert spark.read.json(str(tmp_path / "y")).count() == 6


def test_evict_is_newest_first_with_ties_by_key(spark):
    rows = [(f"k{i}", 10 + i // 2, 5) for i in range(8)]
    df = spark.createDataFrame(rows, "cache_key string, updated_at long, size_bytes long")
    assert sorted(r["cache_key"] for r in audit.evict(df, 3, 0).collect()) == ["k5", "k6", "k7"]
    assert sorted(r["cache_key"] for r in audit.evict(df, 0, 22).collect()) == ["k4", "k5", "k6", "k7"]


def test_heading_rules(spark):
    rows = [("Abstract", True), ("2 Data", True), ("Figure 1", False), ("see http://x", False), ("random words", False), ("## Methods", True)]
    df = spark.createDataFrame(rows, "x string, y boolean").select(structure.is_heading(F.col("x")).alias("g"), "y")
    assert all(r["g"] == r["y"] for r in df.collect())


def test_intervals_of_a_long_document_meet_in_bins(spark):
    """100,000 chunks and as many sections of one document, in seconds; one interval spans all, and some end where others begin."""
    n = 100_000
    chunks = spark.range(n).selectExpr("1L AS doc", "id AS chunk", "id * 100 AS byte_start", "id * 100 + 150 AS byte_end").unionByName(spark.sql(f"SELECT 1L AS doc, -1L AS chunk, 0L AS byte_start, {n * 100}L AS byte_end"))
    sections = spark.range(n).selectExpr("1L AS doc", "id AS section_id", "id * 100 + 50 AS section_start", "id * 100 + 150 AS section_end").unionByName(spark.sql("SELECT 2L AS doc, 0L AS section_id, 0L AS section_start, 10L AS section_end"))
    got = documents.overlapping(chunks, sections, "doc")
    assert got.columns == ["doc", "chunk", "byte_start", "byte_end", "section_id", "section_start", "section_end"]
    # A chunk reaches its own section, the one before (which ends in it) and the next (which begins at its end).
    assert got.where("chunk >= 0").count() == 3 * n - 2 and got.where("chunk < 0").count() == n


def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda: [(rng.randrange(3), i, a, a + rng.choice([-1, 0, 1, 5, 200])) for i, a in enumerate(rng.randrange(300) for _ in range(80))]
    chunks, sections = make(), make()
    got = documents.overlapping(spark.createDataFrame(chunks, "doc long, chunk long, byte_start long, byte_end long"), spark.createDataFrame(sections, "doc long, section_id long, section_start long, section_end long"), "doc")
    expected = sorted((c, s) for d, c, a, b in chunks for e, s, x, y in sections if d == e and a <= b and x <= y and b >= x and a <= y)
    assert sorted((r["chunk"], r["section_id"]) for r in got.collect()) == expected


def test_single_rows_become_a_table(spark):
    row = lambda page, index, y, n_rows=1, n_cols=3, x=10.0, w=100.0, strategy="g": (1, page, index, strategy, n_rows, n_cols, x, y, w, 16.0 if x is not None else None)
    tables = [*(row(1, i, 100.0 + 18 * i) for i in range(5)), row(1, 9, 300.0), row(2, 0, 0.0, n_rows=32), row(2, 1, 20.0), row(2, 2, 40.0), row(3, 0, 0.0, n_cols=1), row(3, 1, 18.0, n_cols=1), row(4, 0, 0.0), row(4, 1, 18.0, x=29.0), row(4, 2, 36.0, strategy="h"), row(5, 0, 0.0, x=None), row(5, 1, 1.0)]
    got = artifacts.merge_single_rows(spark.createDataFrame(tables, "doc_id long, page long, index int, strategy string, n_rows int, n_cols int, x double, y double, w double, h double"))
    found = sorted((r["page"], r["members"], r["n_rows"]) for r in got.collect())
    assert found == [(1, [0, 1, 2, 3, 4], 5), (1, [9], 1), (2, [0, 1], 33), (2, [2], 1), (3, [0], 1), (3, [1], 1), (4, [0], 1), (4, [1], 1), (4, [2], 1), (5, [0], 1), (5, [1], 1)]


def test_single_rows_at_one_place_with_one_index_in_any_order(spark):
    """A table of one row and one of two: in one order they join, in the other they do not. Whichever comes first in the input, the result is the same."""
    tables = [(1, page, 5, "g", n_rows, 3, 10.0, 100.0, 100.0, 8.0) for page in range(20) for n_rows in (1, 2)]
    schema = "doc_id long, page long, index int, strategy string, n_rows int, n_cols int, x double, y double, w double, h double"
    for rows, parts in ((tables, 1), (tables[::-1], 1), (random.Random(4).sample(tables, len(tables)), 7)):
        got = artifacts.merge_single_rows(spark.createDataFrame(rows, schema).repartition(parts))
        assert sorted((r["page"], r["members"], r["n_rows"]) for r in got.collect()) == sorted((page, [5], n) for page in range(20) for n in (1, 2))
