"""Fill-in-middle against a regular expression over code points, and exact round trips."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.llm.fill_in_middle import decisions, fill_in_middle, parts, restore, restored, select, token_starts, transform

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "  \t", "a", " a", "a ", "a b", "a  b\n", "\x0b\x0ca\r\n b", "é ü x 　 y z", "a\x00b \x1f c\x85d", "x <P> y", "x<S>", "<M>", "< <P < S> <", "a<S b<M c<", "日本語 テキスト 🎉🎉 ", "word " * 50_000, "x" * 300_000, " " * 70_000]


def brute(text, doc_id, seed=42, fim=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\v<PSM>aé日🎉\x00\x85\xa0"), st.characters(blacklist_categories=("Cs",))), max_size=60), st.integers(0, 10**6))
def test_random_texts(text, doc_id):
    *head, output = transform(text.encode(), doc_id, 42, 90, 50)
    assert (*head, output.decode()) == brute(text, doc_id, fim=90, spm=50)
    assert restore(output, head[1]).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 1 << 400))
def test_select_finds_each_bit(bits):
    assert [select(bits, k) for k in range(bits.bit_count())] == [i for i in range(bits.bit_length()) if bits >> i & 1]


def test_starts_and_cuts():
    assert token_starts(b"") == 0
    assert bin(token_starts(b"  a  b ")) == "0b1001001"
    assert parts(b"a b c", 3, 1) == (3, 1, 5)
    assert decisions(None, 42) == [int(hashlib.sha256(b"42:").hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]


def test_rows(spark):
    """Nulls, empty, blank and very long texts, markers, repeated rows and ids, clashing columns."""
    rows = [(i, t, "x", 0) for i, t in enumerate(ODD * 3)] + [(None, "some text of no one", "x", 1), (None, None, "x", 1), (7, "a b c", "x", 2), (7, "a b c", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    got = fill_in_middle(docs)
    found = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["output_sha256"], r["restored_sha256"]) for r in got.collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for doc_id, text, *_ in rows:
        *head, output = brute(text, doc_id)
        expected.append((doc_id, *head, output, sha(output), sha(text or "")))
    assert found == sorted(expected, key=repr)
    assert {f[2] for f in found} == {"plain", "spm", "psm"}
    assert sorted((r["doc_id"], r["text"]) for r in restored(got).where("doc_id is not null").collect()) == sorted((i, t or "") for i, t, *_ in rows if i is not None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(docs).collect() == []
    assert "output" not in fill_in_middle(docs, with_text=False).columns


def test_query_equals_its_oracle(spark, sf_dir):
    from lodeworks.llm import queries
    from tests.oracle import connect, oracle_rows, spark_rows

    df = queries.queries()["op12_fill_in_middle"](spark, sf_dir)
    columns, expected = oracle_rows(connect(sf_dir), queries.oracle_sql()["op12_fill_in_middle"])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == expected
