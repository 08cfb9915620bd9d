"""Token counts, token blocks and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from lodeworks.llm.byte_bpe import ByteBpe  # noqa: E402
from lodeworks.llm.packing import Places, pack_documents, shortest_pack_first  # noqa: E402
from lodeworks.llm.token_blocks import BLOCK, pack, token_blocks, unpack  # noqa: E402
from lodeworks.llm.token_count import MergeCounter, token_counts  # noqa: E402

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = [
    "", " ", "  ", "a", " a", "a ", "a b", "a  b", "a\n b\t c", "a \n b", "it's  we 's", "<|endoftext|> a b", "a<|startoftext|>b <|ENDOFTEXT|>", "é ü x 　 y", "\n\n a\n", "a\r\n b", "ΣΑΣ ΟΔΟΣ", "İstanbul", "é a ́x",
    "x\x1c a\x85b\xa0c", "日本語 テキスト 🎉🎉", "THEY'LL 1234 !!??", "word " * 3000, "x" * 5000, "a\x00b", "ﬁ ǅ ẞ",
]


@pytest.fixture(scope="module")
def byte_bpe():
    return ByteBpe(BYTE)


@pytest.fixture(scope="module")
def counter():
    return MergeCounter(WORD)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def check_texts(texts, byte_bpe, counter, libraries):
    flat, counts = byte_bpe.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert flat[end - n : end].tolist() == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)
    for text, n in zip(texts, counter.count(pa.array(texts, pa.string()))):
        assert n == len(libraries[1].encode(text, add_special_tokens=False).ids), repr(text)


def test_hard_texts(byte_bpe, counter, libraries):
    check_texts(HARD, byte_bpe, counter, libraries)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabétΣ<|>1!"), st.characters(blacklist_categories=("Cs",))), max_size=40), min_size=1, max_size=4))
def test_random_texts(byte_bpe, counter, libraries, texts):
    check_texts(texts, byte_bpe, counter, libraries)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=3 * BLOCK), st.integers(0, 100))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    assert (unpack(pack(ids, percentile)) == ids).all()


def test_outliers_are_exceptions():
    ids = np.full(BLOCK, 7, np.uint32)
    plain = len(pack(ids))
    ids[3] = 60_000
    assert len(pack(ids)) == plain + 6 and (unpack(pack(ids)) == ids).all()


def rows(spark, texts):
    """doc_ids out of order, an extra column with a clashing name."""
    data = [(i, t, -1) for i, t in enumerate(texts)]
    random.Random(3).shuffle(data)
    return spark.createDataFrame(data, "doc_id long, text string, length int")


def test_token_blocks_of_a_table(spark, libraries):
    texts = [*HARD, None, "tie", "tie"]
    got = {r["doc_id"]: r for r in token_blocks(rows(spark, texts), BYTE, segment_ids=300, shards=3).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*libraries[0].encode(text or "", add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_counts_of_a_table(spark, libraries):
    texts = [*HARD, None]
    for r in token_counts(rows(spark, texts), WORD, limit=100).collect():
        text = texts[r["doc_id"]] or ""
        n = len(libraries[1].encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_packs_hold_the_histogram(histogram):
    packs = shortest_pack_first(histogram, 64)
    assert all(sum(lengths) <= 64 and n > 0 for n, lengths in packs)
    for length, n in histogram.items():
        assert sum(c * lengths.count(length) for c, lengths in packs) == n
    places, seen = Places(packs), set()
    for length, n in histogram.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            span = {(s, x) for x in range(o, o + length)}
            assert not span & seen
            seen |= span
    assert len(seen) == sum(k * v for k, v in histogram.items())


def test_packing_of_a_table(spark, libraries):
    texts = [*HARD, None, "tie", "tie", "long text here " * 900]
    got = pack_documents(rows(spark, texts), BYTE, capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = np.array([*libraries[0].encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("operator", [lambda d: token_blocks(d, BYTE), lambda d: token_counts(d, WORD), lambda d: pack_documents(d, BYTE)])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


ODD_IDS = [(None, "first null"), (7, "b text"), (7, "a text"), (None, "second null"), (7, "a text"), (-3, None), (2**40, "")]


def test_null_and_repeated_ids(spark, libraries):
    """Each row counts and is packed for itself; blocks hold null ids first and rows of one id by text."""
    docs = spark.createDataFrame(ODD_IDS, "doc_id long, text string").repartition(3)
    ids = lambda tokenizer, text: libraries[tokenizer].encode(text or "", add_special_tokens=False).ids
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    counted = [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, WORD).collect()]
    assert sorted(counted, key=key) == sorted(((i, len((t or "").encode()), len(ids(1, t))) for i, t in ODD_IDS), key=key)
    start, expected = 0, []
    for i, t in sorted(ODD_IDS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        n = len(ids(0, t)) + 1
        expected.append((i, start, n, zlib.crc32(np.array([*ids(0, t), 0], "<u4").tobytes())))
        start += n
    blocks = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_blocks(docs, BYTE, shards=3).collect()]
    assert sorted(blocks, key=lambda r: r[1]) == expected
    pieces = pack_documents(docs, BYTE, capacity=16).collect()
    assert sorted(((r["doc_id"], r["length"], r["ids_crc32"]) for r in pieces), key=key) == sorted(((i, n, c) for i, _, n, c in expected), key=key)
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(ODD_IDS)
