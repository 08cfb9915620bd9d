"""Source divergence against brute force in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import divergence
from lodeworks.llm.divergence import partner, shares, source_divergence, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=10, top=10):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    groups, docs, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall(text.translate(SMALL))
        groups[lang, source].update(found)
        whole[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = lambda counts: sum(counts[t] for t in kept)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (total(counts) + 2 * len(kept)) for t in kept}  # noqa: E731,B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(groups[lang, source]), share(whole[lang])
        pairs = []
        for peer in (s for x, s in groups if x == lang and s != source):
            other = share(groups[lang, peer])
            pairs.append((-sum(f(p[t], other[t]) for t in kept), peer.encode(), peer))
        terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def corpus(n, sources, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "é", "ÉA", "日本", "x1y", "g-h", "it's", "delta", "UP", "İ", "ß", "a\x00b", "\x85z"]
    rows = []
    for _ in range(n):
        source = rng.choice(sources) if rng.random() < 0.6 else sources[0]
        rows.append((" ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de"]), source))
    return rows


def got(spark, rows, **options):
    data = [(i % 7, *r, 1, "x") for i, r in enumerate(rows)]
    df = source_divergence(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, id long, term string").repartition(3), **options)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(df.dtypes)["rank"] == "int" and dict(df.dtypes)["value"] == "bigint"
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("sources,width,blocks", [(["s", "t", "Ü"], 3, 16), ([f"s{i}" for i in range(9)], 4, 5), ([f"s{i}" for i in range(6)], 100, 2)])
def test_against_brute_force(spark, monkeypatch, sources, width, blocks):
    """Several shards and blocks of one and more sources, an odd and an even number of blocks."""
    monkeypatch.setattr(divergence, "SHARD_TERMS", width)
    monkeypatch.setattr(divergence, "MOST_BLOCKS", blocks)
    rows = corpus(160, sources, len(sources))
    rows += [(None, None, None), ("", "fr", "alone"), ("few words", "it", "a"), ("few", "it", "b"), ("alpha " * 200_000 + "z" * 100_000, "en", sources[0]), ("-- 12 !", "en", "no terms"), *[("alpha beta", "en", "same")] * 12, *[("alpha beta", "en", "same too")] * 12]
    assert got(spark, rows) == brute(rows)


def test_few_top_terms_and_lower_bound(spark):
    rows = corpus(40, ["s", "t"], 3)
    assert got(spark, rows, least_docs=2, top=3) == brute(rows, 2, 3)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_terms_and_shares():
    text = "Ab-cd É x\x00y Z[z] {q} 日本語 it's 9a"
    assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(text.translate(SMALL))
    for count, total, terms in [(0, 0, 1), (5, 9, 3), (7 * 10**14, 8 * 10**15, 10**7), (3, 10**12, 1)]:
        assert shares(np.array([count]), np.array(total), terms)[0] == 1 + 10**9 * (count + 2) // (total + 2 * terms)


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 8])
def test_each_two_blocks_meet_once(spark, blocks):
    """For any number of rounds that other languages need."""
    met = []
    table = spark.range(blocks).select(F.col("id").alias("block"), F.lit(blocks).cast("long").alias("blocks"))
    for r in range(1, 10):
        pairs = dict(map(tuple, table.select("block", partner(F.col("block"), r, F.col("blocks"))).collect()))
        assert all(pairs[pairs[b]] == b for b in pairs)
        met += [(a, b) for a, b in pairs.items() if a < b]
    assert sorted(met) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]


def test_query_equals_its_oracle(spark, sf_dir):
    from lodeworks.llm import queries
    from tests.oracle import connect, oracle_rows, spark_rows

    df = queries.queries()["op11_source_divergence"](spark, sf_dir)
    columns, expected = oracle_rows(connect(sf_dir), queries.oracle_sql()["op11_source_divergence"])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == expected
