"""Signature trees and the n-gram Jaccard join against brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from lodeworks.llm.jaccard_join import jaccard_components
from lodeworks.llm.signature_tree import SignatureTree, dual_traversal, enough, may_link, signature, tree_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, words=4):
    found = WORD.findall((text or "").translate(SMALL))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows, words=4, num=85, den=100):
    """(doc_id, n_shingles, component_id) of each (doc_id, text)."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both) and both:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, n):
    """Bases with copies at all distances around the threshold, families, a passage that many share, exact copies, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    bases, texts = [[word() for _ in range(rng.choice([3, 4, 6, 9, 10, 12, 40, 80, 200]))] for _ in range(max(3, n // 10))], []
    for _ in range(n):
        kind, base = rng.randrange(8), list(rng.choice(bases))
        if kind < 4:
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                base[rng.randrange(len(base))] = word()
        elif kind == 4:
            base = base[: len(base) - rng.randint(0, max(1, len(base) // 5))]
        elif kind == 5:
            base = passage + [word() for _ in range(rng.randint(0, 14))]
        elif kind == 6:
            base = [word() for _ in range(rng.randint(0, 60))]
        texts.append(" ".join(base))
    return [*texts, None, "", " \n\t", "a", "A", "a b", "a b c d", "A b\tc  D", "a b c d e", "x y " * 30, "x y " * 31, "É a b c", "é a b c", texts[0], texts[0].upper()]


def got(spark, rows, **options):
    data = [(i, t, 1, 2, "x") for i, t in rows]
    random.Random(2).shuffle(data)
    df = jaccard_components(spark.createDataFrame(data, "doc_id long, text string, row int, size int, node string").repartition(3), **options)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed,tree_rows", [(1, 4096), (2, 5)])
def test_against_brute_force(spark, seed, tree_rows):
    """Whole trees, and trees that are cut into parts."""
    rows = list(enumerate(corpus(seed, 260)))
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len(rows) - 40
    assert got(spark, rows, tree_rows=tree_rows) == expected


def test_other_shingles_and_threshold(spark):
    rows = list(enumerate(corpus(3, 120)))
    assert got(spark, rows, words=2, num=60) == brute(rows, 2, 60)


def test_null_and_repeated_ids_and_ties(spark):
    """Similarity of exactly 85 % links: 17 of 20."""
    words = [f"w{i}" for i in range(23)]
    a, b = " ".join(words), " ".join(words[:20])
    assert len(shingles(a)) == 20 and len(shingles(a) & shingles(b)) == 17
    rows = [(9, a), (8, b), (None, "only nulls here " * 3), (None, "only nulls here " * 3), (3, "one"), (3, "two"), (3, "one"), (None, a), (5, None), (5, "")]
    assert got(spark, rows) == brute(rows)


def test_large_family_and_very_long_texts(spark):
    """300 near copies are one component; a text of 60,000 words and its near copy link."""
    rng = random.Random(4)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        mine = list(base)
        mine[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(mine)))
    long = [f"l{rng.randrange(10**6)}" for _ in range(60_000)]
    rows += [(400, " ".join(long)), (401, " ".join(long[1000:])), (402, " ".join(long[30_000:]))]
    found = {d: c for d, _, c in got(spark, rows, tree_rows=64)}
    assert {found[i] for i in range(300)} == {0}
    assert (found[400], found[401], found[402]) == (400, 400, 402)


def test_empty_table(spark):
    assert got(spark, []) == []


def sets_of(seed, n):
    rng = np.random.default_rng(seed)
    bases = [np.unique(rng.integers(0, 1 << 63, int(k), dtype=np.uint64)) for k in rng.choice([8, 30, 100, 400], n // 4)]
    out = []
    for _ in range(n):
        s = bases[rng.integers(len(bases))]
        drop = rng.random(len(s)) < rng.choice([0, 0.03, 0.1, 0.3])
        out.append(np.unique(np.concatenate([s[~drop], rng.integers(0, 1 << 63, int(drop.sum() * rng.random()), dtype=np.uint64)])))
    return [s for s in out if len(s)]


def test_no_similar_pair_is_ruled_out_and_unlike_ones_are():
    sets = sets_of(1, 120)
    signatures = [signature(s) for s in sets]
    tried = kept = 0
    for (a, x), (b, y) in combinations(zip(sets, signatures), 2):
        both, may = len(np.intersect1d(a, b)), may_link(x, y, len(a), len(b), 85, 100)
        assert may or not enough(both, len(a), len(b), 85, 100)
        tried, kept = tried + (both == 0), kept + (both == 0 and may)
    assert kept < 0.01 * tried


@pytest.mark.parametrize("two", [False, True])
def test_tree_join_equals_all_pairs(two):
    """All pairs of different groups, or of the two sides, that signatures allow; each once."""
    sets = sets_of(2, 300)
    size = np.array([len(s) for s in sets])
    rng = np.random.default_rng(3)
    group, side = rng.integers(0, 60, len(sets)), rng.integers(0, 2 if two else 1, len(sets))
    signatures = [signature(s) for s in sets]
    found = [tuple(sorted(p)) for a, b in tree_join([s.tobytes() for s in signatures], size, size, group, side, 85, 100) for p in zip(a.tolist(), b.tolist())]
    assert len(found) == len(set(found))
    expected = {(i, j) for i, j in combinations(range(len(sets)), 2) if group[i] != group[j] and (not two or side[i] != side[j]) and may_link(signatures[i], signatures[j], size[i], size[j], 85, 100)}
    assert set(found) == expected


def test_trees_prune_whole_groups_and_unlike_nodes():
    """A node holds the OR and the ranges of all below it; two unlike families meet in few steps."""
    sets = [np.sort(np.concatenate([np.arange(f * 1000, f * 1000 + 60), [10**6 + i]])).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for f in range(2) for i in range(64)]
    bits = np.stack([signature(s) for s in sets])  # sets of one size: signatures of one length
    size = np.array([len(s) for s in sets])
    one = SignatureTree(bits, size, size, np.zeros(len(sets), np.int64))
    assert list(dual_traversal(one, one, 85, 100)) == []
    assert [len(x[0]) for x in one.levels] == [128, 16, 2]
    assert (np.bitwise_or.reduce(bits[:64]) == one.levels[2][0][0]).all()
