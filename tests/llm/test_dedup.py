"""Deduplication operators against brute force, on small tables with planted copies and odd rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from lodeworks.llm import components, prefix_filter, simhash, substring_dedup
from lodeworks.llm.exact_dedup import exact_dedup
from lodeworks.llm.line_dedup import line_dedup
from lodeworks.llm.run_index import RunIndex

KIND = "doc_id long, text string, digest string, root int, h int"


def table(spark, texts, ids=None):
    """Extra columns clash with names used inside; rows over several partitions."""
    data = [(i, t, "x", -1, 0) for i, t in zip(ids or range(len(texts)), texts)]
    random.Random(5).shuffle(data)
    return spark.createDataFrame(data, KIND).repartition(3)


def corpus(seed=1, n=60):
    """Invented texts with exact copies, near copies, shared passages, repeated lines, nulls and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for i in range(n):
        kind = i % 6
        body = [word() for _ in range(rng.randint(0, 120))]
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and texts and (base := rng.choice(texts)):
            w = base.split(" ")
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind == 3:
            cut = rng.randint(0, len(body))
            texts.append(" ".join(body[:cut]) + "\n" + passage + "\n" + " ".join(body[cut:]))
        elif kind == 4:
            texts.append("\n".join(rng.choice(["line one", "line two ", "", "third line", word()]) for _ in range(12)))
        else:
            texts.append(" ".join(body))
    return [*texts, None, "", " \t", "ab" * 300, "a" * 200, "ab" * 300 + "c"]


def test_exact_dedup(spark):
    texts = [*corpus(), "A b", "Ab", "A\tb ", "A b"]
    got = {r["doc_id"]: r for r in exact_dedup(table(spark, texts), radix=3).collect()}
    groups = {}
    for i, t in enumerate(texts):
        t = t or ""
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
    for body, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest())


def test_crowded_strings_are_equal_in_both_halves_of_their_hashes():
    """A collision of one half removes nothing."""
    high, low, doc = np.array([7, 7, 7, 7, 8], np.uint64), np.array([1, 2, 1, 1, 1], np.uint64), np.array([5, 6, 6, 5, 9])
    order, later = substring_dedup._later(high, low, doc)
    assert order[later].tolist() == [2]


def test_exact_dedup_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "x"), (3, "x"), (3, "x"), (None, "only")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(rows).collect()), key=repr)
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (None, None, 1, True)], key=repr)


def brute_substrings(texts, length=50):
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    first = {}
    for i in sorted(raw):
        for a in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][a : a + length], i)
    out = {}
    for i, x in raw.items():
        gone = np.zeros(len(x), bool)
        for a in range(len(x) - length + 1):
            if first[x[a : a + length]] < i:
                gone[a : a + length] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out[i] = (len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed, crowd, stretch", [(1, 4096, 1 << 20), (2, 2, 1 << 20), (3, 4096, 150)])
def test_substring_dedup(spark, monkeypatch, seed, crowd, stretch):
    """Also with grams that count as crowded soon (in the driver's part of the code and in tasks), and with documents cut into stretches."""
    texts = corpus(seed)
    job = substring_dedup.substring_dedup
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup.A, "STRETCH", stretch)
    if crowd != 4096 or stretch != 1 << 20:  # tasks import the module anew: run their functions here
        got = local_substring_dedup(texts)
    else:
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in job(table(spark, texts)).collect()}
    assert got == brute_substrings(texts)


def local_substring_dedup(texts, ids=None):
    """The operator's steps without Spark."""
    import pyarrow as pa

    s = substring_dedup
    raw = [t or "" for t in texts]
    plan = s.Plan(50, 16, sum(len(t.encode()) for t in raw))
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(raw)), pa.int64()), pa.array(ids or range(len(raw)), pa.int64()), pa.array(raw)], ["number", "doc_id", "text"])
    (packed,) = s._packed_documents(plan)(iter([docs]))
    half = len(raw) // 2

    def rows_of(batches):
        return [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "payload")))]

    def grouped(rows):
        for bucket in sorted({r[0] for r in rows}):
            yield pa.Table.from_batches([s._row_batch([r for r in rows if r[0] == bucket])])

    def with_documents(rows):
        whole = [(b, s.DOCUMENT, n, d, p) for b, n, d, p in zip(*(packed.column(c).to_pylist() for c in packed.schema.names))] + [(b, k, None, None, p) for b, k, p in rows]
        for bucket in sorted({r[0] for r in whole}):
            yield pa.table({c: pa.array([r[i] for r in whole if r[0] == bucket], t) for i, (c, t) in enumerate(zip(["bucket", "kind", "number", "doc_id", "payload"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]))})

    found = rows_of(s._verdicts(plan)(g) for g in grouped(rows_of(s._anchor_rows(plan)(iter([packed.slice(0, half), packed.slice(half)])))))
    contexts = rows_of(s._contexts(plan)(g) for g in with_documents([r for r in found if r[1] in (s.ASK, s.CROWDED)]))
    marks = rows_of(s._index_marks(plan)(g) for g in grouped(contexts))
    results = [r for g in with_documents([*(r for r in found if r[1] == s.MARK), *marks]) for r in s._results(plan, False)(g).to_pylist()]
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in results], key=repr) if ids else {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in results}


def brute_rows(rows, length=50):
    """rows (doc_id, text) -> results of each row; null is smaller than all ids, rows of one id never delete from each other."""
    raw = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, x in raw:
        for a in range(len(x) - length + 1):
            w = x[a : a + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, x), (doc, _) in zip(raw, rows):
        gone = np.zeros(len(x), bool)
        for a in range(len(x) - length + 1):
            if first[x[a : a + length]] < i:
                gone[a : a + length] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((doc, len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def odd_identities():
    """Ids that agree in their low 32 bits, negative, null and repeated ids, over few texts with shared parts."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(90), word(70)]
    whole = word(300)
    return [(1, whole), (4294967297, whole), (0, whole), (None, whole), (-1, whole), (4294967295, whole), (None, whole), (-4294967295, word(40) + shared[0] + word(30)), (1 << 62, shared[0] + word(10) + shared[1]), (7, whole), (7, whole), (7, word(60) + shared[1]), (7, shared[1] + word(5)), (8, shared[1]), (-(1 << 62), None), (9, "")]


def test_substring_dedup_of_odd_identities(spark):
    rows = odd_identities()
    assert local_substring_dedup([t for _, t in rows], [i for i, _ in rows]) == brute_rows(rows)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == brute_rows(rows)


def test_substring_dedup_of_a_passage_repeated_in_one_document():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, left, right = word(60), word(90), word(90)
    texts = [word(200) + shared + word(200), word(150), (left + shared + right) * 20 + word(40)]
    assert local_substring_dedup(texts) == brute_substrings(texts)


@pytest.mark.parametrize("seed", range(6))
def test_groups_of_long_repetitions(seed):
    """Matches far longer than the measures at run ends."""
    rng = np.random.default_rng(seed)
    text = np.append(np.append(rng.integers(1, 5, 30), np.tile(rng.integers(1, 5, 17 + seed), 40)), 0).astype(np.uint16)
    index = RunIndex(text)
    strings = [text[i : i + 10].tolist() for i in index.sa.tolist()]
    assert index.groups(10, 40).tolist() == np.cumsum([i > 0 and a != b for i, (a, b) in enumerate(zip(strings, [strings[0], *strings]))]).tolist()


@pytest.mark.parametrize("seed", range(40))
def test_run_index(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, rng.integers(2, 6), rng.integers(1, 200)).astype(np.uint16)
    if seed % 3 == 0:
        text = np.tile(text[:10], 20)
        text[rng.integers(0, len(text), 3)] = 7
    text = np.append(text, 0).astype(np.uint16)
    suffixes = [tuple(text[i:].tolist()) for i in range(len(text))]
    index = RunIndex(text)
    order = sorted(range(len(text)), key=suffixes.__getitem__)
    assert index.sa.tolist() == order and index.lengths.sum() == len(text)
    match = index.matching_statistics(10_000)
    for before, here in zip(order, order[1:]):
        n = 0
        for a, b in zip(suffixes[before], suffixes[here]):
            if a != b:
                break
            n += 1
        assert match[here] == n


def brute_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, bits):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_simhash_dedup(spark):
    texts = [*corpus(4, 120), "one two", "ONE two", "a b c d"]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_dedup(table(spark, texts)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    names = brute_components(prints, 4)
    assert got == {i: (f"{prints[i]:016x}", names[i]) for i in prints}


def test_simhash_of_null_and_repeated_ids(spark):
    """Every row is reported; the smallest id that there is names a component, null only where there is no other."""
    rows = [(None, "one two three four five"), (9, "one two three four five"), (9, "other words stand here now"), (9, "one two three four five"), (None, "alone in this long world"), (-4, "ONE two three  four five")]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    names = {"one two three four five": -4, "other words stand here now": 9, "alone in this long world": None, "ONE two three  four five": -4}
    assert got == sorted(((i, f"{brute_fingerprint(t):016x}", names[t]) for i, t in rows), key=repr)


def test_strangers_seldom_share_a_key():
    """Candidate pairs of random fingerprints at three sizes: far fewer than one for each thousand keys."""
    rng = np.random.default_rng(1)
    for n in (2_000, 8_000, 32_000):
        keys, _ = simhash.golay_keys(rng.integers(0, 1 << 63, n, dtype=np.uint64), 4)
        _, counts = np.unique(keys, return_counts=True)
        assert (counts * (counts - 1) // 2).sum() < 1e-7 * n * n + 5 and 80 * n < len(keys) < 110 * n


@pytest.mark.parametrize("bits", [4, 5, 8])
def test_golay_keys_lose_no_link(bits):
    rng = np.random.default_rng(bits)
    for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64):
        y = int(x)
        for b in rng.choice(64, rng.integers(0, bits + 1), replace=False).tolist():
            y ^= 1 << b
        keys, owners = simhash.golay_keys(np.array([x, y], np.uint64), bits)
        assert set(keys[owners == 0]) & set(keys[owners == 1])


@pytest.mark.parametrize("short", [2, 32])
def test_links_of_dense_groups(monkeypatch, short):
    """A large group of near copies, searched pair by pair and breadth-first."""
    monkeypatch.setattr(simhash, "SHORT_RUN", short)
    rng = np.random.default_rng(9)
    fps = set(rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist())
    for base in list(fps)[:20]:
        for _ in range(30):
            y = base
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                y ^= 1 << b
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    keys, owners = simhash.golay_keys(fps, 4)
    u, v = simhash.links_in_bucket(keys, fps[owners], 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    a, b = np.nonzero(np.triu(near, 1))
    x, y = components.local_forest(fps[a], fps[b])
    assert dict(zip(u.tolist(), v.tolist())) == dict(zip(x.tolist(), y.tolist())) and len(u) <= len(fps)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 130)}}


def brute_near_groups(texts, similarity=0.8):
    """Node -> smallest node, of all pairs of five-word shingle sets; the sets are of strings."""
    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in sets:
        for a in range(b):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets if find(i) != i}


@pytest.mark.parametrize("seed", [6, 7])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = corpus(seed, 90)
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_near_groups(texts)


def test_near_duplicates_of_a_large_group(spark):
    """Copies with some words changed, so that runs are long, fingerprints far and groups meet in round two."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    bases, texts = [[word() for _ in range(60)] for _ in range(3)], []
    for i in range(120):
        w = list(bases[i % 3])
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w if i % 5 else w + [word() for _ in range(12)]))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_near_groups(texts) and len(got) > 45


def test_near_duplicates_are_complete(spark):
    """Ends appended or cut off, blocks replaced, a passage in half of the documents: all pairs, whatever their fingerprints."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    passage, texts = words(40), []
    for i in range(60):
        w = words(rng.randint(20, 300)) + (passage if i % 2 else [])
        part = max(1, len(w) // 9)
        texts += [w, w + words(part) if i % 3 == 0 else w[:-part] if i % 3 == 1 else w[:part] + words(part // 2) + w[part + part // 2 :]]
    texts = [" ".join(w) for w in texts] + ["", None, "one two", "one TWO"]
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_near_groups(texts) and len(got) > 50


@pytest.mark.parametrize("short", [2, 8, 200])
def test_rounds_of_the_prefix_filter_lose_no_similar_pair(monkeypatch, short):
    """Short runs give all pairs of round one; with the groups that verified pairs make, round two gives the rest."""
    monkeypatch.setattr(prefix_filter, "SHORT_RUN", short)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(120)]
    ranks = rng.integers(0, 4, prefix_filter.SLOTS).astype(np.uint8)
    rows = [(p, i, len(s), n) for i, s in enumerate(sets) for n, p in enumerate(prefix_filter.prefix_of(s, ranks, 0.5))]
    shingle, doc, size, place = (np.array(c, k) for c, k in zip(zip(*rows), (np.uint64, np.int64, np.int64, np.int64)))
    similar = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b]))
    pairs, longer = prefix_filter.first_pairs(shingle, doc, size, place, 0.5)
    first = {(min(a, b), max(a, b)) for x, y in pairs for a, b in zip(x.tolist(), y.tolist())}
    whole = {(a, b) for b in range(120) for a in range(b) if similar(a, b)}
    group = {i: i for i in range(120)}
    for _ in range(120):
        for a, b in first & whole:
            group[a] = group[b] = min(group[a], group[b])
    known = np.array([group[d] for d in doc[longer].tolist()], np.int64)
    cross = {(min(a, b), max(a, b)) for x, y in prefix_filter.cross_pairs(shingle[longer], doc[longer], known, size[longer], place[longer], [prefix_filter.parities_of(sets[d]) for d in doc[longer].tolist()], 0.5) for a, b in zip(x.tolist(), y.tolist())}
    assert whole and all(group[a] == group[b] for a, b in whole - cross) and (short < 200 or whole <= first)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(0, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 100), dtype=np.uint64)]))
        x, y = (np.frombuffer(prefix_filter.parities_of(s), np.uint64) for s in (a, b))
        words = min(len(x), len(y))
        differ = int(np.bitwise_count(prefix_filter.fold(x, words) ^ prefix_filter.fold(y, words)).sum())
        both = len(np.intersect1d(a, b))
        assert differ <= len(a) + len(b) - 2 * both
        assert both < 0.8 * (len(a) + len(b) - both) or prefix_filter.allowed(len(a), len(b), differ, 0.8)


def test_shingle_sets():
    from lodeworks.llm.shingles import shingle_sets

    texts = [None, "", "  ", " One  two\tTHREE", "one two three", "one two", "a b c d e f", "b c d e f", "  b c d e f a b c d e f", "é\u00a0É x y z w"]
    sets = list(shingle_sets(__import__("pyarrow").array(texts), 5))
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 1, 2, 1, 6, 1] and sets[3].tolist() == sets[4].tolist() != sets[5].tolist()
    assert set(sets[7].tolist()) <= set(sets[6].tolist()) <= set(sets[8].tolist())


def brute_lines(rows, window, long_line):
    """rows (doc_id, text), in order; equal rows are one document."""
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in order:
        lines = (t or "").split("\n")
        solid = [(n, x.rstrip(" ")) for n, x in enumerate(lines) if x.rstrip(" ")]
        gone = set()
        for w, some in ((window, solid), (1, None)):
            for a in range(len(solid) - w + 1):
                part = solid[a : a + w]
                if some is None and len(part[0][1]) < long_line:
                    continue
                if first.setdefault((w == 1 and some is None, *(x for _, x in part)), (d, t, a)) != (d, t, a):
                    gone |= {n for n, _ in part}
        out.append((d, "\n".join(x for n, x in enumerate(lines) if n not in gone), len(solid), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, long_line", [(1, 1000), (2, 40), (3, 240)])
def test_line_dedup(spark, window, long_line):
    texts = corpus(8)
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup(table(spark, texts), window, long_line).collect()), key=repr)
    assert got == brute_lines(list(enumerate(texts)), window, long_line)


def test_line_dedup_of_runs_and_odd_rows(spark):
    """Runs with equal single lines in other surroundings, long lines alone, repeated rows, null ids, blank lines between."""
    rng = random.Random(11)
    lines = [f"line {i}" for i in range(6)]
    passage = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "\n".join(rng.choice([*lines, "", "  "]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(100, f"a\n{passage}\nb"), (101, f"c\n{passage} \nd"), (102, passage), (100, f"a\n{passage}\nb"), (103, None), (104, ""), (105, "line 1\n" * 3000)]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == brute_lines(rows, 3, 240)
    null = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["n_removed"]) for r in line_dedup(null).collect()), key=repr) == [(1, 3), (None, 0), (None, 0)]


@pytest.mark.parametrize("operator", [exact_dedup, line_dedup, substring_dedup.substring_dedup, simhash.simhash_dedup, simhash.near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0
