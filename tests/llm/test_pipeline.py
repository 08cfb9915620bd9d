"""The pipeline: every stage works on what its predecessor kept, and the last one packs it whole."""

import corpus_pipeline
from lodeworks.llm.common import materialize, read


def test_stages_on_small_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns and 0 < docs.count() <= left, name
        left = docs.count()
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == kept
    fill = {}
    for p in pieces:
        fill[p["sequence_id"]] = fill.get(p["sequence_id"], 0) + p["length"]
    assert max(fill.values()) <= 1024 and sum(fill.values()) > 0.97 * 1024 * len(fill)


def test_stages_on_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (None, "same words here", "en", "s", 3, 1), (3, "same words here", None, "s", 3, 1), (3, "same words here", None, "s", 3, 1)], "doc_id long, text string, lang string, source string, n_chars long, root int")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "odd")
        docs.count()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, sf_dir), "empty")
    assert empty.count() == 0


def plain_rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_rows_that_stay(spark, tmp_path):
    """Repeated and null ids, leaks, extra columns with names used inside: each stage decides row by row."""
    question = "A tall ship with nine masts sails from the old harbour to the far island in spring weather"
    long = " ".join(f"word{i}" for i in range(60))
    near = long + " tail"
    kind = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, contaminated long, row_number int, keep_id string, doc_id_ int"
    rows = [(7, "keep me please"), (7, "same text here"), (5, "same text here"), (5, "same text here"), (None, "same  text here"), (None, "only here"), (None, long), (9, near), (9, long + " other tail"), (3, "unlike all others"), (None, "so: " + question), (4, "so: " + question), (4, "clean and short"), (8, None), (8, ""), (6, " ")]
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, 2, 3, "k", 4) for i, t in rows], kind).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    out = materialize(stages["exact dedup"](spark, docs, str(tmp_path)), "t")
    left = [(7, "keep me please"), (None, "same  text here"), (None, "only here"), (None, long), (9, near), (9, long + " other tail"), (3, "unlike all others"), (4, "so: " + question), (4, "clean and short"), (6, " ")]
    assert out.columns == docs.columns and plain_rows(out) == sorted(left, key=repr)
    out = materialize(stages["SimHash near-dedup"](spark, out, str(tmp_path)), "t")
    stay = plain_rows(out)
    left = [r for r in left if r not in ((None, long), (9, near), (9, long + " other tail"))]
    assert out.columns == docs.columns and [r for r in stay if r[0] != 9] == sorted(left, key=repr) and [r[0] for r in stay].count(9) == 1
    out = materialize(stages["benchmark decontamination"](spark, docs, str(tmp_path)), "t")
    assert out.columns == docs.columns and plain_rows(out) == sorted([r for r in rows if question not in (r[1] or "")], key=repr)


def test_run_equals_brute_force(spark, sf_dir):
    """The rows behind each stage of the small tables, against plain Python over what the stage before kept."""
    from lodeworks.llm.quality import quality_scores
    from tests.llm.test_dedup import brute_near_groups

    docs = read(spark, sf_dir, "documents")
    good = {r["doc_id"] for r in quality_scores(docs, read(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in good}
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = materialize(stages[0](spark, docs, sf_dir), "t")
    assert plain_rows(docs) == sorted(texts.items(), key=repr)
    groups = {}
    for i, t in texts.items():
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
    texts = {min(g)[1]: texts[min(g)[1]] for g in groups.values()}
    docs = materialize(stages[1](spark, docs, sf_dir), "t")
    assert plain_rows(docs) == sorted(texts.items(), key=repr)
    ids = sorted(texts)
    gone = {ids[i] for i in brute_near_groups([texts[i] for i in ids])}
    docs = materialize(stages[2](spark, docs, sf_dir), "t")
    assert plain_rows(docs) == sorted(((i, t) for i, t in texts.items() if i not in gone), key=repr) and gone
