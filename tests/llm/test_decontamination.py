"""Benchmark decontamination: verbatim, re-parameterised and inconsistent copies; oracles on the small tables."""

import random
import re

import pytest

from lodeworks.llm import queries as llm
from lodeworks.llm.decontamination import decontaminate, leaks
from tests.oracle import connect, oracle_rows, spark_rows

QUESTION = "A train leaves at 60 km per hour and Alice waits 3 hours, then 60 more minutes until the train is there with 3 apples."
ITEMS = [(1, QUESTION), (2, "short one"), (3, "exactly five plain words here"), (4, None), (5, ""), (1, QUESTION)]


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    return {(r["doc_id"], r["item_id"]): r["same_values"] for r in leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_leaks(spark):
    texts = [
        "before. " + QUESTION + " after",
        "other text " + QUESTION.replace("60", "75").replace("3", "4").replace("Alice", "Robert") + " behind",
        QUESTION.replace("60 km", "75 km").replace("3 hours", "4 hours"),  # 60 stands for 75 and for 60
        "nothing of the kind, only words about a train and an hour",
        None,
        "",
        "now exactly FIVE plain words, here again",
        QUESTION.lower().replace(",", " ,"),
        "x " * 5000 + QUESTION,
    ]
    got = found(spark, texts)
    assert got[0, 1] is True and got[1, 1] is False and (2, 1) not in got and (3, 1) not in got
    assert got[6, 3] is True and got[8, 1] is True
    assert {d for d, _ in got} <= {0, 1, 6, 7, 8}


def test_verbatim_copies_of_numbers_and_of_short_items(spark):
    items = [(1, "Sort 8, 3, 5, 1, 9, 2 and 7 ascending"), (2, "Find the mean of 12, 15, 18, 21, 24, 27, 30, 33, 36 and 39"), (3, "Compute the product of all primes")]
    texts = [f"text before, {items[0][1]} and after", "so: " + items[1][1] + ".", "as an exercise Compute the product of all primes", "Sort 8, 3, 5, 1, 9, 2 and 6 ascending", "Find the mean of 1, 2, 3, 4, 5, 6, 7, 8, 9 and 10"]
    assert found(spark, texts, items) == {(0, 1): True, (1, 2): True, (2, 3): True}


@pytest.mark.parametrize("seed", range(3))
def test_items_of_any_number_of_tokens_against_brute_force(spark, seed):
    """Verbatim items of 1 to 7 tokens: found exactly where their tokens stand in a row."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["is", "2", "What", "+", "capital", "of", "été", "France", "today", "zz"])
    items = [(i, " ".join(word() for _ in range(1 + i % 7))) for i in range(14)] + [(90, "What is 2+2?"), (91, "capital of France today"), (92, "?"), (None, "zz été zz")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["so: what IS 2 + 2", "the capital, of france today", "été", None, ""]
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    expected = {(d, i) for d, t in enumerate(texts) for i, item in items if (x := split(item)) and any(split(t)[k : k + len(x)] == x for k in range(len(split(t))))}
    got = found(spark, texts, items)
    assert set(got) == expected and all(got.values())


def test_different_values_may_become_equal(spark):
    item = "The farmer owns 3 cows and then buys 5 cows at the big market in town"
    texts = [item.replace("3", "4").replace("5", "4"), item.replace("3", "6").replace("5", "7"), item]
    assert found(spark, texts, [(1, item)]) == {(0, 1): False, (1, 1): False, (2, 1): True}


def test_names_of_other_length_and_at_the_start(spark):
    item = "Alice buys 3 apples at the market and then Alice sells 2 of the apples to a friend there"
    texts = [item.replace("Alice", "Mary Ann").replace("3", "7").replace("2", "5"), item.replace("Alice", "Robert"), "he said that " + item, item.upper(), item.replace("Alice sells", "Mary sells")]
    got = found(spark, texts, [(1, item)])
    assert got[0, 1] is False and got[1, 1] is False and got[2, 1] is True and got[3, 1] is True


def test_a_whole_copy_is_verbatim_whatever_name_stands_before_it(spark):
    """A name in front of the item's own joins with it, so the template's value is another one; the plain tokens are all there."""
    item = "Alice buys 3 apples at the market and then sells 2 of the apples to a friend"
    assert found(spark, ["by Robert " + item], [(1, item)]) == {(0, 1): True}


def test_ties_between_diagonals(spark):
    """An item that stands twice is one row; the copy with more windows counts, then the one with the same values."""
    text = QUESTION.replace("3 hours", "4 hours").replace("3 apples", "4 apples")
    assert found(spark, [text + " and " + QUESTION, QUESTION + " and " + QUESTION]) == {(0, 1): True, (1, 1): True}


def test_decontaminate_keeps_other_rows_and_columns(spark):
    kind = "doc_id long, text string, source string, contaminated int, row_number int"
    docs = spark.createDataFrame([(1, QUESTION, "s", 0, 1), (2, "fine", "s", 0, 1), (None, "fine", "s", 0, 1), (2, "fine", "s", 0, 1), (2, QUESTION, "s", 0, 1), (None, QUESTION, "s", 0, 1)], kind)
    kept = decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and [r["text"] for r in kept.collect()] == ["fine"] * 3


@pytest.mark.parametrize("docs, items", [([], ITEMS), ([(1, QUESTION)], []), ([], [])])
def test_empty_tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert leaks(d, spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_queries_equal_oracles(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    columns, expected = oracle_rows(connect(sf_dir), llm.oracle_sql()[name])
    assert sorted(df.columns) == columns and spark_rows(df) == expected
