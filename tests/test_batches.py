"""Batches over one order, against the plain fold."""

import random

import pytest

from corpusloom.operators.batches import greedy_batches


def fold(sizes, most):
    out, used, batch = [], 0, -1
    for n in sizes:
        n = max(n or 0, 0)
        if batch < 0 or used + n > most:
            used, batch = 0, batch + 1
        used += n
        out.append(batch)
    return out


@pytest.mark.parametrize("block_rows", [7, 60, 10_000])
@pytest.mark.parametrize("kind", ["mixed", "nothing", "large", "ones"])
def test_as_one_fold(spark, kind, block_rows):
    r = random.Random(kind)
    one = {"mixed": lambda: r.choice([None, -3, 0, 0, 1, 5, 17, 30, 99, 100, 101, 400]), "nothing": lambda: r.choice([0, 0, 0, 0, 0, 1]), "large": lambda: r.randint(90, 200), "ones": lambda: 1}[kind]
    sizes = [one() for _ in range(400)]
    rows = [(i, n) for i, n in enumerate(sizes)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, n int").repartition(5)
    got = dict(tuple(x) for x in greedy_batches(df, ["id"], "n", 100, block_rows).collect())
    assert [got[i] for i in range(len(sizes))] == fold(sizes, 100)


def test_no_rows_one_row_two_keys(spark):
    none = spark.createDataFrame([], "id long, n int")
    assert greedy_batches(none, ["id"], "n").count() == 0
    df = spark.createDataFrame([("b", 1, 4, "x"), ("a", 2, 4, "y"), ("a", 1, 4, "z")], "k string, i int, n int, batch string")
    assert sorted(tuple(x) for x in greedy_batches(df, ["k", "i"], "n", 8, 1).collect()) == [("a", 1, 0), ("a", 2, 0), ("b", 1, 1)]
