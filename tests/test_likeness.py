"""Joins of names that are alike, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import likeness as k
from corpusloom.operators import registry as g
from corpusloom.sources.tables import table
from test_registry import ratio


def names(seed, n, letters="abcdeimnorst"):
    r = random.Random(seed)
    word = lambda most: "".join(r.choice(letters) for _ in range(r.randint(1, most)))
    out = ["", "a", "b", "ab", "ba", "aaaa aaaa", "aaaa aaab", "é" * 70, "é" * 68 + "ab", "x" * 200, "x" * 190 + "y" * 9]
    while len(out) < n:
        if r.random() < 0.5 and len(out) > 20:
            old = list(r.choice(out))
            for _ in range(r.randint(1, 3)):
                old.insert(r.randint(0, len(old)), r.choice(letters + " ")) if r.random() < 0.5 or not old else old.pop(r.randrange(len(old)))
            out.append("".join(old))
        else:
            out.append(" ".join(word(9) for _ in range(r.randint(1, 4))))
    return list(dict.fromkeys(out))


def test_common_lengths():
    xs, ys = names(3, 160), names(4, 160)
    pairs = [(x, y) for x in xs[:60] for y in ys[:60]]
    got = k.common_lengths([x for x, _ in pairs], [y for _, y in pairs])
    for (x, y), n in zip(pairs, got):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        assert n == row[-1]


@pytest.mark.parametrize("least,letters", [(60, "abcd"), (75, "abcdeimnorst"), (82, "ab"), (88, "abcdeimnorst"), (100, "abc")])
def test_no_pair_is_missing(spark, least, letters):
    all_ = names(least, 150, letters)
    spelt = {n: " ".join(sorted(n.lower().split())) for n in all_}
    want = {(a, b): ratio(spelt[a], spelt[b]) for a in all_ for b in all_ if a < b}
    want = {p: s for p, s in want.items() if s >= least}
    got = {(r["a"], r["b"]): r["score"] for r in g.likely_pairs(spark.createDataFrame([(n,) for n in all_ + [None, all_[0]]], "name string"), least).collect()}
    assert got == want


def test_best_entry(spark):
    asked, entries = names(1, 90), names(2, 60)
    asked += [e[:-1] + "q" for e in entries if len(e) > 8]
    reg = spark.createDataFrame([(e, e.upper()) for e in entries if e], "key string, canonical string")
    got = {r["name"]: (r["canonical"], r["score"]) for r in g.matched(spark.createDataFrame([(n,) for n in asked], "name string"), reg, F.lower, 80).collect()}
    for n in asked:
        best = min(((-ratio(n, e), e) for e in entries if e), default=None)
        score = -best[0]
        if n in entries and n:
            assert got[n] == (n.upper(), 100.0)
        elif score >= 80:
            assert got[n] == (best[1].upper(), round(score, 3))
        else:
            assert got[n] == (n, None)


def test_few_candidates_of_a_vocabulary(spark):
    """Of the words of all benchmark texts, a hundredth of all pairs at most is scored."""
    words = table(spark, "/root/testdata/sf0.01", "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{8,})"), F.lit(1))).alias("x")).distinct()
    n = words.count()
    assert k.candidates(words, 88).count() * 100 < n * (n - 1) / 2


def test_no_names(spark):
    none = spark.createDataFrame([], "name string")
    reg = spark.createDataFrame([], "key string, canonical string")
    assert g.likely_pairs(none).count() == 0 and g.clusters(none).count() == 0 and g.matched(none, reg, F.lower, 85).count() == 0
    one = spark.createDataFrame([("a b",)], "name string")
    assert [tuple(r) for r in g.matched(one, reg, F.lower, 85).collect()] == [("a b", "a b", None)]
