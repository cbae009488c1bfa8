"""Registries grown from clusters, against a plain loop."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import registry as g


def ratio(a, b):
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 100.0 if not a + b else 200.0 * row[-1] / (len(a) + len(b))


def test_clusters_fold_into_the_first_entry_like_them(spark):
    r = random.Random(6)
    name = lambda: " ".join("".join(r.choice("abcdeimnorst") for _ in range(r.randint(4, 8))) for _ in range(3))
    standing = [(i, name(), [f"alias {i}"] if i % 3 else []) for i in range(40)]
    standing += [(40, standing[0][1][:-1] + "x", None), (41, standing[1][1], ["same again"])]  # like an entry before it; twice
    found = {}
    for i in range(60):
        rep = standing[i % 40][1] if i % 3 else name()
        words = rep.split()
        if i % 3 == 1:
            words = words[::-1]
        elif i % 3 == 2:
            words[0] = words[0][:-1] + "zz"
        found[" ".join(words)] = [" ".join(words), f"member {i}"]
    want = {}
    for _, c, aliases in standing:
        want.setdefault(c, set()).update(aliases or [])
    for rep, members in found.items():
        own = next((c for _, c, _ in standing if ratio(rep, c) >= g.FOLD), rep)
        want.setdefault(own, set()).update(m for m in members if m != own)
    rows = [(rep, m) for rep, members in found.items() for m in members]
    got = g.folded(spark.createDataFrame(rows, "canonical string, name string"), spark.createDataFrame(standing, "pos int, canonical string, aliases array<string>")).collect()
    assert {x["canonical"]: x["aliases"] for x in got} == {c: sorted(a) for c, a in want.items()}
    assert len(want) > 42 and any(len(a) > 1 for a in want.values())


def test_nothing_to_fold(spark):
    none = spark.createDataFrame([], "canonical string, name string")
    standing = spark.createDataFrame([(0, "anna bell", ["a bell"])], "pos int, canonical string, aliases array<string>")
    assert [tuple(x) for x in g.folded(none, standing).collect()] == [("anna bell", ["a bell"])]
    some = none.union(none.sparkSession.createDataFrame([("anna bell", "anna bell"), ("anna bell", "bell, anna")], none.schema))
    assert [tuple(x) for x in g.folded(some, standing.where("pos > 0")).collect()] == [("anna bell", ["bell, anna"])]
    assert g.folded(none, standing.where(F.lit(False))).count() == 0
