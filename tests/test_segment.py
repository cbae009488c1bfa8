"""Paragraphs and chunks: the fixtures that the survey describes, newly written, and plain-Python counterparts."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import segment as g

BODY = "the appellant stated the facts at some length."
NUMBERED = "IN THE COURT\n\n" + "\n\n".join(f"{n} Here {BODY}" for n in ("1.", "2.", "3.", "4.1", "4.2", "5.", "6."))


def paras(spark, text):
    return sorted(map(tuple, g.paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("paragraph_order", "strategy", "paragraph_number", "start_char", "end_char", "paragraph_text").collect()))


def test_numbered(spark):
    got = paras(spark, NUMBERED)
    assert [p[2] for p in got] == ["1", "2", "3", "4.1", "4.2", "5", "6"] and {p[1] for p in got} == {"numbered"}
    assert all(p[3] < p[4] for p in got) and [p[3] for p in got] == sorted(p[3] for p in got)
    assert all(p[5] == "Here " + BODY for p in got)


def test_words_and_fallbacks(spark):
    got = paras(spark, "\n".join(f"Para {i} and so {BODY}" for i in range(1, 6)))
    assert [p[2] for p in got] == list("12345") and {p[1] for p in got} == {"para_word"}
    got = paras(spark, "A long line without any number in it. " * 70)
    assert {p[1] for p in got} == {"synthetic"} and all(p[2].startswith("s") for p in got)
    got = paras(spark, "14 days later the notice was served on them.\n15 men were present at that time.")
    assert {p[1] for p in got} == {"synthetic"}
    assert paras(spark, "") == [] and paras(spark, None) == [] and paras(spark, " \n ") == []


def test_repeated_short_and_few(spark):
    got = paras(spark, "\n\n".join(f"{n} Here {BODY}" for n in ("13.", "14.", "14.", "15.")) + "\n\n16. short")
    assert [p[2] for p in got] == ["13", "14", "14#2", "15"]
    assert paras(spark, f"1. {BODY}\n\n2. {BODY}")[0][1] == "synthetic"
    front = "An opening of some length that has no number at all. " * 40
    assert paras(spark, front + "\n" + "\n".join(f"{i}. {BODY}" for i in range(1, 4)))[0][1] == "synthetic"


def chunks(spark, ps, header, target):
    df = spark.createDataFrame([(ps,)], "ps array<struct<paragraph_number:string,paragraph_text:string>>")
    return [(c["chunk_text"], list(c["paragraph_numbers"])) for c in df.select(g.paragraph_chunks(F.col("ps"), F.lit(header), target).alias("c")).first()["c"]]


def test_paragraph_chunks(spark):
    got = chunks(spark, [(str(i), BODY) for i in range(1, 8)], "", 5000)
    assert len(got) == 1 and got[0][1] == list("1234567") and all(f"¶{i}" in got[0][0] for i in range(1, 8))
    got = chunks(spark, [("14", "x" * 3000)], "H\n\n", 1000)
    assert len(got) == 3 and all(n == ["14"] and c.startswith("H\n\n¶14") for c, n in got)
    got = chunks(spark, [("1", "y" * 2800)], "", 100)
    assert len(got) == 28 and got[0][0].startswith("¶1a") and got[25][0].startswith("¶1z") and got[26][0].startswith("¶1_26")
    assert chunks(spark, [], "H", 100) == []
    r = random.Random(1)
    for _ in range(5):
        ps = [(str(i), "z" * r.randint(1, 150)) for i in range(20)]
        want, nums, n = [], [], 0
        for num, body in ps:
            if len(body) > 100:
                want += [nums] if nums else []
                want += [[num]] * -(-len(body) // 100)
                nums, n = [], 0
            elif n + len(body) > 100:
                want.append(nums)
                nums, n = [num], len(body)
            else:
                nums, n = [*nums, num], n + len(body)
        want += [nums] if nums else []
        assert [x for _, x in chunks(spark, ps, "", 100)] == [x for x in want if x]


@pytest.mark.parametrize("n,count", [(0, 0), (1, 1), (1800, 1), (1801, 2), (2000, 2), (2001, 2)])
def test_fixed_windows(spark, n, count):
    df = spark.createDataFrame([(1, "a" * n)], "doc_id int, text string")
    assert g.fixed_chunks(df).count() == count
    assert all(r["chunk_text"].startswith("T: x\n\n") for r in g.fixed_chunks(df, header=g.header([("T", F.lit("x"), None), ("E", F.lit(" "), None)])).collect())


def test_token_batches(spark):
    r = random.Random(3)
    sizes = [r.randint(1, 120) for _ in range(60)]
    want, used, batch = [], 0, -1
    for n in sizes:
        if batch < 0 or used + n > 100:
            batch, used = batch + 1, n
        else:
            used += n
        want.append(batch)
    assert spark.createDataFrame([(sizes,)], "s array<int>").select(g.token_batches(F.col("s"), 100).alias("b")).first()["b"] == want


def test_likeness(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    pairs = [("anna bell", "bell anna"), ("abc", ""), ("", ""), ("a kumar sen", "sen a kumr"), ("contract act", "contracts act")]
    for r in spark.createDataFrame(pairs, "a string, b string").withColumn("s", t.token_sort_ratio(F.col("a"), F.col("b"))).collect():
        a, b = " ".join(sorted(r["a"].split())), " ".join(sorted(r["b"].split()))
        assert abs(r["s"] - (100.0 if not a + b else 200.0 * lcs(a, b) / (len(a) + len(b)))) < 1e-9
    names = {"Ram Lal vs State": "ram lal v state", "Ram  Lal v. State, J.": "ram lal v state j", "Ram Lal vs. State": "ram lal vs state", "A.V. Rao v. State": "av rao v state", "Ram versus State": "ram versus state", "v. State": "v state"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", t.case_name(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in got} == names


def test_offsets_of_paragraphs_that_say_so(spark):
    """A paragraph begins with the blank lines before it, whatever blanks they hold."""
    one = "Para {} and so the appellant stated the facts at length"
    text = "\n\n".join(one.format(i) for i in (1, 2, 3))
    n = len(one.format(1))
    assert [p[3:5] for p in paras(spark, text)] == [(0, n + 1), (n + 1, 2 * n + 3), (2 * n + 3, 3 * n + 4)]
    text = " \n" + one.format(1) + "  \n \n\t\n  " + one.format(2) + "\n" + one.format(3)
    starts = [p[3] for p in paras(spark, text)]
    assert starts == [0, text.index("\n \n\t") + 1, text.index("Para 3")]
