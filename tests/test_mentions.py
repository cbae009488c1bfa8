"""Names in texts, against a plain search of every name in every text."""

import random
import re

import pytest

from corpusloom.operators import mentions as m
from corpusloom.operators import registry as g
from corpusloom.operators import retrieval as r


def told(name, text, short=m.SHORT):
    low = text.lower()
    if len(name) <= short:
        return f" {name} " in " " + re.sub(r"[^a-z0-9]+", " ", low) + " "
    return name in low


def texts(n, seed=5):
    r_ = random.Random(seed)
    words = ["Act", "acts", "of", "the", "rights", "reserved", "copyrights", "Rao", "rao,", "evidence", "evidences", "no.", "A.", "B"]
    return [" ".join(r_.choice(words) for _ in range(r_.randint(0, 12))) + r_.choice(["", ".", "\n", "  "]) for _ in range(n)]


NAMES = ["act", "of the", "rights reserved", "evidence", "evidence act", "rao", "a. b", "a b", "reserved copyrights", "e", "the", "ights rese", "nowhere at all"]


@pytest.mark.parametrize("block", [1 << 21, 20])
def test_every_name_in_every_text(spark, block):
    ts = texts(150) + [""]
    rows = spark.createDataFrame(list(enumerate(ts)) + [(999, None)], "text_id int, text string").repartition(3)
    names = spark.createDataFrame([(n.upper(),) for n in NAMES] + [(None,), ("",), ("Act",)], "name string")
    got = {(x["text_id"], x["name"]) for x in m.occurrences(rows, names, "text_id", block=block).collect()}
    want = {(i, n) for i, t in enumerate(ts) for n in NAMES if told(n, t)}
    assert got == want and len({n for _, n in want}) > 9


def test_first_place(spark):
    rows = spark.createDataFrame([("q", "The ACTS, act: Act of long evidence act")], "id string, text string")
    names = spark.createDataFrame([("act",), ("long evidence",), ("of",)], "name string")
    got = {x["name"]: x["at"] for x in m.occurrences(rows, names, "id", whole=m.spaced).collect()}
    assert got == {"act": 11, "of": 20, "long evidence": 23}


def test_mentions_and_questions(spark):
    aliases = spark.createDataFrame([("Rao",), ("RAO",), ("Rights Reserved",)], "alias string")
    rows = spark.createDataFrame([(1, "of RAO"), (2, "copyrights reserved"), (3, "raos")], "text_id int, text string")
    assert sorted(tuple(x) for x in g.mentions(rows, aliases).collect()) == [(1, "RAO"), (1, "Rao"), (2, "Rights Reserved")]
    assert g.mentions(rows, aliases.where("alias = ''")).count() == 0
    reg = spark.createDataFrame([("IEA", "Evidence Act"), ("evidence act", "Evidence Act"), ("law of evidence", "Evidence Act")], "alias string, canonical string")
    asked = spark.createDataFrame([(1, "What says the Evidence Act?"), (2, "Is IEA, or the law of Evidence, old?"), (3, "none")], "query_id int, question string")
    got = {(x["query_id"], x["variant"]) for x in r.expand(asked, reg).collect()}
    assert got == {
        (1, "What says the Evidence Act?"), (1, "What says the law of evidence?"), (2, "Is IEA, or the law of Evidence, old?"),
        (2, "Is Evidence Act, or the law of Evidence, old?"), (2, "Is IEA, or the Evidence Act, old?"), (3, "none"),
    }
