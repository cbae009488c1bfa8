"""What the findings of round 4 asked for."""

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import extract as x
from corpusloom.operators import segment as g
from corpusloom.plans import segment


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _folded(paras, head, target):
    out, body, n, nums = [], "", 0, []
    for num, text in paras:
        text = text.strip()
        if text and n + len(text) > target and nums:
            out.append((head + body, nums))
            body, n, nums = "", 0, []
        if len(text) > target:
            cut = [text[i:i + target] for i in range(0, len(text), target)]
            out += [(f"{head}¶{num}{chr(97 + i) if i < 26 else f'_{i}'}  {c}", [num]) for i, c in enumerate(cut)]
        elif text:
            body, n, nums = (body + "\n\n" if body else "") + f"¶{num}  {text}", n + len(text), [*nums, num]
    return [*out, (head + body, nums)] if nums else out


def test_chunks_of_paragraphs_are_those_of_a_plain_fold(spark):
    cases = [[], [("1", "")], [("1", "abc"), ("2", " \n"), ("3", "defg")], [("1", "x" * 10), ("2", "y" * 11), ("3", "z" * 25), ("4", "u")], [("1", "ab"), ("2", "c" * 300), ("3", "d" * 8), ("4", "e" * 3)], [("1", "k" * 10)], [("1", "é" * 5), ("1#2", "中" * 6)]]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, ps array<struct<paragraph_number:string,paragraph_text:string>>")
    got = {r["id"]: [(c["chunk_text"], c["paragraph_numbers"]) for c in r["c"]] for r in rows.select("id", g.paragraph_chunks(F.col("ps"), F.lit("H "), 10).alias("c")).collect()}
    assert got == {i: _folded(ps, "H ", 10) for i, ps in enumerate(cases)}


def test_paragraphs_are_chunked_in_their_row(spark, sf):
    plan = _plan(segment.QUERIES["chunk_paragraphs"](spark, sf))
    assert "Aggregate" not in plan and plan.count("collect_list") == 0


def test_words_are_found_in_capitals_without_other_letters(spark):
    said = ["", "civil", "CıVIL appeal", "Tranſfer", "criminal – x", "é†civil", "ﬁx", "straße", "😀tax", "k\u212a", "\u0130x", None]
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    for word in ("CIVIL", "TRANSFER", "CRIMINAL", "FIX", "STRASSE", "TAX", "K", "IX"):
        assert rows.where(~F.contains(t.capitals(F.col("t")), F.lit(word)).eqNullSafe(F.contains(F.upper("t"), F.lit(word)))).count() == 0
    heads = spark.createDataFrame([(x,) for x in ("", "abc", "abcd", "éab", "ééé", "éééé", "a😀😀b", None)], "t string")
    assert heads.where(~t.head(F.col("t"), 3).eqNullSafe(F.substring("t", 1, 3))).count() == 0


def test_parts_of_texts_that_several_rules_read_are_made_once(spark):
    d = spark.createDataFrame([(1, "[A. Rao* and B. Sen, JJ.]\n\nA\n v. \nB\n(Civil Appeal No. 1 of 2001)\nHeadnotes\nOne.\n 12 \nTwo, * Author three.\n\nList of Acts:\n– Sale Code.; A v. B Act\nJudgment")], "id int, text string")
    made = x.all_fields(d)
    assert _plan(made).count(r"\[([^\]]*)\]") == 1  # the bench, for names and author
    row = made.first()
    assert (row.extracted_petitioner, row.extracted_respondent, row.author_judge_name, row.headnotes, row.acts_cited) == ("A", "B", "A. Rao", "One.\nTwo,  three.", ["Sale Code"])
