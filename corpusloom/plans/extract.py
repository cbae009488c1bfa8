"""Queries of field extraction, validation and consensus, over decisions written from orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as j
from ..functions import text as t
from ..operators import consensus as k
from ..operators import extract as x
from ..operators import registry as g
from ..sources.tables import spread, table

_KINDS = ("Criminal Appeal", "Civil Appeal", "Writ Petition", "Transfer Petition", "Contempt Petition", "Review Petition", "Original Suit")
_HELD = "The order was placed in time and the price was paid, so that the claim for its return fails in every part of it."


def decisions(spark, d):
    """A text a decision: parts come from the order and its customer; by the order's number six forms of report and seven kinds of case.

    Form 0 says where the case arises from; 1 has its number without brackets, a date and no headnotes; 2 names a heading
    in running text only; 3 has page marks inside; 4 has the parties on one line; 5 has no citation, parties or lists.
    """
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = spread(o.select("o_orderkey", "o_orderpriority", "c_name", "c_mktsegment"), "o_orderkey")
    n, t, kd = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6, F.floor(F.col("o_orderkey") / 6) % 7
    y = (F.lit(2000) + F.col("o_orderkey") % 24).cast("string")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (kd + 1).cast("int"))
    neutral = F.concat(y, F.lit(" INSC "), (F.col("o_orderkey") % 500 + 1).cast("string"), F.lit("\n\n"))
    report = F.concat(F.lit("["), y, F.lit("] "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" S.C.R. "), (F.col("o_orderkey") % 997 + 1).cast("string"), F.lit(" : "))
    state = F.concat(F.lit("State of "), F.col("c_mktsegment"), F.lit("\n"))
    parts = [
        F.when(t == 5, "").when(t == 4, neutral).otherwise(F.concat(report, neutral)),
        F.concat(F.col("c_name"), F.when(t == 4, " v. ").when(t == 5, " against ").otherwise("\nv.\n"), state),
        F.when((t == 1) & (kd != 6), F.concat(kind, F.lit(" (Special) No. "), n, F.lit(" of "), y, F.lit("\n\n"))).otherwise(F.concat(F.lit("("), kind, F.lit(" No. "), n, F.lit(" of "), y, F.lit(")\n\n"))),
        F.when(t == 1, "[12.05.2003]\n\n").otherwise(""),
        F.when(t % 2 == 0, "[A. Rao* and B. Sen, JJ.]\n\n").otherwise("[C. Das, J.]\n\n"),
        F.when(t == 2, "See Issue for Consideration below, and ").otherwise("Issue for Consideration:\n"),
        F.concat(F.lit("Whether the order of this customer was properly placed under "), F.col("o_orderpriority"), F.when(t == 3, " and the income tax").otherwise(""), F.lit(".\n")),
        F.when(t == 1, "Headnotes of earlier reports aren't printed here.\n\n").otherwise("\n"),
        F.when(t == 1, "").when(t == 3, "Headnotes†\nThe order was placed in time.\n12\nDigital Supreme Court Reports\nThe price was paid, * Author so that the claim fails.\n\n").otherwise(f"Headnotes\n{_HELD}\n\n"),
        F.when(t == 5, "").otherwise(F.concat(
            F.lit("Case Law Cited\nAlpha Traders v. Union [1999] 2 SCR 11; Beta Mills v. State, (2001) 3 SCC "), (F.col("o_orderkey") % 50).cast("string"), F.lit("; Ex parte Gamma of "), F.col("c_mktsegment"),
            F.lit("; Short\n\nList of Acts\n– Contract Act, 1872.; Sale Code; held that any act counts; 1999\n\n"), F.when(t == 4, "Keywords").otherwise("List of Keywords"), F.lit("\nSale; Price;\n"), F.col("c_mktsegment"), F.lit("\n\n"))),
        F.when(t == 0, F.concat(F.lit("Case Arising From\nCIVIL APPELLATE JURISDICTION\nCivil Appeal No. "), n, F.lit(" of "), y, F.lit("\nFrom the Judgment and Order dated 1.1."), y, F.lit("\nWith Writ Petition No. 7 of 2001\n\nAppearances for Parties\nCounsel for both\n\n"))).otherwise(""),
        F.when(t == 2, "\nJUDGMENT / ORDER OF THE SUPREME COURT\n").when(t == 3, "\nORDER\n").otherwise("\nJUDGMENT\n"),
        F.when(t % 2 == 1, "\nC. Das, J.\n").otherwise("\n"),
        F.lit("The appeal is decided as follows.\n\nList of Acts\nAnother Act, 1900\n\n"),
        F.when(t == 5, "").otherwise(F.concat(F.when(t == 1, "Result of the Case :\n").otherwise("Result of the case: "), F.when(F.col("o_orderkey") % 20 == 0, "Appeal allowed").otherwise("Appeal dismissed"), F.lit("\nHeadnotes prepared by the editor\n"))),
    ]
    return o.select(F.col("o_orderkey").alias("id"), F.concat(*parts).alias("text"))


_D = f"""d AS (SELECT o_orderkey AS id, o_orderkey % 6 AS t, CAST(o_orderkey AS BIGINT) // 6 % 7 AS kd, c_name, c_mktsegment AS seg, o_orderpriority AS prio, CAST(2000 + o_orderkey % 24 AS VARCHAR) AS y,
CAST(o_orderkey % 9 + 1 AS VARCHAR) AS v, CAST(o_orderkey % 997 + 1 AS VARCHAR) AS pg, CAST(o_orderkey % 500 + 1 AS VARCHAR) AS ns, ({list(_KINDS)})[CAST(o_orderkey AS BIGINT) // 6 % 7 + 1] AS kind FROM orders JOIN customer ON o_custkey = c_custkey)"""
_FAILED = """concat_ws(',', CASE WHEN t = 5 THEN 'extracted_citation,extracted_petitioner,extracted_respondent' END, CASE WHEN kd = 6 AND t <> 0 THEN 'case_number' END, CASE WHEN t = 3 THEN 'author_judge_name' END,
CASE WHEN t = 2 THEN 'issue_for_consideration' END, CASE WHEN t IN (1, 3) THEN 'headnotes' END, CASE WHEN t = 5 THEN 'keywords,result_of_case' END)"""


def _votes(spark, d):
    p = table(spark, d, "part")
    a = lambda *xs: F.array(*xs)
    one, two, three = F.concat(F.lit("w"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("w"), (F.col("p_size") % 3).cast("string")), F.col("p_brand")
    none = F.lit(None).cast("array<string>")
    layout = F.when(F.col("p_partkey") % 4 == 0, a(one, three)).when(F.col("p_partkey") % 4 == 1, F.array().cast("array<string>")).otherwise(none)
    text = F.when(F.col("p_partkey") % 3 != 0, a(two, three)).otherwise(none)
    llm = F.when(F.col("p_partkey") % 5 != 0, a(one, three)).otherwise(none)
    return p.select("p_partkey", k.lists_agree(layout, text, llm).alias("c")).select("p_partkey", F.array_join("c.value", ",").alias("value"), "c.method", "c.confidence")


_VOTES = """WITH p AS (SELECT p_partkey, 'w' || (p_size % 5) AS one, 'w' || (p_size % 3) AS two, p_brand AS three, p_partkey % 4 = 0 AS l, p_partkey % 4 = 1 AS e, p_partkey % 3 <> 0 AS t, p_partkey % 5 <> 0 AS m FROM part)
SELECT p_partkey, CASE WHEN e THEN '' WHEN l THEN one || ',' || three WHEN t AND m AND one = two THEN two || ',' || three WHEN t AND m THEN one || ',' || three WHEN t THEN two || ',' || three WHEN m THEN one || ',' || three ELSE '' END AS value,
CASE WHEN e THEN 'layout' WHEN l AND ((t AND one = two) OR m) THEN 'layout+agree' WHEN l THEN 'layout' WHEN t AND m AND one = two THEN 'text+llm' WHEN t AND m THEN 'llm' WHEN t THEN 'text' WHEN m THEN 'llm' ELSE 'none' END AS method,
CASE WHEN e THEN 0.8 WHEN l AND ((t AND one = two) OR m) THEN 1.0 WHEN l THEN 0.85 WHEN t AND m AND one = two THEN 0.75 WHEN t AND m THEN 0.5 WHEN t OR m THEN 0.6 ELSE 0.0 END AS confidence FROM p"""


def _short(spark, d):
    p = table(spark, d, "part")
    layout = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand"))
    text = F.when(F.col("p_partkey") % 3 != 0, F.upper("p_brand"))
    llm = F.when(F.col("p_partkey") % 5 != 0, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("other"))
    return p.select("p_partkey", k.short_texts_agree(layout, text, llm).alias("c")).select("p_partkey", "c.value", "c.method", "c.confidence")


def _fields(spark, d):
    return x.all_fields(decisions(spark, d))


def _cut(spark, d, *names):
    return decisions(spark, d).withColumn("s", x.sections(F.col("text"), names))


def _judges(spark, d):
    """Votes on judges: names of parts, as text and model spell them; the registry has them plainly."""
    p = table(spark, d, "part").select("p_partkey", F.initcap("p_name").alias("n"))
    reg = p.select(g.judge_key(F.col("n")).alias("key"), F.col("n").alias("canonical")).distinct()
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.array(F.concat(F.lit("Hon'ble Mr. Justice "), "n"))).alias("text"), F.when(F.col("p_partkey") % 4 != 0, F.array(F.concat(F.upper("n"), F.lit(", J.")))).alias("llm"))
    done = k.judges_in_registry_form(rows, "p_partkey", ("text", "llm"), reg)
    c = done.select("p_partkey", k.lists_agree(F.lit(None).cast("array<string>"), F.col("text"), F.col("llm")).alias("c"))
    return c.select("p_partkey", F.col("c.method").alias("method"), F.col("c.confidence").alias("confidence"))


def _dispatch(spark, d):
    p = table(spark, d, "part")
    even = F.col("p_partkey") % 2 == 0
    none = F.lit(None).cast("string")
    votes = p.select(
        "p_partkey", F.struct(F.when(even, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("keywords"), F.when(even, F.col("p_name")).alias("headnotes")).alias("layout"),
        F.struct(F.array("p_brand").alias("keywords"), F.col("p_type").alias("case_category"), F.col("p_name").alias("headnotes")).alias("text"),
        F.struct(F.array("p_type").alias("keywords"), F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).when(F.col("p_size") % 3 == 0, "other").otherwise(none).alias("case_category")).alias("llm"))
    c = k.agreed(votes, "p_partkey")
    return c.select("p_partkey", F.array_join("keywords.value", "|").alias("keywords"), F.col("keywords.method").alias("how_keywords"), F.col("case_category.value").alias("category"), F.col("case_category.confidence").alias("sure"), F.col("headnotes.method").alias("how_headnotes"))


def _backfill(spark, d):
    p = table(spark, d, "part")
    empty = F.array().cast("array<string>")
    rows = p.select(
        "p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.array("p_brand")).when(F.col("p_partkey") % 4 == 1, empty).alias("layout"), (F.col("p_partkey") % 8 == 0).alias("layout_known"),
        F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand")).alias("text"), F.when(F.col("p_partkey") % 5 == 0, F.array("p_brand")).when(F.col("p_partkey") % 5 == 1, empty).when(F.col("p_partkey") % 5 != 2, F.array("p_type")).alias("stored"))
    return k.acts_backfilled(rows, "p_partkey", 0.7).select("p_partkey", F.array_join("value", "|").alias("value"), "method", "confidence", "written")


def _layout(spark, d):
    p = table(spark, d, "part")
    block = F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 3 == 1, " \n").otherwise(F.concat("p_brand", F.lit("; "), "p_type"))
    parsed = k.layout_block(block, lambda b: F.filter(F.transform(F.split(b, ";"), t.strip), lambda i: i != ""))
    found = F.when(F.col("p_partkey") % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    merged = p.select("p_partkey", parsed.alias("layout"), found.alias("found")).withColumn("merged", k.layout_merged(F.col("found"), F.col("layout"), "array<string>"))
    return merged.select("p_partkey", F.size("layout").alias("n_layout"), F.col("layout").isNull().alias("unavailable"), F.array_join("merged", "|").alias("merged"))


def _filled(spark, d):
    """The model's value first, the rules' where it is empty; texts, lists and both missing."""
    p = table(spark, d, "part")
    model = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, " ")
    listed = F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    rules = F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    return p.select("p_partkey", k.filled(model, rules, "string").alias("text"), F.array_join(k.filled(listed, F.array("p_name"), "array<string>"), "|").alias("list"))


def _lists(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.to_json(F.array("p_brand", F.lit(" "), "p_type"))).when(F.col("p_partkey") % 4 == 1, F.to_json(F.array(F.struct(F.col("p_brand").alias("name"))))).when(F.col("p_partkey") % 4 == 2, F.col("p_brand")).alias("v"))
    return rows.select("p_partkey", F.array_join(j.string_list(F.col("v")), "|").alias("items"))


QUERIES = {
    "extract_citation": lambda spark, d: decisions(spark, d).select("id", x.citation(F.col("text")).alias("citation")),
    "extract_parties": lambda spark, d: decisions(spark, d).select("id", x.parties(F.col("text")).alias("p")).select("id", "p.petitioner", "p.respondent"),
    "extract_case_number": lambda spark, d: _cut(spark, d, "Case Arising From").select("id", x.case_number(F.col("text")).alias("case_number"), x.category(F.col("text"), F.col("s")).alias("category")),
    "extract_judges": lambda spark, d: decisions(spark, d).select("id", F.array_join(x.judge_names(F.col("text")), "|").alias("judges"), x.author_judge(F.col("text")).alias("author")),
    "extract_sections": lambda spark, d: _cut(spark, d, "Issue for Consideration", "Headnotes").select("id", x.section(F.col("s"), "Issue for Consideration").alias("issue"), x.section(F.col("s"), "Headnotes").alias("headnotes")),
    "extract_lists": lambda spark, d: _cut(spark, d, "Case Law Cited", "List of Acts", "Keywords", "List of Keywords").select("id", F.array_join(x.acts_cited(F.col("s")), "|").alias("acts"), F.array_join(x.keywords(F.col("s")), "|").alias("keywords"), F.array_join(F.transform(x.cases_cited(F.col("s")), lambda c: F.concat(c["name"], F.lit("~"), c["citation"])), "|").alias("cases")),
    "extract_arising": lambda spark, d: _cut(spark, d, "Case Arising From").select("id", x.arising_from(F.col("s")).alias("a")).select("id", "a.jurisdiction", "a.primary_case", "a.lower_court_details", F.array_join("a.connected_cases", "|").alias("connected")),
    "extract_result": lambda spark, d: decisions(spark, d).select("id", x.result(F.col("text")).alias("result")),
    "extract_all_counts": lambda spark, d: _fields(spark, d).groupBy("fields_extracted", "bench_size").agg(F.count(F.lit(1)).alias("n")),
    "validate_fields_report": lambda spark, d: k.report(_fields(spark, d), "id").groupBy("field", "valid", "issue").agg(F.count(F.lit(1)).alias("n")),
    "validate_and_fix": lambda spark, d: k.validated(_fields(spark, d)).select("id", F.array_join("failed", ",").alias("failed"), "bench_size"),
    "consensus_judges": _judges,
    "consensus_dispatch": _dispatch,
    "acts_backfill": _backfill,
    "layout_merge": _layout,
    "rules_fill_model": _filled,
    "consensus_lists": _votes,
    "consensus_short": _short,
    "array_jaccard": lambda spark, d: table(spark, d, "part").select("p_partkey", F.round(t.jaccard(F.split("p_name", " "), F.split("p_type", " ")), 6).alias("j"), F.size(F.array_union(F.split("p_name", " "), F.split("p_brand", " "))).alias("n")),
    "json_list_normaliser": _lists,
    "model_json_recovery": lambda spark, d: table(spark, d, "part").select("p_partkey", F.get_json_object(j.model_object(F.concat(F.lit("Sure:\n```json\n{\"brand\": \""), "p_brand", F.lit("\", \"n\": "), F.col("p_size").cast("string"), F.lit("}\n``` done"))), "$.n").cast("int").alias("n")),
    "needs_ocr": lambda spark, d: table(spark, d, "documents").select("doc_id", x.needs_ocr(F.col("text"), F.col("doc_id") % 60).alias("ocr")),
}

SQL = {
    "extract_citation": f"WITH {_D} SELECT id, CASE WHEN t = 5 THEN NULL WHEN t = 4 THEN y || ' INSC ' || ns ELSE '[' || y || '] ' || v || ' S.C.R. ' || pg || ' : ' || y || ' INSC ' || ns END AS citation FROM d",
    "extract_parties": f"WITH {_D} SELECT id, CASE WHEN t <> 5 THEN c_name END AS petitioner, CASE WHEN t = 5 THEN NULL WHEN t = 1 AND kd <> 6 THEN 'State of ' || seg || ' ' || kind || ' (Special) No. ' || id || ' of ' || y ELSE 'State of ' || seg END AS respondent FROM d",
    "extract_case_number": f"""WITH {_D} SELECT id, CASE WHEN kd = 6 THEN CASE WHEN t = 0 THEN 'Civil Appeal No. ' || id || ' of ' || y END WHEN t = 1 THEN kind || ' (Special) No. ' || id || ' of ' || y ELSE kind || ' No. ' || id || ' of ' || y END AS case_number,
CASE WHEN kd = 0 THEN 'Criminal' WHEN kd = 1 OR t = 0 THEN 'Civil' WHEN kd = 2 THEN 'Constitutional' WHEN t = 3 THEN 'Tax' WHEN kd = 3 THEN 'Transfer' WHEN kd = 4 THEN 'Contempt' WHEN kd = 5 THEN 'Review' ELSE 'Other' END AS category FROM d""",
    "extract_judges": f"WITH {_D} SELECT id, CASE WHEN t % 2 = 0 THEN 'A. Rao|B. Sen' ELSE 'C. Das' END AS judges, CASE WHEN t % 2 = 0 THEN 'A. Rao' WHEN t <> 3 THEN 'C. Das' END AS author FROM d",
    "extract_sections": f"""WITH {_D} SELECT id, CASE WHEN t <> 2 THEN 'Whether the order of this customer was properly placed under ' || prio || CASE WHEN t = 3 THEN ' and the income tax' ELSE '' END || '.' END AS issue,
CASE WHEN t = 3 THEN 'The order was placed in time.' || chr(10) || 'The price was paid,  so that the claim fails.' WHEN t <> 1 THEN '{_HELD}' END AS headnotes FROM d""",
    "extract_lists": f"""WITH {_D} SELECT id, CASE WHEN t = 5 THEN '' ELSE 'Contract Act, 1872|Sale Code' END AS acts, CASE WHEN t = 5 THEN '' ELSE 'Sale|Price|' || seg END AS keywords,
CASE WHEN t = 5 THEN '' ELSE 'Alpha Traders v. Union~[1999] 2 SCR 11|Beta Mills v. State~(2001) 3 SCC ' || (id % 50) || '|Ex parte Gamma of ' || seg || '~' END AS cases FROM d""",
    "extract_arising": f"WITH {_D} SELECT id, CASE WHEN t = 0 THEN 'CIVIL APPELLATE JURISDICTION' END AS jurisdiction, CASE WHEN t = 0 THEN 'Civil Appeal No. ' || id || ' of ' || y END AS primary_case, CASE WHEN t = 0 THEN 'From the Judgment and Order dated 1.1.' || y END AS lower_court_details, CASE WHEN t = 0 THEN 'Writ Petition No. 7 of 2001' ELSE '' END AS connected FROM d",
    "extract_result": f"WITH {_D} SELECT id, CASE WHEN t = 5 THEN NULL WHEN id % 20 = 0 THEN 'Appeal allowed' ELSE 'Appeal dismissed' END AS result FROM d",
    "extract_all_counts": f"WITH {_D} SELECT CAST(13 - 7 * CAST(t = 5 AS INT) - CAST(kd = 6 AND t <> 0 AS INT) - CAST(t IN (1, 2, 3) AS INT) AS INT) AS fields_extracted, CAST(CASE WHEN t % 2 = 0 THEN 2 ELSE 1 END AS INT) AS bench_size, count(*) AS n FROM d GROUP BY ALL",
    "validate_fields_report": f"""WITH {_D}, f AS (SELECT unnest([
{{'field': 'extracted_citation', 'issue': CASE WHEN t = 5 THEN 'missing' END}}, {{'field': 'extracted_petitioner', 'issue': CASE WHEN t = 5 THEN 'missing' END}}, {{'field': 'extracted_respondent', 'issue': CASE WHEN t = 5 THEN 'missing' END}},
{{'field': 'case_category', 'issue': NULL}}, {{'field': 'case_number', 'issue': CASE WHEN kd = 6 AND t <> 0 THEN 'missing' END}}, {{'field': 'judge_names', 'issue': NULL}}, {{'field': 'author_judge_name', 'issue': CASE WHEN t = 3 THEN 'missing' END}},
{{'field': 'bench_size', 'issue': NULL}}, {{'field': 'issue_for_consideration', 'issue': CASE WHEN t = 2 THEN 'missing' END}}, {{'field': 'headnotes', 'issue': CASE WHEN t = 1 THEN 'missing' WHEN t = 3 THEN 'invalid_format' END}},
{{'field': 'cases_cited', 'issue': NULL}}, {{'field': 'acts_cited', 'issue': NULL}}, {{'field': 'keywords', 'issue': CASE WHEN t = 5 THEN 'invalid_format' END}}, {{'field': 'case_arising_from', 'issue': NULL}}, {{'field': 'result_of_case', 'issue': CASE WHEN t = 5 THEN 'missing' END}}]) AS r FROM d)
SELECT r.field AS field, r.issue IS NULL AS valid, r.issue AS issue, count(*) AS n FROM f GROUP BY ALL""",
    "validate_and_fix": f"WITH {_D} SELECT id, {_FAILED} AS failed, CAST(CASE WHEN t % 2 = 0 THEN 2 ELSE 1 END AS INT) AS bench_size FROM d",
    "consensus_dispatch": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS keywords, CASE WHEN p_partkey % 2 = 0 THEN 'layout+agree' ELSE 'layout' END AS how_keywords,
CASE WHEN p_size % 2 <> 0 AND p_size % 3 = 0 THEN 'other' ELSE p_type END AS category, CAST(CASE WHEN p_size % 2 = 0 THEN 0.8 WHEN p_size % 3 = 0 THEN 0.5 ELSE 0.6 END AS DOUBLE) AS sure, CASE WHEN p_partkey % 2 = 0 THEN 'layout+agree' ELSE 'text' END AS how_headnotes FROM part""",
    "acts_backfill": """WITH p AS (SELECT p_partkey, p_brand AS b, p_type AS y, p_partkey % 4 = 0 AS l, p_partkey % 4 = 1 AS e, p_partkey % 8 = 0 AS known, p_partkey % 3 <> 0 AS t, p_partkey % 5 = 0 AS same, p_partkey % 5 IN (3, 4) AS other FROM part)
SELECT p_partkey, CASE WHEN e THEN '' WHEN l THEN b WHEN t AND same THEN b WHEN t AND other THEN y WHEN t THEN b WHEN same THEN b WHEN other THEN y ELSE '' END AS value,
CASE WHEN e THEN 'layout' WHEN l AND (t OR same) THEN 'layout+agree' WHEN l THEN 'layout' WHEN t AND same THEN 'text+llm' WHEN t AND other THEN 'llm' WHEN t THEN 'text' WHEN same OR other THEN 'llm' ELSE 'none' END AS method,
CAST(CASE WHEN e THEN 0.8 WHEN l AND (t OR same) AND known THEN 1.0 WHEN l AND (t OR same) THEN 0.9 WHEN l AND known THEN 0.85 WHEN l THEN 0.7 WHEN t AND same THEN 0.75 WHEN t AND other THEN 0.5 WHEN t THEN 0.55 WHEN same OR other THEN 0.45 ELSE 0.0 END AS DOUBLE) AS confidence,
e OR l OR (t AND same) OR NOT (same OR other) AS written FROM p""",
    "layout_merge": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END AS n_layout, p_size % 3 = 0 AS unavailable, CASE WHEN p_size % 3 = 2 THEN p_brand || '|' || p_type WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS merged FROM part""",
    "rules_fill_model": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_partkey % 7 <> 0 THEN p_name END AS text, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS list FROM part",
    "consensus_judges": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 THEN 'text+llm' WHEN p_partkey % 3 <> 0 THEN 'text' WHEN p_partkey % 4 <> 0 THEN 'llm' ELSE 'none' END AS method,
CAST(CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 THEN 0.75 WHEN p_partkey % 3 <> 0 OR p_partkey % 4 <> 0 THEN 0.6 ELSE 0.0 END AS DOUBLE) AS confidence FROM part""",
    "consensus_lists": _VOTES,
    "consensus_short": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS l, CASE WHEN p_partkey % 3 <> 0 THEN upper(p_brand) END AS t, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'other' END END AS m FROM part)
SELECT p_partkey, coalesce(l, CASE WHEN t IS NOT NULL AND m IS NOT NULL AND lower(t) <> lower(m) THEN m END, t, m) AS value,
CASE WHEN l IS NOT NULL AND coalesce(lower(l) = lower(t) OR lower(l) = lower(m), lower(l) = lower(t), lower(l) = lower(m), false) THEN 'layout+agree' WHEN l IS NOT NULL THEN 'layout' WHEN lower(t) = lower(m) THEN 'text+llm' WHEN t IS NOT NULL AND m IS NOT NULL THEN 'llm' WHEN t IS NOT NULL THEN 'text' WHEN m IS NOT NULL THEN 'llm' ELSE 'none' END AS method,
CASE WHEN l IS NOT NULL AND coalesce(lower(l) = lower(t) OR lower(l) = lower(m), lower(l) = lower(t), lower(l) = lower(m), false) THEN 1.0 WHEN l IS NOT NULL THEN 0.85 WHEN lower(t) = lower(m) THEN 0.8 WHEN t IS NOT NULL AND m IS NOT NULL THEN 0.5 WHEN t IS NOT NULL OR m IS NOT NULL THEN 0.6 ELSE 0.0 END AS confidence FROM p""",
    "array_jaccard": "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type, ' ')) AS b, list_distinct(list_concat(string_split(p_name, ' '), string_split(p_brand, ' '))) AS u FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS j, len(u) AS n FROM p",
    "json_list_normaliser": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '|' || p_type WHEN 3 THEN '' ELSE p_brand END AS items FROM part",
    "model_json_recovery": "SELECT p_partkey, p_size AS n FROM part",
    "needs_ocr": "SELECT doc_id, length(trim(coalesce(text, ''))) < 500 OR length(trim(coalesce(text, ''))) / CAST(greatest(doc_id % 60, 1) AS DOUBLE) < 50 AS ocr FROM documents",
}
