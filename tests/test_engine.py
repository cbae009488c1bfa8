"""Filters, citations, context, consensus, sinks, registries, streams and the queries as a whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusloom.operators import consensus, context, evaluate, extract, filters, lookup, ops, quality, registry, retrieval, search
from corpusloom.sources import sinks, tables
from corpusloom.streaming import operational


def answers(spark, text):
    return spark.createDataFrame([(1, text)], "answer_id int, text string")


CASES = [(1, 1, ["12", "28"]), (1, 2, ["14", "42"]), (1, 3, ["14.1", "14.2"])]


@pytest.mark.parametrize("text,markers,bad", [
    ("as in [^1] and [^2, ¶14]", 2, []), ("see [^9]", 1, ["unknown_case"]), ("see [^1, ¶99]", 1, ["unknown_paragraph"]), ("see [^2, ¶42a]", 1, []),
    ("see [^3, ¶14.1] [^3, ¶14.2]", 2, []), ("[^9] [^9] [^9]", 3, ["unknown_case"] * 3), ("none", 0, []), ("[^1] [^2] [^3]", 3, []), ("[^1,¶28] [^1, ¶28]", 2, []),
])
def test_citations(spark, text, markers, bad):
    cases = spark.createDataFrame(CASES, "answer_id int, index int, chunk_paragraphs array<string>")
    got = context.citations(answers(spark, text), cases).orderBy("pos").collect()
    assert len(got) == markers and [r["reason"] for r in got if r["reason"]] == bad
    one = context.checked_answers(answers(spark, text), cases).first()
    assert one["n_mismatches"] == len(bad) and (one["text"] == text) == (not bad) and one["text"].count("\n- ") == len({m for m in bad})


def test_merged_text(spark):
    parts = [(0, "a" * 10), (1, "b" * 10), (3, "c" * 10)]
    df = spark.createDataFrame([(parts,)], "p array<struct<chunk_index:bigint,text:string>>")
    merge = lambda n: df.select(context.merged_text(F.col("p"), n)).first()[0]
    assert merge(100) == "a" * 10 + "\n" + "b" * 10 + context.GAP + "c" * 10
    assert merge(25) == "a" * 10 + "\n" + "b" * 10 + context.GAP + "c" * 5
    assert merge(20) == "a" * 10 + "\n" + "b" * 10


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 90), (2, 5), (3, 50), (4, 1)], "i int, n int")
    assert [r["i"] for r in context.within_budget(df, ["i"], "n", 100).orderBy("i").collect()] == [1, 2]
    assert [r["i"] for r in context.within_budget(df, ["i"], "n", 10).collect()] == [1]


def test_budget_of_many_rows(spark):
    """Dealt out or not, the same rows are in: groups of many rows, rows without a size, large first rows."""
    r = random.Random(2)
    rows = [(g, i, r.choice([None, 0, 1, 5, 40, 90, 200])) for g in range(12) for i in range(r.choice([1, 3, 60, 400]))]
    want = set()
    for g in range(12):
        used = 0
        for k, (_, i, n) in enumerate(x for x in rows if x[0] == g):
            used += n or 0
            if k and used > 300:
                break
            want.add((g, i))
    df = spark.createDataFrame(rows, "g int, i int, n int").repartition(5)
    assert {(x["g"], x["i"]) for x in context.within_budget(df, ["i"], "n", 300, ("g",)).collect()} == want


def test_filters():
    f = filters.Filters.parse({"category": " Civil ", "year_from": "2001", "year_to": "x", "judge": ""})
    assert f.active() == {"category": "Civil", "year_from": 2001}
    assert f.merged(filters.Filters(category="Writ")).active() == {"category": "Writ", "year_from": 2001}
    assert filters.Filters(year_from=0).active() == {}


def test_search_needs_a_filter(spark, sf):
    cases = tables.cases(tables.table(spark, sf, "documents"))
    with pytest.raises(ValueError):
        search.search_page(cases, filters.Filters())
    assert search.diagnostics(cases, filters.Filters(year_from=1990, year_to=2100)).count() == 0
    assert search.find_by_title(cases, " a ").count() == 0


def test_fusion_prefers_earlier_lists(spark):
    a = spark.createDataFrame([(0, 7, 1), (0, 8, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(0, 9, 1), (0, 8, 2)], "query_id int, chunk_id int, rank int")
    got = retrieval.fuse([("fts", a), ("vec", b)]).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == [8, 7, 9] and abs(got[0]["score"] - 2 / 62) < 1e-12 and got[0]["tags"] == ["fts_q0", "vec_q0"]


def test_concatenation_hides_the_second_register(spark):
    rows = [(0, i, "sc", i + 1) for i in range(3)] + [(0, 10 + i, "hc", i + 1) for i in range(3)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, source_table string, rank int")
    assert [r["chunk_id"] for r in retrieval.concatenated(df, "sc", 4).orderBy("rank").collect()] == [0, 1, 2, 10]


def test_expansion(spark):
    reg = spark.createDataFrame([("IPC", "Penal Code"), ("Penal Code", "Penal Code"), ("Indian Penal Law", "Penal Code")], "alias string, canonical string")
    q = spark.createDataFrame([(0, "murder under IPC"), (1, "the penal code today"), (2, "recipcal")], "query_id int, question string")
    got = {(r["query_id"], r["variant"]) for r in retrieval.expand(q, reg).collect()}
    assert got == {(0, "murder under IPC"), (0, "murder under Penal Code"), (1, "the penal code today"), (1, "the Indian Penal Law today"), (2, "recipcal")}


def test_consensus(spark):
    def lists(a, b, c):
        df = spark.createDataFrame([(a, b, c)], "a array<string>, b array<string>, c array<string>")
        r = df.select(consensus.lists_agree(F.col("a"), F.col("b"), F.col("c")).alias("r")).first()["r"]
        return list(r["value"]), r["confidence"]

    assert lists([], ["x"], ["x"]) == ([], 0.8) and lists(["x"], ["x"], None) == (["x"], 1.0) and lists(["x"], ["y"], None) == (["x"], 0.85)
    assert lists(None, list("abcde"), list("abcd")) == (list("abcde"), 0.75) and lists(None, ["a"], ["b"]) == (["b"], 0.5) and lists(None, None, ["b"]) == (["b"], 0.6) and lists(None, None, None) == ([], 0.0)
    df = spark.createDataFrame([("the claim fails in full today", "claim fails in full", None)], "a string, b string, c string")
    assert df.select(consensus.long_texts_agree(F.lit(None).cast("string"), F.col("a"), F.col("b")).alias("r")).first()["r"]["confidence"] == 0.75
    case = "array<struct<name:string,citation:string>>"
    df = spark.createDataFrame([([("A v. B", "1")], [("a vs. b", "1"), ("C v. D", None)])], f"t {case}, m {case}")
    r = df.select(consensus.case_lists_agree(F.lit(None).cast(case), F.col("t"), F.col("m")).alias("r")).first()["r"]
    assert r["confidence"] == 0.5 and len(r["value"]) == 2


def fields(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return extract.all_fields(df).first().asDict(recursive=True)


def test_sections_need_a_line_of_their_own(spark):
    head = "[2003] 4 S.C.R. 77 : 2003 INSC 9\n\nA. Khan\nv.\nState of Goa\n(Review Petition No. 5 of 2003)\n\n"
    got = fields(spark, head + "In the headnotes\nare no Headnotes of any kind.\nHeadnotes*:\nFirst holding.\n\nList of Acts and more\nOne\nJUDGMENT\nList of Acts\nLate Act, 1999\n")
    assert got["headnotes"] == "First holding." and got["acts_cited"] == [] and got["case_category"] == "Review" and got["case_number"] == "Review Petition No. 5 of 2003"
    long = fields(spark, head + "Headnotes\n" + "x" * 4000)
    assert len(long["headnotes"]) == extract.SECTION_CHARS and long["issue_for_consideration"] is None
    assert fields(spark, "Headnotes\n" + "y" * 40_000 + "\nList of Acts\nLate Act, 1999\n")["acts_cited"] == []
    none = fields(spark, None)
    assert none["fields_extracted"] == 1 and none["case_category"] == "Other" and none["judge_names"] == []


@pytest.mark.parametrize("text,kind", [
    ("Criminal and civil", "Criminal"), ("SLP (C) 4", "Civil"), ("a writ petition", "Constitutional"), ("income tax", "Tax"), ("transfer of a petition", "Transfer"), ("transfer alone", "Other"),
    ("contempt and review", "Contempt"), ("review", "Review"), ("x" * 5000 + " criminal", "Other"), ("z" * 5000 + "\nCase Arising From\nCivil Jurisdiction\nJUDGMENT\n", "Civil"),
])
def test_categories(spark, text, kind):
    assert fields(spark, text)["case_category"] == kind


@pytest.mark.parametrize("text,number", [
    ("(Civil Appeal No. 12 of 2003)", "Civil Appeal No. 12 of 2003"), ("(Writ Petition (Civil) No. 1-3 OF 1999)", "Writ Petition (Civil) No. 1-3 OF 1999"), ("in Special Leave Petition No. 7/8 of 2001 we", "Special Leave Petition No. 7/8 of 2001"),
    ("Civil Appeal No. 12", None), ("x" * 3000 + "(Civil Appeal No. 12 of 2003)", None), ("(In the matter of a long Civil Suit No. 3 of 2004)", None),
])
def test_case_numbers(spark, text, number):
    assert fields(spark, text)["case_number"] == number


def test_page_marks_go(spark):
    c = spark.createDataFrame([("a\u0008b [2003] 4 S.C.R.\nc\n 17 \nd Digital Supreme Court Reports\ne * Author\nState of A. v. B. Roy\n7) f  g\n\n\n\nh ",)], "t string")
    assert c.select(extract.cleaned(F.col("t"))).first()[0] == "ab c\nd e \n7) f  g\n\n\n\nh " and c.select(extract.cleaned(F.col("t"), flat=True)).first()[0] == "ab c\nd e \n7) f g\n\nh"


def test_layout_blocks_and_registry_names(spark):
    p = spark.createDataFrame([(1, None, ["x"]), (2, " ", ["x"]), (3, " ", []), (4, "a; b", ["x"])], "i int, b string, f array<string>")
    lists = consensus.layout_block(F.col("b"), lambda b: F.transform(F.split(b, ";"), lambda x: F.trim(x)))
    got = {r["i"]: (r["l"], r["m"]) for r in p.withColumn("l", lists).withColumn("m", consensus.layout_merged(F.col("f"), F.col("l"), "array<string>")).collect()}
    assert got == {1: (None, ["x"]), 2: ([], ["x"]), 3: ([], []), 4: (["a", "b"], ["a", "b"])}
    judges = spark.createDataFrame([("B.R", []), ("Aniruddha Bose andB. Pardiwala", []), ("2 Judge Bench", []), ("A. K. Sikri", ["Sikri"]), ("Chandrachud", [])], "canonical string, aliases array<string>")
    assert {r["alias"] for r in registry.search_names(judges, judges.limit(0)).collect()} == {"A. K. Sikri", "Sikri"}


def test_live_search_equals_the_index(spark, sf, monkeypatch):
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = spark.createDataFrame([(0, "Licensed under the License"), (1, "all rights reserved"), (2, "of the"), (3, "nowhere to be found")], "query_id int, question string")
    all_ = {tuple(r) for r in retrieval.match_all(retrieval.postings(docs), asked).collect()}
    some = retrieval.with_all_terms(docs, asked)
    assert all_ and some.count() < docs.count() and {tuple(r) for r in retrieval.match_all(retrieval.postings(some), asked).collect()} == all_
    monkeypatch.setattr(retrieval, "LIVE_QUERIES", 1)
    assert retrieval.with_all_terms(docs, asked) is docs


def test_session_pieces(spark):
    m = spark.createDataFrame([({"court": "SC", "year": "2001"}, {"court": "", "judge": None})], "tool map<string,string>, session map<string,string>")
    assert m.select(context.merged_filters(("court", "year", "judge"))).first()[0] == {"year": "2001"}
    a = spark.createDataFrame([(["  ", " 4 "],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in a.select(context.paragraph_labels(F.col("a"))).collect()] == [["4"], None, None]
    t = spark.createDataFrame([("a.b*(c)[d]\\",)], "t string").select("t", context.escaped(F.col("t")).alias("p"))
    assert t.where("t RLIKE concat('^', p, '$')").count() == 1 and t.where("'axb*(c)[d]' RLIKE p").count() == 0
    rows = spark.createDataFrame([(1, 7), (2, 8)], "id int, user_id int")
    assert context.owned(rows, F.lit(1), F.lit(7)).count() == 1 and context.owned(rows, F.lit(1), F.lit(8)).count() == 0


def test_registry(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"entries": [{"canonical": "Contract Act", "aliases": ["C Act"]}, {"canonical": "Contract Act 2", "aliases": ["C ACT"]}]}))
    got = {r["key"]: r["canonical"] for r in tables.registry(spark, str(path)).collect()}
    assert got == {"contract act": "Contract Act", "contract act 2": "Contract Act 2", "c act": "Contract Act 2"}
    names = spark.createDataFrame([("A. B. Khan Sharma",), ("A B Khan Sharma",), ("Other Person",)], "name string")
    groups = {r["name"]: r["canonical"] for r in registry.clusters(names).collect()}
    assert groups == {"A. B. Khan Sharma": "A. B. Khan Sharma", "A B Khan Sharma": "A. B. Khan Sharma", "Other Person": "Other Person"}
    keys = spark.createDataFrame([("The Contract Act, 1872", "Hon'ble Mr. Justice A.B. Sen, J.")], "a string, j string").select(registry.act_key(F.col("a")), registry.judge_key(F.col("j"))).first()
    assert keys[0] == "contract act 1872" and keys[1] == "a b sen"


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, n int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(sinks.upsert(old, new, ["k"])) == sorted([(1, "a", 1), (2, None, 9), (3, "c", 3), (None, "n", 0)], key=str)
    assert (2, "b", 9) in rows(sinks.upsert(old, new, ["k"], coalesce_new=True)) and (2, "b", 2) in rows(sinks.upsert(old, new, ["k"], keep_old=True))
    assert rows(sinks.replace_by_key(old, new, ["k"])) == sorted([(1, "a", 1), (2, None, 9), (3, "c", 3), (None, "n", 0)], key=str)


def test_evaluation(spark):
    expected = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "query_id int, key int")
    ranked = spark.createDataFrame([(1, 11, 3), (1, 11, 9), (1, 10, 8), (1, 5, 1)], "query_id int, key int, rank int")
    got = {r["query_id"]: r for r in evaluate.per_query(expected, ranked).collect()}
    assert got[1]["first_rank"] == 3 and got[1]["recall_5"] == 0.5 and got[1]["recall_10"] == 1.0 and got[2]["reciprocal"] == 0.0


def test_retention_and_reports(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at, 'x' AS data UNION ALL SELECT 2, TIMESTAMP_NTZ '2024-02-10 00:00:00', 'y'")
    now = F.expr("TIMESTAMP_NTZ '2024-02-15 00:00:00'")
    assert [r["id"] for r in ops.retain(df, now).collect()] == [2]
    assert {r["id"]: r["data"] for r in ops.forget(df, "data", now).collect()} == {1: None, 2: "y"}
    assert quality.assertions([("twice", quality.duplicates(df.union(df), ["id"]))]).first()["violations"] == 2
    assert tables.schema_drift(df, ["id", "gone"]) == {"missing": ["gone"], "extra": ["created_at", "data"]}


def test_streams_equal_batches(spark, sf, tmp_path):
    events = tables.table(spark, sf, "events")
    src = tmp_path / "in"
    events.write.parquet(str(src))
    seen = []
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    operational.run_available(operational.daily(stream), str(tmp_path / "c"), lambda df, _: seen.append({tuple(r) for r in df.collect()}), "complete")
    assert seen[-1] == {tuple(r) for r in operational.daily(events).collect()}
    found = []
    operational.run_available(operational.sessions(stream, "12 hours"), str(tmp_path / "c1"), lambda df, _: found.append({tuple(r) for r in df.collect()}), "complete")
    assert found[-1] == {tuple(r) for r in operational.sessions(events, "12 hours").collect()}
    for _ in range(2):  # the second time nothing is new
        operational.incremental(spark.readStream.schema(events.schema).parquet(str(src)), str(tmp_path / "c2"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_archives(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("x/one.pdf", b"1" * 10), ("two_EN.pdf", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = lookup.members(spark.read.format("binaryFile").load(str(tmp_path / "a.tar"))).collect()
    assert sorted((r["member"], r["size"], bytes(r["content"])) for r in got) == [("two_EN.pdf", 0, b""), ("x/one.pdf", 10, b"1" * 10)]
    files = spark.createDataFrame([("d/case_1_HIN.pdf",), ("d/case_1_HIN.txt",), ("d/case_2.pdf",)], "file string")
    found = {r["path"]: r["file"] for r in lookup.located(spark.createDataFrame([("2001/case_1",), ("case_2",), ("case_3",)], "path string"), files).collect()}
    assert found == {"2001/case_1": "d/case_1_HIN.pdf", "case_2": "d/case_2.pdf", "case_3": None}


def test_vector_blocks(spark, monkeypatch):
    """Blocks of queries find what one block finds."""
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)], "chunk_id int, embedding array<double>")
    asked = rows.where("chunk_id < 9").selectExpr("chunk_id AS query_id", "embedding AS vector")
    whole = sorted(map(tuple, retrieval.vector_hits(rows, asked, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, retrieval.vector_hits(rows, asked, 4).collect())) == whole and len(whole) == 36


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(n for m in __spark_entry__._MODULES for n in m.QUERIES))
def test_query_matches_its_sql(spark, sf, name):
    """Row counts and columns of every query, against DuckDB where it has SQL."""
    got = __spark_entry__.queries()[name](spark, sf)
    sql = __spark_entry__.oracle_sql().get(name)
    rows = got.count()
    if sql:
        import duckdb

        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        other = con.sql(sql)
        assert sorted(other.columns) == sorted(got.columns) and len(other.fetchall()) == rows


def test_registry_compares_all_pairs(spark):
    """Names without a common word are found; scores equal those of all pairs."""
    names = ["evidance", "evidence", "chandrachood d y", "chandrachud d y", "d y chandrachud", "sale code", "sales codes", "aab", "abb", "contract act", "contracts acts", "x", "", "unlike"]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b):
                row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
        return row[-1]

    def likeness(a, b):
        x, y = (" ".join(sorted(n.split())) for n in (a, b))
        return 200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0

    t = spark.createDataFrame([(n,) for n in names], "name string")
    for least in (60, 75, 82, 88):
        want = {(a, b): likeness(a, b) for a in names for b in names if a < b and likeness(a, b) >= least}
        got = {(r["a"], r["b"]): r["score"] for r in registry.likely_pairs(t, least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    reg = spark.createDataFrame([("evidence", "Evidence"), ("chandrachud d y", "D. Y. Chandrachud")], "key string, canonical string")
    asked = spark.createDataFrame([("Evidance",), ("Chandrachood D. Y.",), ("unlike",)], "name string")
    found = {r["name"]: (r["canonical"], r["score"]) for r in registry.matched(asked, reg, registry.judge_key, registry.JUDGE_SCORE, keep=False).collect()}
    assert found == {"Evidance": ("Evidence", 87.5), "Chandrachood D. Y.": ("D. Y. Chandrachud", 90.323)}


def test_blanks_around_page_marks(spark):
    rows = [("a\n\n 17 \n\nb", "a\nb"), ("17\na\n18", "17\na\n18"), ("a\n[2003] 4 S.C.R.\n\nb", "a\nb"), ("a\n*Author\nb", "a\n\nb"), ("", ""), (None, None), ("x 17\nA. Roy v. B. Rao", "x 17\nA. Roy v. B. Rao")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(extract.cleaned(F.col("t"))).collect()] == [w for _, w in rows]
