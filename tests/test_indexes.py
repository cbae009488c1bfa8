"""Indexes that outlive a query, and vector search by blocks, against plain loops."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dense
from corpusloom.operators import retrieval as r
from corpusloom.operators.text_index import B, K1, TextIndex

TEXTS = [(0, "red parts and blue parts"), (1, "blue sky"), (2, None), (3, ""), (4, "parts of the red red sky above parts"), (5, "red"), (6, "skies of blue and parts of red " + "sky " * 20), (7, "the of and"), (8, "red parts blue sky")]


@pytest.fixture()
def index(spark, tmp_path):
    return TextIndex(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", buckets=5)


def scores(spark, texts, question):
    words = lambda t: [w if len(w) <= 4 else w.removesuffix("s") for w in (t or "").lower().split() if w not in ("and", "of", "the")]
    docs = {k: words(t) for k, t in texts}
    mean = sum(map(len, docs.values())) / len(docs)
    asked = set(words(question))
    out = {}
    for k, own in docs.items():
        if asked and asked <= set(own):
            total = 0.0
            for w in asked:
                df, tf = sum(w in o for o in docs.values()), own.count(w)
                total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
            out[k] = round(total, 6)
    return out


def asked_of(index, *questions):
    rows = [(i, q) for i, q in enumerate(questions)]
    got = index.search(index.spark.createDataFrame(rows, "query_id int, question string"), 100).collect()
    return [{x["chunk_id"]: round(x["score"], 6) for x in got if x["query_id"] == i} for i in range(len(questions))]


def test_index_grows_by_segments_and_compacts(spark, index):
    df = spark.createDataFrame(TEXTS, "chunk_id long, text string")
    index.add(df.where("chunk_id < 4"), 0)
    assert asked_of(index, "red parts") == [scores(spark, TEXTS[:4], "red parts")]
    index.add(df.where("chunk_id >= 4"), 1)
    index.add(df.where("chunk_id >= 4"), 1)  # a repeated run replaces its segment
    want = [scores(spark, TEXTS, q) for q in ("red parts", "Blue sky", "the of", "nothing here", "")]
    assert asked_of(index, "red parts", "Blue sky", "the of", "nothing here", "") == want and len(want[0]) == 4 and want[2] == {}
    index.compact(2)
    index.drop([0, 1])
    assert asked_of(index, "red parts", "Blue sky", "the of", "nothing here", "") == want
    assert [row["segment"] for row in index.sizes().select("segment").distinct().collect()] == [2]


def test_search_reads_the_folders_of_its_terms_only(spark, index):
    index.add(spark.createDataFrame(TEXTS, "chunk_id long, text string"), 0)
    found = index.search(spark.createDataFrame([(0, "red parts")], "query_id int, question string"), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    asked = {row["bucket"] for row in index.terms().where("term IN ('red', 'part')").collect()}
    held = {row["bucket"] for row in index.terms().collect()}
    assert asked < held and f"PartitionFilters: [isnotnull(bucket" in plan
    read = found.sparkSession.read.option("basePath", f"{index.path}/postings").parquet(f"{index.path}/postings/segment=*").where(F.col("bucket").isin(sorted(asked)))
    assert {row["bucket"] for row in read.select("bucket").distinct().collect()} == asked


def vectors(n, dim, seed=1):
    draw = np.random.Generator(np.random.PCG64(seed))
    return draw.normal(size=(n, dim)).astype(np.float32)


def test_blocks_give_exact_neighbours_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(r, "QUERY_BLOCK", 3)
    v = vectors(300, 8)
    v[50:200] = v[50]  # ties
    rows = [(i, [float(x) for x in v[i]], "ab"[i % 2]) for i in range(300)]
    rows += [(400, None, "a"), (401, [0.0] * 8, "a"), (402, [1.0, None] + [0.0] * 6, "a"), (403, [1.0, 2.0], "b"), (404, [float("nan")] * 8, "a"), (405, [], "b")]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, source_table string").repartition(4)
    asked = chunks.where("chunk_id % 40 = 10 or chunk_id >= 401").select(F.col("chunk_id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(x["query_id"], x["source_table"], x["rank"]): (x["chunk_id"], round(x["distance"], 9)) for x in r.vector_hits(chunks, asked, 7, ("source_table",)).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = {}
    for q in range(10, 300, 40):
        for t in "ab":
            order = sorted((round(1 - float(unit[q] @ unit[i]), 12), i) for i in range(300) if "ab"[i % 2] == t)[:7]
            want |= {(q, t, k + 1): (i, round(d, 9)) for k, (d, i) in enumerate(order)}
    want[(403, "b", 1)] = (403, 0.0)
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_codes_reach_recall_with_a_tenth_scored(spark):
    v = vectors(3000, 32, 5)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "chunk_id long, embedding array<float>").repartition(4)
    asked = df.where("chunk_id % 100 = 0").select(F.col("chunk_id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))
    codes, books = r.quantised(df)
    assert codes.count() == 3000 and len(books) == dense.PARTS
    some = {(x["query_id"], x["chunk_id"]) for x in r.quantised_hits(codes, books, df, asked, 10).collect()}
    exact = {(x["query_id"], x["chunk_id"]) for x in r.vector_hits(df, asked, 10).collect()}
    assert r.SHORTLIST <= 300 and len(some & exact) >= 0.9 * len(exact) == 270.0


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    codes, books = r.quantised(none)
    asked = none.select(F.col("chunk_id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))
    assert books == [] and codes.count() == 0 and r.quantised_hits(codes, books, none, asked, 10).count() == 0


def test_recall_query(spark):
    from corpusloom.plans import indexes

    rows = indexes.QUERIES["vector_quantised_recall"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(x["scored"] * 10 <= x["vectors"] for x in rows) and sum(x["recall"] for x in rows) >= 0.9 * len(rows)
