"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens, tokens_sql
from ..functions.vectors import dot
from ..operators import retrieval as r
from ..sources.tables import table

QUESTIONS = ((0, "Licensed under the License"), (1, "all rights reserved"), (2, "then hand"), (3, "of the"))
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + ") v(query_id, question))"
_TABLE = "CASE WHEN lang = 'en' THEN 'sc' ELSE 'hc' END"


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, question string")


def _chunks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", F.when(F.col("lang") == "en", "sc").otherwise("hc").alias("source_table"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.when(F.col("label") % 2 == 0, "sc").otherwise("hc").alias("source_table"), "label")


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))


def fts(spark, d, limit=r.BRANCH):
    chunks = _chunks(spark, d)
    asked = questions(spark)
    some = r.with_all_terms(chunks, asked)
    hits = r.match_all(r.postings(some, only=r.query_terms(asked)), asked).join(chunks.select("chunk_id", "source_table"), "chunk_id")
    return r.ranked(hits, F.desc(F.round("score", 9)), ["query_id", "source_table"], limit=limit)


def _near(spark, d, by=(), limit=r.BRANCH, where="true"):
    v = _vectors(spark, d).where(where)
    hits = r.vector_hits(v.withColumn("embedding", F.col("embedding")), _asked(spark, d), limit, by)
    return hits


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_POST = f"t AS (SELECT doc_id, {_TABLE} AS source_table, {tokens_sql('text')} AS toks FROM documents), p AS (SELECT doc_id, source_table, len(toks) AS length, unnest(toks) AS term FROM t), ix AS (SELECT term, doc_id, source_table, length, count(*) AS tf FROM p GROUP BY ALL)"
_QT = f"qt AS (SELECT query_id, unnest(list_distinct({tokens_sql('question')})) AS term FROM q), qn AS (SELECT query_id, count(*) AS asked FROM qt GROUP BY query_id)"
_HITS = "h AS (SELECT qt.query_id, ix.doc_id, ix.source_table, count(*) AS met, sum(tf / CAST(length AS DOUBLE)) AS s FROM ix JOIN qt USING (term) GROUP BY ALL), m AS (SELECT h.query_id, doc_id AS chunk_id, source_table, s / asked AS score FROM h JOIN qn USING (query_id) WHERE met = asked), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_table ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM m)"
FTS_SQL = _FTS = f"WITH {_Q}, {_POST}, {_QT}, {_HITS}"
_COS = "1.0 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(e.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))))"
_VEC = f"vec AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label, CASE WHEN e.label % 2 = 0 THEN 'sc' ELSE 'hc' END AS source_table, {_COS} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"


def _rrf(spark, d):
    text = r.concatenated(fts(spark, d), "sc")
    near = r.concatenated(_near(spark, d, by=("source_table",)), "sc")
    return r.fuse([("fts", text), ("vec", near)]).select("chunk_id", F.round("score", 9).alias("score"), F.array_join("tags", ",").alias("tags"), "place")


def _rrf_global(spark, d):
    near = _near(spark, d, limit=80)
    text = r.ranked(fts(spark, d, 80).drop("rank"), F.desc(F.round("score", 9)), ["query_id"], limit=80)
    return r.fuse([("fts", text), ("vec", near)], top=80).select("chunk_id", F.round("score", 9).alias("score"), F.array_join("tags", ",").alias("tags"))


_CAT = "SELECT query_id, chunk_id, source_table, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN source_table = 'sc' THEN 0 ELSE 1 END, rank, chunk_id) AS rank FROM {0} WHERE rank <= 40"
_FUSE = "u AS (SELECT chunk_id, rank, 'fts_q' || query_id AS tag, query_id, 0 AS i FROM f UNION ALL SELECT chunk_id, rank, 'vec_q' || query_id, query_id, 1 FROM g), s AS (SELECT chunk_id, sum(1.0 / (60 + rank)) AS score, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, min(query_id * 1000000 + i * 100000 + rank) AS o FROM u GROUP BY chunk_id)"


def _expansion(spark, d):
    reg = table(spark, d, "part").select(F.lower("p_name").alias("p")).distinct().select(F.element_at(F.split("p", " "), 1).alias("alias"), F.col("p").alias("canonical"))
    reg = reg.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    q = spark.createDataFrame([(i, f"Which parts are {a} or alike") for i, a in enumerate(("red", "blue", "large", "nothing"))], "query_id int, question string")
    return r.expand(q, reg)


def _capped(spark, d):
    c = _chunks(spark, d).select("chunk_id", "source_table", (F.col("chunk_id") % 7).alias("source_id"), F.col("chunk_id").alias("chunk_index"))
    preferred = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return r.capped(c, 16, preferred).select("chunk_id", "source_table", "source_id", "n")


def _embedded(spark, d):
    """Items beside the next one: texts with a term in common have vectors that aren't at right angles, and none is all zero."""
    b = table(spark, d, "benchmark").select("item_id", "text", r.hashed_embedding("text", 64).alias("v"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("text").alias("t2"), F.col("v").alias("w")), "item_id")
    common = F.size(F.array_intersect(tokens("text"), tokens("t2"))) > 0
    near, full = dot(F.col("v"), F.col("w")) > 1e-9, F.abs(dot(F.col("v"), F.col("v")) - 1) < 1e-5
    return pairs.where(common | (F.size(tokens("text")) == 0)).select("item_id", "other", near.alias("related"), full.alias("filled"))


QUERIES = {
    "fts_and_match_topk": lambda spark, d: _rounded(fts(spark, d).select("query_id", "chunk_id", "source_table", "score", "rank"), "score"),
    "vector_cosine_topk": lambda spark, d: _rounded(_near(spark, d, limit=10), "distance"),
    "vector_cosine_topk_filtered": lambda spark, d: _rounded(_near(spark, d, limit=10, where="label % 3 = 0"), "distance"),
    "vector_cosine_topk_by_register": lambda spark, d: _rounded(_near(spark, d, by=("source_table",), limit=10), "distance"),
    "hybrid_rrf_concatenated": _rrf,
    "hybrid_rrf": _rrf_global,
    "retrieval_trace_counts": lambda spark, d: r.trace_counts([("fts", fts(spark, d)), ("vec", _near(spark, d, by=("source_table",)))]),
    "query_expansion": _expansion,
    "chunks_per_case_preferred": _capped,
    "rerank_overlap": lambda spark, d: _rounded(r.rerank(fts(spark, d), _chunks(spark, d), questions(spark), 5).select("query_id", "chunk_id", "relevance", "rank"), "relevance"),
    "load_case_aspect": lambda spark, d: r.load_case(_chunks(spark, d).select("chunk_id", "text", "source_table", (F.col("chunk_id") % 7).alias("source_id"), F.col("chunk_id").alias("chunk_index")), "sc", 3, questions(spark).where("query_id = 2"), 60, 10).select("chunk_id", "chunk_index"),
    "hashed_embeddings": lambda spark, d: _embedded(spark, d),
}

SQL = {
    "fts_and_match_topk": _FTS + " SELECT query_id, chunk_id, source_table, round(score, 6) AS score, rank FROM k WHERE rank <= 40",
    "vector_cosine_topk": f"WITH {_VEC}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vec) SELECT query_id, chunk_id, round(distance, 6) + 0.0 AS distance, rank FROM k WHERE rank <= 10",
    "vector_cosine_topk_filtered": f"WITH {_VEC}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vec WHERE label % 3 = 0) SELECT query_id, chunk_id, round(distance, 6) + 0.0 AS distance, rank FROM k WHERE rank <= 10",
    "vector_cosine_topk_by_register": f"WITH {_VEC}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_table ORDER BY distance, chunk_id) AS rank FROM vec) SELECT query_id, chunk_id, source_table, round(distance, 6) + 0.0 AS distance, rank FROM k WHERE rank <= 10",
    "hybrid_rrf_concatenated": _FTS + f", {_VEC}, vk AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_table ORDER BY distance, chunk_id) AS rank FROM vec), f0 AS ({_CAT.format('k')}), g0 AS ({_CAT.format('vk')}), f AS (SELECT * FROM f0 WHERE rank <= 40), g AS (SELECT * FROM g0 WHERE rank <= 40), {_FUSE}, z AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, o, chunk_id) AS place FROM s) SELECT chunk_id, round(score, 9) AS score, tags, place FROM z WHERE place <= 40",
    "hybrid_rrf": _FTS + f", {_VEC}, f AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM k WHERE rank <= 80) x WHERE rank <= 80), g AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vec) x WHERE rank <= 80), {_FUSE} SELECT chunk_id, round(score, 9) AS score, tags FROM s ORDER BY round(score, 12) DESC, o, chunk_id LIMIT 80",
    "retrieval_trace_counts": _FTS + f", {_VEC}, vk AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_table ORDER BY distance, chunk_id) AS rank FROM vec), a AS (SELECT query_id, source_table, 'fts' AS method FROM k WHERE rank <= 40 UNION ALL SELECT query_id, source_table, 'vec' FROM vk WHERE rank <= 40) SELECT query_id, method, count(*) FILTER (source_table = 'sc') AS sc, count(*) FILTER (source_table = 'hc') AS hc FROM a GROUP BY query_id, method",
    "chunks_per_case_preferred": f"WITH c AS (SELECT doc_id AS chunk_id, {_TABLE} AS source_table, doc_id % 7 AS source_id FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source_table, source_id ORDER BY CASE WHEN chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0 ELSE 1 END, chunk_id) AS n FROM c) SELECT chunk_id, source_table, source_id, n FROM n WHERE n <= 16",
    "rerank_overlap": _FTS + f", o AS (SELECT k.query_id, k.chunk_id, len(list_intersect(list_distinct({tokens_sql('q.question')}), {tokens_sql('d.text')})) / CAST(len(list_distinct({tokens_sql('q.question')})) AS DOUBLE) AS relevance FROM k JOIN q USING (query_id) JOIN documents d ON d.doc_id = k.chunk_id WHERE rank <= 40), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS rank FROM o) SELECT query_id, chunk_id, round(relevance, 6) AS relevance, rank FROM z WHERE rank <= 5",
    "query_expansion": """WITH q AS (SELECT * FROM (VALUES (0, 'red'), (1, 'blue'), (2, 'large'), (3, 'nothing')) v(query_id, w)), t AS (SELECT query_id, 'Which parts are ' || w || ' or alike' AS question FROM q),
g AS (SELECT string_split(lower(p_name), ' ')[1] AS alias, min(lower(p_name)) AS canonical FROM part GROUP BY 1), g2 AS (SELECT alias, canonical FROM g WHERE alias <> canonical),
h AS (SELECT query_id, question, alias, canonical, CASE WHEN length(alias) <= 8 THEN instr(' ' || regexp_replace(lower(question), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ', ' ' || alias || ' ') ELSE instr(lower(question), alias) END AS place FROM t, g2),
m AS (SELECT query_id, substr(question, 1, place - 1) || canonical || substr(question, place + length(alias)) AS variant, length(alias) AS len, alias FROM h WHERE place > 0 UNION ALL SELECT query_id, question, 1048576, '' FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, alias, lower(variant)) AS n FROM m) SELECT query_id, variant, CAST(n AS INT) AS n FROM n WHERE n <= 5""",
    "load_case_aspect": f"WITH own AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE lang = 'en' AND doc_id % 7 = 3), p AS (SELECT doc_id, len(list_intersect(list_distinct({tokens_sql('q')}), {tokens_sql('text')})) / 2.0 AS relevance FROM (SELECT doc_id, text, 'then hand' AS q FROM own WHERE n <= 60) x), z AS (SELECT doc_id, row_number() OVER (ORDER BY relevance DESC, doc_id) AS k FROM p) SELECT doc_id AS chunk_id, doc_id AS chunk_index FROM z WHERE k <= 10",
    "search_fresh": _FTS + f", o AS (SELECT k.query_id, k.chunk_id, len(list_intersect(list_distinct({tokens_sql('q.question')}), {tokens_sql('d.text')})) / CAST(len(list_distinct({tokens_sql('q.question')})) AS DOUBLE) AS relevance FROM k JOIN q USING (query_id) JOIN documents d ON d.doc_id = k.chunk_id WHERE rank <= 40), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS rank FROM o) SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM z WHERE rank <= 10",
    "hashed_embeddings": f"WITH t AS (SELECT item_id, list_distinct({tokens_sql('text')}) AS toks FROM benchmark) SELECT a.item_id, b.item_id AS other, len(list_intersect(a.toks, b.toks)) > 0 AS related, len(a.toks) > 0 AS filled FROM t a JOIN t b ON b.item_id = a.item_id + 1 WHERE len(list_intersect(a.toks, b.toks)) > 0 OR len(a.toks) = 0",
}
