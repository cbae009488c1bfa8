"""Queries of indexes that outlive a query: postings on disk, codes of vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import tokens_sql
from ..operators import registry as g
from ..operators import retrieval as r
from ..operators.text_index import B, K1, TextIndex
from ..sources.durable import shared_folder
from ..sources.tables import table
from .retrieval import _asked, _chunks, _vectors


def _questions(spark, d):
    """The items of the benchmark, each asked by its first three words."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("question"))


def _text_index(spark, d):
    """An index of all texts made in two increments and compacted, then searched by register."""
    chunks = _chunks(spark, d)
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}", buckets=8)
    for segment in (0, 1):
        index.add(chunks.where(F.col("chunk_id") % 2 == segment), segment)
    index.compact(2)
    index.drop([0, 1])
    hits = index.search(_questions(spark, d), r.BRANCH, ("source_table",), chunks)
    return hits.select("query_id", "chunk_id", "source_table", F.round("score", 6).alias("score"), "rank")


def _quantised(spark, d):
    """What share of each query's ten nearest vectors is found, and of how many vectors that were scored in full."""
    v = _vectors(spark, d).select("chunk_id", "embedding")
    codes, books = r.quantised(v)
    n = codes.count()
    scored = min(r.SHORTLIST, n // 10)
    some = r.quantised_hits(codes, books, v, _asked(spark, d), 10, scored).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    exact = r.vector_hits(v, _asked(spark, d), 10).select("query_id", "chunk_id")
    found = exact.join(some, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return found.select("query_id", "recall", F.lit(scored).alias("scored"), F.lit(n).alias("vectors"))


def _grown(spark, d):
    """A registry of every other brand and type, grown by clusters that spell names with their words in another order and by new ones."""
    kind = F.concat_ws(" ", "p_name", "p_type")  # with a mark, as names without it are too much like each other for a plain statement of the result
    p = table(spark, d, "part").groupBy(F.concat_ws(" ", kind, F.substring(F.md5(kind), 1, 20)).alias("canonical")).agg(F.min("p_partkey").alias("pos"))
    standing = p.where("pos % 2 = 0").select("pos", "canonical", F.array(F.upper("canonical")).alias("aliases"))
    turned = F.array_join(F.reverse(F.split("canonical", " ")), " ")
    clustered = p.select(turned.alias("canonical"), F.explode(F.array(turned, F.concat(turned, F.lit(" ltd")))).alias("name"))
    grown = g.folded(clustered, standing)
    return grown.select("canonical", F.size("aliases").alias("n_aliases"), F.array_join("aliases", "|").alias("aliases"))


def _words_named(spark, d):
    """A registry of all words of the benchmark, sought in all documents: how many mention each, long ones within other words too."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"), F.lit(1))
    names = table(spark, d, "benchmark").select(F.explode(words).alias("alias")).distinct()
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return g.mentions(texts, names).groupBy("alias").agg(F.countDistinct("text_id").alias("n_texts"))


QUERIES = {"registry_grown": _grown, "registry_words_named": _words_named, "text_index_search": _text_index, "vector_quantised_recall": _quantised}

SQL = {
    "registry_words_named": """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}{2,}')) AS alias FROM benchmark),
d AS (SELECT doc_id, lower(text) AS l, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS ws FROM documents WHERE text IS NOT NULL),
h AS (SELECT alias, doc_id FROM n JOIN (SELECT doc_id, unnest(ws) AS w FROM d) x ON w = alias WHERE length(alias) <= 8 UNION ALL SELECT alias, doc_id FROM n JOIN d ON contains(l, alias) WHERE length(alias) > 8) SELECT alias, count(DISTINCT doc_id) AS n_texts FROM h GROUP BY alias""",
    "registry_grown": """WITH n AS (SELECT p_name || ' ' || p_type || ' ' || substr(md5(p_name || ' ' || p_type), 1, 20) AS c, min(p_partkey) % 2 = 0 AS held FROM part GROUP BY p_name, p_type),
p AS (SELECT c, array_to_string(list_reverse(string_split(c, ' ')), ' ') AS t, held FROM n),
x AS (SELECT CASE WHEN held THEN c ELSE t END AS canonical, CASE WHEN held THEN [upper(c), t, t || ' ltd'] ELSE [t, t || ' ltd'] END AS names FROM p),
y AS (SELECT canonical, list_sort(list_distinct([n for n in names if n <> canonical])) AS aliases FROM x) SELECT canonical, CAST(len(aliases) AS INT) AS n_aliases, array_to_string(aliases, '|') AS aliases FROM y""",
    "text_index_search": f"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'sc' ELSE 'hc' END AS source_table, {tokens_sql('text')} AS toks FROM documents),
q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS question FROM benchmark), qt AS (SELECT query_id, unnest(list_distinct({tokens_sql('question')})) AS term FROM q), qn AS (SELECT query_id, count(*) AS asked FROM qt GROUP BY query_id),
n AS (SELECT count(*) AS texts, sum(len(toks)) / count(*) AS mean FROM d), p AS (SELECT doc_id, source_table, len(toks) AS length, unnest(toks) AS term FROM d), ix AS (SELECT term, doc_id, source_table, length, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, ln(1 + (texts - df + 0.5) / (df + 0.5)) AS weight FROM (SELECT term, count(*) AS df FROM ix GROUP BY term) x, n),
h AS (SELECT query_id, doc_id AS chunk_id, source_table, count(*) AS met, round(sum(weight * (tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * length / mean)))), 9) AS score FROM ix JOIN qt USING (term) JOIN w USING (term), n GROUP BY ALL),
k AS (SELECT query_id, chunk_id, source_table, score, row_number() OVER (PARTITION BY query_id, source_table ORDER BY score DESC, chunk_id) AS rank FROM h JOIN qn USING (query_id) WHERE met = asked)
SELECT query_id, chunk_id, source_table, round(score, 6) AS score, rank FROM k WHERE rank <= {r.BRANCH}""",
}
