"""Queries of chunks and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment as g
from ..operators.batches import greedy_batches
from ..sources.tables import spread, table

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_WINDOWS = "SELECT doc_id, {cols}i, {strip} AS c FROM (SELECT doc_id, {cols2}t, unnest(generate_series(0, CAST((length(t) - 1) // 1800 AS BIGINT))) AS i FROM s WHERE length(t) > 0) x"


def numbered(spark, d):
    """Texts with numbered paragraphs, made from orders; some repeat a number, some have none."""
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    para = lambda n, w: F.concat(F.lit(f"{n} "), F.lit("The order of this customer was placed with priority "), F.col("o_orderpriority"), F.lit(f" and {w} was settled."))
    body = F.concat_ws("\n\n", F.lit("IN THE MATTER"), para("1.", "delivery"), para("2.", "price"), para("3)", "interest"), para("4.1", "costs"), para("4.2", "notice"), F.when(F.col("o_orderkey") % 400 == 0, para("2.", "a second claim")), para("5A", "the rest"))
    plain = F.concat(F.lit("No numbers here.\n\n"), F.repeat(F.lit("A long sentence about nothing at all that goes on. "), 40), F.lit("\n\nThe end of "), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 280 == 0, plain).otherwise(body).alias("text"))


_NUMBERED = """WITH b AS (SELECT o_orderkey AS doc_id, o_orderpriority AS p FROM orders WHERE o_orderkey % 280 <> 0),
v AS (SELECT doc_id, p, u.o, u.n, u.w, CASE WHEN u.n IN ('1', '2', '3') THEN 1 ELSE 0 END AS mark FROM b, (VALUES (0, '1', 'delivery'), (1, '2', 'price'), (2, '3', 'interest'), (3, '4.1', 'costs'), (4, '4.2', 'notice'), (5, '2', 'a second claim'), (6, '5A', 'the rest')) u(o, n, w) WHERE u.o <> 5 OR doc_id % 400 = 0),
pt AS (SELECT *, 'The order of this customer was placed with priority ' || p || ' and ' || w || ' was settled.' AS body FROM v),
pe AS (SELECT *, 15 + sum(length(n) + mark + length(body) + 3) OVER (PARTITION BY doc_id ORDER BY o) AS upto, max(o) OVER (PARTITION BY doc_id) AS last FROM pt)
SELECT doc_id, 'numbered' AS strategy, CASE WHEN o = 5 THEN '2#2' ELSE n END AS paragraph_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INT) AS paragraph_order,
CAST(upto - length(n) - mark - length(body) - 3 AS INT) AS start_char, CAST(upto - CASE WHEN o = last THEN 2 ELSE 0 END AS INT) AS end_char, body AS paragraph_text, 'numbered' AS kind FROM pe"""


def _paragraph_chunks(spark, d):
    p = g.paragraph_lists(numbered(spark, d))  # a text's paragraphs stay in its row
    return p.select("doc_id", F.posexplode(g.paragraph_chunks(F.col("paragraphs"), F.lit("H\n\n"), 200)).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.length("c.chunk_text").alias("n"), F.array_join("c.paragraph_numbers", ",").alias("labels"))


def _with_header(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    h = g.header([("Source", F.col("source"), None), ("Language", F.col("lang"), None), ("Quality", F.col("quality").cast("string"), None), ("Start", F.col("text"), 50)])
    return g.fixed_chunks(docs, header=h).select("doc_id", "chunk_index", F.length("chunk_text").alias("n"), F.md5("chunk_text").alias("digest"))


def _batches(spark, d):
    # a thousand ids a list, so that lists don't grow with the table
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", F.coalesce(g.token_estimate(F.col("text")), F.lit(0)).alias("n"))
    each = docs.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n"))).alias("xs"))
    return each.select("part", F.inline(F.arrays_zip(F.col("xs.doc_id").alias("doc_id"), g.token_batches(F.col("xs.n"), 5000).alias("batch"))))


def _batches_whole(spark, d):
    """All documents in one order, in batches of tokens."""
    docs = table(spark, d, "documents").select("doc_id", g.token_estimate(F.col("text")).alias("n"))
    return greedy_batches(docs, ["doc_id"], "n", 5000)


QUERIES = {
    "token_batches_whole": _batches_whole,
    "chunk_fixed": lambda spark, d: g.fixed_chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", F.length("chunk_text").alias("n"), F.md5("chunk_text").alias("digest")),
    "chunk_with_header": _with_header,
    "paragraph_extract": lambda spark, d: g.paragraphs(numbered(spark, d)).where("kind = 'numbered'"),
    "paragraph_synthetic": lambda spark, d: g.paragraphs(table(spark, d, "documents")).groupBy("doc_id", "strategy").agg(F.count(F.lit(1)).alias("n"), F.max("end_char").alias("end_char")).withColumn("ok", F.col("n") >= 1).select("doc_id", "strategy", "ok"),
    "chunk_paragraphs": _paragraph_chunks,
    "display_resplit": lambda spark, d: numbered(spark, d).select("doc_id", F.posexplode(g.display_parts(F.col("text"))).alias("pos", "part")).select("doc_id", "pos", "part"),
    "token_batches": _batches,
    "token_estimate": lambda spark, d: table(spark, d, "documents").select("doc_id", g.token_estimate(F.col("text")).alias("tokens")),
    "page_ranges": lambda spark, d: table(spark, d, "part").select("p_partkey", F.posexplode(F.sequence(F.lit(0), F.col("p_size") - 1, F.lit(12))).alias("part", "first")).select("p_partkey", "part", "first"),
}

_PLACED = """x AS (SELECT o_orderkey AS doc_id, o_orderpriority AS p, 'The order of this customer was placed with priority ' || o_orderpriority || ' and ' AS a FROM orders)"""
_TEXTS = f"""{_PLACED}, t AS (SELECT doc_id, CASE WHEN doc_id % 280 = 0 THEN 'No numbers here.' || chr(10) || chr(10) || repeat('A long sentence about nothing at all that goes on. ', 40) || chr(10) || chr(10) || 'The end of ' || p
ELSE concat_ws(chr(10) || chr(10), 'IN THE MATTER', '1. ' || a || 'delivery was settled.', '2. ' || a || 'price was settled.', '3) ' || a || 'interest was settled.', '4.1 ' || a || 'costs was settled.', '4.2 ' || a || 'notice was settled.', CASE WHEN doc_id % 400 = 0 THEN '2. ' || a || 'a second claim was settled.' END, '5A ' || a || 'the rest was settled.') END AS text FROM x)"""
SQL = {
    "display_resplit": f"WITH {_TEXTS}, m AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.;:]) (\\(?[0-9ivx]+[.)] )', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda v: trim(v)), lambda v: v <> '') AS xs FROM t) SELECT doc_id, CAST(unnest(generate_series(1, len(xs))) - 1 AS INT) AS pos, unnest(xs) AS part FROM m",
    "chunk_paragraphs": _NUMBERED.replace("WITH b AS", "WITH RECURSIVE b AS").split("SELECT doc_id, 'numbered' AS strategy")[0] + """,
ps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i, CASE WHEN o = 5 THEN '2#2' ELSE n END AS num, 'The order of this customer was placed with priority ' || p || ' and ' || w || ' was settled.' AS body FROM v),
r(doc_id, i, chunk, used) AS (SELECT doc_id, i, 0, length(body) FROM ps WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN r.used + length(p.body) > 200 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + length(p.body) > 200 THEN length(p.body) ELSE r.used + length(p.body) END FROM r JOIN ps p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
e AS (SELECT o_orderkey AS doc_id, o_orderpriority AS p FROM orders WHERE o_orderkey % 280 = 0)
SELECT r.doc_id, CAST(r.chunk AS INT) AS chunk_index, CAST(3 + length(string_agg('¶' || num || '  ' || body, chr(10) || chr(10) ORDER BY r.i)) AS INT) AS n, string_agg(num, ',' ORDER BY r.i) AS labels FROM r JOIN ps ON ps.doc_id = r.doc_id AND ps.i = r.i GROUP BY r.doc_id, r.chunk
UNION ALL SELECT doc_id, CAST(k AS INT), CAST(3 + 6 + CASE WHEN k < 10 THEN 200 ELSE 57 END AS INT), 's1' FROM e, (SELECT unnest(generate_series(0, 10)) AS k) s UNION ALL SELECT doc_id, 11, CAST(3 + 5 + length('The end of ' || p) AS INT), 's2' FROM e""",
    "token_batches_whole": """WITH RECURSIVE t AS (SELECT doc_id, CAST(floor(coalesce(length(text), 0) / 2.5) AS BIGINT) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
s AS (SELECT doc_id, i, n, sum(n) OVER (ORDER BY i) - n AS before FROM t), x AS (SELECT a.i, coalesce(min(b.i), (SELECT max(i) + 1 FROM s)) AS next FROM s a LEFT JOIN s b ON b.i > a.i AND b.before + b.n > a.before + 5000 GROUP BY a.i),
r(i, batch) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT x.next, r.batch + 1 FROM r JOIN x ON x.i = r.i)
SELECT s.doc_id, max(r.batch) AS batch FROM s JOIN r ON r.i <= s.i GROUP BY s.doc_id""",
    "token_batches": """WITH RECURSIVE t AS (SELECT doc_id // 1000 AS part, doc_id, CAST(floor(coalesce(length(text), 0) / 2.5) AS BIGINT) AS n, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS i FROM documents),
r(part, i, doc_id, batch, used) AS (SELECT part, i, doc_id, 0, n FROM t WHERE i = 1 UNION ALL SELECT t.part, t.i, t.doc_id, CASE WHEN r.used + t.n > 5000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used + t.n > 5000 THEN t.n ELSE r.used + t.n END FROM r JOIN t ON t.part = r.part AND t.i = r.i + 1)
SELECT part, doc_id, CAST(batch AS INT) AS batch FROM r""",
    "chunk_fixed": "WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (" + _WINDOWS.format(cols="", cols2="", strip=_STRIP.format("substring(t, i * 1800 + 1, 2000)")) + ") SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_index, length(c) AS n, md5(c) AS digest FROM w WHERE c <> ''",
    "chunk_with_header": f"WITH s AS (SELECT d.doc_id, {_STRIP.format('text')} AS t, 'Source: ' || source || chr(10) || 'Language: ' || lang || coalesce(chr(10) || 'Quality: ' || CAST(quality AS VARCHAR), '') || CASE WHEN trim(substring(text, 1, 50), ' ' || chr(10) || chr(9) || chr(13)) <> '' THEN chr(10) || 'Start: ' || substring(text, 1, 50) ELSE '' END || chr(10) || chr(10) AS h FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), w AS (" + _WINDOWS.format(cols="h, ", cols2="h, ", strip=_STRIP.format("substring(t, i * 1800 + 1, 2000)")) + ") SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_index, length(h || c) AS n, md5(h || c) AS digest FROM w WHERE c <> ''",
    "paragraph_extract": _NUMBERED,
    "paragraph_synthetic": "SELECT doc_id, 'synthetic' AS strategy, true AS ok FROM documents WHERE trim(text) <> ''",
    "token_estimate": "SELECT doc_id, CAST(floor(length(text) / 2.5) AS INT) AS tokens FROM documents",
    "page_ranges": "SELECT p_partkey, CAST(first // 12 AS INT) AS part, CAST(first AS INT) AS first FROM (SELECT p_partkey, unnest(generate_series(0, p_size - 1, 12)) AS first FROM part) x",
}
