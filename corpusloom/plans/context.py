"""Queries of context assembly, sessions and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as c
from ..operators.segment import fixed_chunks
from ..sources.tables import cases, cases_sql, table
from .retrieval import FTS_SQL, fts


def _messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))


def _cited(spark, d):
    m = _messages(spark, d).where("role = 'assistant'")
    return m.withColumn("cited", F.array((F.col("session_id") * 7 + F.col("at")) % 11, (F.col("at") * 3) % 11, F.col("session_id") % 5))


_CITED = "m AS (SELECT conv_id AS session_id, turn AS at, [(conv_id * 7 + turn) % 11, (turn * 3) % 11, conv_id % 5] AS cited, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant'), u AS (SELECT session_id, n, i AS p, cited[i] AS case_id FROM m, (VALUES (1), (2), (3)) v(i) WHERE n <= 20), f AS (SELECT session_id, case_id, min(n * 10 + p) AS o FROM u GROUP BY ALL), z AS (SELECT session_id, case_id, row_number() OVER (PARTITION BY session_id ORDER BY o, case_id) AS place FROM f)"


def _answers(spark, d):
    m = table(spark, d, "conversations").where("role = 'assistant'")
    return m.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.concat(F.lit("As held in [^1] and [^2, ¶14a]; see [^1, ¶"), (F.col("turn") % 4 + 11).cast("string"), F.lit("]. Also [^"), (F.col("conv_id") % 4 + 1).cast("string"), F.lit("].")).alias("text"))


def _visible(spark, d):
    a = _answers(spark, d).select("answer_id")
    two = F.array(F.struct(F.lit(1).alias("index"), F.array(F.lit("12"), F.lit("13")).alias("chunk_paragraphs")), F.struct(F.lit(2).alias("index"), F.array(F.lit("14")).alias("chunk_paragraphs")))
    return a.select("answer_id", F.inline(two))


_ANSWERS = "a AS (SELECT conv_id * 100 + turn AS answer_id, conv_id, turn FROM conversations WHERE role = 'assistant'), k AS (SELECT answer_id, 0 AS pos, '[^1]' AS marker, 1 AS case_index, CAST(NULL AS VARCHAR) AS paragraph, CAST(NULL AS VARCHAR) AS reason FROM a UNION ALL SELECT answer_id, 1, '[^2, ¶14a]', 2, '14a', NULL FROM a UNION ALL SELECT answer_id, 2, '[^1, ¶' || (turn % 4 + 11) || ']', 1, CAST(turn % 4 + 11 AS VARCHAR), CASE WHEN turn % 4 IN (1, 2) THEN NULL ELSE 'unknown_paragraph' END FROM a UNION ALL SELECT answer_id, 3, '[^' || (conv_id % 4 + 1) || ']', CAST(conv_id % 4 + 1 AS INT), NULL, CASE WHEN conv_id % 4 < 2 THEN NULL ELSE 'unknown_case' END FROM a)"


def _steps(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("step_id"), F.col("user_id").alias("message_id"), F.col("event_type").alias("step"), F.col("ts").alias("created_at"), F.col("value").alias("duration_ms"), F.col("props").alias("data"))


def _context(spark, d):
    docs = table(spark, d, "documents")
    hits = fts(spark, d).select(F.col("chunk_id").alias("doc_id"), "source_table", "query_id", "rank")
    # of each hit the first chunks and, after a gap, the fourth
    chunks = fixed_chunks(docs.join(hits, "doc_id", "left_semi")).where("chunk_index <= 3 AND chunk_index <> 2").join(hits, "doc_id")
    chunks = chunks.select("query_id", "source_table", F.col("doc_id").alias("source_id"), "chunk_index", F.col("chunk_text").alias("text"), "rank", F.array(F.col("chunk_index").cast("string")).alias("paragraph_numbers"))
    return c.build_context(chunks, cases(docs), by=("query_id",)).select("query_id", "source_table", "source_id", "case_index", "chars", "used")


def _calls(spark, d):
    return table(spark, d, "events").select(F.to_date("ts").alias("session_id"), F.lit("sc").alias("source_table"), F.col("user_id").alias("source_id"), F.col("event_id").alias("call_order"), (F.col("event_id") % 3).alias("pos"))


QUERIES = {
    "context_budget": lambda spark, d: c.within_budget(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["doc_id"], "n_chars", 20_000, by=("source",)).select("source", "doc_id", "used"),
    "context_assembled": _context,
    "asof_trigger_message": lambda spark, d: c.triggers(_messages(spark, d)),
    "latest_step_scalar_subquery": lambda spark, d: c.latest_step(table(spark, d, "events").select(F.col("user_id").alias("message_id")).distinct(), _steps(spark, d), "error"),
    "session_recency_tiers": lambda spark, d: c.recency(_cited(spark, d)),
    "session_history": lambda spark, d: c.history(_messages(spark, d), 3).select("session_id", "at", "role"),
    "session_summary": lambda spark, d: c.session_summary(c.recency(_cited(spark, d)), spark.range(11).select(F.col("id").alias("case_id"), F.concat(F.lit("Case "), F.col("id").cast("string")).alias("title"))),
    "citation_validate": lambda spark, d: c.citations(_answers(spark, d), _visible(spark, d)),
    "citation_footers": lambda spark, d: c.checked_answers(_answers(spark, d), _visible(spark, d)).select("answer_id", "n_markers", "n_mismatches"),
    "headnote_snippets": lambda spark, d: table(spark, d, "benchmark").select("item_id", c.snippet(F.concat(F.lit("  "), "text", F.lit(" "), F.repeat(F.col("text"), (F.col("item_id") % 4).cast("int")))).alias("snippet")),
    "registry_index": lambda spark, d: c.registry_index(_calls(spark, d), ("session_id",)).select("session_id", "source_id", "index"),
    "audit_steps": lambda spark, d: c.audit_steps(table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("call_order"))),
}

_CHUNKED = "w AS (SELECT doc_id, i, regexp_replace(substring(t, i * 1800 + 1, 2000), '^\\s+|\\s+$', '', 'g') AS c FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(generate_series(0, CAST((length(coalesce(text, '')) - 1) // 1800 AS BIGINT))) AS i FROM documents WHERE length(coalesce(text, '')) > 0) x), ch AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM w WHERE c <> '')"
_ASSEMBLED = FTS_SQL + f""", {_CHUNKED}, cs AS ({cases_sql()}), bodies AS (SELECT doc_id, max(CASE WHEN n = 0 THEN c END) AS c0, max(CASE WHEN n = 1 THEN c END) AS c1, max(CASE WHEN n = 3 THEN c END) AS c3 FROM ch GROUP BY doc_id),
ranked AS (SELECT k.query_id, k.source_table, k.chunk_id AS source_id, k.rank, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank, k.source_table, k.chunk_id) AS case_index FROM k JOIN bodies ON bodies.doc_id = k.chunk_id WHERE k.rank <= 40),
blocks AS (SELECT r.*, length(concat_ws(chr(10), '[Case ' || case_index || ']', 'Title: ' || coalesce(cs.title, 'Untitled'), 'Citation: ' || cs.citation, 'Court: ' || cs.court, 'Paragraphs: ¶0' || CASE WHEN c1 IS NOT NULL THEN ', ¶1' ELSE '' END || CASE WHEN c3 IS NOT NULL THEN ', ¶3' ELSE '' END,
  c0 || coalesce(chr(10) || c1, '') || coalesce(chr(10) || '[...]' || chr(10) || c3, ''))) AS chars FROM ranked r JOIN bodies b ON b.doc_id = r.source_id LEFT JOIN cs ON cs.source_table = r.source_table AND cs.id = r.source_id),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY case_index) AS used FROM blocks)
SELECT query_id, source_table, source_id, CAST(case_index AS INT) AS case_index, CAST(chars AS INT) AS chars, CAST(used AS BIGINT) AS used FROM summed WHERE case_index = 1 OR used <= 60000"""

SQL = {
    "context_assembled": _ASSEMBLED,
    "context_budget": "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER w AS used, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) x WHERE n = 1 OR used <= 20000",
    "asof_trigger_message": "SELECT a.conv_id AS session_id, a.turn AS at, u.turn AS asked_at, u.text AS asked FROM (SELECT * FROM conversations WHERE role = 'assistant') a LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') u ON u.conv_id = a.conv_id AND u.turn = (SELECT max(x.turn) FROM conversations x WHERE x.conv_id = a.conv_id AND x.role = 'user' AND x.turn < a.turn)",
    "latest_step_scalar_subquery": "WITH s AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') SELECT u.user_id AS message_id, s.props AS data FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON s.user_id = u.user_id AND n = 1",
    "session_recency_tiers": f"WITH {_CITED} SELECT session_id, case_id, place, CASE WHEN place <= 6 THEN 'hot' ELSE 'cold' END AS tier FROM z",
    "session_history": "SELECT conv_id AS session_id, turn AS at, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) x WHERE n <= 3",
    "session_summary": f"WITH {_CITED} SELECT session_id, string_agg(place || '. Case ' || case_id || ' (' || CASE WHEN place <= 6 THEN 'hot' ELSE 'cold' END || ')', chr(10) ORDER BY place) AS summary FROM z GROUP BY session_id",
    "citation_validate": f"WITH {_ANSWERS} SELECT * FROM k",
    "citation_footers": f"WITH {_ANSWERS} SELECT answer_id, count(*) AS n_markers, count(reason) AS n_mismatches FROM k GROUP BY answer_id",
    "headnote_snippets": "SELECT item_id, CASE WHEN length(t) > 400 THEN left(t, 400) || '…' ELSE t END AS snippet FROM (SELECT item_id, trim('  ' || text || ' ' || repeat(text, CAST(item_id % 4 AS BIGINT))) AS t FROM benchmark) x",
    "registry_index": "SELECT CAST(ts AS DATE) AS session_id, user_id AS source_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY min(event_id), user_id) AS index FROM events GROUP BY CAST(ts AS DATE), user_id",
    "audit_steps": "WITH c AS (SELECT user_id AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') SELECT message_id, n + 1 AS step_order, 'tool_call' AS step FROM c UNION ALL SELECT DISTINCT message_id, 1, 'agent_start' FROM c UNION ALL SELECT message_id, count(*) + 2, 'generate' FROM c GROUP BY message_id",
}
