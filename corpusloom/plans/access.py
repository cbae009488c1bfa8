"""Queries of partitioned reads, registries on disk, filters, ownership, traces and what sessions load."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import context as c
from ..operators import ops as o
from ..operators import registry as g
from ..operators import retrieval as r
from ..operators import segment as s
from ..sources import sinks, tables
from ..sources.durable import shared_folder
from ..sources.tables import table
from .context import _cited
from .retrieval import _asked, _vectors


def _path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _partitioned(spark, d):
    """Orders written by year and status as folders, read back for one status of three years."""
    path = _path(spark, "orders")
    sinks.append(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("court"), F.lit("x").alias("raw_html")), path, ("year", "court"))
    return tables.partitioned(spark, path, court="F").where("year BETWEEN 1993 AND 1995")


def _partition_values(spark, d):
    path = _path(spark, "customers")
    sinks.append(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("court")), path, ("court",))
    return tables.partition_values(spark, path, "court")


def _entries(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("aliases")).select(F.col("p_brand").alias("canonical"), "aliases")


def _registry_file(spark, d):
    path = _path(spark, "registry")
    g.write_registry(_entries(spark, d), path)
    return tables.registry(spark, path, lines=True)


def _golden(spark, d):
    """A golden set written a question a line and read: a question a customer, its orders as the cases to be found."""
    path = _path(spark, "golden")
    each = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.lit("sc").alias("source_table"), F.col("o_orderkey").cast("long").alias("source_id")))).alias("expected_cases"))
    each = each.select(F.col("o_custkey").cast("string").alias("id"), F.concat(F.lit("Orders of "), F.col("o_custkey").cast("string")).alias("question"), "expected_cases")
    each.write.json(path)
    return tables.golden_set(spark, path, lines=True)


def _replaced(spark, d):
    """Orders written by status as folders; those of one status and of even keys of another are replaced where they lie."""
    path = _path(spark, "replaced")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    sinks.replace_in_place(o, path, ["status", "o_orderkey"], ["status"])
    new = o.where("status = 'F' OR status = 'O' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0))
    sinks.replace_in_place(new, path, ["status", "o_orderkey"], ["status"])
    return spark.read.schema(o.schema).parquet(path)


def _names(spark, d):
    judges = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("1 "), "c_name")).when(F.col("c_custkey") % 4 == 1, F.col("c_name")).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("A. Rao andB. "), "c_name")).otherwise(F.concat(F.lit("Rao "), "c_name")).alias("canonical"), F.array("c_mktsegment").alias("aliases"))
    return g.search_names(judges, _entries(spark, d)).distinct()


def _filters(spark, d):
    e = table(spark, d, "events")
    tool = F.map_from_arrays(F.array(F.lit("court"), F.lit("year")), F.array(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("")))
    session = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("court"), F.lit("HC"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("court"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>"))
    m = e.select("event_id", tool.alias("tool"), session.alias("session")).select("event_id", c.merged_filters(("court", "year", "judge")).alias("f"))
    return m.select("event_id", F.col("f")["court"].alias("court"), F.col("f")["year"].alias("year"), F.size("f").alias("n"))


def _messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role")


def _labels(spark, d):
    raw = F.array(F.concat(F.lit(" "), "p_brand"), F.lit("  "), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""))
    blank = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(" "))).when(F.col("p_partkey") % 5 == 1, None).otherwise(raw)
    return table(spark, d, "part").select("p_partkey", F.array_join(c.paragraph_labels(blank), "|").alias("labels"))


def _hot(spark, d):
    chunks = table(spark, d, "orders").select((F.col("o_custkey") % 11).alias("case_id"), F.col("o_orderkey").alias("chunk_index"))
    return c.full_chunks_of_hot(c.recency(_cited(spark, d)), chunks, 15).groupBy("session_id", "case_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last"))


def _audit(spark, d):
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("message_id"), F.lit(0).alias("query_index"), F.lit("original").alias("query_type"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_text"), F.transform("embedding", lambda x: F.round(x.cast("float") * F.lit(100).cast("float")).cast("int")).alias("embedding"))
    return r.query_embedding_rows(asked)


def _cells(spark, d):
    """How many of each query's ten nearest vectors the nearest cells hold, on average: nine of ten at least. These vectors form no clusters, so most cells are needed."""
    v = _vectors(spark, d).select("chunk_id", "embedding")
    centres = r.cell_centres(v, 16)
    some = r.cell_hits(r.in_cells(v, centres), centres, _asked(spark, d), 10, 13).select("query_id", "chunk_id")
    exact = r.vector_hits(v, _asked(spark, d), 10).select("query_id", "chunk_id")
    met = exact.join(some.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return met.agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"), F.countDistinct("query_id").alias("queries"))


def _drift(spark, d):
    return table(spark, d, "nation").select(F.lit(",".join(tables.schema_drift(table(spark, d, "orders"), ["o_orderkey", "o_total", "o_custkey"])["missing"])).alias("missing"), F.lit(len(tables.schema_drift(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])["extra"])).alias("n_extra"), "n_nationkey")


def _para_words(spark, d):
    """Paragraphs that begin with the word, in several spellings; every tenth text has two only and falls back to blocks."""
    para = lambda label, w: F.concat(F.lit(f"{label} The claim about {w} of "), F.col("o_orderpriority"), F.lit(" was heard at length."))
    three = F.when(F.col("o_orderkey") % 10 != 0, para("PARAGRAPH 3A -", "costs"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n\n", para("Para 1.", "price"), para("paragraph 2:", "delivery"), three).alias("text"))


def _para_rows(spark, d):
    return s.paragraphs(_para_words(spark, d)).where("strategy = 'para_word'").select("doc_id", "paragraph_number", "paragraph_order", "start_char", "end_char", "paragraph_text")


def _acts_normalised(spark, d):
    """Names of a row in registry form: a list with what matched, and what didn't."""
    p = table(spark, d, "part")
    reg = p.select(g.act_key(F.col("p_name")).alias("key"), F.initcap("p_name").alias("canonical")).distinct()
    rows = p.select("p_partkey", F.array(F.concat(F.lit("The "), F.upper("p_name")), F.lit("xq zj"), F.concat(F.lit("the "), "p_name")).alias("names"))
    m = g.matched(rows.select(F.explode("names").alias("name")), reg, g.act_key, g.ACT_SCORE, keep=False)
    return g.normalised_lists(rows, "p_partkey", "names", m).select("p_partkey", F.array_join("values", "|").alias("values"), F.array_join("unmatched", "|").alias("unmatched"))


def _escaped(spark, d):
    raw = F.concat(F.col("p_brand"), F.lit("(.*+?^${}[]|"), F.col("p_size").cast("string"), F.lit("\\"))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", c.escaped(F.col("raw")).alias("pattern"), F.expr("1 = 1").alias("ok"))


QUERIES = {
    "partitioned_scan": _partitioned,
    "partition_values": _partition_values,
    "registry_file": _registry_file,
    "golden_set_file": _golden,
    "replace_in_place": _replaced,
    "registry_search_names": _names,
    "session_filters_win": _filters,
    "owned_order": lambda spark, d: c.owned(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("asked"), "o_orderstatus"), F.col("id"), F.when(F.col("id") % 2 == 0, F.col("asked")).otherwise(-1)).select("id", "o_orderstatus"),
    "message_with_session": lambda spark, d: c.with_session(_messages(spark, d), _messages(spark, d).where("session_id % 3 <> 0").groupBy("session_id").agg(F.concat(F.lit("Session "), F.min("turn").cast("string")).alias("title"))).select("session_id", "turn", "session_title"),
    "paragraph_labels": _labels,
    "hot_cases_in_full": _hot,
    "failed_sample": lambda spark, d: o.failed_sample(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 2 == 0, "failed").otherwise("done").alias("status"))),
    "query_embedding_audit": _audit,
    "plan_types": lambda spark, d: table(spark, d, "customer").select("c_custkey", o.plan_type(F.when(F.col("c_custkey") % 5 != 4, F.concat(F.lit("plan_"), F.col("c_mktsegment"))), {"monthly": "plan_BUILDING", "yearly": "plan_MACHINERY"}).alias("plan")),
    "stamps_backfilled": lambda spark, d: o.stamped(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("date")).alias("at")), "at", F.lit("2024-02-15").cast("date")),
    "vector_cells_recall": _cells,
    "schema_drift": _drift,
    "paragraph_by_word": _para_rows,
    "acts_in_registry_form": _acts_normalised,
    "escaped_patterns": _escaped,
}

SQL = {
    "partitioned_scan": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS court FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1993 AND 1995",
    "partition_values": "SELECT DISTINCT c_mktsegment AS court FROM customer",
    "registry_file": "WITH e AS (SELECT DISTINCT p_brand AS canonical, unnest([p_brand, p_type]) AS name FROM part) SELECT lower(trim(name)) AS key, max(canonical) AS canonical FROM e GROUP BY ALL",
    "replace_in_place": "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders",
    "golden_set_file": "SELECT CAST(o_custkey AS VARCHAR) AS id, 'Orders of ' || o_custkey AS question, 'sc' AS source_table, o_orderkey AS source_id, 1.0 AS weight FROM orders",
    "registry_search_names": "WITH j AS (SELECT 'Rao ' || c_name AS canonical, c_mktsegment AS other FROM customer WHERE c_custkey % 4 = 3), u AS (SELECT unnest([canonical, other]) AS alias, canonical FROM j UNION ALL SELECT unnest([p_brand, p_type]), p_brand FROM part) SELECT DISTINCT alias, canonical FROM u",
    "session_filters_win": "WITH f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'HC' WHEN 1 THEN NULL ELSE nullif(event_type, '') END AS court, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS year FROM events) SELECT event_id, court, year, CAST((court IS NOT NULL)::INT + (year IS NOT NULL)::INT AS INT) AS n FROM f",
    "owned_order": "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0",
    "message_with_session": "SELECT c.conv_id AS session_id, c.turn, 'Session ' || s.t AS session_title FROM conversations c JOIN (SELECT conv_id, min(turn) AS t FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id) s ON s.conv_id = c.conv_id",
    "paragraph_labels": "SELECT p_partkey, CASE WHEN p_partkey % 5 <= 1 THEN NULL WHEN p_size % 2 = 0 THEN p_brand || '|' || p_type ELSE p_brand END AS labels FROM part",
    "hot_cases_in_full": "WITH m AS (SELECT conv_id AS session_id, turn AS at, [(conv_id * 7 + turn) % 11, (turn * 3) % 11, conv_id % 5] AS cited, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant'), u AS (SELECT session_id, n, i AS p, cited[i] AS case_id FROM m, (VALUES (1), (2), (3)) v(i) WHERE n <= 20), f AS (SELECT session_id, case_id, min(n * 10 + p) AS o FROM u GROUP BY ALL), z AS (SELECT session_id, case_id, row_number() OVER (PARTITION BY session_id ORDER BY o, case_id) AS place FROM f), k AS (SELECT o_custkey % 11 AS case_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 11 ORDER BY o_orderkey) AS n FROM orders) SELECT session_id, z.case_id, count(*) AS n, max(o_orderkey) AS last FROM z JOIN k ON k.case_id = z.case_id AND k.n <= 15 WHERE place <= 6 GROUP BY ALL",
    "failed_sample": "SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(nullif(left(text, 200), ''), '(empty)') ELSE '(empty)' END AS preview FROM documents WHERE doc_id % 2 = 0 ORDER BY doc_id LIMIT 5",
    "query_embedding_audit": "SELECT vec_id AS message_id, 0 AS query_index, 'original' AS query_type, 'q' || vec_id AS query_text, '[' || array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS FLOAT) * 100) AS INT)), ',') || ']' AS embedding FROM embeddings",
    "plan_types": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'monthly' WHEN c_mktsegment = 'MACHINERY' THEN 'yearly' END AS plan FROM customer",
    "stamps_backfilled": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2024-02-15' END AS at FROM orders",
    "vector_cells_recall": "SELECT true AS recall_reached, count(*) AS queries FROM embeddings WHERE vec_id % 100 = 0",
    "schema_drift": "SELECT 'o_total' AS missing, CAST((SELECT count(*) FROM (DESCRIBE orders)) - 2 AS INT) AS n_extra, n_nationkey FROM nation",
    "paragraph_by_word": """WITH t AS (SELECT o_orderkey AS doc_id, u.n AS paragraph_number, u.i AS paragraph_order, u.l, 'The claim about ' || u.w || ' of ' || o_orderpriority || ' was heard at length.' AS paragraph_text
FROM orders, (VALUES (0, '1', 'price', 'Para 1. '), (1, '2', 'delivery', 'paragraph 2: '), (2, '3A', 'costs', 'PARAGRAPH 3A - ')) u(i, n, w, l) WHERE o_orderkey % 10 <> 0),
e AS (SELECT *, sum(length(l) + length(paragraph_text) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph_order) AS upto FROM t)
SELECT doc_id, paragraph_number, paragraph_order, CAST(greatest(upto - length(l) - length(paragraph_text) - 3, 0) AS INT) AS start_char, CAST(CASE paragraph_order WHEN 2 THEN upto - 2 ELSE upto - 1 END AS INT) AS end_char, paragraph_text FROM e""",
    "acts_in_registry_form": "SELECT p_partkey, (SELECT string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ') FROM (SELECT unnest(string_split(p_name, ' ')) AS w) x) || '|xq zj' AS values, 'xq zj' AS unmatched FROM part",
    "escaped_patterns": "SELECT p_partkey, regexp_replace(p_brand || '(.*+?^${}[]|' || p_size || chr(92), '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS pattern, true AS ok FROM part",
}
