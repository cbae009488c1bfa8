"""Queries of faceted search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import search as s
from ..sources.tables import cases, cases_sql, profile, table

CASES = f"WITH cases AS ({cases_sql()}) "
PAGE = f.Filters(category="src3", year_from=1995, year_to=2020)
NONE = f.Filters(category="src3", disposal="Allowed", court="Supreme Court", judge="Judge 99", year_from=2000)
_SELECT = "source_table, id, title, citation, CASE WHEN source_table = 'sc' THEN petitioner END AS petitioner, CASE WHEN source_table = 'sc' THEN respondent END AS respondent, court, decision_date, CASE WHEN source_table = 'sc' THEN path IS NOT NULL ELSE pdf_url IS NOT NULL END AS has_pdf"


def _cases(spark, d):
    return cases(table(spark, d, "documents"))


def _multi(spark, d):
    """Orders as rows with two array facets."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.array_sort(F.collect_set("l_linestatus")).alias("statuses"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


_MULTI = "WITH lines AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_linestatus)) AS statuses FROM lineitem GROUP BY l_orderkey), multi AS (SELECT * FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey) "


def _paragraph_asks(spark, d):
    part = table(spark, d, "part")
    paragraphs = part.where("p_size <= 25").select(F.lit("sc").alias("source_table"), F.col("p_partkey").alias("source_id"), F.col("p_size").cast("string").alias("paragraph_number"), F.col("p_name").alias("paragraph_text"))
    asks = part.select(F.lit("sc").alias("source_table"), F.col("p_partkey").alias("source_id"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("")).alias("asked"))
    return s.parent_fallback(paragraphs, asks)


def _load_new(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("cnr"), F.concat(F.lit("p"), (F.col("c_custkey") % 50).cast("string")).alias("path"))
    new = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("cnr"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("p"), (F.col("c_custkey") % 70).cast("string"))).alias("path"))
    return s.load_new(old, new, "cnr", "path")


def _profile(spark, d):
    """All customers' columns that read alike in both engines, and a column of events with nulls."""
    one = profile(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    two = profile(table(spark, d, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("at")))
    return one.union(two).select("column", "n_rows", "n_filled", "sample")


QUERIES = {
    "faceted_search_page": lambda spark, d: s.search_page(_cases(spark, d), PAGE, page=2, limit=10),
    "faceted_search_count": lambda spark, d: s.search_count(_cases(spark, d), f.Filters(year_from=2000)),
    "filter_diagnostics": lambda spark, d: s.diagnostics(_cases(spark, d), NONE),
    "facet_options_text": lambda spark, d: s.facet_text(_cases(spark, d), "category"),
    "facet_options_disposal": lambda spark, d: s.facet_text(_cases(spark, d), "disposal"),
    "facet_options_array": lambda spark, d: s.facet_array(_cases(spark, d), "judges"),
    "facet_courts": lambda spark, d: s.facet_courts(_cases(spark, d)),
    "facet_year_range": lambda spark, d: s.year_range(_cases(spark, d), 2026),
    "order_year_range": lambda spark, d: s.year_range(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), 2026),
    "array_containment_filter": lambda spark, d: _multi(spark, d).where(F.coalesce(F.array_contains("flags", "R"), F.lit(False)) & ~F.coalesce(F.array_contains("statuses", "O"), F.lit(False))).select("o_orderkey", "o_orderstatus", F.size("flags").alias("n_flags")),
    "ilike_party_lookup": lambda spark, d: s.find_by_title(_cases(spark, d), " Then ").select("source_table", "id", "title", "decision_date"),
    "citation_cascade": lambda spark, d: s.find_by_citation(_cases(spark, d), "[2000] 2 LR 10").union(s.find_by_citation(_cases(spark, d), "OLD 7")).select("source_table", "id", "citation"),
    "in_list_fetch": lambda spark, d: s.fetch(_cases(spark, d), table(spark, d, "labels").where("toxic = 1").select(F.lit("sc").alias("source_table"), F.col("doc_id").alias("id"))).select("source_table", "id", "court"),
    "pending_anti_join": lambda spark, d: s.pending(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id", "source", "n_chars"),
    "parent_fallback_lookup": _paragraph_asks,
    "ingest_dedupe_or_keys": _load_new,
    "facet_option_search": lambda spark, d: f.options_like(table(spark, d, "part").select("p_name").distinct(), "p_name", "RED", 20),
    "table_profile": lambda spark, d: _profile(spark, d),
}

SQL = {
    "faceted_search_page": CASES + f"SELECT {_SELECT} FROM cases WHERE category = 'src3' AND year >= 1995 AND year <= 2020 ORDER BY decision_date DESC NULLS LAST, source_table, id LIMIT 10 OFFSET 10",
    "faceted_search_count": CASES + "SELECT count(*) FILTER (source_table = 'sc') AS sc, count(*) FILTER (source_table = 'hc') AS hc, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM cases WHERE year >= 2000",
    "filter_diagnostics": CASES + ", c AS (SELECT * FROM cases WHERE source_table = 'sc'), n AS (SELECT count(*) AS k FROM c WHERE category = 'src3' AND disposal = 'Allowed' AND list_contains(judges, 'Judge 99') AND year >= 2000) SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS filter, '{v}' AS value, (SELECT count(*) FROM c WHERE {w}) AS matches" for k, v, w in (
        ("category", "src3", "category = 'src3'"), ("disposal", "Allowed", "disposal = 'Allowed'"), ("court", "Supreme Court", "true"), ("year_from", "2000", "year >= 2000"), ("judge", "Judge 99", "list_contains(judges, 'Judge 99')"))) + ") x WHERE (SELECT k FROM n) = 0",
    "facet_options_text": CASES + "SELECT DISTINCT category AS value FROM cases WHERE category <> ''",
    "facet_options_disposal": CASES + "SELECT DISTINCT disposal AS value FROM cases WHERE disposal <> ''",
    "facet_options_array": CASES + "SELECT DISTINCT unnest(judges) AS value FROM cases",
    "facet_courts": CASES + "SELECT court, min(CASE WHEN source_table = 'sc' THEN 0 ELSE 1 END) AS place FROM cases WHERE court <> '' GROUP BY court",
    "facet_year_range": CASES + "SELECT coalesce(min(year), 1950) AS min_year, coalesce(max(year), 2026) AS max_year FROM cases",
    "order_year_range": "SELECT min(year(o_orderdate)) AS min_year, max(year(o_orderdate)) AS max_year FROM orders",
    "array_containment_filter": _MULTI + "SELECT o_orderkey, o_orderstatus, len(flags) AS n_flags FROM multi WHERE coalesce(list_contains(flags, 'R'), false) AND NOT coalesce(list_contains(statuses, 'O'), false)",
    "ilike_party_lookup": CASES + ", h AS (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY decision_date DESC NULLS LAST, id) AS n FROM cases WHERE title ILIKE '%Then%' OR petitioner ILIKE '%Then%' OR respondent ILIKE '%Then%' OR (source_table = 'sc' AND (citation ILIKE '%Then%' OR legacy_citation ILIKE '%Then%'))) SELECT source_table, id, title, decision_date FROM h WHERE n <= 3",
    "citation_cascade": CASES + ", h AS (SELECT *, '[2000] 2 LR 10' AS q FROM cases WHERE citation = '[2000] 2 LR 10' UNION ALL SELECT *, 'OLD 7' FROM cases WHERE legacy_citation = 'OLD 7' AND source_table = 'sc'), r AS (SELECT *, row_number() OVER (PARTITION BY q, source_table ORDER BY decision_date DESC NULLS LAST, id) AS n FROM h) SELECT source_table, id, citation FROM r WHERE n <= 3",
    "in_list_fetch": CASES + "SELECT source_table, id, court FROM cases WHERE source_table = 'sc' AND id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "pending_anti_join": "SELECT doc_id, source, n_chars FROM documents d WHERE text IS NOT NULL AND text <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "parent_fallback_lookup": "WITH asks AS (SELECT 'sc' AS source_table, p_partkey AS source_id, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE '' END AS asked, p_size, p_name, p_partkey FROM part) SELECT source_table, source_id, asked, CASE WHEN p_size > 25 THEN 'none' WHEN p_partkey % 2 = 0 THEN 'parent' ELSE 'exact' END AS matched_as, CASE WHEN p_size <= 25 THEN p_name END AS paragraph_text FROM asks",
    "ingest_dedupe_or_keys": "SELECT c_custkey AS id, c_name AS cnr, CASE WHEN c_custkey % 4 <> 0 THEN 'p' || CAST(c_custkey % 70 AS VARCHAR) END AS path FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 4 = 0 OR 'p' || CAST(c_custkey % 70 AS VARCHAR) NOT IN (SELECT 'p' || CAST(c_custkey % 50 AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0))",
    "facet_option_search": "SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'red') ORDER BY p_name LIMIT 20",
    "table_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_filled, min(CAST({c} AS VARCHAR)) AS sample FROM orders" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).replace("FROM orders", "FROM customer") + " UNION ALL SELECT 'at', count(*), count(*) FILTER (event_id % 4 <> 0), min(CAST(user_id AS VARCHAR)) FILTER (event_id % 4 <> 0) FROM events",
}
