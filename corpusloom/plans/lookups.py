"""Queries of lookups, files, registries' merging, consensus of other kinds, and steps on answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as j
from ..operators import consensus as k
from ..operators import extract as x
from ..operators import lookup as u
from ..operators import ops as o
from ..operators import registry as g
from ..operators import retrieval as r
from ..operators import segment as s
from ..sources import sinks
from ..sources.tables import cases, cases_sql, table
from .context import _answers
from .retrieval import fts, questions

_SPECS = ((0, "sc", 4, None, None), (1, None, None, "[2000] 2 LR 10", None), (2, None, None, "OLD 7", None), (3, None, None, None, "Then"), (4, None, None, "no such", "xy"))


def _identified(spark, d):
    specs = spark.createDataFrame(_SPECS, "spec_id int, source_table string, id bigint, citation string, title string")
    return u.identified(specs, cases(table(spark, d, "documents")))


_q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_IDENTIFIED = f"""WITH cases AS ({cases_sql()}), s AS (SELECT CAST(spec_id AS INT) AS spec_id, CAST(source_table AS VARCHAR) AS st, CAST(id AS BIGINT) AS sid, CAST(citation AS VARCHAR) AS sc, CAST(title AS VARCHAR) AS t FROM (VALUES {", ".join("(" + ", ".join(map(_q, row)) + ")" for row in _SPECS)}) v(spec_id, source_table, id, citation, title)),
h AS (SELECT spec_id, source_table, id, decision_date, 0 AS rule FROM s JOIN cases ON st = source_table AND sid = id UNION ALL SELECT spec_id, source_table, id, decision_date, 1 FROM s JOIN cases ON sc = citation UNION ALL SELECT spec_id, source_table, id, decision_date, 2 FROM s JOIN cases ON sc = legacy_citation AND source_table = 'sc'
UNION ALL SELECT spec_id, source_table, id, decision_date, 3 FROM s JOIN cases ON length(t) >= 3 AND (title ILIKE '%' || t || '%' OR petitioner ILIKE '%' || t || '%' OR respondent ILIKE '%' || t || '%')),
b AS (SELECT *, min(rule) OVER (PARTITION BY spec_id) AS best FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY spec_id, source_table ORDER BY decision_date DESC NULLS LAST, id) AS n FROM b WHERE rule = best)
SELECT min(spec_id) AS spec_id, source_table, id, arg_min(rule, spec_id) AS rule FROM n WHERE n <= 3 GROUP BY source_table, id"""


def _files(spark, d):
    o_ = table(spark, d, "orders").select("o_orderkey")
    path = F.concat(F.lit("case_"), F.col("o_orderkey").cast("string"))
    kind = F.element_at(F.array(F.lit(""), F.lit(".pdf"), F.lit("_EN.pdf"), F.lit("_HIN.pdf"), F.lit(".txt")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    files = o_.where("o_orderkey % 6 <> 5").select(F.concat(F.lit("store/"), path, kind).alias("file"))
    return u.located(o_.select(F.concat(F.lit("2001/"), path).alias("path")), files)


def _merged(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_type").distinct()
    scraped = p.groupBy(F.col("p_brand").alias("canonical")).agg(F.array_sort(F.collect_set("p_type")).alias("aliases"))
    seed = p.select(F.upper("p_brand").alias("canonical")).distinct().withColumn("aliases", F.array(F.lit("seeded"))).where("canonical LIKE '%1'")
    return g.merged(scraped, seed).select("canonical", F.array_join("aliases", "|").alias("aliases"))


def _long(spark, d):
    p = table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))
    llm = F.when(F.col("p_partkey") % 5 != 0, F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" x"))).otherwise("another matter"))
    return p.select("p_partkey", k.long_texts_agree(F.lit(None).cast("string"), text, llm).alias("c")).select("p_partkey", "c.value", "c.method", "c.confidence")


def _acts(spark, d):
    p = table(spark, d, "part")
    none = F.lit(None).cast("array<string>")
    layout = F.when(F.col("p_partkey") % 4 == 0, F.array("p_brand", "p_type")).when(F.col("p_partkey") % 4 == 1, F.array().cast("array<string>")).otherwise(none)
    text = F.when(F.col("p_partkey") % 3 != 0, F.array("p_type", "p_brand")).otherwise(none)
    return p.select("p_partkey", k.acts_agree(layout, F.col("p_size") > 25, text, none).alias("c")).select("p_partkey", F.array_join("c.value", ",").alias("value"), "c.method", "c.confidence")


def _objects(spark, d):
    p = table(spark, d, "part")
    obj = lambda on, a, b: F.when(on, F.struct(a.alias("jurisdiction"), b.alias("primary_case")))
    layout = obj(F.col("p_partkey") % 4 == 0, F.col("p_brand"), F.lit(" "))
    text = obj(F.col("p_partkey") % 3 != 0, F.lit(None).cast("string"), F.col("p_type"))
    llm = obj(F.col("p_partkey") % 5 != 0, F.lit("model"), F.lit("model"))
    return p.select("p_partkey", k.objects_agree(layout, text, llm, ("jurisdiction", "primary_case")).alias("c")).select("p_partkey", "c.value.*", "c.method", "c.confidence")


def _cases(spark, d):
    """Lists of two votes: alike in two names; odd sizes have a third, which one spells in a way that counts as another name."""
    p = table(spark, d, "part")
    one = lambda name, cite: F.struct(name.alias("name"), cite.alias("citation"))
    third = lambda word, cite: F.when(F.col("p_size") % 2 == 1, F.array(one(F.concat("p_name", F.lit(f" {word} Union")), F.lit(cite)))).otherwise(F.array().cast("array<struct<name:string,citation:string>>"))
    a = F.concat(F.array(one(F.concat("p_brand", F.lit(" v. A.V. State, J")), F.lit("1")), one(F.concat("p_type", F.lit(" vs Union")), F.lit("2"))), third("versus", "3"))
    b = F.concat(F.array(one(F.concat(F.upper("p_brand"), F.lit(" VS AV State J")), F.lit("9")), one(F.concat("p_type", F.lit(" v Union")), F.lit("8"))), third("v", "7"))
    none = F.lit(None).cast("array<struct<name:string,citation:string>>")
    c = k.case_lists_agree(none, F.when(F.col("p_partkey") % 3 != 0, a).otherwise(none), F.when(F.col("p_partkey") % 5 != 0, b).otherwise(none))
    return p.select("p_partkey", c.alias("c")).select("p_partkey", F.array_join(F.transform("c.value", lambda y: y["citation"]), ",").alias("citations"), "c.method", "c.confidence")


def _tiers(spark, d):
    p = table(spark, d, "part")
    failed = F.slice(F.array(*[F.lit(f"f{i}") for i in range(6)]), F.lit(1), (F.col("p_size") % 6).cast("int"))
    t = k.tier(failed, F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 != 0)
    return p.select(t.alias("tier"), k.status(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")), t).alias("status")).groupBy("tier", "status").agg(F.count(F.lit(1)).alias("n"))


def _reset(spark, d):
    c = table(spark, d, "customer").select(F.lit("sc").alias("source_table"), F.col("c_custkey").alias("source_id"), F.col("c_name").alias("text"), F.lit("done").alias("status"))
    new = table(spark, d, "customer").where("c_nationkey = 3").select(F.lit("sc").alias("source_table"), F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("text"))
    chunks = table(spark, d, "orders").select(F.lit("sc").alias("source_table"), F.col("o_custkey").alias("source_id"), "o_orderkey")
    after, kept, _ = o.reset_cohort(c, chunks, chunks, new)
    return after.join(kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks")), "source_id", "left").select("source_id", "text", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def _updated(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(None).cast("string").alias("extracted_at"), F.lit("before").alias("updated_at"))
    new = table(spark, d, "customer").where("c_nationkey < 9").select("c_custkey", F.when(F.col("c_nationkey") < 4, F.lit("NEW")).alias("c_mktsegment"))
    return sinks.update_fields(c, new, ["c_custkey"], F.lit("now"))


def _fresh(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    pool = fts(spark, d).select("query_id", "chunk_id")
    return r.rerank(pool, docs, questions(spark), 10).select("query_id", "chunk_id", "rank")


def _renumbered(spark, d):
    a = _answers(spark, d)
    pairs = a.select("answer_id", F.inline(F.array(F.struct(F.lit(1).alias("old"), F.lit(2).alias("new")), F.struct(F.lit(2).alias("old"), F.lit(1).alias("new")))))
    return u.renumbered(a, pairs)


QUERIES = {
    "lookup_by_identifier": _identified,
    "file_ladder": _files,
    "registry_merge": _merged,
    "consensus_long": _long,
    "consensus_acts": _acts,
    "consensus_objects": _objects,
    "consensus_cases": _cases,
    "tier_states": _tiers,
    "cohort_reset": _reset,
    "update_fields": _updated,
    "error_log_rows": lambda spark, d: sinks.error_rows(table(spark, d, "conversations").select("conv_id", "turn", F.repeat("text", 40).alias("message"))).select("conv_id", "turn", F.length("message").alias("n"), "resolved"),
    "search_fresh": _fresh,
    "strategy_histogram": lambda spark, d: s.paragraphs(table(spark, d, "documents")).groupBy("doc_id", "strategy").agg(F.count(F.lit(1)).alias("n")).groupBy("strategy").agg(F.count(F.lit(1)).alias("documents"), F.min(F.col("n") > 0).alias("ok")),
    "markers_renumbered": _renumbered,
    "markers_linked": lambda spark, d: u.linked(_answers(spark, d)),
    "cited_cases": lambda spark, d: u.cited_cases(cases(table(spark, d, "documents"))),
    "object_keys": lambda spark, d: cases(table(spark, d, "documents")).where("path IS NOT NULL").select("id", u.object_key(F.lit("supreme-court"), F.col("year"), F.concat("path", F.when(F.col("id") % 2 == 0, "_EN.pdf").otherwise(".pdf"))).alias("key")),
    "html_list_items": lambda spark, d: u.html_items(table(spark, d, "pages")),
    "sampled_rows": lambda spark, d: u.sampled(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 50).agg(F.count(F.lit(1)).alias("n")),
    "stream_frames": lambda spark, d: table(spark, d, "events").select("event_id", F.posexplode(j.frames(F.concat(F.lit("event: start\ndata: {}\n\nevent: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\ndata: end\n\n")))).alias("pos", "f")).select("event_id", "pos", "f.event", "f.data"),
    "blocks_by_heading": lambda spark, d: x.blocks_by_heading(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(p).alias("page"), F.lit(y).alias("y"), F.lit(0.0).alias("x"), t.alias("text")) for p, y, t in ((1, 1.0, F.lit("before")), (1, 2.0, F.lit("Headnotes")), (1, 3.2, F.col("p_name")), (2, 1.0, F.col("p_brand")), (2, 2.0, F.lit("List of Acts:")), (2, 3.0, F.col("p_type")), (3, 1.0, F.lit("Judgment")), (3, 2.0, F.lit("after")))))))),
    "turn_totals": lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.sum(s.token_estimate(F.col("text"))).alias("tokens")),
    "first_of_kind": lambda spark, d: o.first_of_kind(table(spark, d, "events")).select("user_id", "event_type", "event_id"),
}

_A = "a AS (SELECT conv_id * 100 + turn AS answer_id, turn % 4 + 11 AS p, conv_id % 4 + 1 AS c FROM conversations WHERE role = 'assistant')"
_P = "p AS (SELECT *, p_partkey % 3 <> 0 AS t, p_partkey % 5 <> 0 AS m FROM part)"
SQL = {
    "lookup_by_identifier": _IDENTIFIED,
    "file_ladder": "WITH f AS (SELECT o_orderkey AS k, o_orderkey % 6 AS i FROM orders) SELECT '2001/case_' || k AS path, CASE WHEN i < 5 THEN 'store/case_' || k || (['', '.pdf', '_EN.pdf', '_HIN.pdf', '.txt'])[i + 1] END AS file, CASE WHEN i < 5 THEN i END AS rule FROM f",
    "registry_merge": "WITH a AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS al FROM part GROUP BY p_brand) SELECT CASE WHEN p_brand LIKE '%1' THEN upper(p_brand) ELSE p_brand END AS canonical, array_to_string(CASE WHEN p_brand LIKE '%1' THEN list_sort(list_append(al, 'seeded')) ELSE al END, '|') AS aliases FROM a",
    "consensus_long": f"WITH {_P}, v AS (SELECT p_partkey, CASE WHEN t THEN p_name END AS t, CASE WHEN m THEN CASE WHEN p_size % 2 = 0 THEN p_name || ' x' ELSE 'another matter' END END AS m FROM p) SELECT p_partkey, coalesce(m, t) AS value, CASE WHEN t IS NOT NULL AND m = t || ' x' THEN 'text+llm' WHEN m IS NOT NULL THEN 'llm' WHEN t IS NOT NULL THEN 'text' ELSE 'none' END AS method, CASE WHEN t IS NOT NULL AND m = t || ' x' THEN 0.75 WHEN t IS NOT NULL AND m IS NOT NULL THEN 0.5 WHEN t IS NOT NULL OR m IS NOT NULL THEN 0.6 ELSE 0.0 END AS confidence FROM v",
    "consensus_acts": f"WITH {_P} SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand || ',' || p_type WHEN p_partkey % 4 = 1 THEN '' WHEN t THEN p_type || ',' || p_brand ELSE '' END AS value, CASE WHEN p_partkey % 4 = 0 AND t THEN 'layout+agree' WHEN p_partkey % 4 <= 1 THEN 'layout' WHEN t THEN 'text' ELSE 'none' END AS method, CASE WHEN p_partkey % 4 = 1 THEN 0.8 WHEN p_partkey % 4 = 0 THEN CASE WHEN t AND p_size > 25 THEN 1.0 WHEN t THEN 0.9 WHEN p_size > 25 THEN 0.85 ELSE 0.7 END WHEN t THEN 0.55 ELSE 0.0 END AS confidence FROM p",
    "consensus_objects": f"WITH {_P}, v AS (SELECT *, p_partkey % 4 = 0 AS l FROM p) SELECT p_partkey, CASE WHEN l THEN p_brand WHEN m THEN 'model' END AS jurisdiction, CASE WHEN t THEN p_type WHEN m THEN 'model' END AS primary_case, CASE WHEN l OR t OR m THEN concat_ws('+', CASE WHEN l THEN 'layout' END, CASE WHEN t THEN 'text' END, CASE WHEN m THEN 'llm' END) ELSE 'none' END AS method, CASE WHEN l AND (t OR m) THEN 0.9 WHEN l THEN 0.85 WHEN t AND m THEN 0.7 WHEN t OR m THEN 0.55 ELSE 0.0 END AS confidence FROM v",
    "consensus_cases": f"""WITH {_P} SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND t THEN '1,2' WHEN p_size % 2 = 0 AND m THEN '9,8' WHEN p_size % 2 = 0 THEN '' WHEN m THEN '9,8,7' WHEN t THEN '1,2,3' ELSE '' END AS citations,
CASE WHEN t AND m AND p_size % 2 = 0 THEN 'text+llm' WHEN m THEN 'llm' WHEN t THEN 'text' ELSE 'none' END AS method, CASE WHEN t AND m AND p_size % 2 = 0 THEN 0.75 WHEN t AND m THEN 0.5 WHEN t OR m THEN 0.6 ELSE 0.0 END AS confidence FROM p""",
    "tier_states": "WITH t AS (SELECT p_partkey AS k, CASE WHEN p_size % 6 = 0 AND p_partkey % 2 = 1 THEN 'regex' WHEN p_size % 6 = 0 THEN 'regex_layout' WHEN p_partkey % 3 = 0 THEN 'regex_partial' WHEN p_size % 6 <= 3 THEN 'targeted_llm' ELSE 'llm_full' END AS tier FROM part), u AS (SELECT tier, CASE WHEN k % 7 = 0 THEN 'skipped_no_text' WHEN tier = 'regex_partial' THEN 'skipped_no_llm_key' ELSE 'done' END AS status FROM t) SELECT tier, status, count(*) AS n FROM u GROUP BY tier, status",
    "cohort_reset": "SELECT c_custkey AS source_id, CASE WHEN c_nationkey = 3 THEN c_mktsegment ELSE c_name END AS text, CASE WHEN c_nationkey = 3 THEN 'pending' ELSE 'done' END AS status, CASE WHEN c_nationkey = 3 THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) END AS n_chunks FROM customer",
    "update_fields": "SELECT c_custkey, c_name, CASE WHEN c_nationkey < 4 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey < 9 THEN 'now' END AS extracted_at, CASE WHEN c_nationkey < 9 THEN 'now' ELSE 'before' END AS updated_at FROM customer",
    "error_log_rows": "SELECT conv_id, turn, CAST(least(length(text) * 40, 5000) AS INT) AS n, false AS resolved FROM conversations",
    "markers_renumbered": f"WITH {_A} SELECT answer_id, 'As held in [^2] and [^1, ¶14a]; see [^2, ¶' || p || ']. Also [^' || CASE c WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE c END || '].' AS text FROM a",
    "markers_linked": f"WITH {_A} SELECT answer_id, 'As held in [1](#cite-1) and [2 ¶14a](#cite-2-14a); see [1 ¶' || p || '](#cite-1-' || p || '). Also [' || c || '](#cite-' || c || ').' AS text FROM a",
    "cited_cases": f"WITH cases AS ({cases_sql()}) SELECT source_table, id, coalesce(title, 'Untitled') AS title, coalesce(citation, legacy_citation) AS citation FROM cases",
    "object_keys": f"WITH cases AS ({cases_sql()}) SELECT id, 'supreme-court/' || year || '/' || path || '_EN.pdf' AS key FROM cases WHERE path IS NOT NULL",
    "html_list_items": "WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS xs FROM pages), t AS (SELECT page_id, list_filter(list_transform(xs, lambda v: trim(regexp_replace(regexp_replace(v, '<[^>]*>', '', 'g'), '\\s+|&nbsp;', ' ', 'g'))), lambda v: v <> '') AS xs FROM l) SELECT page_id, CAST(unnest(generate_series(1, len(xs))) - 1 AS INT) AS pos, unnest(xs) AS item FROM t",
    "strategy_histogram": "SELECT 'synthetic' AS strategy, count(*) AS documents, true AS ok FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')",
    "sampled_rows": "SELECT least(count(*), 50) AS n FROM orders",
    "stream_frames": "SELECT event_id, u.pos, CASE u.pos WHEN 0 THEN 'start' WHEN 1 THEN event_type END AS event, CASE u.pos WHEN 0 THEN '{}' WHEN 1 THEN props ELSE 'end' END AS data FROM events, (VALUES (0), (1), (2)) u(pos)",
    "blocks_by_heading": "SELECT p_partkey AS doc_id, 'Headnotes' AS heading, p_name || chr(10) || p_brand AS body FROM part UNION ALL SELECT p_partkey, 'List of Acts', p_type FROM part",
    "turn_totals": "SELECT conv_id, count(*) FILTER (role = 'user') AS asked, CAST(sum(CAST(floor(length(text) / 2.5) AS BIGINT)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "first_of_kind": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) x WHERE n = 1",
}
