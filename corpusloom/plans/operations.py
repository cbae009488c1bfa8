"""Queries of registries, quality reports, operational tables and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import token_sort_ratio
from ..operators import evaluate as e
from ..operators import ops as o
from ..operators import quality as q
from ..operators import registry as g
from ..operators import retrieval as r
from ..sources import sinks
from ..sources.durable import shared_folder
from ..sources.tables import spread, table
from ..streaming import operational as st
from .retrieval import _vectors

NOW = "TIMESTAMP_NTZ '2024-02-15 00:00:00'"


def _errors(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.when(F.col("value") > 50, "high").otherwise("low").alias("severity"), (F.col("event_id") % 3 == 0).alias("resolved"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"))


def _steps(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("step_id"), F.col("event_type").alias("step"), F.col("value").alias("duration_ms"), F.col("props").alias("data"), F.col("ts").alias("created_at"))


def _quota(spark, d):
    ev = table(spark, d, "events")
    users = ev.select("user_id").distinct().withColumn("plan", F.when(F.col("user_id") % 4 == 0, "paid").otherwise("free"))
    return o.quota(ev.where("event_type = 'click'"), users, F.lit("2024-01-10").cast("date"))


def _subs(spark, d):
    ev = table(spark, d, "events").where("event_type IN ('purchase', 'signup', 'error')")
    kind = F.when(F.col("event_type") == "purchase", "charged").when(F.col("event_type") == "signup", "activated").otherwise("cancelled")
    return o.subscriptions(ev.select("event_id", "user_id", kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, "yearly").otherwise("monthly").alias("plan"), "ts"))


def _subs_kept_up(spark, d):
    """The same by a stream: events arrive in two loads, and a second run goes on where the first ended."""
    ev = table(spark, d, "events").where("event_type IN ('purchase', 'signup', 'error')")
    base = f"{shared_folder(spark)}/subscriptions-{uuid.uuid4().hex}"
    stream = None
    for load in (0, 1):
        ev.where(F.col("event_id") % 2 == load).write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(ev.schema).parquet(f"{base}/events")
        kind = F.when(F.col("event_type") == "purchase", "charged").when(F.col("event_type") == "signup", "activated").otherwise("cancelled")
        told = stream.select("event_id", "user_id", kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, "yearly").otherwise("monthly").alias("plan"), "ts")
        st.kept_up(st.subscriptions(told), f"{base}/checkpoint", f"{base}/state", ["user_id"], buckets=8)
    return spark.read.parquet(f"{base}/state").drop("bucket")


def _upsert(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return sinks.upsert(old, new, ["c_custkey"], coalesce_new=True)


def _replace(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return sinks.replace_by_key(c, c.where("c_nationkey < 5").withColumn("c_acctbal", F.lit(1.0)), ["c_nationkey"])


def _evaluation(spark, d):
    v = _vectors(spark, d)
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("of"))
    hits = r.vector_hits(v, asked, 80).select("query_id", F.col("chunk_id").alias("key"), "rank")
    # those expected of a query: rows of its label among the hundred that it stands for
    of = asked.select("query_id", "of")
    wanted = v.join(of, (F.col("label") == F.col("of")) & (F.col("chunk_id") - F.col("chunk_id") % 100 == F.col("query_id"))).select("query_id", F.col("chunk_id").alias("key"))
    return e.means(e.per_query(wanted, hits))


_DIST = "1.0 - list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(c.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))))"


def _act_matches(spark, d):
    # the registry: names of every tenth part; a third of the asked names are spelt in another way
    part = table(spark, d, "part").select("p_partkey", "p_name")
    reg = part.where("p_partkey % 10 = 0").groupBy(g.act_key(F.col("p_name")).alias("key")).agg(F.min(F.initcap("p_name")).alias("canonical"))
    names = part.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("The "), F.initcap("p_name"), F.lit("s"))).otherwise(F.col("p_name")).alias("name"))
    return g.matched(names, reg, g.act_key, g.ACT_SCORE)


def _alike(a: str, b: str) -> str:
    """Likeness for DuckDB of two texts whose words are in order: a row of the table for each character of the first."""
    flags = f"list_transform(string_split({a}, ''), lambda c: list_transform(string_split({b}, ''), lambda e: CAST(c = e AS BIGINT)))"
    row = "list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], CASE WHEN k > 1 THEN r[k - 1] + m[k - 1] ELSE 0 END))))"
    table_ = f"list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT)), {flags}), lambda r, m: {row})"
    return f"(200.0 * CAST(list_last({table_}) AS DOUBLE) / (length({a}) + length({b})))"


_BY_WORDS = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
_CAPITALS = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_PAIRS = f"WITH RECURSIVE n AS (SELECT p_name AS name, {_BY_WORDS.format('p_name')} AS x FROM (SELECT DISTINCT p_name FROM part)), s AS (SELECT a.name AS a, b.name AS b, {_alike('a.x', 'b.x')} AS score FROM n a JOIN n b ON a.name < b.name)"

QUERIES = {
    "top_values_per_field": lambda spark, d: q.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], 3),
    "top_array_elements": lambda spark, d: q.top_elements(table(spark, d, "part").select(F.split("p_name", " ").alias("w")), "w"),
    "field_coverage": lambda spark, d: q.coverage(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("tags", F.when(F.col("toxic") == 1, F.array("lang")).otherwise(F.array().cast("array<string>"))), ["text", "lang", "quality", "toxic", "tags"]),
    "status_distribution": lambda spark, d: q.distribution(table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))), "s"),
    "confidence_buckets": lambda spark, d: q.confidence_buckets(table(spark, d, "lineitem").select((1 - F.col("l_discount") * 6).alias("confidence"))),
    "low_confidence_review": lambda spark, d: q.review(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", 0.01),
    "contradictory_pairs": lambda spark, d: q.contradictions(table(spark, d, "part").withColumn("p_type", F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"))), "p_brand", "p_type", 5),
    "validation_summary": lambda spark, d: q.report_summary(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("field"), (F.col("o_totalprice") > 20000).alias("valid")), "id").withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",")),
    "stored_vs_recomputed": lambda spark, d: q.differences(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("v")), table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("v")), "p_partkey", "v"),
    "constraint_checks": lambda spark, d: q.assertions([("orders_key", q.duplicates(table(spark, d, "orders"), ["o_orderkey"])), ("lineitem_order", table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")), ("status_domain", table(spark, d, "orders").where("o_orderstatus NOT IN ('O', 'F')"))]),
    "name_likeness": lambda spark, d: g.likely_pairs(table(spark, d, "part").select(F.col("p_name").alias("name")), 80),
    "name_clusters": lambda spark, d: g.clusters(table(spark, d, "part").select(F.col("p_name").alias("name")), 75),
    "registry_match": _act_matches,
    "registry_mentions": lambda spark, d: g.mentions(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), spark.createDataFrame([("License",), ("MIT",), ("rights reserved",)], "alias string")),
    "token_sort_self": lambda spark, d: spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 2_000).select("p_partkey", token_sort_ratio(F.col("p_name"), F.array_join(F.reverse(F.split("p_name", " ")), " ")).alias("score")),
    "errors_page": lambda spark, d: o.errors_page(_errors(spark, d), category="error", resolved=False, limit=25, offset=50).select("id", "severity", "created_at"),
    "errors_count": lambda spark, d: o.errors_where(_errors(spark, d), severity="high").groupBy("category").agg(F.count(F.lit(1)).alias("n")),
    "errors_resolved": lambda spark, d: o.resolve(_errors(spark, d), table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), F.expr(NOW)).groupBy("category", "resolved").agg(F.count(F.lit(1)).alias("n"), F.count("resolved_at").alias("stamped")),
    "step_latency": lambda spark, d: o.step_latency(_steps(spark, d), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")),
    "slowest_steps": lambda spark, d: o.slowest(_steps(spark, d), "purchase", "k"),
    "retention_counts": lambda spark, d: o.retention_counts({"steps": _steps(spark, d), "errors": _errors(spark, d).where("category = 'error'")}, F.expr(NOW)),
    "retention_nulls": lambda spark, d: o.forget(_steps(spark, d), "data", F.expr(NOW)).groupBy("step").agg(F.count("data").alias("kept"), F.count(F.lit(1)).alias("n")),
    "daily_quota": _quota,
    "subscription_state": _subs,
    "subscription_stream": _subs_kept_up,
    "daily_event_counts": lambda spark, d: st.daily(table(spark, d, "events")),
    "session_windows": lambda spark, d: st.sessions(table(spark, d, "events"), "12 hours"),
    "sessions_by_update": lambda spark, d: o.sessions_by_update(table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"))),
    "cascade_delete": lambda spark, d: o.cascade_delete(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")[1].groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")),
    "upsert_coalesce": _upsert,
    "replace_by_key": _replace,
    "retrieval_evaluation": _evaluation,
}

SQL = {
    "name_likeness": f"{_PAIRS} SELECT a, b, score FROM s WHERE score >= 80",
    "name_clusters": f"""{_PAIRS}, o AS (SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS i FROM n), t AS (SELECT a, b FROM s WHERE score >= 75 UNION ALL SELECT b, a FROM s WHERE score >= 75),
g AS (SELECT i, list_filter(list(p.i2), lambda v: v IS NOT NULL) AS near FROM o LEFT JOIN (SELECT t.a, u.i AS i2 FROM t JOIN o u ON u.name = t.b) p ON p.a = o.name GROUP BY i),
r(i, taken, own) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL SELECT g.i, list_concat(r.taken, r.own), CASE WHEN list_contains(list_concat(r.taken, r.own), g.i) THEN CAST([] AS BIGINT[]) ELSE list_prepend(g.i, list_filter(g.near, lambda v: NOT list_contains(list_concat(r.taken, r.own), v))) END FROM r JOIN g ON g.i = r.i + 1),
q AS (SELECT i, unnest(own) AS j FROM r) SELECT c.name AS canonical, m.name AS name FROM q JOIN o c ON c.i = q.i JOIN o m ON m.i = q.j""",
    "registry_match": f"""WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'The ' || {_CAPITALS.format('p_name')} || 's' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_name || 's' ELSE p_name END AS key FROM part),
e AS (SELECT DISTINCT p_name AS rkey, {_CAPITALS.format('p_name')} AS canonical FROM part WHERE p_partkey % 10 = 0), x AS (SELECT *, {_BY_WORDS.format('key')} AS x FROM n), y AS (SELECT *, {_BY_WORDS.format('rkey')} AS y FROM e),
s AS (SELECT name, canonical, rkey, CASE WHEN key = rkey THEN 100.0 ELSE {_alike('x', 'y')} END AS score FROM x, y), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, rkey) AS k FROM s WHERE score >= {g.ACT_SCORE})
SELECT n.name, coalesce(b.canonical, n.name) AS canonical, round(b.score, 3) AS score FROM n LEFT JOIN b ON b.name = n.name AND b.k = 1""",
    "top_values_per_field": "WITH t AS (SELECT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders), g AS (SELECT field, value, count(*) AS times FROM t WHERE value <> '' GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY times DESC, value) AS place FROM g) x WHERE place <= 3",
    "top_array_elements": "SELECT value, count(*) AS times FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS value FROM part) x GROUP BY value ORDER BY times DESC, value LIMIT 5",
    "field_coverage": "WITH d AS (SELECT text, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n, count(*) FILTER (trim(text) <> '') AS text, count(*) FILTER (trim(lang) <> '') AS lang, count(*) FILTER (quality > 0) AS quality, count(*) FILTER (toxic > 0) AS toxic FROM d) "
    + " UNION ALL ".join(f"SELECT '{f}' AS field, n AS n_rows, {c} AS populated, n - {c} AS missing, round({c} * 100.0 / n, 1) AS percent FROM n" for f, c in (("text", "text"), ("lang", "lang"), ("quality", "quality"), ("toxic", "toxic"), ("tags", "toxic"))),
    "status_distribution": "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE 'pending' END AS value, count(*) AS times FROM orders GROUP BY 1",
    "confidence_buckets": "WITH c AS (SELECT 1 - l_discount * 6 AS c FROM lineitem) SELECT CASE WHEN c >= 1 THEN '1.00' WHEN c >= 0.85 THEN '0.85+' WHEN c >= 0.7 THEN '0.70+' WHEN c >= 0.5 THEN '0.50+' ELSE '<0.50' END AS bucket, count(*) AS times FROM c GROUP BY 1",
    "low_confidence_review": "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.01",
    "contradictory_pairs": "WITH p AS (SELECT p_brand, p_type || ' ' || p_size AS p_type FROM part), a AS (SELECT p_brand FROM p GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5), b AS (SELECT p_type FROM p GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 5) SELECT p_brand, p_type FROM a, b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.p_brand = a.p_brand AND p.p_type = b.p_type)",
    "validation_summary": "WITH v AS (SELECT o_orderkey AS id, o_orderpriority AS field, o_totalprice > 20000 AS valid FROM orders), s AS (SELECT field, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY id) AS n FROM v WHERE NOT valid) x WHERE n <= 10 GROUP BY field) SELECT v.field, count(*) FILTER (valid) AS passed, count(*) FILTER (NOT valid) AS failed, coalesce(max(s.sample), '') AS sample FROM v LEFT JOIN s ON s.field = v.field GROUP BY v.field",
    "stored_vs_recomputed": "SELECT count(*) FILTER (p_size > 10) AS same, count(*) FILTER (p_size <= 10) AS different, 0 AS was_empty, count(*) FILTER (p_size <= 10) AS now_empty FROM part",
    "constraint_checks": "SELECT 'orders_key' AS \"check\", (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) x) AS violations UNION ALL SELECT 'lineitem_order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'status_domain', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))",
    "registry_mentions": "WITH d AS (SELECT doc_id AS text_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' AS p, lower(text) AS l FROM documents) SELECT text_id, 'License' AS alias FROM d WHERE contains(p, ' license ') UNION ALL SELECT text_id, 'MIT' FROM d WHERE contains(p, ' mit ') UNION ALL SELECT text_id, 'rights reserved' FROM d WHERE contains(l, 'rights reserved')",
    "token_sort_self": "SELECT p_partkey, 100.0 AS score FROM part",
    "errors_page": "SELECT event_id AS id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS severity, ts AS created_at FROM events WHERE event_type = 'error' AND event_id % 3 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50",
    "errors_count": "SELECT event_type AS category, count(*) AS n FROM events WHERE value > 50 GROUP BY 1",
    "errors_resolved": "WITH h AS (SELECT event_type, event_id % 3 = 0 AS r, event_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS hit FROM events) SELECT event_type AS category, r OR hit AS resolved, count(*) AS n, count(*) FILTER (hit) AS stamped FROM h GROUP BY 1, 2",
    "step_latency": "SELECT event_type AS step, count(*) AS n, CAST(round(avg(value)) AS BIGINT) AS avg_ms, max(value) AS max_ms FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1",
    "slowest_steps": "SELECT event_id AS step_id, value AS duration_ms, props->>'$.k' AS k FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 20",
    "retention_counts": "SELECT 'steps' AS \"table\", count(*) FILTER (ts < TIMESTAMP '2024-01-16 00:00:00') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00') AS kept FROM events UNION ALL SELECT 'errors', count(*) FILTER (ts < TIMESTAMP '2024-01-16 00:00:00'), count(*) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00') FROM events WHERE event_type = 'error'",
    "retention_nulls": "SELECT event_type AS step, count(*) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00') AS kept, count(*) AS n FROM events GROUP BY 1",
    "daily_quota": "WITH u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 = 0 THEN 'paid' ELSE 'free' END AS plan FROM events), n AS (SELECT user_id, count(*) AS k FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1) SELECT u.user_id, plan, coalesce(k, 0) AS used, CASE WHEN plan = 'free' THEN greatest(0, 5 - coalesce(k, 0)) END AS remaining FROM u LEFT JOIN n ON n.user_id = u.user_id",
    "subscription_state": "WITH s AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'charged' WHEN 'signup' THEN 'activated' ELSE 'cancelled' END AS kind, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'signup', 'error')) SELECT user_id, CASE WHEN kind = 'cancelled' THEN 'free' WHEN user_id % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS plan, kind AS status, CASE WHEN kind <> 'cancelled' THEN CAST(CAST(ts AS DATE) + CASE WHEN user_id % 2 = 0 THEN INTERVAL 12 MONTH ELSE INTERVAL 1 MONTH END AS DATE) END AS until FROM s WHERE n = 1",
    "daily_event_counts": "SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "session_windows": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM g GROUP BY user_id, k",
    "sessions_by_update": "SELECT conv_id AS session_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1",
    "cascade_delete": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "upsert_coalesce": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "replace_by_key": "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 5 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "retrieval_evaluation": f"WITH h AS (SELECT q.vec_id AS query_id, c.vec_id AS key, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, c.vec_id) AS rank FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0), w AS (SELECT q.vec_id AS query_id, c.vec_id AS key FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0 AND c.label = q.label AND c.vec_id - c.vec_id % 100 = q.vec_id), j AS (SELECT w.query_id, w.key, h.rank FROM w LEFT JOIN h ON h.query_id = w.query_id AND h.key = w.key AND h.rank <= 80), p AS (SELECT query_id, coalesce(1.0 / min(rank), 0) AS rr, " + ", ".join(f"count(*) FILTER (rank <= {k}) / CAST(count(*) AS DOUBLE) AS r{k}" for k in e.CUTS) + " FROM j GROUP BY query_id) SELECT count(*) AS n_queries, round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg(r{k}), 6) AS recall_{k}" for k in e.CUTS) + " FROM p",
}

SQL["subscription_stream"] = SQL["subscription_state"]
