"""Operational tables: errors, steps, quotas, retention, subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, MOST = 50, 200
KEEP_DAYS = 30
FREE_QUERIES = 5


def errors_page(errors: DataFrame, category: str | None = None, severity: str | None = None, resolved: bool | None = None, since=None, until=None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """The newest errors that meet the filters given."""
    rows = errors_where(errors, category, severity, resolved, since, until)
    limit = max(1, min(limit, MOST))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + offset).offset(offset)


def errors_where(errors: DataFrame, category=None, severity=None, resolved=None, since=None, until=None) -> DataFrame:
    for name, value in (("category", category), ("severity", severity), ("resolved", resolved)):
        if value is not None:
            errors = errors.where(F.col(name) == F.lit(value))
    if since is not None:
        errors = errors.where(F.col("created_at") >= F.lit(since))
    return errors.where(F.col("created_at") <= F.lit(until)) if until is not None else errors


def resolve(errors: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Errors with those of the list marked as resolved now."""
    hit = errors.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumns({"resolved": F.coalesce("_hit", "resolved"), "resolved_at": F.when(F.col("_hit"), now).otherwise(F.col("resolved_at"))}).drop("_hit").select(*errors.columns)


def step_latency(steps: DataFrame, since: Column) -> DataFrame:
    """(step, n, avg_ms, max_ms) of steps since a time."""
    return steps.where(F.col("created_at") > since).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms")).cast("long").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))


def slowest(steps: DataFrame, step: str, field: str, n: int = 20) -> DataFrame:
    """The slowest steps of a kind with a field of their JSON data."""
    return steps.where(F.col("step") == step).select("step_id", "duration_ms", F.get_json_object("data", f"$.{field}").alias(field)).orderBy(F.desc("duration_ms"), "step_id").limit(n)


def expired(rows: DataFrame, now: Column, days: int = KEEP_DAYS) -> Column:
    return F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")


def retain(rows: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Rows young enough to stay; to be written over the table."""
    return rows.where(~expired(rows, now, days))


def forget(rows: DataFrame, column: str, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """All rows, the column null where they are too old."""
    return rows.withColumn(column, F.when(~expired(rows, now, days), F.col(column)))


def retention_counts(tables: dict[str, DataFrame], now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """(table, deleted, kept)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count_if(expired(df, now, days)).alias("deleted"), F.count_if(~expired(df, now, days)).alias("kept")).select(F.lit(name).alias("table"), "deleted", "kept")
        out = one if out is None else out.union(one)
    return out


def quota(uses: DataFrame, users: DataFrame, today: Column, free: int = FREE_QUERIES) -> DataFrame:
    """(user_id, plan, used, remaining): uses of today; paid plans have no limit (null)."""
    n = uses.where(F.to_date("ts") == today).groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    j = users.join(n, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return j.select("user_id", "plan", "used", F.when(F.col("plan") == "free", F.greatest(F.lit(0), F.lit(free) - F.col("used"))).alias("remaining"))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys that go."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def subscriptions(events: DataFrame) -> DataFrame:
    """(user_id, plan, status, until) from subscription events; each event counts once, the latest decides, ended ones are free."""
    once = events.groupBy("event_id").agg(F.min_by(F.struct("user_id", "kind", "plan", "ts"), "ts").alias("e")).select("event_id", "e.*")
    last = once.groupBy("user_id").agg(F.max_by(F.struct("kind", "plan", "ts"), F.struct("ts", "event_id")).alias("e"))
    return subscribed(last)


def subscribed(last: DataFrame) -> DataFrame:
    """(user_id, plan, status, until) from each user's latest event ``e`` (kind, plan, ts)."""
    ended = F.col("e.kind").isin("cancelled", "completed")
    months = F.when(F.col("e.plan") == "yearly", 12).otherwise(1)
    return last.select("user_id", F.when(ended, "free").otherwise(F.col("e.plan")).alias("plan"), F.col("e.kind").alias("status"), F.when(~ended, F.add_months(F.to_date("e.ts"), months)).alias("until"))


def reset_cohort(cases: DataFrame, chunks: DataFrame, progress: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases with new texts as pending, and chunks and progress without them."""
    keys = ["source_table", "source_id"]
    t = texts.select(*keys, F.col("text").alias("_new"))
    new = cases.join(t, keys, "left").withColumns({"text": F.coalesce("_new", "text"), "status": F.when(F.col("_new").isNotNull(), "pending").otherwise(F.col("status"))}).drop("_new").select(*cases.columns)
    return new, chunks.join(t.select(*keys), keys, "left_anti"), progress.join(t.select(*keys), keys, "left_anti")


def sessions_by_update(messages: DataFrame) -> DataFrame:
    """(session_id, n, last): sessions, the latest first."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")).orderBy(F.desc("last"), "session_id")


def daily_counts(events: DataFrame) -> DataFrame:
    """(day, kind, n): the batch form of the tumbling window of the stream."""
    return events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def first_of_kind(events: DataFrame, by: str = "user_id") -> DataFrame:
    w = Window.partitionBy(by, "event_type").orderBy("ts", "event_id")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def plan_type(plan_id: Column, ids: dict[str, str]) -> Column:
    """The plan whose id this is (``ids``: plan to id), else null; a blank id is no plan's."""
    out = F.lit(None).cast("string")
    for plan, known in ids.items():
        out = F.when((plan_id == known) & (plan_id != ""), plan).otherwise(out)
    return out


def stamped(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """A time put in where none is; others stay."""
    return rows.withColumn(column, F.coalesce(column, value))


def failed_sample(rows: DataFrame, n: int = 5, chars: int = 200) -> DataFrame:
    """(id, preview): the first failed records by id and how their texts begin."""
    return rows.where("status = 'failed'").orderBy("id").limit(n).select("id", F.coalesce(F.nullif(F.substring("text", 1, chars), F.lit("")), F.lit("(empty)")).alias("preview"))
