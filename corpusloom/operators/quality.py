"""Reports on the quality of fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """(field, value, times, place): the most frequent non-empty values of each text column, all columns in one pass."""
    tall = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))).where("value <> ''")
    g = tall.groupBy("field", "value").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("times"), "value"))
    return g.withColumn("place", place).where(F.col("place") <= n)


def top_elements(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """(value, times): elements of an array column, each counted once a row."""
    g = df.select(F.explode(F.array_distinct(column)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    return g.orderBy(F.desc("times"), "value").limit(n)


def filled(c: str, kind: str) -> Column:
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind in ("int", "bigint", "smallint"):
        return F.coalesce(F.col(c) > 0, F.lit(False))
    return F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_rows, populated, missing, percent) in one pass."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(filled(c, kinds[c])).alias(f"_{c}") for c in columns))
    rows = [F.struct(F.lit(c).alias("field"), F.col("_n").alias("n_rows"), F.col(f"_{c}").alias("populated"), (F.col("_n") - F.col(f"_{c}")).alias("missing"),
                     F.round(F.when(F.col("_n") > 0, F.col(f"_{c}") * 100.0 / F.col("_n")).otherwise(0.0), 1).alias("percent")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, times), most frequent first; null counts as pending."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("pending")).alias("value")).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "value")


def report_summary(reports: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """(field, passed, failed, sample): of (key, field, valid) rows; the sample holds the least failing keys."""
    # only the least keys of each field are gathered, not all that fail
    failing = reports.where("NOT valid").withColumn("_n", F.row_number().over(Window.partitionBy("field").orderBy(key))).where(F.col("_n") <= sample)
    some = failing.groupBy("field").agg(F.array_sort(F.collect_list(key)).alias("sample"))
    counts = reports.groupBy("field").agg(F.count_if("valid").alias("passed"), F.count_if(~F.col("valid")).alias("failed"))
    return counts.join(some, "field", "left").select("field", "passed", "failed", F.coalesce("sample", F.array().cast(some.schema["sample"].dataType)).alias("sample"))


def issue_counts(reports: DataFrame) -> DataFrame:
    return reports.where("issue IS NOT NULL").groupBy("field", "issue").agg(F.count(F.lit(1)).alias("times"))


def confidence_buckets(df: DataFrame, column: str = "confidence") -> DataFrame:
    """(bucket, times): 1.0, then from .85, .7, .5 and below."""
    c = F.col(column)
    b = F.when(c >= 1, "1.00").when(c >= 0.85, "0.85+").when(c >= 0.7, "0.70+").when(c >= 0.5, "0.50+").otherwise("<0.50")
    return df.where(c.isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("times"))


def review(df: DataFrame, column: str, below: float = 0.7) -> DataFrame:
    return df.where(F.col(column) < below).orderBy(column)


def contradictions(df: DataFrame, left: str, right: str, n: int = 3) -> DataFrame:
    """(left, right): pairs of frequent values of two columns that no row has together; n times n pairs at most."""
    top = lambda c: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), c).limit(n).select(c)
    pairs = top(left).crossJoin(F.broadcast(top(right)))
    return pairs.join(df.select(left, right).distinct(), [left, right], "left_anti")


def differences(stored: DataFrame, recomputed: DataFrame, key: str, column: str) -> DataFrame:
    """(same, different, was_empty, now_empty): a stored field against what is computed now."""
    j = stored.select(key, F.col(column).alias("a")).join(recomputed.select(key, F.col(column).alias("b")), key, "left")
    same = F.col("a").eqNullSafe(F.col("b"))
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    return j.agg(F.count_if(same).alias("same"), F.count_if(~same).alias("different"), F.count_if(empty("a")).alias("was_empty"), F.count_if(empty("b")).alias("now_empty"))


def assertions(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check, violations): rows that break each rule; a rule is a DataFrame of offenders."""
    return reduce(DataFrame.union, [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
