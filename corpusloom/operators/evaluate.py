"""Evaluation of retrieval: recall at k, first hit, means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (5, 10, 20, 40, 80)


def per_query(expected: DataFrame, ranked: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(query_id, n_expected, first_rank, reciprocal, recall_k ...): expected keys found among the first k rows.

    ``expected``: query_id, key. ``ranked``: query_id, key, rank; a key may stand at several ranks and counts once.
    """
    best = ranked.groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    j = expected.select("query_id", "key").distinct().join(best, ["query_id", "key"], "left")
    return j.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_expected"), F.min("rank").alias("first_rank"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal"),
        *((F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))) / F.count(F.lit(1))).alias(f"recall_{k}") for k in cuts),
    )


def means(queries: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    return queries.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("reciprocal"), 6).alias("mrr"), *(F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in cuts))
