"""Writing: appends, replacement by key, upserts; each gives the new content of a table, to be written at once."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and all of ``new``."""
    gone = new.select(*keys).distinct()
    return old.join(gone, same(old, gone, keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_in_place(new: DataFrame, path: str, keys: list[str], by: list[str]) -> None:
    """Puts ``new`` into the Parquet folder ``path``, partitioned ``by``: rows there whose key is in ``new`` go, all others stay.

    Only partitions that ``new`` has rows of are read and written; their new files are staged and change places with the
    old ones once all tasks are done, so a job that fails leaves the folder as it was. (Not so if the driver is lost while
    files change places.) ``by`` has to be among ``keys``, else a key could leave a partition that has no new row. A
    folder that isn't there is made. Rows have the columns of ``new``.
    """
    if not by or not set(by) <= set(keys):
        raise ValueError("the columns of partitions must be among the keys")
    content = new
    try:
        old = new.sparkSession.read.schema(new.schema).parquet(path)
        touched = new.select(*by).distinct()
        content = replace_by_key(old.join(touched, same(old, touched, by), "left_semi"), new, keys)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False, coalesce_new: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key, one row a key on either side.

    ``keep_old``: a row that is there stays as it is. ``coalesce_new``: a null in the new row leaves the old value.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), "full_outer")
    out = []
    for c in old.columns:
        left, right = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            value = F.when(F.col("_a"), left).otherwise(right)
        elif c not in new.columns:
            value = left
        elif keep_old:
            value = F.when(F.col("_a"), left).otherwise(right)
        elif coalesce_new:
            value = F.coalesce(right, left)
        else:
            value = F.when(F.col("_b"), right).otherwise(left)
        out.append(value.alias(c))
    return joined.select(*out)


def update_fields(old: DataFrame, changes: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Non-null values of ``changes`` over ``old``; ``extracted_at`` keeps its first value, ``updated_at`` gets ``now``."""
    a, b = old.alias("a"), changes.withColumn("_b", F.lit(True)).alias("b")
    joined = a.join(b, reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), "left")
    hit = F.col("_b").isNotNull()
    special = {"extracted_at": F.when(hit, F.coalesce("a.extracted_at", now)).otherwise(F.col("a.extracted_at")), "updated_at": F.when(hit, now).otherwise(F.col("a.updated_at"))}
    out = [special[c] if c in special and c in old.columns else F.coalesce(f"b.{c}", f"a.{c}") if c in changes.columns and c not in keys else F.col(f"a.{c}") for c in old.columns]
    return joined.select(*(v.alias(c) for v, c in zip(out, old.columns, strict=True)))


def error_rows(df: DataFrame, limit: int = 5000) -> DataFrame:
    """Log rows ready to append: messages cut to ``limit`` characters, not yet resolved."""
    return df.withColumn("message", F.substring("message", 1, limit)).withColumn("resolved", F.lit(False))
