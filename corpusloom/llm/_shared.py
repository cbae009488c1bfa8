"""Small helpers that several operators use: lineage cuts, text keys, prefix sums, digests."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a row that one step makes.
RANGE = 1 << 16
#: A word of every contract: a run of characters other than these six.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    context = spark.sparkContext
    held = context.getCheckpointDir()
    if held is None:
        held = spark.conf.get("spark.checkpoint.dir", None)
        if held is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            held = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(held)
        held = context.getCheckpointDir()
    return held


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, as compressed Parquet; for tables that carry texts. Deleted when the driver ends."""
    spark = df.sparkSession
    path = passing_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def let_go(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, before the driver ends; nothing may read it any more."""
    _drop(df.sparkSession, df._stored_at)


def passing_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already, and its folder with it
        pass


def text_key(text: str | Column) -> Column:
    """64-bit key of a text; null and empty texts share one."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit("")))


def words_of(text: str | Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))


def numbered(rows: DataFrame, count: str, number: str) -> DataFrame:
    """Each row so many times as its column ``count`` says, with ``number`` (long) from 1 in place of it.

    A row with more than RANGE copies is first cut into ranges, which are dealt out, so that no task makes all of them.
    """
    rest = [F.col(f"`{c}`") for c in rows.columns if c != count]
    few = rows.where(F.col(count) <= RANGE).select(*rest, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))).alias(number))
    many = rows.where(F.col(count) > RANGE).select(*rest, count, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / RANGE))).alias(number))
    many = many.repartition(F.xxhash64(F.struct(*rest)), number)
    begin, end = F.col(number) * RANGE + 1, F.least(F.col(count).cast("long"), (F.col(number) + 1) * RANGE)
    return few.union(many.select(*rest, F.explode(F.sequence(begin, end)).alias(number)))


def others(docs: DataFrame, *made: str) -> list[str]:
    """The columns of ``docs`` but those named as in ``made``, in whatever case: results replace them."""
    names = {m.lower() for m in made}
    return [c for c in docs.columns if c.lower() not in names]


def free(docs: DataFrame, *wanted: str) -> list[str]:
    """The names wanted, each with as many underscores before it as keep it apart from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]
