"""Two-pass external shuffle into shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import numbered, others, settled

#: Rows of a bucket at most on average: a bucket is one array in one task.
BUCKET_ROWS = 4096
#: Bytes of a bucket at most on average.
BUCKET_BYTES = 32 << 20
#: Buckets that one task shuffles, one after the other; there are as many tasks as that makes, whatever the input.
TASK_BUCKETS = 4
#: Buckets whose sizes are added up together; the sums of such blocks are added up in turn.
BLOCK = 4096


def external_shuffle(
    rows: DataFrame, n_shards: int = 8, seed: int = 42, size_col: str | None = None,
    bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Put all rows in random order and cut that order into shards whose row counts differ by one at most.

    First pass: equal rows are counted by a hash, and only if one comes twice by the rows themselves (combined before
    the shuffle, so a row repeated without end is one row with a number); each copy gets its number, a seeded hash of
    row and number says which bucket that fits in memory a copy falls into, and the buckets' sizes are added up over
    blocks of buckets. Second pass: the whole rows are scattered into buckets, each is sorted, so that its content
    alone decides, and put in order by ``shuffle`` with a seed, which is Fisher-Yates. Whole rows are shuffled once.
    ``rows`` is read in both passes and must be the same in both.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), which replace columns so named. Nulls are
    values as any other. No rows: no rows. With fewer rows than shards the last shards are empty. ``size_col`` names
    a column with the bytes of a row; without it only ``bucket_rows`` bounds a bucket. Same rows, seed and bucket
    bounds give the same order.
    """
    columns = [F.col(f"`{c}`") for c in others(rows, "shard", "slot")]
    whole = rows.select(F.struct(*columns).alias("_row"))
    size = F.coalesce(F.col("_row")[size_col].cast("long"), F.lit(0)) if size_col else F.lit(0)
    keys = whole.groupBy(F.xxhash64("_row").alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_size"))
    total, size, most = keys.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_size"), F.lit(0)), F.max("_n")).first()
    n_buckets = max(1, -(-total // bucket_rows), -(-size // bucket_bytes))

    copies = whole.withColumn("_copy", F.lit(1).cast("long"))
    if total and most > 1:
        held = settled(whole.groupBy("_row").agg(F.count(F.lit(1)).alias("_copies")))
        copies = numbered(held, "_copies", "_copy")
    scattered = copies.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_row", "_copy"), F.lit(n_buckets)))
    counts = settled(scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))).withColumn("_block", F.floor(F.col("_bucket") / BLOCK))
    within = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_block").orderBy("_bucket")) - F.col("_n"))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_in_block"))
    blocks = blocks.withColumn("_blocks_before", F.sum("_in_block").over(Window.orderBy("_block")) - F.col("_in_block"))
    offsets = within.join(blocks, "_block").select("_bucket", (F.col("_before") + F.col("_blocks_before")).alias("_offset"))

    parts = -(-n_buckets // TASK_BUCKETS)
    part = F.floor(F.col("_bucket") * parts / n_buckets).cast("int").alias("_part")
    one = F.struct(F.xxhash64(F.lit(seed), "_row", "_copy").alias("_h"), "_row", "_copy").alias("_one")
    rows_of = scattered.select(part, "_bucket", one, F.lit(None).cast("long").alias("_offset"))
    # a bucket's place goes where its rows go, as a row more
    dealt = rows_of.union(offsets.select(part, "_bucket", F.lit(None).cast(rows_of.schema["_one"].dataType), "_offset")).repartitionById(parts, "_part")
    lists = dealt.groupBy("_part", "_bucket").agg(F.sort_array(F.collect_list("_one")).alias("_all"), F.max("_offset").alias("_offset"))
    # in order of bucket within a task, so that the seed's random numbers fall to the same buckets each time
    shuffled = lists.sortWithinPartitions("_bucket").select("_offset", F.shuffle("_all", seed).alias("_all"))
    placed = shuffled.select("_offset", F.posexplode("_all").alias("_pos", "_one"))
    place = F.col("_offset") + F.col("_pos")
    each, more = total // n_shards, total % n_shards  # the first `more` shards have one row more
    edge = more * (each + 1)
    shard = F.when(place < edge, F.floor(place / (each + 1))).otherwise(more + F.floor((place - edge) / max(each, 1)))
    start = F.when(F.col("shard") < more, F.col("shard") * (each + 1)).otherwise(edge + (F.col("shard") - more) * each)
    placed = placed.select("_one._row", place.alias("_place"), shard.cast("int").alias("shard"))
    return placed.select("_row.*", "shard", (F.col("_place") - start).alias("slot"))


def write_shards(rows: DataFrame, path: str, size_col: str, **options) -> None:
    """``external_shuffle`` written as Parquet under ``path``, one folder a shard, files and rows in their order.

    ``size_col`` names the bytes of a row, so that a bucket of long rows fits in memory too. Tasks hold buckets in
    order and write them as they are, without another shuffle.
    """
    done = external_shuffle(rows, size_col=size_col, **options)
    done.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
