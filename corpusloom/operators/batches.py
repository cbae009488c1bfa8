"""Greedy batches over one long order: blocks of it tell where each way in leads out, and the ways are joined by doubling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.durable import settled

#: Rows of a block, about: a block is one group of places and sizes.
BLOCK_ROWS = 1 << 18
MOST = 100_000


def _next(ends: np.ndarray, begin: int, row: int, most: int) -> int:
    """The row that starts the batch after the one that ``row`` starts; the length of the block if none in it does."""
    before = begin if row == 0 else ends[row - 1]
    return max(int(np.searchsorted(ends, before + most, "right")), row + 1)


def _ways(pdf: pd.DataFrame, tops: np.ndarray, most: int) -> pd.DataFrame:
    """(block, low, high, row, to, at, n): a row of the block that starts a batch if the last batch before reaches up to a
    sum from ``low`` to below ``high``; ``n`` batches start from there on, and the last reaches up to ``at``, past which
    block ``to`` has the next start."""
    pdf = pdf.sort_values("pos")
    block = int(pdf["block"].iloc[0])
    begin = int(tops[block - 1]) if block else 0
    ends = begin + pdf["size"].to_numpy(dtype=np.int64).cumsum()
    befores = np.concatenate([[begin], ends[:-1]])
    entries = [0] if block == 0 else [r for r in range(int(np.searchsorted(befores, begin + most, "right"))) if r == 0 or ends[r] > ends[r - 1]]
    known: dict[int, tuple[int, int]] = {}
    out = []
    for entry in entries:
        path, row = [], entry
        while row < len(ends) and row not in known:
            path.append(row)
            row = _next(ends, begin, row, most)
        n, at = known[row] if row < len(ends) else (0, int(befores[path[-1]]) + most)
        for row in reversed(path):
            n += 1
            known[row] = (n, at)
        n, at = known[entry]
        low = -1 if entry == 0 else int(ends[entry - 1])
        out.append((block, low, int(ends[entry]), entry, max(int(np.searchsorted(tops, at, "right")), block + 1), at, n))
    return pd.DataFrame(out, columns=["block", "low", "high", "row", "to", "at", "n"])


def _numbered(pdf: pd.DataFrame, most: int, order: list[str]) -> pd.DataFrame:
    """The batch of each row of a block, given its first row that starts one and the number of batches before."""
    pdf = pdf.sort_values("pos")
    ends = pdf["size"].to_numpy(dtype=np.int64).cumsum()
    starts = np.zeros(len(ends), dtype=np.int64)
    row = pdf["row"].iloc[0]
    row = len(ends) if pd.isna(row) else int(row)
    while row < len(ends):
        starts[row] = 1
        row = _next(ends, 0, row, most)
    return pdf[order].assign(batch=int(pdf["past"].iloc[0]) - 1 + starts.cumsum())


def greedy_batches(rows: DataFrame, order: list[str], size: str, most: int = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(order columns, batch): batches of all rows in order, from 0, each filled until the next row would pass ``most``.

    A row over ``most`` stands alone; null and negative sizes count as 0. ``order`` should tell rows apart: among equal
    ones any order may hold. The same as one fold over the whole table, but in blocks of about ``block_rows``: sizes are
    ranged by ``order``, and as a batch holds ``most`` at most, only rows within ``most`` of a block's beginning can be the
    first in it that start a batch. For each of these a block says where the last batch that follows from it ends, so a
    table of some rows a block is what remains; from the first row the ways on are doubled, in as many rounds as the
    number of blocks has binary digits. The driver sees one sum a block.
    """
    spark = rows.sparkSession
    sizes = rows.select(*order, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    n_blocks = max(1, -(-sizes.count() // block_rows))
    placed = settled(sizes.repartitionByRange(n_blocks, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33).cast("int")))
    sums = placed.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()
    tops = np.array([r["size"] for r in sums], dtype=np.int64).cumsum()
    blocks = spark.createDataFrame([(r["part"], i) for i, r in enumerate(sums)], "part int, block int")  # without empty ones
    placed = placed.join(blocks, "part").drop("part")
    ways = settled(placed.select("block", "pos", "size").groupBy("block").applyInPandas(lambda pdf: _ways(pdf, tops, most), "block int, low long, high long, row int, to int, at long, n long"))
    goals = ways.select(F.col("block").alias("to"), F.col("row").alias("to_row"), "low", "high")
    exits = ways.select("to", "at").distinct().join(goals, "to").where("at >= low AND at < high").select("to", "at", "to_row")
    jump = settled(ways.join(exits, ["to", "at"]).select("block", "row", "to", "to_row"))
    reached = ways.where("block = 0").select("block", "row")
    for _ in range(len(sums).bit_length()):
        reached = settled(reached.union(reached.join(jump, ["block", "row"]).select("to", "to_row")).distinct())
        ahead = jump.select(F.col("block").alias("to"), F.col("row").alias("to_row"), F.col("to").alias("to2"), F.col("to_row").alias("to_row2"))
        jump = settled(jump.join(ahead, ["to", "to_row"]).select("block", "row", F.col("to2").alias("to"), F.col("to_row2").alias("to_row")))
    own = blocks.select("block").join(reached.join(ways.select("block", "row", "n"), ["block", "row"]), "block", "left")
    past = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select("block", "row", past.alias("past"))  # one row a block
    schema = placed.select(*order).schema.add("batch", "long")
    return placed.join(own, "block").groupBy("block").applyInPandas(lambda pdf: _numbered(pdf, most, order), schema)
