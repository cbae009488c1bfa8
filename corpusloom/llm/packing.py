"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import numbered, settled

#: Permitted sequence lengths, in words, separators included.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Words' worth that a sequence costs besides its length.
OVERHEAD = 24
#: Pieces that are packed together in one task, about; each block is packed for itself.
BLOCK_PIECES = 20_000


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, final capacity of it) of each piece; no piece is longer than the largest capacity.

    Longest first, ties in the given order. A piece goes into the open bin that it fills best, that is with the least
    room left; of such bins the oldest. If it fits into none, a bin is opened whose size costs least a word: its length
    and ``overhead``, over the words it can be expected to hold, which are those of the piece and as much of what is
    still to come as has room beside it, the pieces too long for that room left out. At the end each bin gets the
    least permitted length that holds its content.
    """
    capacities = tuple(sorted(capacities))
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    to_come = np.concatenate([np.cumsum(ordered[::-1])[::-1], [0]])
    down = -ordered
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins: dict[int, list[int]] = {}  # of each room, the bins with it; newest first, so that pop() takes the oldest
    for k, length in enumerate(ordered.tolist()):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            held = bins[room]
            chosen = held.pop()
            if not held:
                del bins[room]
                rooms.pop(at)
            size = used[chosen] + room
        else:
            best, size = None, 0
            for c in capacities:
                if c >= length:
                    from_here = max(k + 1, int(np.searchsorted(down, length - c)))  # the first piece that fits beside this one
                    cost = (c + overhead) / (length + min(c - length, int(to_come[from_here])) or 1)
                    if best is None or cost < best:
                        best, size = cost, c
            chosen = len(used)
            used.append(0)
        which[order[k]], offset[order[k]] = chosen, used[chosen]
        used[chosen] += length
        room = size - used[chosen]
        if room:
            if room not in bins:
                insort(rooms, room)
                bins[room] = [chosen]
            else:
                insort(bins[room], chosen, key=lambda b: -b)
    final = np.array([next(c for c in capacities if c >= u) for u in used], np.int64)
    return which, offset, final[which] if len(which) else which


def pack(rows: DataFrame, length_col: str, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """A row for each piece of each row of ``rows``: id, piece, start, length, bin_id, capacity, bin_offset, separator.

    A document of ``length`` words takes one more place, for the separator after its last piece; a longer one than the
    largest capacity is cut into pieces of that capacity and a rest. Pieces are dealt to blocks by a hash of id, length
    and number, as many blocks as pieces ask for, so no block grows with the input; repeated rows are counted first
    and numbered, so that they are dealt out as well. Null lengths count as 0: the document takes one place, its
    separator. ``bin_id`` is block and bin. Ties: by id, length, piece and copy. No rows: no rows. Only the id is
    carried; null ids are packed as any other.
    """
    top = max(capacities)
    counted = rows.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(0)).alias("_len")).groupBy("_id", "_len").agg(F.count(F.lit(1)).alias("_copies"))
    pieces = numbered(settled(counted), "_copies", "_copy")
    pieces = settled(pieces.select("_id", "_len", "_copy", F.explode(F.sequence(F.lit(0), F.floor(F.col("_len") / top).cast("int"))).alias("piece")))
    n_blocks = max(1, -(-pieces.count() // block_pieces))
    taken = F.least(F.lit(top), F.col("_len") + 1 - F.col("piece").cast("long") * top)
    dealt = pieces.withColumn("taken", taken).withColumn("block", F.pmod(F.xxhash64("_id", "_len", "piece", "_copy"), F.lit(n_blocks)))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["_id", "_len", "piece", "_copy"], kind="stable", na_position="first").reset_index(drop=True)
        which, offset, capacity = best_fit(block["taken"].to_numpy(np.int64), capacities, overhead)
        return pd.DataFrame({
            "_id": block["_id"], "_len": block["_len"], "piece": block["piece"], "taken": block["taken"],
            "bin_id": [f"{b}:{w}" for b, w in zip(block["block"], which, strict=True)], "capacity": capacity, "bin_offset": offset,
        })

    done = dealt.groupBy("block").applyInPandas(run, f"_id {id_type}, _len bigint, piece int, taken bigint, bin_id string, capacity bigint, bin_offset bigint")
    last = F.col("piece") == F.floor(F.col("_len") / top)
    return done.select(
        F.col("_id").alias(id_col), "piece", (F.col("piece").cast("long") * top).alias("start"), (F.col("taken") - F.when(last, 1).otherwise(0)).alias("length"),
        "bin_id", "capacity", "bin_offset", last.alias("separator"),
    )


def check_bins(packed: DataFrame) -> DataFrame:
    """Sequences that break the rules: over capacity, or with a gap or an overlap. None, if all is well."""
    size = F.col("length") + F.col("separator").cast("long")
    sums = packed.groupBy("bin_id").agg(F.sum(size).alias("filled"), F.max("capacity").alias("capacity"), F.max(F.col("bin_offset") + size).alias("end"))
    return sums.where((F.col("filled") > F.col("capacity")) | (F.col("filled") != F.col("end")))
