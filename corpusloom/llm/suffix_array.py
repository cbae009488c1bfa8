"""Substring dedup by a sparse suffix array: suffixes kept at minimisers only, sorted, and neighbours extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._repeats import Anchored, affected, at_shared, cut_texts, repeats_of, window_starts
from ._shared import let_go, settled, stored
from ._words import Running, Words, pieces, words

#: Words of the shortest repeat.
SHORTEST = 50
#: Words by which positions are selected; a window begins so many words before its suffix, at most, as it is longer than these.
HEAD = 12
#: Places that a window can have before its suffix: the bits of a mask.
PLACES = 62
#: Surroundings of suffixes that a task sorts, at most about and, while there are cores for them, at least: to find the
#: borders of ranges Spark brings 100 rows of each task to the driver, so tasks are large.
TASK_ROWS, LEAST_ROWS = 1_000_000, 20_000
#: Suffixes whose words are put together at a time.
BATCH = 20_000


def head_of(n: int) -> int:
    return min(n, max(HEAD, n - PLACES + 1))


def minimisers(w: Words, run: Running, starts: np.ndarray, n: int) -> Anchored:
    """The retained suffix of each window: it begins at the least hash of HEAD words within the window, the first of equals."""
    head = head_of(n)
    grams = run.of(np.arange(len(w.hash) - head + 1), np.arange(len(w.hash) - head + 1) + head)
    width = n - head + 1
    at = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    for a in range(0, len(starts), 1 << 16):
        some = starts[a:a + (1 << 16)]
        at[a:a + (1 << 16)] = some + view[some].argmin(1)
    return Anchored(starts, grams[at], at)


def _spaced(w: Words, order: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words in ``order``, a space after each, and where each of them begins (and the last ends)."""
    length = w.end[order] - w.start[order]
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out = np.full(begin[-1], 32, np.uint8)
    out[np.repeat(begin[:-1], length) + inside] = w.data[np.repeat(w.start[order], length) + inside]
    return out.tobytes(), begin


def _suffixes(n: int):
    """(k, at, right, left) of each retained suffix whose first words others have: up to ``n`` words from it on, and those before it, the nearest first.

    A space follows each word, so that in order of bytes what begins with the same words stands together.
    """
    before = n - head_of(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in pieces(batch.column(1)):
                w = words(batch.column(1).slice(lo, hi - lo))
                starts, doc = window_starts(w, n)
                if not len(starts):
                    continue
                found = minimisers(w, Running(w.hash), starts, n)
                at = np.unique(found.place[at_shared(found, doc, batch.column(2), lo, hi)])
                of = np.searchsorted(w.first, at, "right") - 1
                total = len(w.hash)
                forth, begin = _spaced(w, np.arange(total))
                back, turned = _spaced(w, np.arange(total)[::-1])
                ends, reach = np.minimum(at + n, w.first[of + 1]), np.minimum(before, at - w.first[of])
                for a in range(0, len(at), BATCH):
                    some = slice(a, a + BATCH)
                    right = [forth[x:y] for x, y in zip(begin[at[some]].tolist(), begin[ends[some]].tolist(), strict=True)]
                    left = [back[x:y] for x, y in zip(turned[total - at[some]].tolist(), turned[total - at[some] + reach[some]].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(text_keys[lo:hi][of[some]]), pa.array((at - w.first[of])[some].astype(np.int32)), pa.array(right, pa.string()), pa.array(left, pa.string())],
                        names=["k", "at", "right", "left"],
                    )

    return run


def _in_common(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of its first words the text before it has too (0 for the first)."""
    parts = pc.split_pattern(texts, " ")
    offsets = parts.offsets.to_numpy()
    n = np.diff(offsets) - 1  # nothing follows the last space
    codes = pc.dictionary_encode(parts.values).indices.to_numpy()
    width = int(n.max()) + 1 if len(n) else 1
    column = np.arange(width)
    filled = column < n[:, None]
    grid = np.where(filled, codes[np.minimum(offsets[:-1, None] + column, len(codes) - 1)], -1 - (np.arange(len(n)) % 2)[:, None])
    same = np.zeros(len(n), np.int64)
    same[1:] = (grid[1:] == grid[:-1]).argmin(1)  # the last column never agrees
    return n, same


def _bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A bit for each place from ``lo`` to ``hi``, both included; none if there is no such place."""
    return np.where(hi >= lo, (np.int64(1) << (hi + 1)) - (np.int64(1) << np.maximum(lo, 0)), 0)


def _neighbours(n: int):
    """(h, check, mask, r, l) of the rows (right, left, h, check, twice) in their order, from a comparison with the rows before and after.

    Two suffixes with ``r`` words in common from there on and ``l`` before share the windows that begin n - r to l words
    before them: these are the bits of the mask. Rows found twice share all their windows. A row may come more than
    once. Of each task the first and last row come again with its number, their words and their place in it.
    """
    head = head_of(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, number = None, 0

        def out(rows: pa.RecordBatch, mask: np.ndarray, r: np.ndarray, l: np.ndarray, edge: bool) -> pa.RecordBatch:  # noqa: E741
            words_too = [rows.column(c) if edge else pa.nulls(rows.num_rows, pa.string()) for c in (0, 1)]
            places = pa.array([number + i for i in range(rows.num_rows)] if edge else [None] * rows.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [rows.column(2), rows.column(3), pa.array(mask, pa.int64()), pa.array(r, pa.int32()), pa.array(l, pa.int32()), pa.array([part] * rows.num_rows, pa.int32()), places, *words_too],
                names=["h", "check", "mask", "r", "l", "part", "place", "right", "left"],
            )

        nothing = np.zeros(1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield out(batch.slice(0, 1), nothing, nothing, nothing, True)
                number = 1
                rows = batch
            else:
                rows = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            last = rows.slice(rows.num_rows - 1)
            n_right, r = _in_common(rows.column(0))
            n_left, l = _in_common(rows.column(1))  # noqa: E741
            same_row = np.zeros(rows.num_rows, bool)
            same_row[1:] = (r[1:] == n_right[1:]) & (n_right[1:] == n_right[:-1]) & (l[1:] == n_left[1:]) & (n_left[1:] == n_left[:-1])
            apart = same_row | (r < head)
            r, l = np.where(apart, 0, r), np.where(apart, 0, l)  # noqa: E741
            mask = np.where(apart, 0, _bits(n - r, l))
            after = lambda x: np.append(x[1:], 0)
            twice = rows.column(4).to_numpy(zero_copy_only=False)
            own = np.where(twice, _bits(n - n_right, n_left), 0)
            yield out(rows, mask | after(mask) | own, np.maximum(r, after(r)), np.maximum(l, after(l)), False)
        if last is not None:
            yield out(last, nothing, nothing, nothing, True)

    return run


_MET = "h bigint, check int, mask bigint, r int, l int, part int, place bigint, right string, left string"


def _compared(surroundings: DataFrame, order: list[Column], n: int, parts: int) -> DataFrame:
    """What neighbours in the order have in common, over the borders of tasks as well: (h, check, mask, r, l), some more than once."""
    met = surroundings.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("right", "left", "h", "check", "twice").mapInArrow(_neighbours(n), _MET)
    met = stored(met)
    # two rows of each task: the last of one meets the first of the next
    edges = met.where(F.col("place").isNotNull()).repartition(1).sortWithinPartitions("part", "place").select("right", "left", "h", "check", F.lit(False).alias("twice"))
    narrow = ("h", "check", "mask", "r", "l")
    return met.select(*narrow).union(edges.mapInArrow(_neighbours(n), _MET).select(*narrow))


def _by_words(surroundings: DataFrame, met: DataFrame, n: int) -> DataFrame:
    """(h, check, mask) of windows that may be shared as far as neighbours tell, but not with a neighbour: found by their words.

    A window's partner may agree further neither to the right than the right neighbour nor to the left than the left
    one. All windows that begin as far before suffixes that begin alike are grouped by their words.
    """
    first = F.substring_index("right", " ", head_of(n))
    beyond = surroundings.join(met.where("rest != 0").select("h", "check", "rest"), ["h", "check"]).groupBy(first.alias("head")).agg(F.bit_or("rest").alias("asked"))
    some = surroundings.withColumn("head", first).join(settled(beyond), "head").join(met.where(F.col("l") >= n - F.col("r")).select("h", "check", "r", "l"), ["h", "check"])
    asked = F.filter(F.sequence(n - F.col("r"), F.col("l")), lambda o: F.getbit("asked", o) == 1)  # a partner's window begins as far before
    each = some.select("h", "check", F.split("right", " ").alias("right"), F.split("left", " ").alias("left"), F.explode(asked).alias("o"))
    held = stored(each.select("h", "check", "o", F.array_join(F.concat(F.reverse(F.slice("left", F.lit(1), F.col("o"))), F.slice("right", F.lit(1), n - F.col("o"))), " ").alias("w")))
    again = settled(held.groupBy("o", "w").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("o", "w"))
    return held.join(again, ["o", "w"], "left_semi").select("h", "check", F.expr("shiftleft(1L, o)").alias("mask"))


def _starts(found: pa.Array) -> np.ndarray:
    at, mask = (column.to_numpy(zero_copy_only=False) for column in found.flatten())
    row, place = np.nonzero((mask[:, None] >> np.arange(PLACES)) & 1)
    return at[row].astype(np.int64) - place


def repeats(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The repeats of ``shortest`` words or more of each distinct text, see ``_repeats.repeats_of``.

    1. Of all suffixes only those at minimisers are retained: a position that is least in some window of ``shortest``
       words, which any other copy of the window retains as well. Those whose first words no other suffix has end here.
    2. What surrounds the others, so far as a window reaches, is collected as words; equal surroundings are one row,
       combined before the shuffle, that shares all its windows.
    3. Spark sorts the rows by ranges, by the words from the suffix on. Each is compared with its neighbours, over the
       borders of ranges too: r words are the same to the right, l to the left, and the windows inside this stretch
       are repeats. No other row agrees further to the right than a neighbour does.
    4. The same in order of the words to the left among suffixes that begin alike, where no other row agrees further to
       the left. So a window longer to the left or to the right than both neighbours allow has no partner at all.
    5. What is left are windows within both reaches that neither pair of neighbours has whole. They are compared by
       their words with all of that kind at suffixes that begin alike.

    Words are compared, not hashes; a row of surroundings is named by 96 bits of hash from the second step on.
    """
    n = shortest
    texts = affected(docs, text_col, n, minimisers)
    suffixes = stored(texts.mapInArrow(_suffixes(n), "k bigint, at int, right string, left string"))
    h, check = F.xxhash64("right", "left").alias("h"), F.hash("left", "right").alias("check")
    surroundings = stored(suffixes.groupBy("right", "left").agg((F.count(F.lit(1)) > 1).alias("twice")).select("right", "left", h, check, "twice"))
    count = surroundings.count()
    parts = max(1, -(-count // TASK_ROWS), min(docs.sparkSession.sparkContext.defaultParallelism, count // LEAST_ROWS))
    first = F.substring_index("right", " ", head_of(n))
    met = _compared(surroundings, [F.col("right"), F.col("left")], n, parts).union(_compared(surroundings, [first, F.col("left"), F.col("right")], n, parts))
    met = met.groupBy("h", "check").agg(F.bit_or("mask").alias("mask"), F.max("r").alias("r"), F.max("l").alias("l"))
    within = F.when(F.col("l") >= n - F.col("r"), F.expr("shiftleft(1L, l + 1)") - F.expr(f"shiftleft(1L, {n} - r)")).otherwise(F.lit(0).cast("long"))
    met = settled(met.withColumn("rest", within.bitwiseAND(F.bitwise_not("mask"))))
    masks = met.select("h", "check", "mask").where("mask != 0")
    if not met.where("rest != 0").isEmpty():
        masks = masks.union(_by_words(surroundings, met, n)).groupBy("h", "check").agg(F.bit_or("mask").alias("mask"))
    masks = settled(masks)  # read by the join from storage, so that surroundings of very many texts can be split there
    let_go(surroundings)
    found = suffixes.select("k", "at", h, check).join(masks, ["h", "check"]).groupBy("k").agg(F.collect_list(F.struct("at", "mask")).alias("found"))
    return repeats_of(docs, text_col, n, texts, found, _starts)


def remove_repeats(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Every row of ``docs`` without its stretches of ``shortest`` words or more that occur elsewhere, in any text.

    All occurrences go, the first included. As in the other substring operator a changed text is its kept words joined
    by one space; unchanged, null, empty and short texts stay; repeated rows count as copies; n_words, n_removed and
    spans are added or replaced. No rows: no rows.
    """
    return cut_texts(docs, repeats(docs, text_col, shortest), text_col, shortest)
