"""Recompression with names given by Spark: each round's distinct runs, and pairs of them, make a dictionary for all texts.

Words count by 64-bit hashes. From there on a name stands for one run, or one pair of runs, by construction: all texts
look their definitions up in the same dictionary. ``recompression`` finds the stretches of text that are worth naming,
by rounds within tasks whose names are hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import affected, at_shared, cut_texts, repeats_of, spans_of, window_starts
from ._shared import let_go, settled, stored
from ._words import Running, lists, mix, pieces, words
from .recompression import ROUNDS, WINDOW, symbols

_TOKENS = "sid bigint, n_words int, names array<bigint>, lo array<int>, hi array<int>"
#: Names of up to so many rounds differ in their lowest digits.
STEPS = 64


def _stretches(n: int):
    """(k, start, ids) of the stretches of each text that windows with a shared anchor cover, a hash for each word; only there can a repeat be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in pieces(batch.column(1)):
                w = words(batch.column(1).slice(lo, hi - lo))
                starts, doc = window_starts(w, n)
                if not len(starts):
                    continue
                good = at_shared(symbols(w, Running(w.hash), starts, n), doc, batch.column(2), lo, hi)
                out = ([], [], [])
                at, of = starts[good], doc[good]
                if not len(at):
                    continue
                own, begin = np.unique(of, return_index=True)
                for d, some in zip(own, np.split(at, begin[1:]), strict=True):
                    for a, b in spans_of(some, n).tolist():
                        out[0].append(int(text_keys[lo + d]))
                        out[1].append(a - int(w.first[d]))
                        out[2].append(w.hash[a:b].view(np.int64))
                ids = lists(np.concatenate(out[2]), np.array([len(x) for x in out[2]], np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), ids], names=["k", "start", "ids"])

    return run


def _rows_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists and the row of each."""
    offsets = column.offsets.to_numpy()
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(offsets))


def _runs(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal names of a row begin, and how long they are."""
    begin = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])])) if len(names) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(names)))


def _pairs(names: np.ndarray, count: np.ndarray, row: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """The side of each run, left (False) or right, drawn by what it is and the round; which runs join the next one of their row, a left one before a right one."""
    drawn = mix(names.view(np.uint64) + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + np.full(1, r + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    side, joins = (mix(drawn) & np.uint64(1)).astype(bool), np.zeros(len(names), bool)
    joins[:-1] = ~side[:-1] & side[1:] & (row[1:] == row[:-1])
    return side, joins


def _definitions(names: np.ndarray, count: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which runs get a new name, and for what: (a, b, c) of a run a and a run b after it, or of a run a alone (b = -1) that is longer than one; c holds how long both are."""
    lone = (count > 1) & ~joins & ~np.append(False, joins[:-1])[:len(joins)]
    at = np.flatnonzero(joins | lone)
    after = np.minimum(at + 1, len(names) - 1)
    b, second = np.where(joins[at], names[after], -1), np.where(joins[at], count[after], 0)
    return at, names[at], b, (count[at].astype(np.int64) << 31) | second


def _defined(r: int):
    """(sid, a, b, c) of the distinct definitions of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, row = _rows_of(batch.column(1))
            begin, count = _runs(names, row)
            names, row = names[begin], row[begin]
            at, a, b, c = _definitions(names, count, _pairs(names, count, row, r)[1])
            of = row[at]
            order = np.lexsort((c, b, a, of))
            of, a, b, c = of[order], a[order], b[order], c[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[new])), pa.array(a[new]), pa.array(b[new]), pa.array(c[new])], names=["sid", "a", "b", "c"])

    return run


def _looked_up(known: tuple[np.ndarray, ...], names: np.ndarray, asked: tuple[np.ndarray, ...]) -> np.ndarray:
    """The name of each asked (row, a, b); all of them are known."""
    n = len(names)
    keys = [np.concatenate(x) for x in zip(known, asked, strict=True)]
    order = np.lexsort((np.arange(n + len(asked[0])) >= n, *keys[::-1]))  # what is known stands before what asks for it
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = names[np.minimum(order[first], n - 1)] if n else 0
    return out[n:]


def _renamed(r: int):
    """The stretches with the runs and pairs of this round as one symbol each, by the dictionary's names; ``lo:hi`` as in ``recompression.rounds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = batch.column(1).to_numpy(), batch.column(5)
            (names, row), (lo, _), (hi, _) = (_rows_of(batch.column(c)) for c in (2, 3, 4))
            fa, fb, fc, fn = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())
            of = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))

            def around(lo: np.ndarray, hi: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                # where what stands before begins, and what stands after ends; beyond the stretch at its ends
                before = np.where(row[np.maximum(first - 1, 0)] == row[first], lo[np.maximum(first - 1, 0)], -1)
                after = np.where(row[np.minimum(last + 1, len(row) - 1)] == row[last], hi[np.minimum(last + 1, len(row) - 1)], n_words[row[last]] + 1)
                return np.where(first == 0, -1, before), np.where(last == len(row) - 1, n_words[row[last]] + 1, after)

            begin, count = _runs(names, row)
            lo, hi = around(lo, hi, row, begin, begin + count - 1)
            made, row = names[begin], row[begin]
            side, joins = _pairs(made, count, row, r)
            at, a, b, c = _definitions(made, count, joins)
            each = np.arange(len(row))
            before, after = around(lo, hi, row, each, each)
            if len(at):
                made = made.copy()
                made[at] = _looked_up((of, fa, fb, fc), fn, (row[at], a, b, c))
            keep = ~np.append(False, joins[:-1])[:len(joins)]
            hi, lo = np.where(joins | ~side, after, hi), np.where(~joins & side, before, lo)
            names, lo, hi, row = made[keep], lo[keep], hi[keep], row[keep]
            counts = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists(names, counts, pa.int64()), lists(lo.astype(np.int32), counts, pa.int32()), lists(hi.astype(np.int32), counts, pa.int32())], names=["sid", "n_words", "names", "lo", "hi"])

    return run


def _named(defined: DataFrame, step: int) -> DataFrame:
    """(sid, found): a dictionary of the distinct definitions, combined before the shuffle and checkpointed with its names, given back to the stretches."""
    what = [c for c in defined.columns if c != "sid"]
    dictionary = settled(defined.groupBy(*what).agg(F.count(F.lit(1)).alias("rows")).select(*what, (F.monotonically_increasing_id() * STEPS + step).alias("name")))
    return defined.join(dictionary, what).groupBy("sid").agg(F.collect_list(F.struct(*what, "name")).alias("found"))


def symbols_by_spark(texts: DataFrame, window: int = WINDOW, n_rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Of the stretches of ``texts`` (as ``_repeats.affected`` gives them) their words (sid, k, start, ids), and their symbols after all rounds (sid, n_words, names, lo, hi).

    ``lo:hi`` are the words that settle a symbol. Each round's table goes when the next is written.
    """
    base = stored(texts.mapInArrow(_stretches(window), "k bigint, start int, ids array<bigint>").withColumn("sid", F.monotonically_increasing_id()))
    place = F.sequence(F.lit(0), F.size("ids") - 1)
    tokens = base.select("sid", F.size("ids").alias("n_words"), F.col("ids").alias("names"), place.alias("lo"), F.transform(place, lambda i: i + 1).alias("hi"))
    nothing = F.array().cast("array<struct<a:bigint,b:bigint,c:bigint,name:bigint>>")
    for r in range(n_rounds):
        defined = tokens.select("sid", "names").mapInArrow(_defined(r), "sid bigint, a bigint, b bigint, c bigint")
        with_names = tokens.join(_named(defined, r + 1), "sid", "left").withColumn("found", F.coalesce("found", nothing))
        new = stored(with_names.mapInArrow(_renamed(r), _TOKENS))
        if r:
            let_go(tokens)
        tokens = new
    return base, tokens


def _windows(n: int):
    """(hash, check, k, start) of the windows over a shared symbol that is settled inside, or over none at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.array(batch.column(3)[i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                lo, hi = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                shared = np.isin(batch.column(4)[i].values.to_numpy(zero_copy_only=False), np.array(batch.column(7)[i].as_py() or [], np.int64))
                starts = np.arange(max(0, len(ids) - n + 1))
                upto = np.concatenate([[0], np.cumsum(shared)])
                a, b = np.searchsorted(lo, starts), np.searchsorted(hi, starts + n, "right")
                at = starts[(b <= a) | (upto[np.maximum(a, b)] > upto[a])]
                held = Running(mix(ids)).of(at, at + n)
                check = (Running(mix(ids ^ np.uint64(0x5DEECE66D))).of(at, at + n) >> np.uint64(33)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(check), pa.array(np.full(len(at), batch.column(1)[i].as_py())), pa.array((at + batch.column(2)[i].as_py()).astype(np.int32))], names=["hash", "check", "k", "start"])

    return run


def repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """As ``recompression.repeats``, from symbols with names that Spark's rounds gave."""
    texts = affected(docs, text_col, window, symbols)
    base, tokens = symbols_by_spark(texts, window)
    each = tokens.select("sid", F.explode("names").alias("name"))
    shared = settled(each.groupBy("name").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("name"))
    hits = each.join(shared, "name", "left_semi").groupBy("sid").agg(F.collect_set("name").alias("shared"))
    held = base.join(tokens, "sid").join(hits, "sid", "left").select("sid", "k", "start", "ids", "names", "lo", "hi", "shared")
    held = stored(held.mapInArrow(_windows(window), "hash bigint, check int, k bigint, start int"))
    let_go(base)
    let_go(tokens)
    again = settled(held.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("hash", "check"))
    found = held.join(again, ["hash", "check"], "left_semi").groupBy("k").agg(F.collect_list("start").alias("starts"))
    return repeats_of(docs, text_col, window, texts, found, lambda starts: starts.to_numpy(zero_copy_only=False))


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """As ``recompression.remove_repeats``: every row of ``docs`` without the words that a window found twice or more covers.

    Null, empty and short texts stay as they are; repeated rows are copies and lose all, if long enough; n_words,
    n_removed and spans are added or replaced; other columns play no part. No rows: no rows.
    """
    return cut_texts(docs, repeats(docs, text_col, window), text_col, window)
