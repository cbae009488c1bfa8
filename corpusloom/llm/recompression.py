"""Substring dedup by recompression: rounds that name runs and pairs of tokens alike wherever they stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Anchored, affected, at_shared, cut_texts, repeats_of, window_starts
from ._shared import settled
from ._words import Running, Words, mix, pieces, words

#: Words of a window: repeats of so many words or more are found.
WINDOW = 35
#: Rounds of naming; what settles a symbol of the last is some 13 words, so that most windows have several inside.
ROUNDS = 3
#: Symbols of earlier rounds are too short to tell a window by.
FIRST_ROUND = 2
_RUN, _LEFT, _RIGHT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def rounds(w: Words, n_rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, lo, hi) of the symbols after each round: ``lo:hi`` are the words that settle that this symbol stands here.

    A round names each run of equal symbols, then each pair of a left and a right symbol, sides being drawn by a hash of
    the symbol's name and the round. A name is a hash of what it names, so all tasks give the same names without a
    dictionary that would have to be shuffled each round. Where a symbol ends depends on its neighbours, so equal
    passages have equal symbols inside, and may differ at the ends; ``lo:hi`` tells where inside begins. At the ends of
    a text it goes beyond them, so that nothing is said to be inside there.
    """
    name = w.hash
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    lo, hi = np.arange(len(name)), np.arange(1, len(name) + 1)
    before, after = w.first[:-1] - 1, w.first[1:] + 1
    out = []
    for r in range(n_rounds):
        if not len(name):
            break
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        a = np.flatnonzero(fresh)
        b = np.append(a[1:], len(name)) - 1
        count = (b - a + 1).astype(np.uint64)
        of = doc[a]
        left = np.where((a > 0) & (doc[np.maximum(a - 1, 0)] == of), lo[np.maximum(a - 1, 0)], before[of])
        nxt = np.minimum(b + 1, len(name) - 1)
        right = np.where((b + 1 < len(name)) & (doc[nxt] == of), hi[nxt], after[of])
        name = np.where(count == 1, name[a], mix(name[a] * _RUN + count))
        lo, hi, doc = left, right, of

        side = (mix(name + np.full(1, r + 1, np.uint64) * _RUN) & np.uint64(1)).astype(bool)  # False: left
        joins = np.zeros(len(name), bool)  # with the next one
        joins[:-1] = ~side[:-1] & side[1:] & (doc[:-1] == doc[1:])
        second = np.zeros(len(name), bool)
        second[1:] = joins[:-1]
        follows = np.append((doc[:-1] == doc[1:]), False)
        after_lo, after_hi = np.append(lo[1:], 0), np.append(hi[1:], 0)
        named = np.where(joins, mix(name * _LEFT + np.append(name[1:], np.uint64(0)) * _RIGHT + np.uint64(r)), name)
        # a lone left symbol depends on the next, a lone right one on the one before
        new_hi = np.where(joins, after_hi, np.where(~side, np.where(follows, after_hi, after[doc]), hi))
        precedes = np.concatenate([[False], doc[1:] == doc[:-1]])
        prev_lo = np.concatenate([[0], lo[:-1]])
        new_lo = np.where(~joins & side, np.where(precedes, prev_lo, before[doc]), lo)
        keep = ~second
        name, lo, hi, doc = named[keep], new_lo[keep], new_hi[keep], doc[keep]
        out.append((name, lo, hi))
    return out


def least_in(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the least value of each non-empty range ``begin:end`` is, the first of equals (44 bits are compared)."""
    marked = (values >> np.uint64(20) << np.uint64(20)) | (np.arange(len(values), dtype=np.uint64) & np.uint64((1 << 20) - 1))
    size = end - begin
    out = np.empty(len(begin), np.uint64)
    level, width = marked, 1
    while True:
        some = np.flatnonzero((size >= width) & (size < 2 * width))
        out[some] = np.minimum(level[begin[some]], level[end[some] - width])
        if not (size >= 2 * width).any():
            break
        level, width = np.minimum(level[:-width], level[width:]), 2 * width
    at = (out & np.uint64((1 << 20) - 1)).astype(np.int64)
    return at + ((begin - at + (1 << 20) - 1) >> 20 << 20)  # places are kept modulo 2**20; ranges are short


def symbols(w: Words, run: Running, starts: np.ndarray, n: int) -> Anchored:
    """The anchor of each window: of the symbols settled inside it, in the latest round that has any, that of least name.

    So neighbouring windows mostly share their anchor. Its key is its name with the words that settle it. A window
    without a symbol (one of a long run, say) is its own anchor.
    """
    key = run.of(starts, starts + n)
    place = starts.astype(np.int64)
    todo = np.arange(len(starts))
    found = rounds(w)
    for r in range(len(found) - 1, FIRST_ROUND - 2, -1):
        name, lo, hi = found[r]
        begin, end = np.searchsorted(lo, starts[todo]), np.searchsorted(hi, starts[todo] + n, "right")
        ok = begin < end
        at, done = least_in(mix(name), begin[ok], end[ok]) if ok.any() else begin[:0], todo[ok]
        key[done] = mix(run.of(lo[at], hi[at]) + name[at])
        place[done] = at + (r + 1) * (len(w.hash) + 1)
        todo = todo[~ok]
    return Anchored(starts, key, place)


def _windows(n: int):
    """(hash, check, k, start) of each window whose anchor key is among the text's shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in pieces(batch.column(1)):
                w = words(batch.column(1).slice(lo, hi - lo))
                starts, doc = window_starts(w, n)
                if not len(starts):
                    continue
                held = Running(w.hash)
                good = at_shared(symbols(w, held, starts, n), doc, batch.column(2), lo, hi)
                at, of = starts[good], doc[good]
                # a second hash of the same words, by other values of the words
                check = Running(mix(w.hash ^ np.uint64(0x5DEECE66D))).of(at, at + n) >> np.uint64(33)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.of(at, at + n).view(np.int64)), pa.array(check.astype(np.int32)), pa.array(text_keys[lo:hi][of]), pa.array((at - w.first[of]).astype(np.int32))],
                    names=["hash", "check", "k", "start"],
                )

    return run


def repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The repeated windows of each distinct text, see ``_repeats.repeats_of``; anchors are recompression symbols.

    Windows are compared by 95 bits of hash.
    """
    texts = affected(docs, text_col, window, symbols)
    held = texts.mapInArrow(_windows(window), "hash bigint, check int, k bigint, start int")
    again = settled(held.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("hash", "check"))
    found = held.join(again, ["hash", "check"], "left_semi").groupBy("k").agg(F.collect_list("start").alias("starts"))
    return repeats_of(docs, text_col, window, texts, found, lambda starts: starts.to_numpy(zero_copy_only=False))


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` without the words that a window found twice or more covers; adds n_words, n_removed, spans.

    Windows are ``window`` consecutive words of one text, taken from the input; each occurrence is removed, the first
    included. A changed text is its kept words joined by one space; others stay as they are, null too. Texts shorter
    than a window, and empty ones, lose nothing. Repeated rows are copies: they lose all, if long enough. Columns named
    n_words, n_removed or spans are replaced; others, keys and languages play no part. No rows: no rows.
    """
    return cut_texts(docs, repeats(docs, text_col, window), text_col, window)
