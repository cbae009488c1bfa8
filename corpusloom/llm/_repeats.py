"""Windows of words that occur more than once: what the two substring operators share.

Each window of n words gets an anchor: a place in it that its words alone decide, so that equal windows have equal
anchors. How anchors are chosen is the operators' own affair. Texts that share an anchor's key with another text, or
have it at two places, go on; what stands at shared anchors is compared by the operators, each in its way, and the
windows that they find are cut out here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free, let_go, others, settled, stored, text_key, words_of
from ._words import Running, Words, pieces, words

SPANS = "array<struct<start:int,end:int>>"


@dataclass
class Anchored:
    """Of each window: its first word, the key of its anchor, and a number of the anchor's place (of one text, places differ)."""

    start: np.ndarray
    key: np.ndarray
    place: np.ndarray


Finder = Callable[[Words, Running, np.ndarray, int], Anchored]


def window_starts(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``n`` words within one text, and the text of each."""
    counts = np.maximum(np.diff(w.first) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(w.first[:-1], counts), doc


def _keys(n: int, find: Finder):
    """(key, k, twice) of each distinct anchor key of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in pieces(batch.column(1)):
                w = words(batch.column(1).slice(lo, hi - lo))
                starts, doc = window_starts(w, n)
                if not len(starts):
                    continue
                found = find(w, Running(w.hash), starts, n)
                new = np.ones(len(starts), bool)
                new[1:] = (found.place[1:] != found.place[:-1]) | (doc[1:] != doc[:-1])
                key, of = found.key[new], doc[new]
                order = np.lexsort((key, of))
                key, of = key[order], of[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                twice = np.zeros(len(key), bool)
                twice[:-1] = ~first[1:]
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(text_keys[lo:hi][of[first]]), pa.array(twice[first])], names=["key", "k", "twice"])

    return run


def at_shared(found: Anchored, doc: np.ndarray, shared: pa.ListArray, lo: int, hi: int) -> np.ndarray:
    """Which windows have an anchor whose key is among those that their text shares; ``shared``: the keys of each text of the batch."""
    values, offsets = shared.values.to_numpy(zero_copy_only=False).view(np.uint64), shared.offsets.to_numpy()
    good = np.zeros(len(found.key), bool)
    bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
    for d in range(hi - lo):
        own = slice(bounds[d], bounds[d + 1])
        good[own] = np.isin(found.key[own], values[offsets[lo + d]:offsets[lo + d + 1]])
    return good


def spans_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The stretches that windows of ``n`` words at ``starts`` cover, as rows of start and end."""
    starts = np.sort(starts)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + n
    ends = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + n
    return np.stack([starts[new], ends], 1)


def _cut(n: int, starts_of: Callable[[pa.Array], np.ndarray]):
    """(k, n_removed, spans, kept) of each text with its repeated windows, of which ``starts_of`` tells the first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, offsets = batch.column(2).values, batch.column(2).offsets.to_numpy()
            for lo, hi in pieces(batch.column(1)):
                w = words(batch.column(1).slice(lo, hi - lo))
                data = w.data.tobytes()
                removed, spans, kept = [], [], []
                for d in range(hi - lo):
                    cut = spans_of(starts_of(found.slice(offsets[lo + d], offsets[lo + d + 1] - offsets[lo + d])), n)
                    first, last = int(w.first[d]), int(w.first[d + 1])
                    stay = np.ones(last - first, bool)
                    for a, b in cut:
                        stay[a:b] = False
                    which = np.flatnonzero(stay) + first
                    kept.append(b" ".join(data[a:b] for a, b in zip(w.start[which].tolist(), w.end[which].tolist(), strict=True)).decode())
                    removed.append(last - first - len(which))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in cut])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["k", "n_removed", "spans", "kept"])

    return run


def affected(docs: DataFrame, text_col: str, n: int, find: Finder) -> DataFrame:
    """(k, t, keys) of each distinct text, by its ``text_key``, that shares keys of anchors with others or has one twice.

    Only keys travel at first. They are combined before the shuffle, so that a passage that a third of the texts have
    is one row of each task. Equal texts count as one. Two texts that share the 64-bit key of a text are taken for one:
    a chance of one in 10 billion for each text of 1 billion.
    """
    keyed = docs.select(text_key(text_col).alias("k"), F.col(f"`{text_col}`").alias("t"))
    anchors = stored(keyed.mapInArrow(_keys(n, find), "key bigint, k bigint, twice boolean"))
    shared = anchors.groupBy("key").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.max("twice").alias("twice")).where("twice or k0 != k1").select("key")
    shared = settled(shared)  # read by the join from storage, so that a key of very many texts can be split there
    hits = anchors.join(shared, "key", "left_semi").groupBy("k").agg(F.collect_list("key").alias("keys"))
    hits = hits.withColumn("keys", F.array_distinct("keys"))
    texts = keyed.groupBy("k").agg(F.first("t").alias("t"))
    out = stored(texts.join(hits, "k").select("k", "t", "keys"))
    let_go(anchors)
    return out


def repeats_of(docs: DataFrame, text_col: str, n: int, texts: DataFrame, found: DataFrame, starts_of: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(k, whole, n_removed, spans, kept) of each distinct text with a window found twice or more.

    ``texts``: as ``affected`` gives them; ``found``: (k, list) of those with repeated windows, whose first words
    ``starts_of`` reads from a list. ``whole``: the text itself occurs twice or more, so all its words are covered if
    it has a window at all; the other columns may be null then. Else spans (in words), their words and the rest, joined
    by one space.
    """
    cut = texts.select("k", "t").join(found, "k").mapInArrow(_cut(n, starts_of), f"k bigint, n_removed bigint, spans {SPANS}, kept string")
    copied = docs.select(text_key(text_col).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("k", F.lit(True).alias("whole"))
    return cut.join(copied, "k", "full_outer").select("k", F.coalesce("whole", F.lit(False)).alias("whole"), "n_removed", "spans", "kept")


def removed_words(n: int, n_words: Column) -> Column:
    """How many words go, given the columns of ``repeated`` after a left join."""
    return F.when(F.coalesce("whole", F.lit(False)), F.when(n_words >= n, n_words).otherwise(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")


def cut_texts(docs: DataFrame, found: DataFrame, text_col: str, n: int) -> DataFrame:
    """``docs`` with repeated windows cut out: a changed text is its kept words joined by one space; adds n_words, n_removed, spans."""
    docs = docs.select(*[F.col(f"`{c}`") for c in others(docs, "n_words", "n_removed", "spans")])
    key, own, whole, removed, spans, kept = free(docs, "_k", "_own", "_whole", "_n_removed", "_spans", "_kept")
    found = settled(found.select(F.col("k").alias(key), F.col("whole").alias(whole), F.col("n_removed").alias(removed), F.col("spans").alias(spans), F.col("kept").alias(kept)))
    joined = docs.withColumn(own, text_key(text_col)).join(found, F.col(own) == F.col(key), "left")
    n_words = F.size(words_of(text_col)).cast("long")
    all_go = F.coalesce(whole, F.lit(False)) & (n_words >= n)
    text = F.when(all_go, "").when(F.coalesce(removed, F.lit(0)) > 0, F.col(kept)).otherwise(F.col(f"`{text_col}`"))
    everything = F.array(F.struct(F.lit(0).alias("start"), n_words.cast("int").alias("end")))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n_words.alias("n_words"),
        F.when(all_go, n_words).otherwise(F.coalesce(removed, F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_go, everything).otherwise(F.coalesce(spans, F.array().cast(SPANS))).alias("spans"),
    )
