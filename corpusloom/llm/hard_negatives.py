"""Hard negatives of anchor vectors by blocked dense products: broadcast blocks of anchors against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

#: Components are scaled by this and rounded down.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Hundredths of a positive's score between which a negative's may lie.
LOWEST, HIGHEST = 50, 95
#: Bytes of anchors' components that are broadcast at once; more anchors take more passes over the rows.
ANCHOR_BYTES = 1 << 25
#: Rows and anchors of one product, so that a block of scores has 8 MiB.
ROWS, ANCHORS = 2048, 512
#: Products of sums of squares below this are exact in float64; rows of larger ones are left to integers.
EXACT = 1 << 53
#: Rows whose components' squares sum to this or more take no part: a hundred times their scores would pass 64 bits.
TOO_LONG = 1 << 56
_NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part, one row for each id."""
    at, vector, label = (F.col(f"`{c}`") for c in (id_col, vector_col, label_col))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = rows.where(at.isNotNull() & label.isNotNull() & vector.isNotNull() & sound).select(at.cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < TOO_LONG)
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and components of a batch's rows, by their number of components and then by id."""
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
    vectors = batch.column("v")
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, first = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        at = at[np.argsort(ids[at], kind="stable")]
        for lo in range(0, len(at), ROWS):
            part = at[lo:lo + ROWS]
            yield ids[part], labels[part], flat[first[part][:, None] + np.arange(n)].reshape(len(part), n)


class Anchors:
    """A batch of anchors of one number of components; ``wanted`` has the scores of each one's positives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, wanted: np.ndarray | None = None):
        self.ids, self.labels, self.v, self.wanted = ids, labels, v, wanted

    def parts(self) -> Iterator[slice]:
        for lo in range(0, len(self.ids), ANCHORS):
            yield slice(lo, min(lo + ANCHORS, len(self.ids)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, as integers."""
    bound = np.sqrt((a * a).sum(1).max(initial=0.0) * (b * b).sum(1).max(initial=0.0)) * 1.001
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` highest allowed scores of each row, the first of equal ones; -1 where there are fewer."""
    left = np.where(allowed, scores, _NONE)
    at, got = np.full((len(left), k), -1), np.full((len(left), k), _NONE)
    every = np.arange(len(left))
    for j in range(min(k, left.shape[1])):
        top = left.argmax(1)
        got[:, j] = left[every, top]
        at[:, j] = np.where(got[:, j] == _NONE, -1, top)
        left[every, top] = _NONE
    return at, got


class Kept:
    """The ``k`` best (score, id) of each of ``n`` anchors so far; two of them merge by ``add``."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, part: slice, score: np.ndarray, id_: np.ndarray) -> None:
        k = self.score.shape[1]
        score, id_ = np.hstack([self.score[part], score]), np.hstack([self.id[part], id_])
        order = np.lexsort((id_, np.where(score == _NONE, np.iinfo(np.int64).max, -score)), axis=-1)[:, :k]
        self.score[part], self.id[part] = np.take_along_axis(score, order, 1), np.take_along_axis(id_, order, 1)


def _scan(batches: Iterator[pa.RecordBatch], groups: dict[int, Anchors], n_slots: int, k: int, allowed: Callable) -> Iterator[pa.RecordBatch]:
    """The ``k`` best rows of this task for each anchor and slot; ``allowed`` says which scores count."""
    kept = {n: [Kept(len(g.ids), k) for _ in range(n_slots)] for n, g in groups.items()}
    for batch in batches:
        for ids, labels, v in _matrices(batch):
            group = groups.get(v.shape[1])
            if group is None:
                continue
            for part in group.parts():
                scores = products(group.v[part], v)
                for slot in range(n_slots):
                    at, got = best(scores, allowed(group, part, slot, scores, ids, labels), k)
                    kept[v.shape[1]][slot].add(part, got, np.where(at < 0, np.iinfo(np.int64).max, ids[at]))
    for n, group in groups.items():
        for slot, held in enumerate(kept[n]):
            row, col = np.nonzero(held.score != _NONE)
            if len(row):
                yield pa.record_batch({"anchor_id": group.ids[row], "slot": np.full(len(row), slot, np.int32), "id": held.id[row, col], "score": held.score[row, col]})


def _positive(group: Anchors, part: slice, slot: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return (group.labels[part, None] == labels) & (group.ids[part, None] != ids)


def _negative(group: Anchors, part: slice, slot: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    wanted = group.wanted[part, slot, None]
    there = wanted != _NONE
    wanted = np.where(there, wanted, 0)
    return there & (group.labels[part, None] != labels) & (LOWEST * wanted <= 100 * scores) & (100 * scores <= HIGHEST * wanted)


def _groups(anchors: pa.Table, wanted: dict[int, dict[int, int]] | None = None) -> dict[int, Anchors]:
    """Anchors by their number of components; ``wanted``: the score of the positive of each rank of each anchor."""
    out: dict[int, list] = {}
    for batch in anchors.to_batches():
        for ids, labels, v in _matrices(batch):
            out.setdefault(v.shape[1], []).append((ids, labels, v))
    groups = {n: Anchors(*(np.concatenate(x) for x in zip(*parts))) for n, parts in out.items()}
    if wanted is not None:
        for group in groups.values():
            group.wanted = np.array([[wanted.get(int(a), {}).get(j, _NONE) for j in range(POSITIVES)] for a in group.ids], np.int64).reshape(len(group.ids), POSITIVES)
    return groups


def _passed(rows: DataFrame, groups: dict[int, Anchors], n_slots: int, k: int, allowed: Callable) -> DataFrame:
    """A pass over all rows: (anchor_id, slot, id, score, rank) of the ``k`` best of all tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(groups)
    found = rows.mapInArrow(lambda batches: _scan(batches, sent.value, n_slots, k, allowed), "anchor_id long, slot int, id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor and each of its POSITIVES nearest rows of the same label, the NEGATIVES best rows of other labels
    whose score is LOWEST to HIGHEST hundredths of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    ``is_anchor`` is over the columns id, label and v. A score is the inner product of components scaled by SCALE and
    rounded down, exact; higher comes first, ties go to the smaller id. Anchors are cut into batches of ANCHOR_BYTES,
    by a hash of their ids; each batch is broadcast and meets all rows twice: the first pass keeps the best positives of
    each task and merges them, the second the best negatives in each positive's window. So no row is sent to an anchor,
    whatever labels or equal vectors prevail.

    Rows with a null id, label or vector or with a null or non-finite component take no part, nor those of which the
    components' squares sum to TOO_LONG. Of several rows with one id that of the least label and vector counts. Only
    vectors with equally many components meet; empty vectors score 0. An anchor without positives and a positive
    without negatives have no rows; fewer are given where there are fewer. No rows: no rows. Other columns are ignored.
    """
    ready = stored(usable(rows, id_col, vector_col, label_col))
    spark = ready.sparkSession
    anchors = ready.where(is_anchor)
    size = anchors.agg(F.sum(F.size("v") * 8 + 16).alias("bytes")).first()["bytes"] or 0
    n_batches = int(-(-size // ANCHOR_BYTES))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    batch_of = F.pmod(F.xxhash64("id"), F.lit(max(1, n_batches)))
    if n_batches > 1:  # each batch then reads its own part only
        anchors = stored(anchors.withColumn("batch", batch_of))
    for batch in range(n_batches):
        held = (anchors.where(F.col("batch") == batch) if n_batches > 1 else anchors).select("id", "label", "v").toArrow()
        near = _passed(ready, _groups(held), 1, POSITIVES, _positive)
        positives = stored(near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        wanted: dict[int, dict[int, int]] = {}
        for r in positives.select("anchor_id", "slot", "positive_score").collect():  # POSITIVES rows an anchor of this batch
            wanted.setdefault(r["anchor_id"], {})[r["slot"]] = r["positive_score"]
        far = _passed(ready, _groups(held, wanted), POSITIVES, NEGATIVES, _negative)
        done = far.join(positives, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = out.union(stored(done) if n_batches > 1 else done)
    return out
