"""The trie of conversations' prefixes: nodes by digests of prefixes, sums over subtrees by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import let_go, stored

#: Turns of a conversation whose prefix sums one window makes; longer conversations are put together from such blocks.
BLOCK = 4096
#: Ids that one row carries on the way to a digest of all ids of a node.
IDS = 4096
#: The most turns that a conversation can borrow.
MOST_SHARED = 5
_MASK = (1 << 32) - 1
_SUMS = ("s0", "s1", "s2", "s3")


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, at, t0, t1, n): the turns of each conversation numbered from 1, by digests and length of their text.

    Rows are sorted by ranges, so that a conversation may lie over several tasks; only conversations on the border of a
    range need the numbers before it: two rows a range at most.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    told = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("t0"), F.xxhash64(F.lit(2), text, role).alias("t1"), F.length(text).cast("long").alias("n"),
    )
    order = ("conv_id", "turn", "t0", "t1")
    ranged = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    counted = stored(ranged.drop("turn").mapInArrow(_counted, "conv_id long, t0 long, t1 long, n long, part int, at long"))
    ends = counted.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    over = ends.select("part", F.explode(F.array_distinct(F.array("first", "last"))).alias("conv_id"))
    here = counted.join(F.broadcast(over), ["part", "conv_id"], "left_semi").groupBy("conv_id", "part").agg(F.max("at").alias("held"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = here.withColumn("start", F.sum("held").over(before)).where("start > 0").select("conv_id", "part", "start")
    at = (F.col("at") + F.coalesce("start", F.lit(0))).alias("at")
    return counted.join(F.broadcast(start), ["part", "conv_id"], "left").select("conv_id", at, "t0", "t1", "n")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation within a sorted task."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        begin = np.repeat(new, np.diff(np.append(new, len(ids))))
        at = np.arange(len(ids)) - begin + 1
        if ids[0] == last:
            at[begin == 0] += held
        last, held = ids[-1], at[-1]
        yield batch.append_column("at", pa.array(at, pa.int64()))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation borrows at most."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED + 1)).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations as (conv_id, depth, t0, t1, n), and (conv_id, depth) of each conversation's end."""
    lent = F.col("conv_id") - F.col("conv_id") % 100
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("own")).withColumn("h", shared_turns(F.col("conv_id"))).withColumn("lender", lent)
    lenders = sizes.where(F.col("conv_id") == F.col("lender")).select("lender", F.least("own", F.lit(MOST_SHARED)).alias("lends"))
    sizes = sizes.join(lenders, "lender", "left").select("conv_id", "lender", "own", "h", F.least("h", F.coalesce("lends", F.lit(0))).alias("got"))
    sizes = stored(sizes)
    first = turns.where((F.col("at") <= MOST_SHARED) & (F.col("conv_id") == lent)).withColumnRenamed("conv_id", "lender")
    borrowed = sizes.select("conv_id", "lender", "h").join(first, "lender").where("at <= h").select("conv_id", F.col("at").alias("depth"), "t0", "t1", "n")
    own = turns.where(F.col("at") > shared_turns(F.col("conv_id"))).join(sizes.select("conv_id", "h", "got"), "conv_id")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("got")).alias("depth"), "t0", "t1", "n")
    ends = sizes.select("conv_id", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("depth"))
    return borrowed.union(own), ends


def _key(depth: Column, sums: list[Column]) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(3), depth, *sums).alias("k0"), F.xxhash64(F.lit(4), *sums[::-1], depth).alias("k1")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k0, k1, p0, p1, n): the digest of each prefix, and of the prefix one turn shorter.

    A prefix is known by its length and the sums of four hashes over (place, turn), 32 bits each, so that sums of
    blocks can be put together in any order; all of it is hashed to 128 bits.
    """
    a, b = F.xxhash64("depth", "t0", "t1"), F.xxhash64("t1", "depth", "t0")
    parts = [a.bitwiseAND(_MASK), F.shiftrightunsigned(a, 32), b.bitwiseAND(_MASK), F.shiftrightunsigned(b, 32)]
    block = F.floor((F.col("depth") - 1) / BLOCK)
    each = turns.select("conv_id", "depth", "n", block.alias("block"), *[p.alias(f"v{i}") for i, p in enumerate(parts)])
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("*", *[F.sum(f"v{i}").over(within).alias(s) for i, s in enumerate(_SUMS)])
    long_ones = turns.where(F.col("depth") > BLOCK).select("conv_id").distinct()
    totals = turns.join(long_ones, "conv_id", "left_semi").groupBy("conv_id", block.alias("block")).agg(*[F.sum(p).alias(f"b{i}") for i, p in enumerate(parts)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", *[F.sum(f"b{i}").over(before).alias(f"b{i}") for i in range(4)]).where("block > 0")
    each = each.join(totals, ["conv_id", "block"], "left")
    sums = [F.col(s) + F.coalesce(F.col(f"b{i}"), F.lit(0)) for i, s in enumerate(_SUMS)]
    shorter = [s - F.col(f"v{i}") for i, s in enumerate(sums)]
    (k0, k1), (p0, p1) = _key(F.col("depth"), sums), _key(F.col("depth") - 1, shorter)
    return each.select("conv_id", "depth", k0, k1, p0.alias("p0"), p1.alias("p1"), "n")


def _root() -> tuple[Column, Column]:
    return _key(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node of a sorted task, row after row; nothing but the digest's state is held."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for k0, k1, ids in zip(batch.column("k0").to_pylist(), batch.column("k1").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (k0, k1) == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k0, k1), hashlib.sha256()
            state.update(ids.encode())
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    k0, k1, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch({"k0": pa.array(k0, pa.int64()), "k1": pa.array(k1, pa.int64()), "ends_sha256": pa.array(sha, pa.string())})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that follow each other in a sorted task, joined by commas, up to IDS in a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k0, k1, ids = (batch.column(c).to_numpy() for c in ("k0", "k1", "conv_id"))
        new = np.concatenate([[True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])
        new[::IDS] = True
        at = np.append(np.flatnonzero(new), len(ids))
        joined = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch({"k0": k0[at[:-1]], "k1": k1[at[:-1]], "first": ids[at[:-1]], "ids": pa.array(joined, pa.string())})


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256) over the ids of (k0, k1, conv_id), ascending and joined by commas.

    A digest has to read its ids in order, in one task; so ids are first sorted by ranges and joined within tasks, and
    what meets in a node's task are a few long rows.
    """
    packed = ends.repartitionByRange("k0", "k1", "conv_id").sortWithinPartitions("k0", "k1", "conv_id").mapInArrow(_packed, "k0 long, k1 long, first long, ids string")
    return packed.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "first").mapInArrow(_digests, "k0 long, k1 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, deepest: int, sums: tuple[str, ...]) -> DataFrame:
    """``nodes`` (k0, k1, p0, p1, ...) with each column of ``sums`` added up over the node's subtree, by pointer jumping.

    After r rounds a node has the sums of its descendants less than 2**r below it and points to its ancestor 2**r
    above. In a round, every node hands its sums to the node it points to (combined before the shuffle) and takes over
    that node's pointer; so depth n takes log2(n) rounds. Each round is written and the one before it let go.
    """
    held = stored(nodes.select("k0", "k1", F.col("p0").alias("q0"), F.col("p1").alias("q1"), *sums))
    reach = 1
    while reach <= deepest:
        rising = held.where("q0 is not null")
        handed = rising.groupBy("q0", "q1").agg(*[F.sum(s).alias(f"_{s}") for s in sums]).withColumnsRenamed({"q0": "k0", "q1": "k1"})
        beyond = rising.select(F.col("k0").alias("q0"), F.col("k1").alias("q1"), F.col("q0").alias("r0"), F.col("q1").alias("r1"))
        jumped = rising.select("k0", "k1", "q0", "q1").join(beyond, ["q0", "q1"]).select("k0", "k1", "r0", "r1")
        after = held.select("k0", "k1", *sums).join(handed, ["k0", "k1"], "left").join(jumped, ["k0", "k1"], "left")
        after = after.select("k0", "k1", F.col("r0").alias("q0"), F.col("r1").alias("q1"), *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])
        before, held, reach = held, stored(after), reach * 2
        let_go(before)
    return held.select("k0", "k1", *sums)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations of ``rows`` (conv_id, turn, role, text): conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn, null first; turns of one number are ordered by their digests, repeated rows are
    turns of their own. A conversation c is rebuilt from the first turns of conversation c - c % 100, as many as
    crc32(c) % 6 says or as there are, and its own turns after that number. Null roles and texts count as empty; rows
    without a conv_id take no part. The root has depth 0, no text and all conversations; without conversations there
    is no node. Other columns are ignored. Texts and prefixes are compared by 128 bits of hash.
    """
    turns = turns_of(rows.select("conv_id", "turn", "role", "text"))
    told, ends = rebuilt(turns)
    paths = stored(prefixes(told))
    root0, root1 = _root()
    nothing = F.lit(None).cast("long")
    starts = ends.select("conv_id", F.lit(0).cast("long").alias("depth"), root0, root1, nothing.alias("p0"), nothing.alias("p1"), F.lit(0).cast("long").alias("n"))
    nodes = paths.select("conv_id", "depth", "k0", "k1", "p0", "p1", "n").union(starts).groupBy("k0", "k1").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("p0").alias("p0"), F.max("p1").alias("p1"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_convs"))
    children = nodes.where("p0 is not null").groupBy("p0", "p1").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"p0": "k0", "p1": "k1"})
    nodes = nodes.join(children, ["k0", "k1"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(nodes, deepest, ("n_leaves", "saved_tokens"))
    parents = nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    done = ends.join(paths.select("conv_id", "depth", "k0", "k1"), ["conv_id", "depth"]).select("k0", "k1", "conv_id")
    done = done.union(ends.where("depth = 0").select(root0, root1, "conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, ["k0", "k1"]).join(parents, ["p0", "p1"], "left").join(ends_digests(done), ["k0", "k1"], "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
