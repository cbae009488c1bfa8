"""Near-duplicates by bottom-k sketches of word shingles, confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settled, stored, text_key
from ._words import Running, lists, mix, pieces, words

WORDS = 5
SIMILARITY = 0.8
#: Values that a sketch retains.
K = 64
#: Sketches of so many values or fewer are listed value by value, those of so many or more by pairs of neighbours.
SINGLES_TO, PAIRS_FROM = 20, 12
#: Nodes of a list that are compared with as many others in one step: longer lists are dealt out in blocks.
BLOCK = 512
#: Values that one product of a block with another covers.
COLUMNS = 4096
#: Edges of a partition of a graph, at least: smaller partitions are put together, so that a round doesn't leave thousands of tiny files.
PARTITION_EDGES = 100_000


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of ``n`` words; of all its words, if they are fewer."""
    for lo, hi in pieces(texts):
        w = words(texts.slice(lo, hi - lo), lower=True)
        total = len(w.hash)
        run = Running(w.hash)
        starts = np.arange(max(0, total - n + 1))
        grams = run.of(starts, starts + n)
        for d in range(hi - lo):
            a, b = int(w.first[d]), int(w.first[d + 1])
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield run.of(np.array([a]), np.array([b]))
            else:
                yield grams[:0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sketches(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, kept = [], [], []
            for s in shingle_sets(batch.column(batch.num_columns - 1), n):
                sizes.append(len(s))
                marks.append(int(_signed(mix(np.array([s.sum(dtype=np.uint64) ^ (mix(s).sum(dtype=np.uint64) << np.uint64(1)) ^ np.uint64(len(s))], np.uint64)))[0]) if len(s) else 0)
                kept.append(s[:k])
            sketch = lists(_signed(np.concatenate(kept)) if kept else np.zeros(0, np.int64), np.array([len(x) for x in kept], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), sketch], names=["id", "k", "n", "mark", "sketch"])

    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in pieces(texts):
                sets = list(shingle_sets(texts.slice(lo, hi - lo), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists(_signed(np.concatenate(sets)), np.array([len(s) for s in sets], np.int64), pa.int64())], names=["mark", "full"])

    return run


def _compared(similarity: float, k: int):
    """(a, b): the pairs whose sets are similar enough.

    Pairs aren't whose sizes or whose estimate from the union of the sketches, the ``k`` least values of both, are
    hopeless; the full sets decide about the others.
    """
    percent = round(similarity * 100)
    least = similarity - 6 * math.sqrt(similarity * (1 - similarity) / k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = np.zeros(batch.num_rows, bool)
            (va, oa), (vb, ob) = (_values(batch.column(c)) for c in (2, 3))
            for i in range(batch.num_rows):
                x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                union = np.union1d(x[:k], y[:k])[:k]
                both = np.isin(union, x[:k], assume_unique=True) & np.isin(union, y[:k], assume_unique=True)
                if both.sum() >= least * len(union):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    alike[i] = shared * 100 >= percent * (len(x) + len(y) - shared)
            at = pa.array(np.flatnonzero(alike))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def _values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column, and where each list begins and ends."""
    return col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of the last two columns, sets of values, what just one of them has."""
    for batch in batches:
        *rest, x, y = batch.columns
        (va, oa), (vb, ob) = _values(x), _values(y)
        apart = [np.setxor1d(va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]], assume_unique=True) for i in range(batch.num_rows)]
        made = lists(_signed(np.concatenate(apart)) if apart else np.zeros(0, np.int64), np.array([len(d) for d in apart], np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([*rest, made], names=[*batch.schema.names[:-2], "apart"])


def _shared(rows: np.ndarray, values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values each row of ``x`` shares with each of ``y``: products over the values that both blocks hold; ``values`` belong to ``rows``."""
    number = np.full(max(x.max(), y.max()) + 1, -1)
    sides = []
    for side in (x, y):
        number[:] = -1
        number[side] = np.arange(len(side))
        own = np.isin(rows, side)
        sides.append((number[rows[own]], values[own]))
    known = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(x), len(y)), np.int64)
    for lo in range(0, len(known), COLUMNS):
        some = known[lo:lo + COLUMNS]
        dense = []
        for (at, v), side in zip(sides, (x, y), strict=True):
            col = np.minimum(np.searchsorted(some, v), len(some) - 1)
            held = some[col] == v
            dense.append(np.zeros((len(side), len(some)), np.float32))
            dense[-1][at[held], col[held]] = 1
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _linked(percent: int):
    """(a, b) that join what is linked between two blocks of nodes, or in one, whose differences from one centre are given.

    Two sets differ just where their differences from a third do: in all of both but what these share, twice. Each node is
    joined with the first of those that it can reach within the blocks, so that there are no more rows than nodes.
    """

    def run(block: pa.Table) -> pa.Table:
        i, j = block["i"][0].as_py(), block["j"][0].as_py()
        own, mark, root, n = (block[c].to_numpy() for c in ("block", "mark", "root", "n"))
        values, at = _values(block["apart"].combine_chunks())
        size = np.diff(at)
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        first = np.arange(len(own))
        if len(x) and len(y):
            differ = size[x][:, None] + size[y][None, :] - 2 * _shared(np.repeat(first, size), values[at[0]:at[-1]], x, y)
            alike = (differ * (100 + percent) <= (100 - percent) * (n[x].astype(np.int64)[:, None] + n[y][None, :])) & (root[x][:, None] != root[y][None, :])
            few = alike.any(axis=1)
            x, alike = x[few], alike[few]
            few = alike.any(axis=0)
            y, alike = y[few], alike[:, few]
            was = None
            while len(x) and (was is None or (was != first).any()):
                was = first.copy()
                first[y] = np.minimum(first[y], np.where(alike, first[x][:, None], len(own)).min(axis=0))
                first[x] = np.minimum(first[x], np.where(alike, first[y][None, :], len(own)).min(axis=1))
        moved = np.flatnonzero(first != np.arange(len(own)))
        return pa.table({"a": mark[moved], "b": mark[first[moved]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): the least node that can be reached.

    Each round a node takes the least root among its neighbours', combined before the shuffle so that a node with many
    neighbours is no burden, and then its root's root. Roots only fall, so it ends; each round is checkpointed.
    """
    edges = settled(edges.select("a", "b").union(edges.select("b", "a")))
    parts = max(8, edges.count() // PARTITION_EDGES)
    edges = edges.coalesce(parts)
    roots = settled(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).coalesce(parts))
    while True:
        near = edges.join(roots, edges["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("m"))
        near = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        above = near.select(F.col("node").alias("up"), F.col("root").alias("above"))
        new = settled(near.join(above, near["root"] == above["up"]).select("node", "was", F.least("root", "above").alias("root")).coalesce(parts))
        if new.where("was != root").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: documents linked when the Jaccard similarity of their sets reaches ``similarity``.

    Sets are of lower-cased (A-Z) shingles of ``n_words`` words, as 64-bit hashes; a text with fewer words is one
    shingle, and one without words (or null) has none and is linked with nothing.

    1. One hash function gives the shingles' values; a sketch is the ``k`` least of a set. Equal sets are one node.
    2. Inverted lists hold the nodes that retain a value. A similar pair shares most of its sketch, so it shares many of
       the rarest values of each (as many are looked at as the sketch may lack): this leaves out passages that many
       documents have. Lists are kept of two retained values that are neighbours in the order of rarity, as a lone value
       is met by chance in a large corpus; short sketches are listed by value. A similar pair has 12 or more values
       between some 5 differences to meet in, so that it isn't missed, but for sketches many standard errors off.
    3. Each node is compared with a centre, the node of its lists whose values are the most common: the original of a
       group of edited copies. Components are formed. Of lists that still hold several components, nodes whose values
       that no other node has rule every similar set out are left aside. Nodes of one centre are then compared by
       products of blocks, each pair once however many lists it shares: two sets differ just where their differences
       from the centre do, so the many edited copies of one original, too far from it to be linked, cost a
       product's share each and no row. Nodes of the largest component of a centre only meet the others.
    4. Nodes of several centres are paired by their lists, where the nodes of the list's largest component or of its
       most frequent centre only meet the others; long lists are dealt out in blocks. As a value that no other node has
       is in no other set, sizes and numbers of such values bound what two sets share; two nodes with many such values
       don't even meet. A pair left is dropped by the estimate from the union of the sketches, six standard errors off,
       or else confirmed on full sets.

    component_id is the least id reachable, itself included; kept says whether the id is that one (a repeated id is
    kept each time). Null ids: their row has a component_id only if another id is in its component. No rows: no rows.
    """
    sketched = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("k"), F.col(f"`{text_col}`").alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    sketched = sketched.mapInArrow(_sketches(n_words, k), f"id {id_type}, k bigint, n bigint, mark bigint, sketch array<bigint>")
    ids = settled(sketched.select("id", "n", "mark"))
    nodes = settled(sketched.where("n > 0").groupBy("mark").agg(F.min("id").alias("id"), F.min("k").alias("k"), F.max("sketch").alias("sketch")))

    percent = round(similarity * 100)
    floor = similarity - 6.3 * math.sqrt(similarity * (1 - similarity) / K)
    held = nodes.select("mark", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    sizes = settled(held.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1"))
    common = held.join(sizes, "value").groupBy("mark").agg(F.max("m").alias("m"), F.sum("length").alias("weight"), F.sort_array(F.collect_list(F.struct("length", "value"))).alias("shared"))
    # the rarest m - ceil(floor m) + 1 values must meet; values in one list only come first and meet nothing
    rest = (F.col("m") - F.ceil(F.col("m") * floor) + 1 - (F.col("m") - F.size("shared"))).cast("int")
    common = common.where(rest > 0).withColumn("v", F.transform(F.slice("shared", F.lit(1), rest), lambda x: x["value"]))
    pairs_of = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v")), lambda x, y: F.xxhash64(x, y))
    none = F.array().cast("array<bigint>")
    keys = F.concat(F.when(F.col("m") <= SINGLES_TO, F.col("v")).otherwise(none), F.when((F.col("m") >= PAIRS_FROM) & (F.size("v") > 1), pairs_of).otherwise(none))
    posted = settled(common.select("mark", "weight", F.explode(keys).alias("value")))
    several = posted.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1").select("value")
    posted = settled(posted.join(several, "value", "left_semi"))

    wanted = posted.select("mark").distinct().join(nodes.select("mark", "k"), "mark")
    texts = docs.select(text_key(text_col).alias("k"), F.col(f"`{text_col}`").alias("t")).groupBy("k").agg(F.first("t").alias("t"))
    full = stored(wanted.join(texts, "k").select("mark", "t").mapInArrow(_full_sets(n_words), "mark bigint, full array<bigint>"))

    def with_sets(pairs: DataFrame) -> DataFrame:
        return pairs.join(full.withColumnsRenamed({"mark": "a", "full": "full_a"}), "a").join(full.withColumnsRenamed({"mark": "b", "full": "full_b"}), "b")

    def compared(pairs: DataFrame) -> DataFrame:
        return settled(with_sets(pairs).select("a", "b", "full_a", "full_b").mapInArrow(_compared(similarity, k), "a bigint, b bigint"))

    # a star: each node with the heaviest node of a list, that of most of its lists
    heaviest = settled(posted.groupBy("value").agg(F.max_by("mark", F.struct("weight", "mark")).alias("centre"), F.max("weight").alias("of")))
    stars = posted.join(heaviest, "value").where("mark != centre").groupBy("mark", "centre").agg(F.count(F.lit(1)).alias("times"), F.max("of").alias("of"))
    stars = settled(stars.groupBy("mark").agg(F.max_by("centre", F.struct("times", "of", "centre")).alias("centre")))
    links = compared(stars.select(F.col("mark").alias("a"), F.col("centre").alias("b")))
    roots = components(links)

    # nodes of lists that hold several components, and what they may share with others
    placed = posted.join(roots, posted["mark"] == roots["node"], "left").select("value", "mark", F.coalesce("root", "mark").alias("root"))
    mixed = settled(placed.groupBy("value").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("value"))
    left = settled(placed.join(mixed, "value", "left_semi"))
    here = left.select("mark").distinct()
    some = full.join(here.union(stars.join(here, "mark", "left_semi").select("centre")).distinct(), "mark", "left_semi")
    own = some.select("mark", F.explode("full").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("times"), F.max("mark").alias("mark")).where("times = 1").groupBy("mark").agg(F.count(F.lit(1)).alias("own"))
    bounds = some.select("mark", F.size("full").alias("n")).join(own, "mark", "left").join(stars, "mark", "left").select("mark", "n", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("centre", "mark").alias("centre"))
    bounds = bounds.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)
    left = settled(left.groupBy("mark", "root").agg(F.array_sort(F.collect_set("value")).alias("values")).join(bounds, "mark"))
    most = lambda rows, *of: rows.groupBy(*of).agg(F.count(F.lit(1)).alias("n"))

    # nodes of one centre: blocks of those outside the largest component, from 0, then blocks of that component
    groups = most(left, "centre", "root").groupBy("centre").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    groups = groups.where("most < all").select("centre", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("of"), F.ceil(F.col("most") / BLOCK).alias("to"))
    near = left.join(groups, "centre").select(F.col("mark").alias("a"), F.col("centre").alias("b"), "root", "n", "of", "to", (F.col("root") == F.col("main")).alias("in_main"))
    near = with_sets(near).select(F.col("a").alias("mark"), F.col("b").alias("centre"), "root", "n", "of", "to", "in_main", "full_a", "full_b").mapInArrow(_differences, "mark bigint, centre bigint, root bigint, n int, of bigint, to bigint, in_main boolean, apart array<bigint>")
    dealt = F.xxhash64("mark")
    near = near.withColumn("block", F.when(F.col("in_main"), F.col("of") + F.pmod(dealt, "to")).otherwise(F.pmod(dealt, "of")))
    near = near.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("in_main"), F.col("of")).otherwise(F.col("of") + F.col("to")) - 1)))
    near = near.select("centre", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "mark", "root", "n", "apart")
    near = settled(near.groupBy("centre", "i", "j").applyInArrow(_linked(percent), "a bigint, b bigint"))

    # nodes of several centres: of each list the largest component or centre, and how many blocks its nodes, and the others, make
    listed = left.select(F.explode("values").alias("value"), "mark", "root", "n", "own", "centre", "values")
    listed = settled(listed.withColumn("heavy", F.col("own") * (100 + percent) > F.col("n") * (100 - percent)))
    parted = listed.select("value", F.explode(F.array(F.struct(F.lit(True).alias("by_root"), F.col("root").alias("main")), F.struct(F.lit(False).alias("by_root"), F.col("centre").alias("main")))).alias("main"))
    lists = most(parted, "value", "main").groupBy("value").agg(F.max_by("main", F.struct("n", "main")).alias("main"), (F.sum("n") / 2).cast("long").alias("all"), F.max("n").alias("most"))
    lists = settled(lists.where("most < all").select("value", "main.*", F.ceil(F.col("all") / BLOCK).alias("to"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("of")))
    met = listed.join(lists, "value").withColumn("in_main", F.expr("if(by_root, root, centre) = main"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    one = met.where("NOT in_main").withColumn("i", F.pmod(dealt, "of")).withColumn("j", every(F.col("to")))
    one = one.withColumn("with_heavy", F.explode(F.when(F.col("heavy"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).alias("x")
    two = met.withColumn("j", F.pmod(dealt, "to")).withColumn("i", every(F.col("of"))).alias("y")
    share, either = F.least(F.expr("x.n - x.own"), F.expr("y.n - y.own")), F.greatest(F.expr("x.n + y.own"), F.expr("y.n + x.own"))
    may = (share * 100 >= either * percent) & F.expr("x.mark != y.centre AND y.mark != x.centre")
    once = F.array_min(F.array_intersect("x.values", "y.values")) == F.col("x.value")  # of several lists the first
    block = F.expr("x.value = y.value AND x.i = y.i AND x.j = y.j AND x.with_heavy = y.heavy AND x.root != y.root AND x.centre != y.centre AND (y.in_main OR x.mark < y.mark)")
    pairs = one.join(two, block & may & once)
    far = compared(settled(pairs.select(F.col("x.mark").alias("a"), F.col("y.mark").alias("b"))))
    found = near.union(far)
    if not found.isEmpty():
        roots = components(links.union(found))

    grouped = nodes.select("mark", "id")
    grouped = settled(grouped.join(roots, grouped["mark"] == roots["node"], "left").select("mark", "id", F.coalesce("root", "mark").alias("root")))
    least = settled(grouped.groupBy("root").agg(F.min("id").alias("component_id")))  # from storage, so that the join can split a large component
    grouped = settled(grouped.join(least, "root").select("mark", "component_id"))
    done = ids.join(grouped.withColumnRenamed("mark", "_of"), (F.col("mark") == F.col("_of")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that aren't kept; a row whose id is null stays.

    Rows that share an id stay together: all of them, if one is kept by its own text, and else none.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.groupBy(id_col).agg(F.max("kept").alias("_any")).where(~F.col("_any")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
