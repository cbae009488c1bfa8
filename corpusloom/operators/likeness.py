"""Pairs of short texts that are alike in their characters: a join by rare character pairs, then exact scores by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.durable import settled

SLACK = 1e-6
#: Texts of more characters together are joined by one rare gram, as their pairs of grams would be many.
LONG = 128
#: Numbers in a table of places at once: pairs times different letters.
TABLE = 1 << 21


def common_lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, the columns of its table held as bits.

    A cleared bit is a place of x at which the length grows; a character of y moves it by one addition. Texts of up to 64
    characters go side by side in 64-bit words, longer ones one by one in integers of any length.
    """
    out = np.zeros(len(xs), dtype=np.int64)
    short = np.array([0 < len(x) <= 64 and 0 < len(y) <= 64 for x, y in zip(xs, ys)], dtype=bool)
    for i in np.flatnonzero(~short):
        x, y = xs[i], ys[i]
        places: dict[str, int] = {}
        for k, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << k
        full = (1 << len(x)) - 1
        row = full
        for c in y:
            met = row & places.get(c, 0)
            row = (row + met | row - met) & full
        out[i] = len(x) - row.bit_count()
    at = np.flatnonzero(short)
    if len(at):
        letters, codes = np.unique(_codes([xs[i] for i in at] + [ys[i] for i in at]), return_inverse=True)
        codes = codes.reshape(2 * len(at), -1)
        step = max(1, TABLE // len(letters))
        for begin in range(0, len(at), step):
            some = at[begin : begin + step]
            out[some] = _grown(codes[begin : begin + len(some)], codes[len(at) + begin : len(at) + begin + len(some)], letters)
    return out


def _grown(a: np.ndarray, b: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Common lengths of pairs side by side, texts as numbers of ``letters``; the letter 0 is a text's end and meets nothing."""
    pair = np.arange(len(a))
    places = np.zeros((len(a), len(letters)), dtype=np.uint64)
    for k in range(min(64, a.shape[1])):
        places[pair, a[:, k]] |= np.uint64(1 << k)
    places[:, letters == 0] = 0
    row = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(b.shape[1]):
        met = row & places[pair, b[:, j]]
        row = (row + met) | (row - met)
    return np.bitwise_count(~row)


def _codes(texts: list[str]) -> np.ndarray:
    """One text a row as code points, counted from 1; 0 where a text has ended."""
    out = np.zeros((len(texts), max(map(len, texts))), dtype=np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + 1
    return out


@F.pandas_udf(DoubleType())
def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
    """0 to 100: 200 * common / both lengths; two empty texts are the same."""
    both = x.str.len().to_numpy(dtype=np.float64) + y.str.len().to_numpy(dtype=np.float64)
    common = common_lengths(list(x), list(y))
    return pd.Series(np.where(both == 0, 100.0, 200.0 * common / np.maximum(both, 1)))


def _needed(q, both: Column, least: float) -> Column:
    """Grams of ``q`` characters that texts of so many characters together share at least, if they score ``least``.

    Of n - q + 1 grams of a text a character left out spoils q, one put in q - 1; n and m less what is common are the
    characters to leave out and to put in.
    """
    share = (2 * q - 1) * (least / 200) - (q - 1)
    return F.ceil(both * share - (q - 1) - SLACK)


def _grams(texts: DataFrame, least: float) -> DataFrame:
    """(x, q, gram, pos): the pairs of characters of each text and, of short texts, its characters."""
    n = F.length("x")
    cut = lambda q: F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.struct(F.substring(F.col("x"), i, F.lit(q)).alias("gram"), i.alias("pos")))
    of = texts.where("x <> ''").distinct()
    two = of.where(n > 1).select("x", F.lit(2).alias("q"), F.inline(cut(2)))
    return two.union(of.where(_needed(2, n + _lowest(n, least), least) < 2).select("x", F.lit(1).alias("q"), F.inline(cut(1))))


def _lowest(n: Column, least: float) -> Column:
    """The fewest characters of a partner of a text of ``n``."""
    return F.greatest(F.lit(1), F.ceil(n * (least / (200 - least)) - SLACK))


def _keys(grams: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """(kind, key, x, n, lo, hi, turned, left): what texts are joined by; ``left``: grams after the key's last, in order of rarity."""
    each = settled(grams.join(often, ["q", "gram"]).groupBy("x", "q").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "pos"))).alias("gs")))
    each = each.withColumn("n", F.length("x")).withColumn("size", F.size("gs"))
    both = F.col("n") + _lowest(F.col("n"), least)
    highest = F.col("n") + F.floor(F.col("n") * ((200 - least) / least) + SLACK)
    rarest = lambda fewest, more: F.slice("gs", 1, F.greatest(F.col("size") - fewest + more, F.lit(0)).cast("int"))
    of = lambda kind, key, a, b, at: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.least(a["pos"], b["pos"]).alias("lo"), F.greatest(a["pos"], b["pos"]).alias("hi"), (a["pos"] > b["pos"]).alias("turned"), (F.col("size") - at).alias("left"))
    alone = lambda kind: lambda g, i: of(kind, F.xxhash64(g["gram"]), g, g, i + 1)
    beside = lambda g, i: F.transform(F.slice("some", i + 2, F.size("some")), lambda h, j: of(0, F.xxhash64(g["gram"], h["gram"]), g, h, i + j + 2))
    pairs = each.where((F.col("q") == 2) & (both <= LONG)).withColumn("some", rarest(F.greatest(_needed(2, both, least), F.lit(2)), 2))
    pairs = pairs.select("x", "n", F.explode(F.flatten(F.transform("some", beside))).alias("k"))
    long = each.where((F.col("q") == 2) & (highest > LONG))
    long = long.select("x", "n", F.explode(F.transform(rarest(F.greatest(_needed(2, F.greatest(both, F.lit(LONG + 1)), least), F.lit(2)), 1), alone(1))).alias("k"))
    short = each.where("q = 1").select("x", "n", F.explode(F.transform(rarest(F.greatest(_needed(1, both, least), F.lit(1)), 1), alone(2))).alias("k"))
    return pairs.union(long).union(short).select("x", "n", "k.*")


def candidates(texts: DataFrame, least: float, others: DataFrame | None = None) -> DataFrame:
    """(x, y): distinct pairs of texts, unequal and not empty, that may score ``least``; none that does is missing.

    ``texts`` and ``others`` have a column ``x``; without ``others`` each pair of ``texts`` comes once, x < y. Grams that
    an alignment keeps whole have the same order in both texts, by rarity, then by place. Of texts that must share t of s
    grams, the first that they share is among the rarest s - t + 1, the second among s - t + 2: so texts are joined by two
    of their rarest grams, or by one if they are long (LONG characters together), or by single characters if they are too
    short to share two grams. Of what is joined only those pairs go on whose grams lie so that few enough characters come
    and go before, between and after them.
    """
    a = _grams(texts.select("x"), least)
    b = a if others is None else _grams(others.select("x"), least)
    often = (a if others is None else a.union(b)).groupBy("q", "gram").agg(F.count(F.lit(1)).alias("often"))
    left = _keys(a, often, least)
    right = (left if others is None else _keys(b, often, least)).select("kind", "key", F.col("x").alias("y"), F.col("n").alias("m"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("turned").alias("turned2"), F.col("left").alias("left2"))
    both = F.col("n") + F.col("m")
    two = _needed(2, both, least)
    kind = F.when(two < 2, 2).when(both <= LONG, 0).otherwise(1)
    enough = F.least("left", "left2") + F.when(F.col("kind") == 0, 2).otherwise(1) >= F.when(F.col("kind") == 2, _needed(1, both, least)).otherwise(two)
    change = F.abs(F.expr("lo - lo2")) + F.abs(F.expr("(hi - lo) - (hi2 - lo2)")) + F.abs(F.expr("(n - hi) - (m - hi2)"))
    near = (change <= both - 2 * F.ceil(both * (least / 200) - SLACK)) & F.expr("turned = turned2")
    order = F.col("x") < F.col("y") if others is None else F.col("x") != F.col("y")
    # sorted and merged, never broadcast: the keys' number is known when they are made, and shared keys are split as skew
    return left.join(right.hint("merge"), ["kind", "key"]).where((F.col("kind") == kind) & near & enough & order).select("x", "y").distinct()


def alike(texts: DataFrame, least: float, others: DataFrame | None = None) -> DataFrame:
    """(x, y, score): the pairs of ``candidates`` that score ``least`` or more."""
    return candidates(texts, least, others).withColumn("score", likeness("x", "y")).where(F.col("score") >= least)
