"""Vector search by blocks: Arrow batches of rows against a bounded block of query vectors, exact or by codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, ShortType, StructField, StructType

#: Vectors from which the codebooks are learnt, about; all rows are coded.
SAMPLE = 16_384
#: Parts that a vector is cut into, and centres of each part.
PARTS, CENTRES = 16, 64
#: Distances that a task holds at once, about: queries of the block times rows.
HELD = 2_000_000
#: Distances that agree so far count as equal, whatever order a product added them up in.
DIGITS = 12


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and components of the rows of each number of components; rows with a null or non-finite one are left out."""
    offsets, flat = column.offsets.to_numpy().astype(np.int64), column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes, whole = np.diff(offsets), column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[whole]):
        at = np.flatnonzero(whole & (sizes == n))
        rows = flat[offsets[at][:, None] + np.arange(n)].reshape(len(at), n)
        sound = np.isfinite(rows).all(axis=1)
        yield at[sound], rows[sound]


@dataclass
class Cosine:
    """Cosine distances of a block of queries; vectors of length 0 have none."""

    ids: list
    units: np.ndarray

    def distances(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            far = 1.0 - self.units @ unit(rows).T
        return np.where(np.isnan(far), np.inf, np.round(far, DIGITS))

    def of(self, some: set) -> Cosine:
        """The same for some of the queries."""
        at = [i for i, q in enumerate(self.ids) if q in some]
        return Cosine([self.ids[i] for i in at], self.units[at])


@dataclass
class ByCode:
    """Distances of a block of queries to the centres that codes stand for: a look-up for each part."""

    ids: list
    tables: np.ndarray

    def distances(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.int64)
        return sum(self.tables[:, p, codes[:, p]] for p in range(codes.shape[1]))


@dataclass
class Nearest:
    """What can be among the ``limit`` nearest of each query; the bounds shrink from batch to batch of a task."""

    limit: int
    best: dict = field(default_factory=dict)

    def of(self, group: tuple, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of queries and of rows; ``distance`` has a row for each query and columns in order of their keys."""
        seen = np.concatenate([self.best[group], distance], axis=1) if group in self.best else distance
        if seen.shape[1] > self.limit:
            seen = np.partition(seen, self.limit - 1, axis=1)[:, : self.limit]
        self.best[group] = seen
        bound = seen.max(axis=1) if seen.shape[1] == self.limit else np.full(len(distance), np.inf)
        query, row = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance))
        order = np.lexsort((row, distance[query, row], query))  # of many ties those of the least keys
        query, row = query[order], row[order]
        counts = np.bincount(query, minlength=len(distance))
        few = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts) < self.limit
        return query[few], row[few]


def _scanned(batches: Iterator[pa.RecordBatch], scorers: dict, key: str, by: tuple[str, ...], vector: str, limit: int, query_type: pa.DataType, asking: dict[tuple, set] | None = None) -> Iterator[pa.RecordBatch]:
    near, parts = Nearest(limit), {}
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(key)))
        groups = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
        told = batch.select([key, *by])  # without the vectors, as a row can be near to many queries
        for at, rows in matrices(batch.column(vector)):
            scorer = scorers.get(rows.shape[1])
            if scorer is None or not len(at):
                continue
            whole, own = scorer, [groups[i] for i in at]
            for group in dict.fromkeys(own):
                mine, known = np.flatnonzero([g == group for g in own]), (rows.shape[1], group)
                if asking is not None and known not in parts:
                    parts[known] = whole.of(asking.get(group, set()))
                scorer = parts.get(known, whole)
                ids = pa.array(scorer.ids, query_type)
                if not len(ids):
                    continue
                step = max(1, HELD // max(1, len(ids)))
                for part in (mine[lo : lo + step] for lo in range(0, len(mine), step)):
                    distance = scorer.distances(rows[part])
                    query, row = near.of((rows.shape[1], *group), distance)
                    picked = told.take(pa.array(at[part][row]))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), *picked.columns, pa.array(distance[query, row])], ["query_id", key, *by, "distance"])


def nearest(rows: DataFrame, asked: DataFrame, scorers: dict, key: str, by: tuple[str, ...], vector: str, limit: int, asking: dict[tuple, set] | None = None) -> DataFrame:
    """(query_id, key, *by, distance): rows of ``rows`` that can be among the ``limit`` nearest of each query within ``by``.

    ``scorers``, by number of components, hold a block of queries and are broadcast; a task gives some ``limit`` rows a
    query and group, which the caller ranks. ``asking``: the queries that each group is compared with, else all.
    """
    types = {f.name: f.dataType for f in rows.schema}
    query = asked.schema["query_id"].dataType
    out = StructType([StructField("query_id", query), StructField(key, types[key]), *(StructField(c, types[c]) for c in by), StructField("distance", DoubleType())])
    sent, kind = rows.sparkSession.sparkContext.broadcast((scorers, asking)), to_arrow_type(query)
    return rows.select(key, *by, vector).mapInArrow(lambda batches: _scanned(batches, sent.value[0], key, by, vector, limit, kind, sent.value[1]), out)


def block_of(asked: DataFrame, vector: str = "vector") -> dict[int, tuple[list, np.ndarray]]:
    """Ids and vectors of a block of queries, by number of components; the caller bounds the block."""
    held = asked.select("query_id", vector).toArrow()
    out: dict[int, tuple[list, np.ndarray]] = {}
    for batch in held.to_batches():
        ids = batch.column("query_id").to_pylist()
        for at, rows in matrices(batch.column(vector)):
            had = out.get(rows.shape[1], ([], rows[:0]))
            out[rows.shape[1]] = (had[0] + [ids[i] for i in at], np.concatenate([had[1], rows]))
    return out


def cosine_scorers(asked: DataFrame) -> dict[int, Cosine]:
    out = {}
    for n, (ids, rows) in block_of(asked).items():
        told = (rows != 0).any(axis=1)
        out[n] = Cosine([i for i, t in zip(ids, told, strict=True) if t], unit(rows[told]))
    return out


def learn_codebooks(vectors: DataFrame, key: str, vector: str = "embedding", rounds: int = 12) -> list[np.ndarray]:
    """Centres of each part of unit vectors, by k-means over about SAMPLE vectors that a hash of the key picks.

    The most frequent number of components of the sample counts; vectors of others get no code. Without vectors: none.
    """
    n = vectors.count()
    picked = vectors.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // SAMPLE))) == 0).select(F.col(key).alias("query_id"), vector)
    found = block_of(picked, vector)
    if not found:
        return []
    rows = max((v for _, v in found.values()), key=len)
    rows = unit(rows[(rows != 0).any(axis=1)])
    draw = np.random.Generator(np.random.PCG64(11))
    books = []
    for part in np.array_split(np.arange(rows.shape[1]), min(PARTS, rows.shape[1])):
        x = rows[:, part]
        centres = x[draw.permutation(len(x))[:CENTRES]]
        for _ in range(rounds):
            near = _code(x, centres)
            counts = np.bincount(near, minlength=len(centres))
            sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        books.append(centres)
    return books


def _code(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _parts(rows: np.ndarray, books: list[np.ndarray]) -> Iterator[np.ndarray]:
    at = np.cumsum([0, *(b.shape[1] for b in books)])
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield rows[:, lo:hi]


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], key: str, vector: str) -> Iterator[pa.RecordBatch]:
    width = sum(b.shape[1] for b in books)
    for batch in batches:
        for at, rows in matrices(batch.column(vector)):
            if rows.shape[1] != width or not width:
                continue
            told = (rows != 0).any(axis=1)
            rows = unit(rows[told])
            codes = np.stack([_code(x, b) for x, b in zip(_parts(rows, books), books, strict=True)], axis=1).astype(np.int16)
            offsets = np.arange(len(codes) + 1, dtype=np.int32) * len(books)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at[told])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))], [key, "code"])


def coded(vectors: DataFrame, books: list[np.ndarray], key: str, vector: str = "embedding") -> DataFrame:
    """(key, code) of every vector that has as many components as the codebooks: a number for each part; to be stored."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    schema = StructType([StructField(key, vectors.schema[key].dataType), StructField("code", ArrayType(ShortType()))])
    return vectors.select(key, vector).mapInArrow(lambda batches: _coded(batches, sent.value, key, vector), schema)


def code_scorers(asked: DataFrame, books: list[np.ndarray]) -> dict[int, ByCode]:
    """For each query the inner products of its parts with all centres, as distances."""
    width = sum(b.shape[1] for b in books)
    ids, rows = block_of(asked).get(width, ([], np.zeros((0, width))))
    told = (rows != 0).any(axis=1)
    ids, rows = [i for i, t in zip(ids, told, strict=True) if t], unit(rows[told])
    most = max((len(b) for b in books), default=0)
    tables = np.full((len(ids), len(books), most), np.inf)
    for p, (x, b) in enumerate(zip(_parts(rows, books), books, strict=True)):
        tables[:, p, : len(b)] = -x @ b.T
    return {len(books): ByCode(ids, tables)} if ids else {}
