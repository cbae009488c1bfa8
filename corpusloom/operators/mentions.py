"""Many names in many texts: one pass over each text for a block of names, whatever their number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..sources.durable import settled

#: Characters of the names that go to the tasks at once; more names take more passes over the texts.
BLOCK = 1 << 21
#: Names of so many characters are sought as whole words only.
SHORT = 8


def spaced(text: Column) -> Column:
    """Lower case, each character that is neither letter nor digit a blank, one blank more at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "), F.lit(" "))


def squeezed(text: Column) -> Column:
    """As ``spaced``, runs of blanks as one."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def _automaton(names: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def _first(automaton, text: str) -> dict[str, int]:
    """Where each name begins first, from 1."""
    out: dict[str, int] = {}
    if len(automaton):
        for end, name in automaton.iter(text):
            out.setdefault(name, end - len(name) + 2)
    return out


def _seeker(names: list[str], short: int):
    """A function over Arrow batches (key, whole, low): the names that each text has and where."""

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = _automaton([f" {n} " for n in names if len(n) <= short]), _automaton([n for n in names if len(n) > short])
        for batch in batches:
            rows, found, at = [], [], []
            for i, (whole, low) in enumerate(zip(batch.column(1), batch.column(2))):
                hits = [(name[1:-1], p) for name, p in _first(words, whole.as_py()).items()] + list(_first(parts, low.as_py()).items())
                rows += [i] * len(hits)
                found += [n for n, _ in hits]
                at += [p for _, p in hits]
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string()), pa.array(at, pa.int32())], names=["key", "name", "at"])

    return seek


def occurrences(texts: DataFrame, names: DataFrame, key: str, text: str = "text", short: int = SHORT, whole=squeezed, block: int = BLOCK) -> DataFrame:
    """(key, name, at): each lower-case name that a text has, once, and where it begins first, from 1.

    ``names`` has a column ``name``. Names of up to ``short`` characters count as whole words of ``whole(text)``, and
    ``at`` is a place there but for the blank before; longer ones count anywhere in the lower-case text. A block of names
    is one automaton in each task, so a text is read once for a block, however many names that holds. Null texts
    and null or empty names have no hits; texts with equal keys are sought one by one.
    """
    n = settled(names.select(F.lower("name").alias("name")).where("name <> ''").distinct())
    n_blocks = max(1, -(-(n.agg(F.sum(F.length("name"))).first()[0] or 0) // block))
    source = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), whole(F.col(text)).alias("whole"), F.lower(text).alias("low"))
    out = StructType([StructField("key", source.schema["key"].dataType), StructField("name", StringType()), StructField("at", IntegerType())])
    found = None
    for b in range(n_blocks):
        own = n.where(F.pmod(F.xxhash64("name"), F.lit(n_blocks)) == b) if n_blocks > 1 else n
        hits = source.mapInArrow(_seeker([r["name"] for r in own.collect()], short), out)
        found = hits if found is None else found.union(hits)
    return found.withColumnRenamed("key", key)
