"""Removal of boilerplate lines by the spread of a line over sites, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, free, let, others, settled, stored, words_of

#: Sites from which a line can be boilerplate.
MIN_SITES = 10
#: A text of which spread lines are so many hundredths or more is compared with others by what else it says.
MIXED = 10
#: A text of which they are more hundredths says next to nothing else and bears no witness.
MOSTLY = 85
#: A text between those bounds is a version of another that has so many hundredths of the shingles of its other lines.
ALIKE = 30
#: Words of those shingles.
SHINGLE = 3
#: Estimates within this part of the threshold, in hundredths, are counted exactly; twelve standard errors of the sketch.
BAND = 20
#: Sketches have 2**LG_K registers.
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(text: Column) -> Column:
    """60 bits of a text's digest, which other engines can compute too; null and empty texts share one."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _lines_of_texts(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(line_hash, k, site, chars, total) of each line with a word of each distinct text ``k`` at each of its sites.

    ``chars`` and ``total`` are the lengths of the line and of the text. Copies are combined before the shuffle.
    """
    text = F.col(f"`{text_col}`")
    each = docs.select(_key(text).alias("k"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0null")).alias("site"), F.length(text).cast("long").alias("total"), F.explode(_lines(text)).alias("line"))
    each = each.where(F.col("line").rlike(WORD)).select(F.xxhash64("line").alias("line_hash"), "k", "site", F.length("line").cast("long").alias("chars"), "total")
    return each.groupBy("line_hash", "k", "site").agg(F.max("chars").alias("chars"), F.max("total").alias("total"))


def widespread(rows: DataFrame, min_sites: int) -> DataFrame:
    """``line_hash`` of the lines of ``rows`` (line_hash, site) at ``min_sites`` sites or more.

    A HyperLogLog sketch for each line, merged by aggregation; lines clearly below the threshold end there, those
    clearly above it pass, and those near it get exact distinct counts, in two steps that combine before the shuffle.
    """
    sketches = rows.groupBy("line_hash").agg(F.hll_sketch_agg("site", LG_K).alias("sites"))
    guess = sketches.select("line_hash", F.hll_sketch_estimate("sites").alias("sites"))
    guess = stored(guess.where(F.col("sites") >= min_sites * (1 - BAND / 100)))  # as files, so that Spark knows how small it is
    sure = F.col("sites") >= min_sites * (1 + BAND / 100)
    near = rows.join(guess.where(~sure).select("line_hash"), "line_hash", "left_semi").select("line_hash", "site").distinct()
    counted = near.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return stored(guess.where(sure).select("line_hash").union(counted.select("line_hash")))


def _shingles(text: Column) -> Column:
    steps = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")))
    short = lambda w: F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return let(words_of(text), lambda w: F.when(F.size(w) >= SHINGLE, steps(w)).otherwise(short(w)))


def _said(docs: DataFrame, text_col: str, placed: DataFrame) -> DataFrame:
    """(k, whole, s): the distinct shingles of what the texts of ``placed`` (line_hash, k, c) say besides those lines, and
    (whole) all shingles of the texts that others are compared with."""
    text = F.col(f"`{text_col}`")
    spread = placed.groupBy("k").agg(F.collect_list("line_hash").alias("spread"))  # no more than the text's own lines
    firsts = placed.select(F.col("c").alias("k"), F.lit(True).alias("first")).distinct()
    texts = docs.select(_key(text).alias("k"), text.alias("text")).join(spread.join(firsts, "k", "left"), "k")
    rest = F.array_join(F.filter(_lines(F.col("text")), lambda line: ~F.array_contains("spread", F.xxhash64(line))), "\n")
    tagged = lambda shingles, whole: F.transform(shingles, lambda s: F.struct(F.lit(whole).alias("whole"), s.alias("s")))
    both = F.concat(tagged(_shingles(rest), False), F.when(F.col("first"), tagged(_shingles(F.col("text")), True)).otherwise(F.array().cast("array<struct<whole:boolean,s:bigint>>")))
    return texts.select("k", F.explode(both).alias("x")).select("k", "x.whole", "x.s").distinct()


def _apart(docs: DataFrame, text_col: str, held: DataFrame) -> DataFrame:
    """``line_hash`` of the rows of ``held`` (line_hash, k) but those whose text is a version of the least text with the line."""
    placed = stored(held.join(held.groupBy("line_hash").agg(F.min("k").alias("c")), "line_hash").select("line_hash", "k", "c"))
    said = stored(_said(docs, text_col, placed))
    own = said.where(~F.col("whole")).select("k", "s")
    sizes = stored(own.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    pairs = placed.where("k <> c").select("k", "c").distinct()
    common = pairs.join(own, "k").join(said.where("whole").select(F.col("k").alias("c"), "s"), ["c", "s"]).groupBy("k", "c").agg(F.count(F.lit(1)).alias("both"))
    versions = common.join(sizes, "k").where(F.col("both") * 100 >= ALIKE * F.col("n")).select("k", "c")
    return placed.join(sizes.select("k"), "k", "left_semi").join(versions, ["k", "c"], "left_anti").select("line_hash")


def _spread_among(docs: DataFrame, each: DataFrame, text_col: str, min_sites: int) -> DataFrame:
    """``line_hash`` of the boilerplate lines among ``each``, the lines of ``docs``."""
    spread = widespread(each, min_sites)
    held = stored(each.join(spread, "line_hash", "left_semi").groupBy("line_hash", "k").agg(F.max("chars").alias("chars"), F.max("total").alias("total")))
    bodies = held.groupBy("k").agg(F.sum("chars").alias("chars"), F.max("total").alias("total"))
    mixed = stored(bodies.where(F.col("chars") * 100 >= F.col("total") * MIXED).select("k", (F.col("chars") * 100 > F.col("total") * MOSTLY).alias("mostly")))
    compared = stored(held.join(mixed.where(~F.col("mostly")), "k", "left_semi").select("line_hash", "k"))
    witnesses = held.join(mixed, "k", "left_anti").select("line_hash").union(_apart(docs, text_col, compared))
    return stored(witnesses.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line_hash"))


def line_spread(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``line_hash`` of each boilerplate line: ``min_sites`` sites and as many texts have it, versions of one text counted once.

    Sites are counted over all pairs of a line and a site. Then texts bear witness: a document copied unchanged is one
    text. Of texts with a good part (MIXED) of such lines, those whose other lines are for the most part (ALIKE) in the
    line's first text too are versions of it and count once with it; those with hardly another line (MOSTLY) don't
    count. So lines go from short pages and from pages that share a site, in blocks too, and lines of copied and edited
    documents stay. A null site is a site; lines without a word don't count.
    """
    return _spread_among(docs, stored(_lines_of_texts(docs, text_col, site_col)), text_col, min_sites)


def drop_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Every row of ``docs`` with its boilerplate lines cut out of the text; adds n_lines and n_lines_removed.

    Lines are the parts between ``\\n``; only lines with a word are removed, from all texts that have them, and the rest
    stay as they were, joined by ``\\n``. A null text stays null, with one line and none removed; an empty one stays
    empty. Other columns, repeated rows and ties need no care: the spread counts distinct sites and texts. No rows: no
    rows. Columns n_lines and n_lines_removed of the input, in any case, are replaced. Lines and shingles are compared by
    64-bit hashes, texts by 60 bits.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in others(docs, "n_lines", "n_lines_removed")])
    key, bad, lines, kept = free(docs, "_k", "_bad", "_lines", "_kept")
    each = stored(_lines_of_texts(docs, text_col, site_col))
    found = each.join(_spread_among(docs, each, text_col, min_sites), "line_hash", "left_semi").select("line_hash", "k").distinct().groupBy("k").agg(F.collect_list("line_hash").alias(bad))
    found = settled(found.withColumnRenamed("k", key))  # from storage, so that the join can split the rows of a text with very many copies
    joined = docs.withColumn(key, _key(F.col(f"`{text_col}`"))).join(found, key, "left").withColumn(lines, _lines(F.col(f"`{text_col}`")))
    stay = F.when(F.col(bad).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda line: ~(F.array_contains(bad, F.xxhash64(line)) & line.rlike(WORD))))
    joined = joined.withColumn(kept, stay)
    out = [F.when(F.col(f"`{text_col}`").isNotNull(), F.array_join(kept, "\n")).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*out, F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_lines_removed"))
