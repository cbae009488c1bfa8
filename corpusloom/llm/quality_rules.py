"""Quality rules whose thresholds come from quantile sketches of each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import WORD, free, let, others, settled, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents that a language and source need for thresholds of their own; below, those of the language hold, then those of all.
MIN_GROUP = 100
#: Values below this are kept exactly; above, each power of two has half as many buckets.
EXACT = 128
#: A value is rejected beyond the upper (lower) quartile by so many distances between the quartiles ...
FENCE = 6
#: ... of which each is this long at least, in thousandths.
LEAST_SPREAD = {"word_length": 300, "symbol_rate": 30, "line_rate": 100, "repeat_rate": 40}
#: Measures with a lower fence as well.
TWO_SIDED = ("word_length",)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of the whole text.

    Repeats of 3-word windows are found by sorting the windows of a document by a 64-bit hash of their words, in the
    row: neighbours with the same hash are repeats. A null text has no words; so has an empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    (own,) = free(docs, "_w")
    held = docs.withColumn(own, words_of(text_col))

    def windows(w: Column) -> Column:
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>"))

    def repeated(s: Column) -> Column:
        # s: windows in order of hash; the places of those that equal a neighbour, in order of place
        last = F.size(s) - 1
        same = F.filter(s, lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == x["h"])))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        # three words each, less what the next repeated window covers too
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])

    repeat = let(F.col(own), lambda w: let(F.sort_array(windows(w)), lambda s: covered(repeated(s))))
    lines = let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return held.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(own).cast("long").alias("n_words"), F.length(F.array_join(own, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"), repeat.cast("long").alias("n_repeat_words"),
    )


def rates(n: dict[str, Column]) -> dict[str, Column]:
    """Whole numbers, so that engines agree: thousandths of a letter a word, and counts in a thousand words."""
    words = F.greatest(n["n_words"], F.lit(1))
    each = {"word_length": n["word_chars"], "symbol_rate": n["n_symbols"], "line_rate": n["n_dup_lines"] * 10, "repeat_rate": n["n_repeat_words"]}
    return {k: F.floor(v * 1000 / words).cast("long") for k, v in each.items()}


def bucket(value: Column) -> Column:
    """The least value of the sketch's bucket: values below EXACT as they are, others to EXACT / 2 steps a power of two."""
    digits = EXACT.bit_length() - 1
    step = F.expr("1L") * F.pow(F.lit(2.0), F.length(F.bin(value)) - digits).cast("long")
    return F.when(value < EXACT, value).otherwise(F.floor(value / step).cast("long") * step)


def sketch(rated: DataFrame, keys: list[str]) -> DataFrame:
    """A quantile sketch of each measure of each group: bucket and count. Sketches of parts merge by adding counts."""
    tall = rated.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in LEAST_SPREAD))).alias("x"))
    return tall.groupBy(*keys, "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """low and high of each measure of each group, a row a group; and the group's rows."""
    group = [*keys, "measure"]
    order = Window.partitionBy(*group).orderBy("bucket")
    ranked = sketched.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy(*group))})
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    cut = ranked.groupBy(*group).agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))
    least = F.create_map(*(F.lit(x) for kv in LEAST_SPREAD.items() for x in kv))
    reach = F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")]) * FENCE
    cut = cut.select(*group, "total", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    ends = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in LEAST_SPREAD for side in ("low", "high")]
    return cut.groupBy(*keys).agg(F.max("total").alias("group_rows"), *ends)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A verdict on every row: the measures, base_failed, the fences that held and kept; the text itself isn't carried.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT of them in repeated windows. Of the others
    a row is kept if no rate lies beyond the fences of its language and source. Fences are quartiles widened by FENCE
    spreads; the quartiles come from sketches (counts of value buckets) built once for each language and source and
    merged upwards, by adding, for languages and for all; a group of fewer than MIN_GROUP rows uses the next one up.
    Null languages or sources are groups of their own. Empty and null texts have no words, so base_failed. A group whose
    rows all are the same is kept. No rows: no rows. Columns of the input with the names of results, in any case, are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fence_of"]
    rest = others(docs, *made, *LEAST_SPREAD, text_col)
    inner = {c: f"_{i}_column" for i, c in enumerate(rest)}  # under other names until the end, so that none clashes
    base = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()], F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{source_col}`").alias("_source"), F.col(f"`{text_col}`").alias("_text"))
    base = measures(base, "_text").drop("_text")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    rated = settled(base.withColumns(rates({c: F.col(c) for c in made[:5]})))

    usable = rated.where(~F.col("base_failed"))
    fine = settled(sketch(usable, ["_lang", "_source"]))
    by_lang = fine.groupBy("_lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    own, of_lang, of_all = (fences(s, k) for s, k in ((fine, ["_lang", "_source"]), (by_lang, ["_lang"]), (by_all, [])))
    own, of_lang = own.where(F.col("group_rows") >= MIN_GROUP), of_lang.where(F.col("group_rows") >= MIN_GROUP)

    def pack(f: DataFrame, name: str, keys: list[str]) -> DataFrame:
        return f.select(*(F.col(k).alias(f"{k}_") for k in keys), F.struct(*(c for c in f.columns if c not in (*keys, "group_rows"))).alias(name))

    groups = rated.select("_lang", "_source").distinct()
    limits = groups.join(pack(own, "own", ["_lang", "_source"]), F.col("_lang").eqNullSafe(F.col("_lang_")) & F.col("_source").eqNullSafe(F.col("_source_")), "left").drop("_lang_", "_source_")
    limits = limits.join(pack(of_lang, "by_lang", ["_lang"]), F.col("_lang").eqNullSafe(F.col("_lang_")), "left").drop("_lang_")
    limits = limits.crossJoin(F.broadcast(pack(of_all, "by_all", [])))  # one row
    limits = limits.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), F.coalesce("own", "by_lang", "by_all").alias("_limit"),
                           F.when(F.col("own").isNotNull(), "source").when(F.col("by_lang").isNotNull(), "lang").otherwise("all").alias("fence_of"))
    joined = rated.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    beyond = F.lit(False)
    for m in LEAST_SPREAD:
        beyond = beyond | (F.col(m) > F.col("_limit")[f"{m}_high"])
        if m in TWO_SIDED:
            beyond = beyond | (F.col(m) < F.col("_limit")[f"{m}_low"])
    kept = ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))
    return joined.select(*[F.col(x).alias(c) for c, x in inner.items()], *made[:5], "base_failed", kept.alias("kept"), "fence_of")
