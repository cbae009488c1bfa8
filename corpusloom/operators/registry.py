"""Registries of canonical names: normalising, fuzzy matching, clustering into a registry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sort_tokens, squeeze
from ..sources.durable import settled
from .likeness import alike
from .mentions import occurrences

ACT_SCORE, JUDGE_SCORE = 85, 82
ABSORB, FOLD = 88, 90


def act_key(c: Column) -> Column:
    """Lower case, without ``the``, commas, brackets and dots."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*the\s+", ""), r"[.,()\[\]]", " "))


def judge_key(c: Column) -> Column:
    """Lower case, without honours before and titles after the name."""
    k = F.regexp_replace(F.lower(c), r"\b(hon'?ble|mr\.?|mrs\.?|ms\.?|dr\.?|justice|smt\.?)\s+", "")
    return squeeze(F.regexp_replace(F.regexp_replace(k, r",?\s*\b(c\.?j\.?i?|jj?)\.?\s*$", ""), r"[.,]", " "))


def _spelt(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``x``: the lower-case words of ``text`` in order, which likeness compares; rows without a text are left out."""
    return df.withColumn("x", sort_tokens(F.col(text))).where("x IS NOT NULL")


def _scored(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(x, y, score): the spellings of ``a`` and ``b`` that are alike by ``least``, equal ones among them."""
    xs, ys = a.select("x").distinct(), b.select("x").distinct()
    return xs.join(ys, "x").select("x", F.col("x").alias("y"), F.lit(100.0).alias("score")).union(alike(xs, least, ys))


def matched(names: DataFrame, registry: DataFrame, key, least: float, keep: bool = True) -> DataFrame:
    """(name, canonical, score): the registry entry most like each distinct name, if it scores ``least`` or more.

    Exact keys are joined; the rest is compared with the entries that share enough of its rare pairs of letters.
    The score is token order's likeness, 0 to 100; ties go to the least key. ``keep``: names without a match
    stand for themselves, else they are left out.
    """
    n = names.select("name").distinct().withColumn("key", key(F.col("name")))
    r = registry.select(F.col("key").alias("rkey"), "canonical")
    exact = n.join(r, n["key"] == r["rkey"]).select("name", "canonical", F.lit(100.0).alias("score"))
    rest = n.join(exact.select("name"), "name", "left_anti")
    rest, entries = settled(_spelt(rest, "key")), settled(_spelt(r, "rkey"))
    scored = rest.join(_scored(rest, entries, least), "x").join(entries.select(F.col("x").alias("y"), "rkey", "canonical"), "y")
    best = scored.groupBy("name").agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), F.col("rkey"), F.col("canonical"))).alias("b")).select("name", "b.canonical", F.round("b.score", 3).alias("score"))
    found = exact.union(best)
    if not keep:
        return found
    return n.select("name").join(found, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"), "score")


def normalised_lists(rows: DataFrame, id_col: str, list_col: str, matches: DataFrame) -> DataFrame:
    """(id, values, unmatched): each row's names in canonical form, once each in order, and those not found."""
    e = rows.select(id_col, F.posexplode(list_col).alias("pos", "name")).join(matches, "name", "left")
    g = e.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical", "name").alias("v"), F.col("score").isNull().alias("u"), "name"))).alias("xs"))
    return g.select(id_col, F.array_distinct(F.transform("xs", lambda x: x["v"])).alias("values"), F.transform(F.filter("xs", lambda x: x["u"]), lambda x: x["name"]).alias("unmatched"))


def likely_pairs(names: DataFrame, least: float = ABSORB) -> DataFrame:
    """(a, b, score) of distinct names that are alike, of all pairs; each pair once, a < b."""
    n = settled(_spelt(names.select("name").distinct(), "name"))
    a, b = n.select("x", F.col("name").alias("a")), n.select(F.col("x").alias("y"), F.col("name").alias("b"))
    far = alike(n, least).join(a, "x").join(b, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    return far.union(a.join(b.withColumnRenamed("y", "x"), "x").where("a < b").select("a", "b", F.lit(100.0).alias("score")))


def clusters(names: DataFrame, least: float = ABSORB) -> DataFrame:
    """(canonical, name): the longest name first takes all names like it that are free; ties by name.

    Names linked by likeness form blocks, and a block is one group: the order matters only within one. Registries hold
    thousands of names, and a block a few.
    """
    edges = likely_pairs(names, least)
    both = settled(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    block = settled(names.select("name").distinct().withColumn("block", F.col("name")))
    while True:  # the least name of a block, some rounds as blocks are small
        near = both.join(block, both["b"] == block["name"]).groupBy("a").agg(F.min("block").alias("m"))
        new = settled(block.join(near, block["name"] == near["a"], "left").select("name", "block", F.least("block", "m").alias("next")))
        done = new.where("next < block").isEmpty()
        block = new.select("name", F.col("next").alias("block"))
        if done:
            break
    linked = block.join(both.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("near")), F.col("name") == F.col("a"), "left").select("block", "name", F.coalesce("near", F.array().cast("array<string>")).alias("near"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {r["name"]: set(r["near"]) for _, r in pdf.iterrows()}
        taken, out = set(), []
        for name in sorted(near, key=lambda x: (-len(x), x)):
            if name in taken:
                continue
            own = [name, *sorted(x for x in near[name] if x not in taken and x != name)]
            taken.update(own)
            out += [(name, x) for x in own]
        return pd.DataFrame(out, columns=["canonical", "name"])

    return linked.groupBy("block").applyInPandas(greedy, "canonical string, name string")


def folded(clustered: DataFrame, standing: DataFrame, least: float = FOLD) -> DataFrame:
    """(canonical, aliases): the registry ``standing`` (pos, canonical, aliases) grown by ``clustered`` (canonical, name).

    A cluster whose canonical name is like one of the registry by ``least`` or more goes to the first such entry in order
    of ``pos``, all its names but that entry's own as aliases; any other cluster becomes an entry. Clusters' canonical
    names are apart from each other, so none has to wait for another. Standing aliases are kept, each once, in order.
    """
    entries = standing.select("pos", F.col("canonical").alias("entry"), "aliases")
    reps = clustered.select(F.col("canonical").alias("rep")).distinct()
    reps, kept = settled(_spelt(reps, "rep")), settled(_spelt(entries.select("pos", "entry"), "entry"))
    pairs = reps.join(_scored(reps, kept, least), "x").join(kept.select(F.col("x").alias("y"), "pos", "entry"), "y")
    near = pairs.groupBy("rep").agg(F.min_by("entry", "pos").alias("entry"))
    placed = clustered.withColumnRenamed("canonical", "rep").join(near, "rep", "left").select(F.coalesce("entry", "rep").alias("canonical"), "name")
    told = entries.select(F.col("entry").alias("canonical"), F.explode_outer("aliases").alias("name"))
    both = told.union(placed).groupBy("canonical").agg(F.collect_set("name").alias("names"))
    return both.select("canonical", F.array_sort(F.filter("names", lambda n: n != F.col("canonical"))).alias("aliases"))


def merged(scraped: DataFrame, seed: DataFrame) -> DataFrame:
    """(canonical, aliases): both registries by key; the seed's spelling wins, aliases of both are kept in order."""
    a = scraped.select(act_key(F.col("canonical")).alias("key"), F.col("canonical").alias("c1"), F.col("aliases").alias("a1"))
    b = seed.select(act_key(F.col("canonical")).alias("key"), F.col("canonical").alias("c2"), F.col("aliases").alias("a2"))
    none = F.array().cast("array<string>")
    return a.join(b, "key", "full_outer").select(F.coalesce("c2", "c1").alias("canonical"), F.array_sort(F.array_distinct(F.concat(F.coalesce("a2", none), F.coalesce("a1", none)))).alias("aliases"))


def mentions(texts: DataFrame, aliases: DataFrame, short: int = 8) -> DataFrame:
    """(text_id, alias) of aliases in texts; short ones as whole words only. Texts meet blocks of aliases, each in one pass."""
    hits = occurrences(texts, aliases.select(F.col("alias").alias("name")), "text_id", short=short)
    return hits.join(aliases.withColumn("name", F.lower("alias")), "name").select("text_id", "alias")


def is_clean_judge(c: Column) -> Column:
    """Whether a registry's name can be a person's: six letters and two words at least, no number first, no ``and`` run into a name."""
    name = F.trim(c)
    return (F.length(name) >= 6) & (F.size(F.split(name, r"\s+")) >= 2) & ~name.rlike(r"\band(?=[A-Z])") & ~name.rlike(r"^\d")


def search_names(judges: DataFrame, acts: DataFrame) -> DataFrame:
    """(alias, canonical) for questions: of both registries (canonical, aliases) each name and alias, without judges' names that can't be names."""
    both = judges.where(is_clean_judge(F.col("canonical"))).select("canonical", "aliases").union(acts.select("canonical", "aliases"))
    return both.select(F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"), "canonical")


def write_registry(entries: DataFrame, path: str) -> None:
    """A registry (canonical, aliases) as JSON, an entry a line in order of name, as ``registry`` of the sources reads it by lines."""
    entries.select("canonical", "aliases").orderBy("canonical").write.mode("overwrite").json(path)
