"""Lookups by identifier, files of cases, and small steps on answers."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_link
from .filters import SC

#: Suffixes by which a file is looked for, in order: as named, with its type, with language and type.
FILE_RULES = ("", ".pdf", "_EN.pdf")
NEWEST = 3


def identified(specs: DataFrame, cases: DataFrame, most: int = NEWEST) -> DataFrame:
    """(spec_id, source_table, id, rule) of the cases that each spec names: a pinned key, else a citation, else a title.

    ``specs``: spec_id, source_table, id, citation, title; what isn't given is null. Keys and citations are equi-joins;
    only specs with a title of three letters or more and nothing better meet the cases one by one, and of a question
    there are a few. Of each register the newest ``most``; a case that two specs name goes to the first.
    """
    s, c = specs.alias("s"), cases.select("source_table", "id", "citation", "legacy_citation", "title", "petitioner", "respondent", "decision_date").alias("c")

    def hits(condition: Column, rule: int, of: DataFrame = s) -> DataFrame:
        return of.join(c, condition).select("s.spec_id", "c.source_table", "c.id", "c.decision_date", F.lit(rule).alias("rule"))

    like = reduce(lambda a, b: a | b, (F.expr(f"c.{k} ILIKE concat('%', trim(s.title), '%')") for k in ("title", "petitioner", "respondent")))
    titled = specs.where("length(trim(title)) >= 3").alias("s")
    found = hits((F.col("s.source_table") == F.col("c.source_table")) & (F.col("s.id") == F.col("c.id")), 0)
    found = found.union(hits(F.trim("s.citation") == F.col("c.citation"), 1))
    found = found.union(hits((F.trim("s.citation") == F.col("c.legacy_citation")) & (F.col("c.source_table") == SC), 2)).union(hits(like, 3, titled))
    best = found.withColumn("_best", F.min("rule").over(Window.partitionBy("spec_id"))).where("rule = _best")
    newest = Window.partitionBy("spec_id", "source_table").orderBy(F.desc_nulls_last("decision_date"), "id")
    best = best.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    return best.groupBy("source_table", "id").agg(F.min(F.struct("spec_id", "rule")).alias("_s")).select("_s.spec_id", "source_table", "id", "_s.rule")


def located(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file, rule): of each path the file that holds it by the first rule that finds one, else one that begins with it.

    ``files``: file. Every rule is an equality of the path's name with one made from the file's: by ``FILE_RULES`` less the
    suffix, by the last less language and type, PDFs preferred. So each file tells its few names, of each name the best
    file is kept, and one join gives it to all paths of that name, however many paths and files share it. Names are
    grouped and joined with a hash before them, as long texts that begin alike are slow to sort. Paths without a file
    have nulls.
    """
    name = lambda c: F.substring_index(c, "/", -1)
    hashed = lambda df: df.withColumn("_h", F.xxhash64("_key"))
    w = hashed(wanted.select("path").distinct().withColumn("_key", name("path")))
    f = files.select("file", name("file").alias("_name")).withColumn("_stem", F.regexp_replace("_name", r"(_[A-Z]{2,3})?\.[^.]*$", ""))
    names = [F.when(F.endswith("_name", F.lit(x)), F.substring("_name", F.lit(1), F.length("_name") - len(x))) for x in FILE_RULES]
    rest = F.when(reduce(lambda a, b: a & b, (~n.eqNullSafe(F.col("_stem")) for n in names)), F.col("_stem"))
    last = F.when(F.endswith("_name", F.lit(".pdf")), len(FILE_RULES)).otherwise(len(FILE_RULES) + 1)
    told = F.array(*(F.struct(n.alias("_key"), r.alias("rule")) for n, r in zip([*names, rest], [*map(F.lit, range(len(FILE_RULES))), last], strict=True)))
    best = hashed(f.select("file", F.inline(told)).where("_key IS NOT NULL")).groupBy("_h", "_key").agg(F.min(F.struct("rule", "file")).alias("_b"))
    return w.join(best, ["_h", "_key"], "left").select("path", "_b.file", "_b.rule")


def members(archives: DataFrame) -> DataFrame:
    """(archive, member, size, content) of the regular files in tar archives (path, content), as ``binaryFile`` reads them.

    One archive is in memory at a time, and of its members one.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame({"archive": [path], "member": [m.name], "size": [m.size], "content": [tar.extractfile(m).read()]})

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, size bigint, content binary")


def object_key(register: Column, year: Column, path: Column) -> Column:
    """The key of a case's file in the store: register, year, path and the ending of its language."""
    return F.concat_ws("/", register, year.cast("string"), F.concat(F.regexp_replace(path, r"(_EN)?(\.pdf)?$", ""), F.lit("_EN.pdf")))


def renumbered(answers: DataFrame, index: DataFrame) -> DataFrame:
    """(answer_id, text): markers ``[^n]`` of each answer by the numbers of a registry; others stay.

    ``index``: answer_id, old, new. All old numbers become placeholders first, so that 1 to 2 and 2 to 1 don't meet.
    """
    pairs = index.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("_p"))
    j = answers.join(pairs, "answer_id", "left")
    p = F.coalesce("_p", F.array().cast("array<struct<old:int,new:int>>"))
    held = F.aggregate(p, F.col("text"), lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"\[\^"), x["old"].cast("string"), F.lit(r"(?=[,\]])")), F.concat(F.lit("[\u0001"), x["new"].cast("string"))))
    return j.select("answer_id", F.regexp_replace(held, "\\[\u0001", "[^").alias("text"))


def cited_cases(cases: DataFrame) -> DataFrame:
    """(source_table, id, title, citation): what an answer's list shows of a case, its own citation before the register's."""
    return cases.select("source_table", "id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("citation", "legacy_citation").alias("citation"))


def linked(answers: DataFrame) -> DataFrame:
    return answers.withColumn("text", as_link(F.col("text")))


def html_items(pages: DataFrame, tag: str = "li", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, item): the text of each element of a kind, without tags and entities of space, blank ones left out."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    text = F.transform(raw, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+|&nbsp;", " ")))
    return pages.select(key, F.posexplode(F.filter(text, lambda x: x != "")).alias("pos", "item"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a seeded hash of their key: a random order that is the same each time, as one top-k."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
