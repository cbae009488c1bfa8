"""Faceted search over cases: pages, counts, diagnostics and the options of facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import HC, SC, Filters, apply, condition, one_clause

PAGE, MOST = 20, 50
OPTIONS = 5000


def has_pdf() -> Column:
    """A register of one court keeps a path, the other an address."""
    return F.when(F.col("source_table") == SC, F.col("path").isNotNull()).otherwise(F.col("pdf_url").isNotNull())


def search_page(cases: DataFrame, filters: Filters, page: int = 1, limit: int = PAGE) -> DataFrame:
    """A page of cases, newest first, dates as text, unknown dates last; parties only from the first register.

    Sorting and cutting is one top-k of ``page * limit`` rows; no full sort.
    """
    if not filters.active():
        raise ValueError("at least one filter is required")
    limit, page = max(1, min(limit, MOST)), max(1, page)
    of_sc = F.col("source_table") == SC
    rows = apply(cases, filters).select(
        "source_table", "id", "title", "citation", F.when(of_sc, F.col("petitioner")).alias("petitioner"), F.when(of_sc, F.col("respondent")).alias("respondent"),
        "court", F.col("decision_date").cast("string").alias("decision_date"), has_pdf().alias("has_pdf"),
    )
    return rows.orderBy(F.desc_nulls_last("decision_date"), "source_table", "id").limit(page * limit).offset((page - 1) * limit)


def search_count(cases: DataFrame, filters: Filters, limit: int = PAGE) -> DataFrame:
    """(sc, hc, total, pages) in one pass."""
    count = lambda t: F.count_if(F.col("source_table") == t)
    one = apply(cases, filters).agg(count(SC).alias("sc"), count(HC).alias("hc"), F.count(F.lit(1)).alias("total"))
    return one.withColumn("pages", F.ceil(F.col("total") / max(1, min(limit, MOST))).cast("long"))


def diagnostics(cases: DataFrame, filters: Filters) -> DataFrame:
    """(filter, value, matches): of a search without results, what each filter finds alone; the court goes with all.

    One pass with a conditional count a filter. No rows if the search has results or one filter only.
    """
    active = filters.active()
    court = one_clause("court", active["court"]) if "court" in active else F.lit(True)
    alone = {k: one_clause(k, v) & court for k, v in active.items()}
    one = cases.agg(F.count_if(condition(filters)).alias("_all"), *(F.count_if(c).alias(k) for k, c in alone.items()))
    rows = [F.struct(F.lit(k).alias("filter"), F.lit(str(v)).alias("value"), F.col(k).alias("matches")) for k, v in active.items()]
    if len(rows) < 2:
        return one.select(F.inline(F.array(*rows))).limit(0) if rows else one.select(F.lit("").alias("filter"), F.lit("").alias("value"), F.lit(0).cast("long").alias("matches")).limit(0)
    return one.where("_all = 0").select(F.inline(F.array(*rows))).orderBy("matches", "filter")


def facet_text(cases: DataFrame, column: str, limit: int = OPTIONS) -> DataFrame:
    """(value): the distinct non-empty values, the first ``limit`` of each register, merged and sorted."""
    parts = [cases.where((F.col("source_table") == t) & (F.col(column) != "")).select(F.col(column).alias("value")).distinct().orderBy("value").limit(limit) for t in (SC, HC)]
    return reduce(DataFrame.union, parts).distinct().orderBy("value")


def facet_array(cases: DataFrame, column: str, limit: int = OPTIONS) -> DataFrame:
    """(value): the distinct non-empty elements of an array column, likewise."""
    each = cases.select("source_table", F.explode(column).alias("_e"))
    return facet_text(each.select("source_table", F.col("_e").alias(column)), column, limit)


def facet_courts(cases: DataFrame) -> DataFrame:
    """(court, place): the courts in order, those of the first register first, each once."""
    first = cases.where(F.col("court") != "").groupBy("court").agg(F.min(F.when(F.col("source_table") == SC, 0).otherwise(1)).alias("place"))
    return first.orderBy("place", "court")


def year_range(cases: DataFrame, this_year: int, least: int = 1950) -> DataFrame:
    """(min_year, max_year) over both registers."""
    return cases.agg(F.coalesce(F.min("year"), F.lit(least)).alias("min_year"), F.coalesce(F.max("year"), F.lit(this_year)).alias("max_year"))


def find_by_title(cases: DataFrame, term: str, limit: int = 3) -> DataFrame:
    """Cases of each register with ``term`` in a title or party, newest first; ``%`` and ``_`` in it are wild."""
    term = term.strip()
    if len(term) < 3:
        return cases.limit(0)
    like = lambda *cols: reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{term}%") for c in cols))
    parts = [cases.where((F.col("source_table") == t) & like(*cols)).orderBy(F.desc_nulls_last("decision_date"), "id").limit(limit) for t, cols in ((SC, ("title", "petitioner", "respondent", "citation", "legacy_citation")), (HC, ("title", "petitioner", "respondent")))]
    return parts[0].unionByName(parts[1])


def find_by_citation(cases: DataFrame, citation: str, limit: int = 3) -> DataFrame:
    """Exact citations: in the first register by the new form, only if that finds none by the old one; and in the second by the new."""
    citation = citation.strip()
    hits = cases.where((F.col("citation") == citation) | ((F.col("source_table") == SC) & (F.col("legacy_citation") == citation)))
    rule = F.when(F.col("citation") == citation, 0).otherwise(1)
    from pyspark.sql import Window

    by = Window.partitionBy("source_table")
    ranked = hits.withColumn("_rule", rule).withColumn("_best", F.min("_rule").over(by)).where("_rule = _best")
    return ranked.withColumn("_n", F.row_number().over(by.orderBy(F.desc_nulls_last("decision_date"), "id"))).where(F.col("_n") <= limit).drop("_rule", "_best", "_n")


def fetch(cases: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("source_table", "id")) -> DataFrame:
    """The cases of a list of keys; a semi-join, so the list may be of any length and name a case twice."""
    return cases.join(ids.select(*keys), list(keys), "left_semi")


def pending(rows: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with text that progress doesn't name yet."""
    return rows.where("text IS NOT NULL AND text <> ''").join(progress.select(*keys), keys, "left_anti")


def load_new(existing: DataFrame, incoming: DataFrame, key: str, alternative: str) -> DataFrame:
    """Incoming rows neither of whose keys is known; two anti-joins instead of one with OR, which would be a nested loop.

    Within ``incoming`` the first row of each key stays (by ``id``); null alternatives meet nothing.
    """
    new = incoming.join(existing.select(key), key, "left_anti")
    new = new.join(existing.where(F.col(alternative).isNotNull()).select(alternative), alternative, "left_anti")
    return new.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in incoming.columns]), "id").alias("_r")).select("_r.*")


def parent_fallback(paragraphs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source_table, source_id, asked, matched_as, paragraph_text): the paragraph itself, else the one without its last letter."""
    keys = ["source_table", "source_id", "paragraph_number"]
    p = paragraphs.select(*keys, "paragraph_text")
    w = wanted.withColumn("_parent", F.regexp_replace("asked", "[A-Za-z]$", ""))
    w = w.join(p.withColumnRenamed("paragraph_number", "asked").withColumnRenamed("paragraph_text", "_exact"), ["source_table", "source_id", "asked"], "left")
    w = w.join(p.withColumnRenamed("paragraph_number", "_parent").withColumnRenamed("paragraph_text", "_of_parent"), ["source_table", "source_id", "_parent"], "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_of_parent").isNotNull(), "parent").otherwise("none")
    return w.select("source_table", "source_id", "asked", how.alias("matched_as"), F.coalesce("_exact", "_of_parent").alias("paragraph_text"))
