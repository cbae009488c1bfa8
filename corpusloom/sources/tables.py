"""The tables the engine works on, and cases made from a plain documents table.

A case is a document seen as a decision of one of two courts' registers: ``sc`` (one court) or ``hc`` (several). Both
have the same columns here; what a register lacks is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of cases as SQL over documents that both Spark and DuckDB read.
_CASE = {
    "source_table": "CASE WHEN lang = 'en' THEN 'sc' ELSE 'hc' END",
    "id": "doc_id",
    "title": "substring(text, 1, 60)",
    "citation": "concat('[', CAST(1990 + doc_id % 35 AS STRING), '] ', CAST(1 + doc_id % 9 AS STRING), ' LR ', CAST(doc_id AS STRING))",
    "legacy_citation": "CASE WHEN lang = 'en' THEN concat('OLD ', CAST(doc_id % 400 AS STRING)) END",
    "petitioner": "CASE WHEN lang = 'en' THEN substring(text, 1, 12) END",
    "respondent": "CASE WHEN lang = 'en' THEN substring(text, 14, 12) END",
    "court": "CASE WHEN lang = 'en' THEN 'Supreme Court' ELSE lang END",
    "category": "source",
    "disposal": "CASE WHEN n_chars % 4 = 0 THEN 'Dismissed' WHEN n_chars % 4 = 1 THEN 'Allowed' WHEN n_chars % 4 = 2 THEN '' END",
    "year": "CAST(1990 + doc_id % 35 AS INT)",
    "decision_date": "CASE WHEN doc_id % 10 <> 3 THEN concat(CAST(1990 + doc_id % 35 AS STRING), '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) END",
    "path": "CASE WHEN doc_id % 3 <> 0 THEN concat(CAST(1990 + doc_id % 35 AS STRING), '_', CAST(doc_id AS STRING)) END",
    "pdf_url": "CASE WHEN doc_id % 5 = 0 THEN concat('https://files.example/', CAST(doc_id AS STRING), '.pdf') END",
    "judges": "ARRAY(concat('Judge ', CAST(doc_id % 17 AS STRING)), concat('Judge ', CAST(doc_id % 5 AS STRING)))",
    "acts": "ARRAY(concat('Act ', CAST(doc_id % 11 AS STRING)), concat('Act ', CAST(doc_id % 13 AS STRING)))",
    "keywords": "ARRAY(source, lang)",
    "n_chars": "n_chars",
    "text": "text",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of ``folder``; filters and the choice of columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that a task takes where each is little to read and much to work on.
ROWS_A_TASK = 20_000


def spread(df: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt out by its unique ``key``, some ``rows`` a task: for work that grows with rows, as splits go by bytes.

    A file of narrow rows is one split, or one row group, though making and reading texts of its rows takes minutes.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, key)


def cases(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(*(f"{sql} AS {name}" for name, sql in _CASE.items()))


def cases_sql(documents: str = "documents") -> str:
    """The same as DuckDB SQL, to be put in a WITH clause."""
    as_duck = lambda sql: sql.replace("ARRAY(", "list_value(").replace("AS STRING", "AS VARCHAR")
    return "SELECT " + ", ".join(f"{as_duck(sql)} AS {name}" for name, sql in _CASE.items()) + f" FROM {documents}"


def partitioned(spark: SparkSession, base: str, drop: tuple[str, ...] = ("raw_html", "scraped_at"), **parts) -> DataFrame:
    """A Hive-style Parquet folder (``year=``, ``court=``), only the partitions asked for, without bulky columns."""
    df = spark.read.option("basePath", base).parquet(base)
    for name, value in parts.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.drop(*drop)


def partition_values(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The values of a partition column, from the folder names alone."""
    return spark.read.parquet(base).select(name).distinct()


def registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(key, canonical) from a JSON registry of canonical names and aliases; of equal keys the last one counts.

    One document, or with ``lines`` an entry a line, which tasks share; then the last is that of the greatest name.
    """
    entry = "canonical string, aliases array<string>"
    if lines:
        rows = spark.read.schema(entry).json(path).select(F.col("canonical").alias("pos"), F.struct("canonical", "aliases").alias("e"))
    else:
        rows = spark.read.option("multiLine", True).schema(f"entries array<struct<{entry}>>").json(path).select(F.posexplode("entries").alias("pos", "e"))
    each = rows.select("pos", F.col("e.canonical").alias("canonical"), F.explode(F.concat(F.array("e.canonical"), F.coalesce("e.aliases", F.array().cast("array<string>")))).alias("name"))
    return each.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max_by("canonical", "pos").alias("canonical"))


def golden_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, question, source_table, source_id, weight) of questions with the cases they should find: one JSON document, or with ``lines`` a question a line."""
    question = "id string, question string, expected_cases array<struct<source_table string, source_id bigint, weight double>>"
    if lines:
        q = spark.read.schema(question).json(path).select(F.struct("*").alias("q"))
    else:
        q = spark.read.option("multiLine", True).schema(f"queries array<struct<{question}>>").json(path).select(F.explode("queries").alias("q"))
    return q.select("q.id", "q.question", F.explode("q.expected_cases").alias("e")).select("id", "question", "e.source_table", "e.source_id", F.coalesce("e.weight", F.lit(1.0)).alias("weight"))


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, n_filled, sample): one pass over all columns, a row for each."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.min(F.col(f"`{c}`").cast("string")).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("n_rows"), F.col(f"n{i}").alias("n_filled"), F.col(f"s{i}").alias("sample")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.inline(F.array(*rows)))


def schema_drift(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Columns that are missing and those nobody asked for, in order."""
    have = set(df.columns)
    return {"missing": [c for c in expected if c not in have], "extra": [c for c in df.columns if c not in set(expected)]}
