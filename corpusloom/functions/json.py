"""JSON expressions: lists and objects as they come from forms, stores and models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_list(c: Column) -> Column:
    """Trimmed non-empty strings of a JSON text: a list of strings or of objects with a name or title; other text is itself one.

    Null and blank texts give an empty list.
    """
    plain = F.from_json(c, "array<string>")
    item = lambda s: F.coalesce(F.get_json_object(s, "$.name"), F.get_json_object(s, "$.title"), F.when(~s.startswith("{"), s))
    listed = F.filter(F.transform(plain, lambda s: F.trim(item(s))), lambda s: s.isNotNull() & (s != ""))
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (F.trim(c) == ""), none).when(F.trim(c).startswith("["), F.coalesce(listed, F.array(F.trim(c)))).otherwise(F.array(F.trim(c)))


def model_object(c: Column) -> Column:
    """The JSON object in a model's answer: from the first brace to the last, fences and talk around it dropped; null if it isn't JSON."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def as_json(values: Column) -> Column:
    return F.to_json(values)


def frames(body: Column) -> Column:
    """Server-sent events of a stream's text: (event, data) of each frame."""
    parts = F.filter(F.split(body, "\n\n"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, r"(?m)^event: ?(.*)$", 1), F.lit("")).alias("event"), F.regexp_extract(p, r"(?m)^data: ?(.*)$", 1).alias("data")))
