"""Chunks and paragraphs of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, head, let, strip

SIZE, STRIDE = 2000, 1800
MIN_BODY, MIN_COUNT, MIN_COVER = 15, 3, 0.4
SYNTHETIC = 1500
#: Where a numbered paragraph begins: at the start of a line, a number with a part after a dot, a letter, or a dot or
#: bracket (a number alone could be that of "14 days later"), then blanks and text on the same line.
NUMBERED = r"[ \t]*\d+(?:\.\d+[A-Za-z]?|[A-Za-z]|[.)])[ \t]+(?=\S)"
#: Where one begins that says so, blank lines before it included: the word and a number, with a part or a letter if there is one.
PARA_WORD = r"\s*(?i:para(?:graph)?)\s+\d+(?:\.\d+)?[A-Za-z]?\b\s*[.:-]?\s*"
#: Blanks at the end of a line, at most, that may stand before the blank lines of an opening.
_TRAILING = 200


def fixed_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", header: Column | None = None, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """(key, chunk_index, chunk_text): windows of ``size`` characters each ``stride`` on, trimmed, blank ones left out.

    With a header the text is trimmed first and each chunk begins with the header. An empty text has no chunk.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    body = strip(body) if header is not None else body
    d = docs.select(key, body.alias("_t"), *([header.alias("_h")] if header is not None else [])).where("length(_t) > 0")
    starts = F.expr(f"sequence(0, cast((length(_t) - 1) div {stride} as int))")
    pieces = F.filter(F.transform(starts, lambda i: strip(F.substring(F.col("_t"), i * stride + 1, F.lit(size)))), lambda c: c != "")
    out = d.select(key, *(["_h"] if header is not None else []), F.posexplode(pieces).alias("chunk_index", "chunk_text"))
    return out.withColumn("chunk_text", F.concat("_h", "chunk_text")).drop("_h") if header is not None else out


def header(fields: list[tuple[str, Column, int | None]]) -> Column:
    """Labelled lines of the fields that aren't blank, long ones cut, and a blank line after; empty without any."""
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), blank_to_null(head(value, most) if most else value)) for label, value, most in fields))
    return F.when(lines != "", F.concat(lines, F.lit("\n\n"))).otherwise("")


def _regex_paragraphs(text: Column, opening: str) -> Column:
    """Paragraphs from one opening to the next: (start, end, num, body), short ones left out, labels as they come."""
    # an opening that takes in blank lines is cut at the first of them only: where the line before isn't blank
    first = rf"(?:(?<![\s\S])|(?<=\S[ \t\r]{{0,{_TRAILING}}}\n))"
    parts = F.split(text, f"(?m)^{first if opening.startswith(chr(92) + 's') else ''}(?={opening})")
    # lengths add up to offsets
    placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,raw:string>>").alias("all")), lambda a, p: F.struct(
        (a["at"] + F.length(p)).alias("at"), F.concat(a["all"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p)).alias("end"), p.alias("raw")))).alias("all")), lambda a: a["all"])
    own = F.filter(placed, lambda p: p["raw"].rlike(f"^{opening}"))
    made = F.transform(own, lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"),
        F.regexp_extract(p["raw"], r"^\D*(\d+(?:\.\d+)?[A-Za-z]?)", 1).alias("num"), strip(F.regexp_replace(p["raw"], f"^{opening}", "")).alias("body")))
    return F.filter(made, lambda p: F.length(p["body"]) >= MIN_BODY)


def _labelled(paras: Column, kind: str) -> Column:
    """The second paragraph 14 becomes 14#2, and so on."""
    def one(p: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(paras, F.lit(1), i), lambda q: q["num"] == p["num"]))
        return F.struct(F.when(before == 0, p["num"]).otherwise(F.concat(p["num"], F.lit("#"), (before + 1).cast("string"))).alias("paragraph_number"), i.alias("paragraph_order"),
                        p["start"].alias("start_char"), p["end"].alias("end_char"), p["body"].alias("paragraph_text"), F.lit(kind).alias("kind"))

    return F.transform(paras, one)


def _reasonable(paras: Column, text: Column) -> Column:
    covered = F.aggregate(paras, F.lit(0), lambda s, p: s + p["end"] - p["start"])
    return (F.size(paras) >= MIN_COUNT) & (covered >= F.length(text) * MIN_COVER)


def _synthetic(text: Column, target: int = SYNTHETIC) -> Column:
    """Blocks between blank lines, joined until they reach the target; labels s1, s2, ..."""
    blocks = F.split(text, r"(?<=\n)(?=[ \t]*\n)|(?<=\n\n)(?=\S)")
    kind = "array<struct<start:int,end:int,body:string>>"
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit("").alias("body"), F.array().cast(kind).alias("all"))

    def step(a: Column, raw: Column) -> Column:
        piece, end = strip(raw), a["at"] + F.length(raw)
        body = F.when(a["body"] == "", piece).when(piece == "", a["body"]).otherwise(F.concat(a["body"], F.lit("\n\n"), piece))
        start = F.when(a["body"] == "", a["at"]).otherwise(a["start"])
        full = F.length(body) >= target
        return F.struct(end.alias("at"), F.when(full, end).otherwise(start).alias("start"), F.when(full, "").otherwise(body).alias("body"),
                        F.when(full, F.concat(a["all"], F.array(F.struct(start.alias("start"), end.alias("end"), body.alias("body"))))).otherwise(a["all"]).alias("all"))

    done = F.aggregate(blocks, state, step, lambda a: F.when(a["body"] != "", F.concat(a["all"], F.array(F.struct(a["start"].alias("start"), a["at"].alias("end"), a["body"].alias("body"))))).otherwise(a["all"]))
    return F.transform(done, lambda p, i: F.struct(F.concat(F.lit("s"), (i + 1).cast("string")).alias("paragraph_number"), i.alias("paragraph_order"), p["start"].alias("start_char"), p["end"].alias("end_char"), p["body"].alias("paragraph_text"), F.lit("synthetic").alias("kind")))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, strategy, paragraph_number, paragraph_order, start_char, end_char, paragraph_text, kind): a row a paragraph of ``paragraph_lists``."""
    return paragraph_lists(docs, key, text).select(key, "strategy", F.inline("paragraphs"))


def paragraph_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, strategy, paragraphs): a row a text that isn't blank, its paragraphs in order.

    Numbered paragraphs if there are three or more and they cover two fifths of the text; else paragraphs that begin
    with the word; else blocks. Openings are counted first: texts with fewer than three aren't cut by them. Steps are
    kept as columns, so that each is computed once.
    """
    t = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).where(strip(F.col("_t")) != "")
    cut = lambda opening: F.when(F.regexp_count("_t", F.lit(f"(?m)^{opening}")) >= MIN_COUNT, _regex_paragraphs(F.col("_t"), opening))
    ok = lambda c: F.coalesce(_reasonable(F.col(c), F.col("_t")), F.lit(False))
    t = t.withColumn("_n", cut(NUMBERED)).withColumn("_by_number", ok("_n")).withColumn("_w", F.when(~F.col("_by_number"), cut(PARA_WORD)))
    t = t.withColumn("strategy", F.when(F.col("_by_number"), "numbered").when(ok("_w"), "para_word").otherwise("synthetic"))
    chosen = F.when(F.col("strategy") == "numbered", _labelled(F.col("_n"), "numbered")).when(F.col("strategy") == "para_word", _labelled(F.col("_w"), "numbered")).otherwise(_synthetic(F.col("_t")))
    return t.select(key, "strategy", chosen.alias("paragraphs"))


def paragraph_chunks(paras: Column, header_: Column, target: int = SIZE) -> Column:
    """Chunks of whole paragraphs (paragraph_number, paragraph_text) until the target is passed: (chunk_text, paragraph_numbers).

    A paragraph over the target is cut into slices named a to z, then _26 and on; chunks of one keep its number.
    """
    kind = "array<struct<chunk_text:string,paragraph_numbers:array<string>>>"
    shown = lambda n, t: F.concat(F.lit("¶"), n, F.lit("  "), t)
    chunk = lambda body, nums: F.struct(F.concat(header_, body).alias("chunk_text"), nums.alias("paragraph_numbers"))
    none = F.array().cast("array<string>")
    state = F.struct(F.lit("").alias("body"), F.lit(0).alias("n"), none.alias("nums"), F.array().cast(kind).alias("all"))

    def flush(a: Column) -> Column:
        return F.when(F.size(a["nums"]) > 0, F.concat(a["all"], F.array(chunk(a["body"], a["nums"])))).otherwise(a["all"])

    def grown(a: Column, num: Column, body: Column, size: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / target).cast("int")), lambda i: chunk(
            shown(F.concat(num, F.when(i < 26, F.char(97 + i)).otherwise(F.concat(F.lit("_"), i.cast("string")))), F.substring(body, i * target + 1, F.lit(target))), F.array(num)))
        over = a["n"] + size > target
        now = lambda body, n, nums, all_: F.struct(body.alias("body"), n.alias("n"), nums.alias("nums"), all_.alias("all"))
        begun = now(shown(num, body), size, F.array(num), flush(a))
        added = now(F.when(a["body"] == "", shown(num, body)).otherwise(F.concat(a["body"], F.lit("\n\n"), shown(num, body))), a["n"] + size, F.concat(a["nums"], F.array(num)), a["all"])
        return F.when(size == 0, a).when(size > target, now(F.lit(""), F.lit(0), none, F.concat(flush(a), slices))).when(over, begun).otherwise(added)

    def step(a: Column, p: Column) -> Column:
        return let(strip(p["paragraph_text"]), lambda body: let(F.length(body), lambda size: grown(a, p["paragraph_number"], body, size)))

    return F.aggregate(paras, state, step, flush)


def display_parts(c: Column) -> Column:
    """Text for reading, cut before clause numbers that follow the end of a sentence."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    marked = F.regexp_replace(flat, r"([.;:]) (\(?[0-9ivx]+[.)] )", "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001"), F.trim), lambda p: p != "")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 2.5).cast("int")


def token_batches(sizes: Column, most: int = 100_000) -> Column:
    """The batch, from 0, of each size in order: filled until the next would pass ``most``; one over that stands alone."""
    state = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).alias("batch"), F.array().cast("array<int>").alias("all"))

    def step(a: Column, n: Column) -> Column:
        new = (a["batch"] < 0) | (a["used"] + n > most)
        batch = F.when(new, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(F.when(new, n.cast("bigint")).otherwise(a["used"] + n).alias("used"), batch.alias("batch"), F.concat(a["all"], F.array(batch)).alias("all"))

    return F.aggregate(sizes, state, step, lambda a: a["all"])
