"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any kind, as ``\\s`` has it under ``(?U)``.
WHITE = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """Without white space of any kind at the ends; ``trim`` alone takes spaces only. Only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def blank_to_null(c: Column) -> Column:
    return let(c, lambda v: F.when(strip(v) != "", v))


def empty_to_null(c: Column) -> Column:
    """``c`` evaluated once; ``nullif`` does so twice wherever it stands within a lambda or a branch."""
    return let(c, lambda v: F.when(v != "", v))


def found(c, pattern: str, group: int = 1) -> Column:
    """A group of the first match, trimmed; null where there is none."""
    return empty_to_null(F.trim(F.regexp_extract(c, pattern, group)))


def replaced(c, held: str, pattern: str, by: str = "") -> Column:
    """``regexp_replace`` for a pattern that can't match without the characters ``held``, which are looked for first."""
    return let(c, lambda v: F.when(F.contains(v, F.lit(held)), F.regexp_replace(v, pattern, by)).otherwise(v))


def head(c, n: int) -> Column:
    """The first ``n`` characters; a text of no more bytes has no more of them, which is known without a walk through it."""
    return F.when(F.octet_length(c) <= n, c).otherwise(F.substring(c, 1, n))


#: Letters beyond ASCII whose capitals have ASCII letters.
_TO_ASCII = "".join(chr(n) for n in range(0x80, 0x110000) if any(x < "\x80" for x in chr(n).upper()))


def capitals(c) -> Column:
    """``upper`` to look for words in ASCII in: other characters may be lost, as it takes ten times as long over them."""
    def made(v: Column, other: Column) -> Column:
        return F.upper(F.when((other == "") | other.rlike(f"[{_TO_ASCII}]"), v).otherwise(F.regexp_replace(v, r"[^\x00-\x7F]", "\u0001")))

    return let(c, lambda v: let(F.regexp_replace(v, r"[\x00-\x7F]+", ""), lambda other: made(v, other)))


def shorten(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def year_of(path: Column, fallback: Column) -> Column:
    """The four digits that a path begins with, else the fallback."""
    return F.when(path.rlike(r"^\d{4}"), F.substring(path, 1, 4).cast("int")).otherwise(fallback)


def without_letter(label: Column) -> Column:
    return F.regexp_replace(label, "[A-Za-z]$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: Words that full-text search leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "its", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "were", "which", "will", "with")


def stem(token: Column) -> Column:
    """A light stem: longer words without the endings ing, ed, es or s. Bytes are compared; a pattern costs several times that."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    two = F.endswith(token, F.lit("ed")) | F.endswith(token, F.lit("es"))
    return F.when(n <= 4, token).when(F.endswith(token, F.lit("ing")), cut(3)).when(two, cut(2)).when(F.endswith(token, F.lit("s")), cut(1)).otherwise(token)


def tokens(c) -> Column:
    """Lower-case stems of the words of letters and digits, without stop words, repeats kept."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(F.filter(raw, lambda t: ~t.isin(*STOP_WORDS)), stem)


def tokens_sql(c: str) -> str:
    """The same for DuckDB."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    raw = f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"list_transform(list_filter({raw}, lambda t: NOT list_contains([{stops}], t)), lambda t: CASE WHEN length(t) > 4 THEN regexp_replace(t, '(ing|ed|es|s)$', '') ELSE t END)"


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of characters, a row of the table at a time; no Python."""
    right = F.split(b, "")
    zeros = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(above: Column, ch: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("row"), F.lit(1).alias("j"))
        step = lambda acc, other: F.struct(
            F.concat(acc["row"], F.array(F.when(other == ch, above[acc["j"] - 1] + 1).otherwise(F.greatest(above[acc["j"]], acc["row"][acc["j"] - 1])))).alias("row"),
            (acc["j"] + 1).alias("j"),
        )
        return F.aggregate(F.when(F.length(b) > 0, right).otherwise(F.array().cast("array<string>")), start, step, lambda acc: acc["row"])

    done = F.aggregate(F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>")), zeros, row)
    return F.element_at(done, -1)


def sort_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the likeness of two texts whose words are put in order, 200 * common / both lengths."""
    x, y = sort_tokens(a), sort_tokens(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * common_length(x, y) / total)


def long_similarity(a: Column, b: Column) -> Column:
    """Of long texts: equal 1; one within the other, the ratio of lengths; else the overlap of their words."""
    x, y = squeeze(F.lower(a)), squeeze(F.lower(b))
    shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return F.when(x == y, 1.0).when((shorter > 0) & (F.contains(x, y) | F.contains(y, x)), shorter / longer).otherwise(jaccard(words(x), words(y)))


def case_name(c: Column) -> Column:
    """A case's name for comparison: lower case, without dots and commas; between other words ``vs`` and ``v.`` are ``v``."""
    words = F.split(squeeze(F.lower(c)), " ")
    known = lambda x: F.transform(x, lambda w, i: F.when((i > 0) & (i < F.size(x) - 1) & w.isin("v", "vs", "v."), "v").otherwise(w))
    return squeeze(F.regexp_replace(F.array_join(let(words, known), " "), "[.,]", ""))


def any_of(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def as_link(c: Column) -> Column:
    """Citation markers as links: ``[^2, ¶14]`` to ``[2 ¶14](#cite-2-14)``."""
    pinned = F.regexp_replace(c, r"\[\^(\d+),\s*¶\s*([0-9A-Za-z.]+)\]", "[$1 ¶$2](#cite-$1-$2)")
    return F.regexp_replace(pinned, r"\[\^(\d+)\]", "[$1](#cite-$1)")
