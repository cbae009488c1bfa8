"""Secrets in texts: fixed shapes, and runs of symbols that a battery of randomness tests takes for random."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free, let, others


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kinds of fixed shape, in order: pattern, group whose length counts, least length.
SHAPES = {
    "assign": ("(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),  # a run that is too short holds no other one, so that only long ones need be found
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
#: What a text has in lower case if it has a match of a kind; most texts end there.
HINTS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey")}
#: The kind that the tests add, the runs that they look at, and the shortest that they judge.
RANDOM, RUN, SHORTEST = "random", "[A-Za-z0-9+/_-]{16,}", 16
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, the smallest first: a run has the first whose symbols are all it consists of.
ENCODINGS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "hex_upper": _DIGITS + "ABCDEF", "base32": _LOWER.upper() + "234567", "base36": _DIGITS + _LOWER, "base36_upper": _DIGITS + _LOWER.upper(),
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/", "base64_url": _LOWER.upper() + _LOWER + _DIGITS + "-_",
}
#: Lengths from which a run falls into the next class; runs of a class are judged together.
CLASSES = (16, 20, 24, 32, 40, 48, 64, 96, 128)
#: Cuts of the sum of three squared deviates: 95, 99 and 99.9 of a hundred random runs lie below.
CUTS = (7.815, 11.345, 16.266)
#: Above the last cut and up to this the density of runs that aren't random is measured.
FAR = 48.798
#: The share of false ones among the runs of a class that may be reported.
FALSE_SHARE = 0.05
#: Spans from which the ends of those before them are added up in steps.
_STEP = 128


def _summed(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)


def _before(lengths: Column) -> Column:
    """For each place of an array the sum of what stands before it, by sums of blocks, so that long arrays stay cheap."""
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / _STEP).cast("int")), lambda j: _summed(F.slice(x, j * _STEP + 1, _STEP)))
    starts = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda j: _summed(F.slice(x, F.lit(1), j)))
    place = lambda x, s: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(s, F.floor(i / _STEP).cast("int")) + _summed(F.slice(x, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP)))
    return let(lengths, lambda x: let(starts(blocks(x)), lambda s: place(x, s)))


def _pieces(text: Column, pattern: str, group: int, body) -> Column:
    """``body(matches, what lies between them, a group of each)``; the text is those between each other."""
    said, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    parts = F.struct(said.alias("said"), F.split(text, pattern, -1).alias("between"), value.alias("value"))
    return let(parts, lambda p: body(p["said"], p["between"], p["value"]))


def _hinted(text: Column, pattern: str, hints: tuple[str, ...]) -> Column:
    """Whether the pattern occurs; where hints are given, one of them is looked for first."""
    if not hints:
        return text.rlike(pattern)
    low = let(F.lower(text), lambda t: reduce(Column.__or__, [t.contains(h) for h in hints]))
    return low & text.rlike(pattern)


def matches(text: Column, pattern: str, group: int, hints: tuple[str, ...] = ()) -> Column:
    """Array of (start, end, value) of the matches of ``pattern``, leftmost and non-overlapping; ``value`` is a group.

    The lengths of the matches and of what lies between them give their places.
    """
    def placed(said: Column, between: Column, value: Column) -> Column:
        size = lambda s: F.length(s).cast("long")
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(said)), said, lambda g, s: size(g) + size(s))
        zipped = F.arrays_zip(_before(steps).alias("at"), between.alias("gap"), said.alias("said"), value.alias("value"))
        spans = F.slice(zipped, F.lit(1), F.size(said))
        start = lambda z: z["at"] + size(z["gap"])
        return F.transform(spans, lambda z: F.struct(start(z).alias("start"), (start(z) + size(z["said"])).alias("end"), z["value"].alias("value")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return let(text, lambda t: F.when(_hinted(t, pattern, hints), _pieces(t, pattern, group, placed)).otherwise(none))


def _blanked(text: Column, kind: str) -> Column:
    """The text with the matches of a kind of SHAPES as blanks, all else at its place."""
    pattern, group, least = SHAPES[kind]

    def joined(said: Column, between: Column, value: Column) -> Column:
        blank = F.zip_with(said, value, lambda s, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(s))).otherwise(s))
        return F.array_join(F.flatten(F.zip_with(between, blank, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")

    return let(text, lambda t: F.when(_hinted(t, pattern, HINTS.get(kind, ())), _pieces(t, pattern, group, joined)).otherwise(t))


def fixed_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of a kind of SHAPES; matches that are too short drop out, and what they cover with them."""
    pattern, group, least = SHAPES[kind]
    return F.filter(matches(text, pattern, group, HINTS.get(kind, ())), lambda m: F.length(m["value"]) >= least)


def encoding_of(run: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, symbols in reversed(ENCODINGS.items()):
        out = F.when(run.rlike("^[" + symbols.replace("-", "\\-") + "]+$"), F.lit(name)).otherwise(out)
    return out


def _by_encoding(encoding: Column, value) -> Column:
    out = F.lit(None).cast("double")
    for name, symbols in ENCODINGS.items():
        out = F.when(encoding == name, value(symbols)).otherwise(out)
    return out


def _uniform(run: Column, symbols: str) -> Column:
    """Deviate of Pearson's chi-squared of the counts of all symbols from equal counts."""
    n, m = F.length(run).cast("double"), float(len(symbols))
    counts = F.transform(F.array(*[F.lit(s) for s in symbols]), lambda s: (F.length(run) - F.length(F.replace(run, s, F.lit("")))).cast("long"))
    squares = _summed(F.transform(counts, lambda c: c * c)).cast("double")
    return (squares * m / n - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)


def _runs(run: Column, symbols: str) -> Column:
    """Deviate of the number of runs of symbols of the lower and of the upper half of the alphabet, given how many of each there are."""
    half = len(symbols) // 2
    halves = F.translate(run, symbols, "L" * half + "H" * (len(symbols) - half))
    n = F.length(run).cast("double")
    high = F.length(F.replace(halves, F.lit("L"), F.lit(""))).cast("double")
    turns = sum((F.length(run) - F.length(F.replace(halves, F.lit(pair), F.lit("")))) / 2 for pair in ("LH", "HL"))
    mean = 2 * high * (n - high) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return F.when(spread > 0, (turns + 1 - mean) / F.sqrt(spread)).otherwise(F.lit(FAR))


def _serial(run: Column, symbols: str) -> Column:
    """Deviate of the correlation of each symbol's place in the alphabet with the next one's."""
    n = F.length(run).cast("double")
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(symbols), c).cast("long"))

    def of(x: Column) -> Column:
        total = _summed(x).cast("double")
        own = _summed(F.transform(x, lambda v: v * v)).cast("double") - total * total / n
        pairs = _summed(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * b)).cast("double")
        ends = (F.element_at(x, 1) + F.element_at(x, -1)).cast("double") * total / n
        mean = total / n
        cross = pairs - 2 * mean * total + ends + (n - 1) * mean * mean
        return F.when(own > 0, (cross / own + 1 / n) * F.sqrt(n)).otherwise(F.lit(FAR))

    return let(places, of)


def distance(run: Column, encoding: Column) -> Column:
    """Sum of the squared deviates of the three tests: about chi-squared with three degrees if the run is random."""

    def of(symbols: str) -> Column:
        u, r, s = _uniform(run, symbols), _runs(run, symbols), _serial(run, symbols)
        return let(F.array(u, r, s), lambda d: d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    return _by_encoding(encoding, of)


def _length_class(n: Column) -> Column:
    out = F.lit(CLASSES[0])
    for at in CLASSES[1:]:
        out = F.when(n >= at, F.lit(at)).otherwise(out)
    return out


def runs_of(text: Column) -> Column:
    """Array of (start, end, encoding, class, distance) of the runs that the tests judge, all outside base spans."""
    for kind in SHAPES:
        text = _blanked(text, kind)
    named = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), encoding_of(m["value"]).alias("encoding"))
    found = F.filter(F.transform(matches(text, RUN, 0), named), lambda m: m["encoding"].isNotNull())
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["encoding"].alias("encoding"), _length_class(F.length(m["value"])).alias("class"), distance(m["value"], m["encoding"]).alias("distance")))


def cuts(runs: DataFrame) -> DataFrame:
    """(encoding, class, cut): up to which distance runs of an encoding and a class of lengths count as random.

    ``runs`` has encoding, class and distance. Runs beyond the last of CUTS are hardly random; their density up to FAR
    is carried down to zero, where ordinary runs are rarer rather than denser. The largest cut below which they make up
    FALSE_SHARE at most holds; a class without such a cut has none. Counts combine before the shuffle, and the result
    has a row for each encoding and class at most.
    """
    below = [F.sum((F.col("distance") <= c).cast("long")).alias(f"n{i}") for i, c in enumerate(CUTS)]
    ordinary = F.sum(((F.col("distance") > CUTS[-1]) & (F.col("distance") <= FAR)).cast("long")).alias("ordinary")
    counted = runs.groupBy("encoding", "class").agg(*below, ordinary)
    cut = F.lit(None).cast("double")
    for i, c in enumerate(CUTS):
        cut = F.when(F.col("ordinary") * F.lit(c / (FAR - CUTS[-1])) <= F.col(f"n{i}") * FALSE_SHARE, F.lit(c)).otherwise(cut)
    return counted.select("encoding", "class", cut.alias("cut")).where("cut is not null")


def _first(otherwise: Column, cases: list[tuple[Column, float]]) -> Column:
    for condition, value in cases:
        otherwise = F.when(condition, F.lit(value)).otherwise(otherwise)
    return otherwise


def _told(spans: Column) -> Column:
    """kind:start:end of each span, by start and then by kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_assign, n_access, n_hex, n_random, base_spans and spans; the last two as text.

    Base spans are the matches of SHAPES. Runs of letters, digits and the signs of base 64 in what base spans leave get
    the least of ENCODINGS that holds them; chi-squared of the symbols, runs of the halves and serial correlation give
    three deviates, whose squares add up to a distance from randomness. ``cuts`` says for each encoding and class of
    lengths, over all rows, up to which distance runs are reported, so that few of them are ordinary words; they are
    added as kind ``random``. Places are code points, ends exclusive.

    A null text counts as empty and has no spans; very long texts and texts with very many spans are rows like others.
    Every row is judged for itself, and repeated rows count as often as they stand. No rows: no rows. Columns of the
    input with the names that are added, in any case, are replaced.
    """
    added = ("n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans")
    kept = others(docs, *added)
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    limits = cuts(docs.select(F.explode(runs_of(text)).alias("r")).select("r.*")).collect()  # a row for each encoding and class at most
    limit = F.lit(None).cast("double")
    cut_of = lambda r: _first(limit, [((r["encoding"] == x["encoding"]) & (r["class"] == x["class"]), x["cut"]) for x in limits])
    rank = {k: i for i, k in enumerate((*SHAPES, RANDOM))}
    span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(rank[kind]).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    base, more = free(docs, "_base", "_more")
    fixed = F.concat(*[F.transform(fixed_spans(text, k), span(k)) for k in SHAPES])
    random_ones = F.transform(F.filter(runs_of(text), lambda r: r["distance"] <= cut_of(r)), span(RANDOM))
    found = docs.withColumns({base: fixed, more: random_ones})
    count = lambda kind: F.size(F.filter(F.col(base), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [*[count(k) for k in SHAPES], F.size(more).cast("long").alias("n_random")]
    return found.select(*[F.col(f"`{c}`") for c in kept], *counts, _told(F.col(base)).alias("base_spans"), _told(F.concat(base, more)).alias("spans"))
