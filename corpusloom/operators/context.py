"""Context for an answer: cases assembled from chunks within budgets, sessions, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shorten, without_letter

TOTAL, PER_CASE = 60_000, 12_000
GAP = "\n[...]\n"
SHOWN = 20
HOT, HOT_CHUNKS, LOOKBACK, SNIPPET, HISTORY = 6, 16, 20, 400, 10
KEY = ["source_table", "source_id"]
#: Tasks that a group with a budget is dealt to at first.
SALTS = 32


def merged_text(parts: Column, budget: int = PER_CASE) -> Column:
    """Chunks (chunk_index, text) in order as one text: a gap marker where an index is missing, cut at the budget.

    A marker counts as six characters against the budget and room is measured before it, so a text may run over by it.
    """
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(-2).cast("bigint").alias("last"))

    def step(a: Column, c: Column) -> Column:
        room = F.lit(budget) - a["used"]
        gap = (a["last"] != -2) & (c["chunk_index"] != a["last"] + 1)
        piece = F.substring(c["text"], F.lit(1), F.greatest(room, F.lit(0)))
        glue = F.when(gap, GAP).when(a["last"] == -2, "").otherwise("\n")
        more = F.length(piece) + F.when(gap, 6).otherwise(0)
        grown = F.struct(F.concat(a["text"], glue, piece).alias("text"), (a["used"] + more).alias("used"), c["chunk_index"].cast("bigint").alias("last"))
        return F.when(room > 0, grown).otherwise(a)

    return F.aggregate(parts, state, step, lambda a: a["text"])


def cases_of(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(case, best_rank, parts, paragraphs): the chunks of each case in order of index; cases rank by their best chunk."""
    each = F.struct(F.col("chunk_index").cast("bigint").alias("chunk_index"), "text", "paragraph_numbers")
    g = chunks.groupBy(*by, *KEY).agg(F.min("rank").alias("best_rank"), F.array_sort(F.collect_list(each)).alias("_all"))
    parts = F.transform("_all", lambda c: F.struct(c["chunk_index"].alias("chunk_index"), c["text"].alias("text")))
    return g.select(*by, *KEY, "best_rank", parts.alias("parts"), F.array_distinct(F.flatten(F.transform("_all", lambda c: F.coalesce(c["paragraph_numbers"], F.array().cast("array<string>"))))).alias("paragraphs"))


def within_budget(sized: DataFrame, order: list, size: str, total: int = TOTAL, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in order until one would pass the total; from it on none. The first is always in. Adds ``used``.

    Once the running sum, taken over all rows, passes the total it stays there, so one window says it all. A group of
    very many rows is dealt to SALTS tasks first: each keeps the rows that its own share has room for and the one that
    passes the total there, behind which no row can be in.
    """
    group, size = list(by or [F.lit(0)]), F.coalesce(size, F.lit(0))
    dealt = sized.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    upto = F.sum(size).over(Window.partitionBy(*group, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    some = dealt.withColumn("_upto", upto - size).where(F.col("_upto") <= total).drop("_s", "_upto")
    w = Window.partitionBy(*group).orderBy(*order)
    n, used = F.row_number().over(w), F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("used", used).withColumn("_n", n).where((F.col("_n") == 1) | (F.col("used") <= total)).drop("_n")


def case_block(index: Column, title: Column, citation: Column, court: Column, paragraphs: Column, body: Column) -> Column:
    """What a reader sees of a case: labelled lines without blank ones, the first paragraphs by name, then the text."""
    n = F.size(paragraphs)
    names = F.array_join(F.transform(F.slice(paragraphs, 1, SHOWN), lambda p: F.concat(F.lit("¶"), p)), ", ")
    shown = F.when(n > SHOWN, F.concat(names, F.lit(" …(+"), (n - SHOWN).cast("string"), F.lit(")"))).when(n > 0, names)
    return F.concat_ws("\n", F.concat(F.lit("[Case "), index.cast("string"), F.lit("]")), F.concat(F.lit("Title: "), title), F.concat(F.lit("Citation: "), citation), F.concat(F.lit("Court: "), court), F.concat(F.lit("Paragraphs: "), shown), body)


def build_context(chunks: DataFrame, cases: DataFrame, total: int = TOTAL, per_case: int = PER_CASE, by: tuple[str, ...] = ()) -> DataFrame:
    """(source_table, source_id, case_index, block, chars, used): the blocks that fit, best case first, for each question that ``by`` names.

    The chunks are those found for a question, so the window over its cases is a short list.
    """
    c = cases_of(chunks, by).withColumn("body", merged_text(F.col("parts"), per_case))
    c = c.join(cases.select(F.col("source_table"), F.col("id").alias("source_id"), "title", "citation", "court"), KEY, "left")
    c = c.withColumn("case_index", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("best_rank", *KEY)))
    block = case_block(F.col("case_index"), F.coalesce("title", F.lit("Untitled")), F.col("citation"), F.col("court"), F.col("paragraphs"), F.col("body"))
    c = c.withColumn("block", block).withColumn("chars", F.length("block"))
    return within_budget(c, ["best_rank", *KEY], "chars", total, by).select(*by, *KEY, "case_index", "block", "chars", "used")


def registry_index(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(case, index): cases numbered in the order in which calls first brought them, in each session that ``by`` names."""
    first = calls.groupBy(*by, *KEY).agg(F.min(F.struct("call_order", "pos")).alias("_f"))
    return first.withColumn("index", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_f", *KEY))).drop("_f")


def triggers(messages: DataFrame) -> DataFrame:
    """Each assistant message with the latest user message before it in its session, by the strict order of ``at``."""
    w = Window.partitionBy("session_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.struct("at", "content")), ignorenulls=True).over(w)
    return messages.withColumn("_u", asked).where("role = 'assistant'").select("session_id", "at", F.col("_u.at").alias("asked_at"), F.col("_u.content").alias("asked"))


def latest_step(messages: DataFrame, steps: DataFrame, step: str) -> DataFrame:
    """Each message with the data of its latest step of a kind, null if it has none; one row a message."""
    one = steps.where(F.col("step") == step).groupBy("message_id").agg(F.max_by("data", F.struct("created_at", "step_id")).alias("data"))
    return messages.join(one, "message_id", "left")


def recency(messages: DataFrame, lookback: int = LOOKBACK, hot: int = HOT) -> DataFrame:
    """(session_id, case_id, place, tier): cases in the order met going back over the latest messages; the first are hot."""
    back = Window.partitionBy("session_id").orderBy(F.desc("at"))
    m = messages.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= lookback)
    first = m.select("session_id", "_n", F.posexplode("cited").alias("_p", "case_id")).groupBy("session_id", "case_id").agg(F.min(F.struct("_n", "_p")).alias("_f"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("_f", "case_id"))
    return first.withColumn("place", place).select("session_id", "case_id", "place", F.when(F.col("place") <= hot, "hot").otherwise("cold").alias("tier"))


def history(messages: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last turns of each session, in order."""
    w = Window.partitionBy("session_id").orderBy(F.desc("at"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").orderBy("session_id", "at")


def snippet(c: Column) -> Column:
    return shorten(F.trim(c), SNIPPET, "…")


def session_summary(tiers: DataFrame, cases: DataFrame) -> DataFrame:
    """(session_id, summary): a line a case in order of recency, with its tier."""
    line = F.format_string("%d. %s (%s)", F.col("place"), F.coalesce("title", F.lit("Untitled")), F.col("tier"))
    each = tiers.join(cases, "case_id", "left").select("session_id", "place", line.alias("line"))
    return each.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def citations(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(answer_id, pos, marker, case_index, paragraph, reason) of each marker ``[^n]`` or ``[^n, ¶p]`` of the answers.

    ``cases``: answer_id, index, chunk_paragraphs. reason: unknown_case, unknown_paragraph, or null for a good marker; a
    paragraph is known by its label or by that without its last letter.
    """
    pattern = r"\[\^(\d+)(?:,\s*¶\s*([0-9]+(?:\.[0-9]+)*[A-Za-z]?))?\]"
    all_ = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
    m = answers.select("answer_id", F.posexplode(F.arrays_zip(all_(0).alias("marker"), all_(1).alias("n"), all_(2).alias("p"))).alias("pos", "m"))
    m = m.select("answer_id", "pos", "m.marker", F.col("m.n").try_cast("int").alias("case_index"), F.nullif(F.col("m.p"), F.lit("")).alias("paragraph"))
    c = cases.select("answer_id", F.col("index").alias("case_index"), "chunk_paragraphs")
    j = m.join(c, ["answer_id", "case_index"], "left")
    visible = F.array_contains("chunk_paragraphs", F.col("paragraph")) | F.array_contains("chunk_paragraphs", without_letter(F.col("paragraph")))
    reason = F.when(F.col("chunk_paragraphs").isNull(), "unknown_case").when(F.col("paragraph").isNotNull() & ~F.coalesce(visible, F.lit(False)), "unknown_paragraph")
    return j.select("answer_id", "pos", "marker", "case_index", "paragraph", reason.alias("reason"))


def checked_answers(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(answer_id, n_markers, n_mismatches, text): answers with a footer that names each bad marker once."""
    c = citations(answers, cases).groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_markers"), F.count("reason").alias("n_mismatches"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("pos", "marker")))).alias("_bad"))
    names = F.array_distinct(F.transform("_bad", lambda b: b["marker"]))
    footer = F.when(F.size("_bad") > 0, F.concat(F.lit("\n\n---\nUnverified citations:\n"), F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n)), "\n"))).otherwise("")
    j = answers.join(c, "answer_id", "left")
    return j.select("answer_id", F.coalesce("n_markers", F.lit(0)).alias("n_markers"), F.coalesce("n_mismatches", F.lit(0)).alias("n_mismatches"), F.concat("text", F.coalesce(footer, F.lit(""))).alias("text"))


def audit_steps(calls: DataFrame) -> DataFrame:
    """(message_id, step_order, step): a start, the tool calls in order, the generation."""
    n = F.row_number().over(Window.partitionBy("message_id").orderBy("call_order"))
    tools = calls.select("message_id", (n + 1).alias("step_order"), F.lit("tool_call").alias("step"))
    per = calls.groupBy("message_id").agg(F.count(F.lit(1)).alias("_c"))
    ends = per.select("message_id", F.inline(F.array(F.struct(F.lit(1).alias("step_order"), F.lit("agent_start").alias("step")), F.struct((F.col("_c") + 2).cast("int").alias("step_order"), F.lit("generate").alias("step")))))
    return tools.unionByName(ends)


def merged_filters(names: tuple[str, ...], tool: str = "tool", session: str = "session") -> Column:
    """Filters by name of two maps of texts: the session's win, even blank ones, and blank ones are dropped then."""
    one = [F.struct(F.lit(n).alias("k"), F.when(F.map_contains_key(session, n), F.col(session)[n]).otherwise(F.col(tool)[n]).alias("v")) for n in names]
    return F.map_from_entries(F.filter(F.array(*one), lambda x: F.coalesce(x["v"], F.lit("")) != ""))


def owned(rows: DataFrame, id_: Column, user: Column) -> DataFrame:
    """The row of an id if it is the user's."""
    return rows.where((F.col("id") == id_) & (F.col("user_id") == user))


def with_session(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with the title of their session; those without a session are left out."""
    return messages.join(sessions.select("session_id", F.col("title").alias("session_title")), "session_id")


def paragraph_labels(c: Column) -> Column:
    """Labels that aren't blank, trimmed; null for none at all."""
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def full_chunks_of_hot(tiers: DataFrame, chunks: DataFrame, most: int = 150) -> DataFrame:
    """(session_id, case_id, chunk_index, ...): all chunks of each session's hot cases, the first ``most`` of a case."""
    hot = tiers.where("tier = 'hot'").select("session_id", "case_id")
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("chunk_index"))
    return hot.join(chunks.withColumn("_n", n).where(F.col("_n") <= most).drop("_n"), "case_id")


def escaped(c: Column) -> Column:
    """Text as a pattern that matches just it."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")
