"""Chat formatting in windows of a token budget.

The turns of a conversation get the sum of the tokens before them. The sums are cut into cells of equal width, and the
turns that begin in a cell form a window; a turn longer than a cell is a window of its own. With half the budget left
after the system turn and the history as the width, a window keeps to the budget unless one turn alone exceeds it.
Each window repeats the system turn and the turns just before it, as far as ``HISTORY`` tokens reach, as context. Only
assistant turns that are new in a window are under its loss mask, so each is a target once.

A turn is written as ``<|role|>text</s>``. Control strings inside roles and texts are broken by a backslash after their
first character, and backslashes are doubled, so they read back as they were.

Defined results: null texts and roles are empty. Turns with equal numbers are ordered by role and text, null numbers
come first, and repeated turns stay. Null conversation ids are one conversation. An empty table gives no windows. Columns
besides conv_id, turn, role and text aren't read. A conversation of any length is summed by blocks of turn
numbers and windowed by cells, never gathered whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm import text as tx
from ledgerloom.workspace import staged

BUDGET = 512  # tokens of a window
HISTORY = 128  # of them, for repeated turns
MARKS = 4  # tokens for the marks of a turn
BLOCK = 256  # turn numbers whose tokens are summed together
END = "</s>"
# The control strings of this template and of others that a text may imitate.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their number in the conversation, their tokens and the tokens before them, written."""
    t = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / BLOCK).alias("block"))
    t = t.withColumn("tokens", tx.n_words(F.col("text")) + MARKS)
    earlier = Window.partitionBy("of").orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(F.col("conv_id").alias("of"), F.col("block").alias("of_block")).agg(
        F.sum("tokens").alias("tokens_in"), F.count("*").alias("turns_in"))
    blocks = blocks.select("of", "of_block", *[
        F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)).alias(f"{n}_before") for n in ("tokens", "turns")])
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("block").eqNullSafe(F.col("of_block")))
    return staged(joined.select(
        "conv_id", "role", "text", "tokens", (F.col("turns_before") + F.row_number().over(inside)).alias("number"),
        (F.col("tokens_before") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias("before")), "turns")


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, n_context, loss, n_tokens): the first ``n_context`` turns of ``text`` are repeated, and
    ``loss`` has the start and end of each new assistant text in it."""
    turns = numbered(conversations)
    system = turns.where("number = 1 AND role = 'system'").select(
        F.col("conv_id").alias("of"), F.col("text").alias("system_text"), F.col("tokens").alias("system_tokens"))
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    left = F.lit(budget - history) - F.coalesce(F.col("system_tokens"), F.lit(0))
    t = turns.join(system, same, "left").drop("of").withColumn("width", F.greatest(F.lit(1), F.floor(left / 2)))
    long = (F.col("tokens") > F.col("width")).cast("long")
    t = staged(t.withColumn("window", 2 * F.floor(F.col("before") / F.col("width")) + long), "windows")

    new = t.select("conv_id", "window", F.lit(2).alias("kind"), "number", "role", "text", "tokens")
    windows = t.groupBy("conv_id", "window").agg(
        F.min("before").alias("start"), F.min("number").alias("first"), F.sum("tokens").alias("new_tokens"),
        F.first("width").alias("width"), F.first("system_text").alias("system_text"),
        F.first("system_tokens").alias("system_tokens"))
    retained = windows.where("first > 1 AND system_text IS NOT NULL").select(
        "conv_id", "window", F.lit(0).alias("kind"), F.lit(1).cast("long").alias("number"), F.lit("system").alias("role"),
        F.col("system_text").alias("text"), F.col("system_tokens").alias("tokens"))
    # a turn before a window begins at most `history` tokens before it, so in one of two stretches of that length
    stretch = F.floor(F.col("start") / history)
    fits = windows.where(F.col("new_tokens") <= 2 * F.col("width")).select(
        F.col("conv_id").alias("of"), "window", "start", F.explode(F.array(stretch - 1, stretch)).alias("stretch"))
    past = t.where("NOT (number = 1 AND system_text IS NOT NULL)").select(
        "conv_id", "number", "role", "text", "tokens", "before", F.floor(F.col("before") / history).alias("of_stretch"))
    repeated = past.join(fits, same & (F.col("of_stretch") == F.col("stretch"))).where(
        (F.col("before") < F.col("start")) & (F.col("start") - F.col("before") <= history)
    ).select("conv_id", "window", F.lit(1).alias("kind"), "number", "role", "text", "tokens")

    pieces = new.unionAll(retained).unionAll(repeated)
    body, mark = escaped(F.col("text")), F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>"))
    pieces = pieces.select("conv_id", "window", "tokens", F.struct(
        "kind", "number", mark.alias("mark"), body.alias("body"), (F.col("role") == "assistant").alias("answers"),
    ).alias("piece"))
    w = pieces.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"), F.sum("tokens").alias("n_tokens"))
    w = tx.computed(
        w, text=F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"], F.lit(END))), ""),
        lengths=F.transform("pieces", lambda p: F.length(p["mark"]) + F.length(p["body"]) + len(END)))
    placed = F.transform("pieces", lambda p, i: F.struct(
        ((p["kind"] == 2) & p["answers"]).alias("target"),
        (F.aggregate(F.slice("lengths", 1, i), F.lit(0), lambda a, x: a + x) + F.length(p["mark"])).alias("start"),
        F.length(p["body"]).alias("size")))
    loss = F.transform(F.filter(placed, lambda x: x["target"]), lambda x: F.struct(
        x["start"].alias("start"), (x["start"] + x["size"]).alias("end")))
    n_context = F.size(F.filter("pieces", lambda p: p["kind"] < 2))
    return w.select("conv_id", "window", "text", n_context.alias("n_context"), loss.alias("loss"), "n_tokens")


def read_turns(windows: DataFrame) -> DataFrame:
    """(conv_id, window, place, role, text) of the turns that are new in a window."""
    parts = F.split("text", END)
    new = F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context"))
    t = windows.select("conv_id", "window", F.posexplode(new).alias("place", "part"))
    pattern = r"(?s)^<\|(.*?)\|>"
    return t.select("conv_id", "window", "place", unescaped(F.regexp_extract("part", pattern, 1)).alias("role"),
                    unescaped(F.regexp_replace("part", pattern, "")).alias("text"))


def read_targets(windows: DataFrame) -> DataFrame:
    """(conv_id, window, place, text) of the texts under the loss mask."""
    t = windows.select("conv_id", "window", "text", F.posexplode("loss").alias("place", "span"))
    found = F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    return t.select("conv_id", "window", "place", unescaped(found).alias("text"))


def joined(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """The texts of a conversation's rows in order, as one; for digests of whole conversations."""
    in_order = F.array_sort(F.collect_list(F.struct("window", "place", text.alias("text"))))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias(f"n_{name}"), F.array_join(F.transform(in_order, lambda x: x["text"]), "").alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    windows = staged(formatted(conversations.unionAll(extra)), "formatted")
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    turns = joined(read_turns(windows), line, "turns")
    targets = joined(read_targets(windows), F.col("text"), "targets").withColumnRenamed("conv_id", "of")
    sizes = windows.groupBy(F.col("conv_id").alias("sized")).agg(F.sum(F.length("text")).alias("formatted_chars"))
    found = turns.join(sizes, F.col("conv_id").eqNullSafe(F.col("sized"))).join(
        targets, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    answers = F.coalesce("targets", F.lit(""))
    return found.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length(answers).cast("long").alias("loss_chars"),
        F.sha2(answers, 256).alias("loss_sha256"), "formatted_chars")


def _escaped_sql(column: str) -> str:
    start = f"replace({column}, '\\', '\\\\')"
    return reduce(lambda t, c: f"replace({t}, '{c}', '{c[0]}\\{c[1:]}')", CONTROL, start)


SQL = rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
    SELECT *, {MARKS} + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
           length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + 8 AS chars,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS number FROM c),
s AS (
    SELECT *, CAST(sum(tokens) OVER turns - tokens AS BIGINT) AS before,
           first(CASE WHEN role = 'system' THEN tokens END) OVER turns AS system_tokens,
           first(CASE WHEN role = 'system' THEN chars END) OVER turns AS system_chars
    FROM t WINDOW turns AS (PARTITION BY conv_id ORDER BY number)),
w AS (
    SELECT *, greatest(1, ({BUDGET - HISTORY} - coalesce(system_tokens, 0)) // 2) AS width FROM s),
placed AS (SELECT *, 2 * (before // width) + CAST(tokens > width AS INT) AS win FROM w),
windows AS (
    SELECT conv_id, win, min(before) AS start, sum(tokens) AS new_tokens, min(number) AS first_number,
           first(width) AS width, first(system_chars) AS system_chars, sum(chars) AS chars
    FROM placed GROUP BY conv_id, win),
history AS (
    SELECT w.conv_id, w.win, sum(p.chars) AS chars
    FROM windows w JOIN placed p ON p.conv_id = w.conv_id AND p.before < w.start AND w.start - p.before <= {HISTORY}
    WHERE new_tokens <= 2 * w.width AND NOT (p.number = 1 AND p.role = 'system') GROUP BY ALL),
sizes AS (
    SELECT conv_id, CAST(sum(w.chars + coalesce(h.chars, 0)
                             + CASE WHEN first_number > 1 THEN coalesce(system_chars, 0) ELSE 0 END) AS BIGINT) AS n
    FROM windows w LEFT JOIN history h USING (conv_id, win) GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), '')) AS loss_sha256,
       any_value(n) AS formatted_chars
FROM placed JOIN sizes USING (conv_id) GROUP BY conv_id"""
